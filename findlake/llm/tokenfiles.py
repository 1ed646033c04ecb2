"""Token ids of whole documents in range-coded files, and back.

Documents are range-partitioned and sorted by key, so the files hold them in
ascending order. A file's rows are segments: whole documents of together about
``SEGMENT`` ids, cut into independently coded blocks with a checksum each, plus
the documents' keys and lengths. A segment can be read alone.
"""

from __future__ import annotations

import functools
import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm import rangecoder
from findlake.llm.common import bounded_batches, shared_path, slices, tidy, utf8

END = 1
#: The split of _splits_at_spaces for lower-case ASCII without white space.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Kinds of bytes; those of characters beyond ASCII count as letters until one is found to be none.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_BYTE_KINDS = bytes(_LETTER if b > 127 or chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SPACE if chr(b) in " \t\n\v\f\r"
                    else _MARK if chr(b).isprintable() else _ODD for b in range(256))
#: Letters that may make a part of their own with an apostrophe before them.
_AFTER_APOSTROPHE = np.isin(np.arange(256), list(b"stvmlrdSTVMLRD"))
#: Ids in a segment, at least (a document stays in one segment).
SEGMENT = 1 << 18
#: Segments are coded together up to so many ids, so that many blocks run side by side.
GATHER = rangecoder.LANES * rangecoder.BLOCK
#: A task keeps the ids of about so many pieces of text, and as many that it has used before these.
CACHE = 150_000
#: The library takes so many pieces (or texts) at a time; what it returns for one is some hundred bytes and more.
AT_ONCE = 2048


class Tokenize:
    """Texts to ids below 65,535 with a file of the tokenizers library.

    Where the file's own steps drop white space and never join text across it,
    the ids of a text are those of its pieces between white space. A piece of
    letters, digits and marks is cut into its runs of letters, its digits and
    its runs of marks, as the file's own split does. Each distinct part or other
    piece is encoded once and kept. Other files encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.by_piece, self.lower_case, self.closes, self.added, words = _facts(path, os.stat(path).st_mtime_ns)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        if self.closes is not None:
            model = self.tokenizer.model
            self.ascii_words, self.words = _of_words(model, {}), _of_words(model, words)
            self.byte_chars = _byte_chars() if words["levels"] == 1 else None
        self.letters = set(string.ascii_letters)
        #: Letters that the file's steps leave as they are, also between others (Hangul, beyond these, is composed).
        self.steady = set(string.ascii_lowercase if self.lower_case else string.ascii_letters)
        #: By code point: 0 not met yet, 1 a letter to the file's steps, alone and between others, 2 none.
        self.met = np.zeros(0x110000, np.uint8)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), AT_ONCE):
            found = self.tokenizer.encode_batch_fast(texts[at:at + AT_ONCE], add_special_tokens=False)
            out += [np.array(e.ids, "<u2").tobytes() for e in found]
        return out

    def _words(self, words: list[bytes], library, byte_chars: str | None = None) -> list[bytes]:
        """The ids of each word of letters: of many at once, with a space between.

        A word has one id or more that ends a word. Where there are as many of
        these as words, each word has one, its last; else the words go alone.
        ``byte_chars``: the characters that stand for bytes, for a library without that step.
        """
        out = []
        for at in range(0, len(words), AT_ONCE):
            some = words[at:at + AT_ONCE]
            text = b" ".join(some)
            text = text.decode("latin-1").translate(byte_chars) if byte_chars else text.decode()
            found = library.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u2")
            ends = (2 * np.flatnonzero(self.closes.take(ids)) + 2).tolist()
            if len(ends) == len(some):
                data = ids.tobytes()
                out += [data[i:j] for i, j in zip([0, *ends], ends)]
            else:
                out += self._whole([w.decode() for w in some])
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Encode new parts and pieces: words of letters many at once, pieces of printable ASCII by the file's own split,
        and the rest as they are."""
        known, older, letters = self.known, self.older, self.letters
        if self.closes is None:
            known.update(zip(new, self._whole([p.decode() for p in new])))
            return
        plain, steady, words, parted, odd = {}, [], [], [], {}
        for p in new:
            if p.isalpha():  # of ASCII
                plain[p] = None
            elif not p.isascii():
                word = p.decode()
                if self.steady.issuperset(word):
                    steady.append(p)
                elif letters.issuperset(word):
                    words.append(p)
                else:
                    odd[p] = None
            elif not (self.lower_case and p.decode().isprintable()) or any(c in p.lower() for c in self.added):
                odd[p] = None
            else:
                parts = [x.encode() for x in _PARTS.findall(p.decode().lower())]
                if len(parts) == 1:
                    odd[p] = None
                    continue
                for x in parts:
                    if x not in known:
                        if x in older:
                            known[x] = older[x]
                        else:
                            (plain if x.isalpha() else odd)[x] = None
                parted.append((p, parts))
        known.update(zip(plain, self._words(list(plain), self.ascii_words)))
        known.update(zip(steady, self._words(steady, self.ascii_words, self.byte_chars)))
        known.update(zip(words, self._words(words, self.words)))
        known.update(zip(odd, self._whole([p.decode() for p in odd])))
        for p, parts in parted:
            known[p] = b"".join(map(known.__getitem__, parts))

    def _not_letters(self, text: np.ndarray) -> np.ndarray:
        """Where characters beyond ASCII start that are no letters to the file's steps."""
        starts = np.flatnonzero(text >= 0xC0)
        points = np.frombuffer(text[text >= 0x80].tobytes().decode().encode("utf-32-le"), "<u4")
        met = self.met.take(points)
        if not met.all():
            new = [chr(x) for x in np.unique(points[met == 0]).tolist()]
            for c, ids in zip(new, self._whole([f"a{c}a" for c in new])):
                # one word, so no split; a mark is no letter though it may become one with the letter before it
                ends = self.closes.take(np.frombuffer(ids, "<u2"))
                whole = c.isalpha() and np.count_nonzero(ends) == 1 and bool(ends[-1])
                self.met[ord(c)] = 1 if whole else 2
                if whole:
                    self.letters.add(c)
                    if self.byte_chars and c < "\u1100" and self.words.normalizer.normalize_str(c) == c:
                        self.steady.add(c)
            met = self.met.take(points)
        return starts[met == 2]

    def _parts(self, data: bytes) -> tuple[pa.BinaryArray, np.ndarray]:
        """Parts and whole pieces of ``data``, which ends with white space, and where each starts."""
        text, lower = np.frombuffer(data, np.uint8), data.lower()
        kinds = np.frombuffer(bytearray(data.translate(_BYTE_KINDS)), np.uint8)
        apostrophes = np.flatnonzero(text == ord("'"))
        kinds[apostrophes[_AFTER_APOSTROPHE.take(text[apostrophes + 1])]] = _ODD
        for added in self.added:
            if added in lower:
                kinds[[m.start() for m in re.finditer(re.escape(added), lower)]] = _ODD
        if self.closes is None:
            kinds[kinds != _SPACE] = _ODD
        elif not data.isascii():
            kinds[self._not_letters(text)] = _ODD
        out = np.frombuffer(lower if self.lower_case else data, np.uint8)
        odd = np.flatnonzero(kinds == _ODD)
        if len(odd):  # their pieces stay whole and as they are
            spaces = np.flatnonzero(kinds == _SPACE)
            after = np.unique(np.searchsorted(spaces, odd))
            steps = np.zeros(len(kinds) + 1, np.int8)
            steps[np.append(-1, spaces).take(after) + 1] = 1
            steps[spaces.take(after)] = -1
            inside = np.cumsum(steps[:-1], dtype=np.int8).view(bool)
            kinds[inside] = _ODD
            out = np.where(inside, text, out)
        first = kinds == _DIGIT
        first[0] = True
        first[1:] |= kinds[1:] != kinds[:-1]
        kept = kinds != _SPACE
        first &= kept
        until = np.append(np.flatnonzero(first[kept]), np.count_nonzero(kept)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(until) - 1, [None, pa.py_buffer(until), pa.py_buffer(out[kept])])
        return parts, np.flatnonzero(first)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 16-bit words, END appended."""
        end = np.array([END], "<u2").tobytes()
        if not self.by_piece or not texts:
            return [x + end for x in self._whole(texts)]
        data = [t.encode() for t in texts]
        parts, starts = self._parts(b"\n".join([*data, b""]))
        if not len(parts):
            return [end] * len(texts)
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
        coded = parts.dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), b" ")
        distinct = joined[0].as_py().split(b" ")  # to_pylist takes several times as long
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        own = list(map(known.get, distinct))
        missing = [i for i, x in enumerate(own) if x is None]
        known.update((p, older[p]) for p in map(distinct.__getitem__, missing) if p in older)
        self._learn([p for p in map(distinct.__getitem__, missing) if p not in known])
        for i in missing:
            own[i] = known[distinct[i]]
        # the ids of all parts, taken for each use of a part
        ids = pa.array(own, pa.large_binary()).take(coded.indices)
        until = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
        cuts = until.take(np.append(0, np.searchsorted(starts, ends))).tolist()
        ids = memoryview(ids.buffers()[2])
        return [b"".join((ids[i:j], end)) for i, j in zip(cuts, cuts[1:])]


@functools.lru_cache(4)
def _facts(path: str, changed: int) -> tuple:
    """What a file's steps are, small enough to stay with a worker: whether its pieces stand alone, whether it lowers case,
    the ids that end a word, added tokens in lower case, and the steps that words of letters take."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    by_piece = _splits_at_spaces(spec)
    words = {"normalizers": [s["type"] for s in _steps(spec) if s["type"] != "Replace"],
             "levels": len(spec["pre_tokenizer"]["pretokenizers"]) - 1} if by_piece else {}
    return (by_piece, by_piece and any(s["type"] == "Lowercase" for s in _steps(spec)), _closing(spec) if by_piece else None,
            [t["content"].encode().lower() for t in spec["added_tokens"]], words)


@functools.lru_cache(1)
def _byte_chars() -> str:
    """The library's character for each byte of characters below U+1100; the space stays, as it stands between words."""
    from tokenizers import pre_tokenizers

    level, chars = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), [chr(b) for b in range(256)]
    for first, end, step in ((33, 192, 1), (192, 0x800, 64), (0x800, 0x1100, 0x800)):
        for c in map(chr, range(first, end, step)):
            for byte, stands in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
                chars[byte] = stands
    return "".join(chars)


def _of_words(model, steps: dict):
    """The model with the steps that change words of letters between spaces; ASCII in its final case needs none."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    out = Tokenizer(model)
    if steps:
        out.normalizer = normalizers.Sequence([getattr(normalizers, name)() for name in steps["normalizers"]])
    levels = [pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False) for _ in range(steps.get("levels", 0))]
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), *levels])
    return out


def _steps(spec: dict) -> list[dict]:
    return (spec.get("normalizer") or {}).get("normalizers", [])


def _splits_at_spaces(spec: dict) -> bool:
    """Whether the tokenizer keeps nothing of white space and matches nothing across it."""
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = all(s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
                for s in _steps(spec))
    first = before[0] if before else {}
    words = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    return (known and first.get("type") == "Split" and first.get("pattern") == {"Regex": words}
            and first.get("behavior") == "Removed" and first.get("invert") is True
            and all(p["type"] == "ByteLevel" and not p["add_prefix_space"] for p in before[1:])
            and spec["model"]["type"] == "BPE" and not spec.get("post_processor")
            and not any(t["lstrip"] or t["rstrip"] or any(map(str.isspace, t["content"])) for t in spec["added_tokens"]))


def _closing(spec: dict) -> np.ndarray | None:
    """For each id whether it ends a word; None where ids do not show it or a word may hold an added token."""
    suffix = spec["model"].get("end_of_word_suffix")
    added = [t["content"] for t in spec["added_tokens"]]
    if not suffix or any(len(c) < 2 or c[:-1].isalpha() or not c.isascii() for c in added):
        return None
    closes = np.zeros(1 << 16, bool)
    closes[[i for piece, i in spec["model"]["vocab"].items() if piece.endswith(suffix)]] = True
    return closes


_SEGMENT_SCHEMA = ("part int, segment int, n_tokens long, keys array<{key}>, sizes array<long>, "
                   "block_bytes array<int>, block_checks array<long>, payload binary")


def _write_segments(path: str, kind):
    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        tokenize = Tokenize(path)  # goes with the task, with the pieces that it keeps

        def rows(segments):
            nonlocal number
            blocks = [[ids[i:i + rangecoder.BLOCK] for i in range(0, len(ids), rangecoder.BLOCK)] for _, _, ids in segments]
            coded = iter(rangecoder.encode([b for one in blocks for b in one]))
            out = []
            for (keys, sizes, ids), one in zip(segments, blocks):
                mine = [next(coded) for _ in one]
                out.append((part, number, len(ids), keys, sizes, [len(p) for p, _ in mine], [c for _, c in mine],
                            b"".join(p for p, _ in mine)))
                number += 1
            names = ["part", "segment", "n_tokens", "keys", "sizes", "block_bytes", "block_checks", "payload"]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int32()),
                     pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        segments, keys, parts, size, gathered = [], [], [], 0, 0

        def close():
            nonlocal keys, parts, size
            if keys:
                segments.append((keys, [len(p) // 2 for p in parts], np.frombuffer(b"".join(parts), "<u2")))
            keys, parts, size = [], [], 0

        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                texts = [t.decode("utf-8", "replace") for t in utf8(batch.column(1))]
                for key, ids in zip(batch.column(0).to_pylist(), tokenize(texts)):
                    keys.append(key)
                    parts.append(ids)
                    size += len(ids) // 2
                    if size >= SEGMENT:
                        gathered += size
                        close()
                        if gathered >= GATHER:
                            yield rows(segments)
                            segments.clear()
                            gathered = 0
        close()
        if segments:
            yield rows(segments)
    return run


def write_files(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write all documents' ids (null text: empty) to ``path``, keys ascending, nulls first; END follows each document.

    Files are Parquet containers of segment rows. ``tokenizer`` is a file of the tokenizers library that every worker can open.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = rows.repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("key", "text")
    segments = parts.mapInArrow(tidy(_write_segments(tokenizer, arrow)), _SEGMENT_SCHEMA.format(key=kind.simpleString()))
    segments.write.option("compression", "none").parquet(path)


def _read_segments(kind):
    def run(batches):
        for batch in batches:
            done, n = 0, batch.column(2).to_pylist()
            while done < batch.num_rows:
                end, ids = done + 1, n[done]
                while end < batch.num_rows and ids + n[end] <= GATHER:
                    ids += n[end]
                    end += 1
                yield from _decoded(batch.slice(done, end - done), kind)
                done = end
    return run


def _decoded(batch, kind):
    coded, sizes = [], []
    for payload, n_bytes, checks, left in zip(*(batch.column(i).to_pylist() for i in (7, 5, 6, 2))):
        at = 0
        for size, check in zip(n_bytes, checks):
            coded.append((payload[at:at + size], check))
            sizes.append(min(left, rangecoder.BLOCK))
            at, left = at + size, left - rangecoder.BLOCK
    blocks = iter(rangecoder.decode(coded, sizes))
    del coded
    for i, n_blocks in enumerate(pc.list_value_length(batch.column(5)).to_pylist()):
        ids = np.concatenate([next(blocks) for _ in range(n_blocks)]).astype("<u4")
        docs = batch.column(4)[i].values.to_numpy()
        n, ends = len(docs), np.cumsum(docs)
        upto = pa.py_buffer(np.append(0, 4 * ends).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(batch.column(0)[i], n), pa.repeat(batch.column(1)[i], n), batch.column(3)[i].values.cast(kind),
             pa.array(ends - docs, pa.int64()), pa.array(docs, pa.int64()),
             pa.Array.from_buffers(pa.binary(), n, [None, upto, pa.py_buffer(ids)])],
            ["part", "segment", "key", "at", "n_tokens", "ids"])


def read_files(spark, path: str, key: str = "doc_id", ids: Column | None = None) -> DataFrame:
    """One row per document of the files: key, start (ids of all documents before it), n_tokens (END included) and ids
    (little-endian 32-bit words). A block that does not match its checksum raises ``CorruptBlock``.

    ``ids``, an expression over the ids that takes their place, is evaluated where the ids are read: they do not move then.
    """
    segments = spark.read.parquet(path)
    kind = segments.schema["keys"].dataType.elementType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    docs = segments.mapInArrow(tidy(_read_segments(arrow)),
                               f"part int, segment int, key {kind}, at long, n_tokens long, ids binary")
    own = F.col("ids") if ids is None else ids
    docs = docs.select("part", "segment", "key", "at", "n_tokens", own)
    sizes = segments.select("part", "segment", "n_tokens")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    files = files.select(F.col("part").alias("fp"), F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("f0"))
    inside = sizes.select(F.col("part").alias("sp"), F.col("segment").alias("ss"),
                          F.coalesce(F.sum("n_tokens").over(before("part", "segment")), F.lit(0)).alias("s0"))
    offsets = inside.join(files, F.col("sp") == F.col("fp")).select("sp", "ss", (F.col("s0") + F.col("f0")).alias("base"))
    return docs.join(offsets, (F.col("part") == F.col("sp")) & (F.col("segment") == F.col("ss"))).select(
        F.col("key").alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", docs.columns[-1])


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document, from files just written: doc_id, start, n_tokens, ids_crc32 (unsigned)."""
    path = shared_path(docs.sparkSession, "token-files")
    write_files(docs, tokenizer, path)
    return read_files(docs.sparkSession, path, ids=F.crc32("ids").alias("ids_crc32"))
