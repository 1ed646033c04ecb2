import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from findlake.llm import rangecoder as R
from findlake.llm import tokenfiles as TF
from findlake.llm.common import tidy
from findlake.llm.queries import op2_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello  world\nIt's\t'll\r\n<|endoftext|>x <|startoftext|>", "é ́a ÅΣΑΣ ΟΔΟΣ",
         " a b\x1cc\x85d　", "𝒳 ﬁ İ 12 34,5 !!!? '", "w " * 30_000 + "end", "x" * 9000, "don't 've'd"]


def brute(rows):
    """Rows by key, nulls first; equal keys in table order."""
    tok, out, start = Tokenizer.from_file(PATH), [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_match_whole_text_encoding(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)][::-1] + [(None, "no key")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, start int, ids string")
    assert sorted(map(tuple, TF.round_trip(df, PATH).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_repeated_keys_and_small_segments(spark, monkeypatch):
    rows = [(7, "same text here")] * 40 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, TF.round_trip(df, PATH).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_empty_table(spark):
    assert TF.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_tokenizers_encode_whole_texts():
    tokenize = TF.Tokenize(public_tokenizers.path("byte_bpe_50k.json"))
    assert not tokenize.by_piece and TF.Tokenize(PATH).by_piece
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(tokenize(["a  b"])[0], "<u2").tolist() == own.encode("a  b").ids + [1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 65_534)), min_size=1, max_size=300), min_size=1, max_size=6))
def test_blocks_round_trip(blocks):
    blocks = [np.array(b, np.uint16) for b in blocks]
    coded = R.encode(blocks)
    for a, b in zip(R.decode(coded, [len(b) for b in blocks]), blocks):
        assert a.tolist() == b.tolist()
    alone = R.encode(blocks[-1:])
    assert alone[0] == coded[-1]  # a block does not depend on its neighbours


def test_full_blocks_and_compression():
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 49_408, R.BLOCK).astype(np.uint16), np.zeros(R.BLOCK, np.uint16),
              np.tile(np.arange(64, dtype=np.uint16), R.BLOCK // 64), (rng.zipf(1.5, R.BLOCK) % 49_408).astype(np.uint16)]
    coded = R.encode(blocks)
    assert all((a == b).all() for a, b in zip(R.decode(coded, [R.BLOCK] * 4), blocks))
    bits = [len(p) * 8 / R.BLOCK for p, _ in coded]
    assert bits[1] < 0.2 and bits[2] < 1 and bits[3] < 8 and bits[0] < 19


def test_damage_is_found():
    block = (np.arange(2000) * 7919 % 49_408).astype(np.uint16)
    (payload, check), = R.encode([block])
    bad = bytearray(payload)
    bad[100] ^= 0x10
    with pytest.raises(R.CorruptBlock):
        R.decode([(bytes(bad), check)], [len(block)])


def test_query_matches_whole_text_encoding(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op2_token_files(spark, sf).collect())) == sorted(brute(rows))


def test_tidy_passes_batches_and_errors_through():
    assert list(tidy(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3]
    with pytest.raises(ZeroDivisionError):
        list(tidy(lambda batches: (1 // b for b in batches))([1, 0]))


def test_words_go_to_the_library_together():
    tokenize, handed = TF.Tokenize(PATH), []

    class Counting:
        def encode_batch_fast(self, texts, **how):
            handed.append(len(texts))
            return library.encode_batch_fast(texts, **how)

    library, tokenize.tokenizer = tokenize.tokenizer, Counting()
    words = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}ü"[:3 + i % 2] for i in range(1000)]
    text = ", ".join(words) + " " + " ".join(w.title() + "." for w in words)
    assert np.frombuffer(tokenize([text])[0], "<u2").tolist() == library.encode(text).ids + [1]
    assert sum(handed) < 100  # 1,000 words and more before


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aAbZsStTéÉßİΣσǰ\u030c'’.,-<|>019² \n\t\x0b\x1c\x1f\x7f\x85\u2028", max_size=40),
                          st.sampled_from(["<|EndOfText|>", "x<|endoftext|>,", "I'LL", "don't's", "J\u030c", "\u1e9e", "ⅷ", "한글", "ᄒ", "각"])),
                min_size=1, max_size=8))
def test_any_text_has_the_ids_of_the_whole_text(texts):
    own = Tokenizer.from_file(PATH)
    got = _shared().__call__([*texts, " ".join(texts), "".join(texts)])
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == \
        [own.encode(t, add_special_tokens=False).ids + [1] for t in [*texts, " ".join(texts), "".join(texts)]]


def _shared(kept=[]):
    if not kept:
        kept.append(TF.Tokenize(PATH))
    return kept[0]


def test_words_alone_where_ends_do_not_count_them(monkeypatch):
    tokenize = TF.Tokenize(PATH)
    monkeypatch.setattr(tokenize, "closes", np.ones(1 << 16, bool))
    assert np.frombuffer(tokenize(["unbelievably longish words"])[0], "<u2").tolist() == \
        Tokenizer.from_file(PATH).encode("unbelievably longish words").ids + [1]


def test_memory_of_coding_is_small():
    rng = np.random.default_rng(1)
    blocks = [(rng.zipf(1.3, R.BLOCK) % 49_408).astype(np.uint16) for _ in range(256)]
    tracemalloc.start()
    coded = R.encode(blocks)
    back = R.decode(coded, [R.BLOCK] * len(blocks))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(back, blocks))
    assert most / len(blocks) < 90_000  # 200,000 and more before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400), st.randoms(use_true_random=False))
def test_any_damage_is_a_corrupt_block(ids, rnd):
    block = np.array(ids, np.uint16)
    (payload, check), = R.encode([block])
    bad = bytearray(payload)
    for _ in range(3):
        bad[rnd.randrange(len(bad))] = rnd.randrange(256)
    try:
        ids, = R.decode([(bytes(bad), check)], [len(block)])
    except R.CorruptBlock:
        return
    assert (ids == block).all()


def test_blocks_of_many_lengths():
    rng = np.random.default_rng(2)
    blocks = [np.arange(R.BLOCK, dtype=np.uint16)[::-1]]
    blocks += [(rng.zipf(1.2, n) % 65_535).astype(np.uint16) for n in [1, 2, 15, 16, 17, 64, 513, 1024, 2049, 4095, 4096, 4096]]
    assert all((a == b).all() for a, b in zip(R.decode(R.encode(blocks), [len(b) for b in blocks]), blocks))


def test_a_word_is_kept_once_whatever_its_case_and_marks():
    tokenize = TF.Tokenize(PATH)
    words = [f"{a}{w}{b}" for w in ("word", "Word", "WORD", "größe") for a in ("", "(", "'") for b in (".", ",", "?!", "1", ";-", "...", "'")]
    text = " ".join(words)
    assert np.frombuffer(tokenize([text])[0], "<u2").tolist() == Tokenizer.from_file(PATH).encode(text).ids + [1]
    assert len(tokenize.known) < 20  # 94 before


def test_characters_between_letters_and_alone():
    own, tokenize = Tokenizer.from_file(PATH), TF.Tokenize(PATH)
    chars = [chr(c) for c in [*range(1, 0x1200), *range(0x2000, 0x2200), *range(0xAC00, 0xAC20), *range(0xFB00, 0xFB50), 0x10400, 0x1D4B3, 0x1F600]]
    texts = [f"a{c}b {c} 1{c}É, {c}. {c}{c}'s" for c in chars]
    expected = [e.ids + [1] for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u2").tolist() for g in tokenize(texts)] == expected
    assert "ü" in tokenize.steady and "Ü" in tokenize.letters - tokenize.steady and not {"́", "·", "İ"} & tokenize.letters
