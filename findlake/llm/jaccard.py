"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct 5-word shingles (64-bit hashes); two
link when their Jaccard similarity is 0.8 or more. The global shingle order is
cut into ``FRAGMENTS`` hash ranges. Fragment by fragment:

1. Equal sets form a class; from here on a class is one member.
2. A shingle that no other class has counts against its class: a linked class
   lacks at most a fifth of its shingles in its partner, so a class with more
   has no link and leaves. Fragment 0 of all documents is counted first, the
   other fragments of the classes that are left.
3. The classes that stay order their shingles by fragment and, in fragment 0,
   from rare to common. Linked classes share one of the first fifth (plus one).
4. Classes with such a shingle in common are compared with one of its classes,
   another one for each shingle, not with each other; pairs of classes that
   already are in one component need no comparison, and whatever is still apart
   is compared exhaustively, where sizes and lonely shingles allow a link. No
   possible link is dropped.
5. A comparison counts the overlap of each fragment separately and sums the
   partial counts per pair.

Components of the links come from minimum labels with pointer jumping.
Hash collisions aside (64 bits), the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.common import bounded_batches, member_filter, slices, split_by_filter, stored, tidy, utf8

N = 5
FRAGMENTS = 4
#: Rounds in which each still divided shingle compares its classes with one of them.
HUB_ROUNDS = 2
#: Bytes of text that a task cuts into shingles at a time; it takes about 40 times as much memory.
SLICE = 1 << 18

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, hashes): the sorted distinct shingle hashes of text i are ``hashes[cuts[i]:cuts[i + 1]]``.

    Words are runs without white space, A-Z in lower case. A text of 1 to 4
    words is one shingle; one without words has none.
    """
    n = len(texts)
    data = np.frombuffer(b" ".join([*texts, b""]).translate(_FOLD), np.uint8)
    if not len(data):
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint64)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.append(True, space[1:] != space[:-1]))
    size = np.diff(np.append(edge, len(data)))
    at = np.arange(len(data)) - np.repeat(edge, size)
    powers = np.cumprod(np.full(int(size.max()), _A))
    words = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[at], edge)
    real = ~space[edge]
    start, words = edge[real], _mix(words[real])
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    bounds = np.searchsorted(start, first)  # words of each text
    count = np.diff(bounds)
    # Windows of N words that stay in their text, and the whole of shorter texts.
    text_of = np.repeat(np.arange(n), count)
    own = np.full(len(words), N)
    short = (count > 0) & (count < N)
    begins = np.arange(len(words)) + N <= np.repeat(bounds[1:], count)
    begins[bounds[:-1][short]] = True
    own[bounds[:-1][short]] = count[short]
    i = np.flatnonzero(begins)
    h = own[i].astype(np.uint64) * _B
    padded = np.append(words, np.zeros(N, np.uint64))
    for k in range(N):
        h = np.where(own[i] > k, (h ^ padded[i + k]) * _A + (h >> np.uint64(27)), h)
    h, of = _mix(h), text_of[i]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return np.searchsorted(of, np.arange(n + 1)), h


def _signatures(cuts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit sum over each set, which does not depend on order."""
    total = np.append(np.uint64(0), np.cumsum(_mix(h ^ _A)))
    return _mix(total[cuts[1:]] - total[cuts[:-1]]).view(np.int64)


def _lists(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Arrow lists values[lo[i]:hi[i]]."""
    size = hi - lo
    at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)),
                                    pa.array(values[at].view(np.int64)))


def _first_pass(batches):
    """(id, key, n, sig, f0): size, signature and fragment 0 of each set."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            cuts, h = shingle_sets(utf8(batch.column(2)))
            n = np.diff(cuts)
            # Sorted by text, then hash, so fragment 0 is the start of each set.
            upto = np.append(0, np.cumsum(h >> np.uint64(62) == 0))
            f0 = _lists(h, cuts[:-1], cuts[:-1] + upto[cuts[1:]] - upto[cuts[:-1]])
            sig = pa.array(_signatures(cuts, h), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), sig, f0],
                                             ["id", "key", "n", "sig", "f0"])


def _full_sets(batches):
    """(sig, n, f0 .. f3): whole sets, once per slice."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            cuts, h = shingle_sets(utf8(batch.column(0)))
            sig = _signatures(cuts, h)
            _, keep = np.unique(sig, return_index=True)
            keep = keep[np.diff(cuts)[keep] > 0]
            if not len(keep):
                continue
            lo, hi, frag = cuts[:-1][keep], cuts[1:][keep], (h >> np.uint64(62)).astype(np.int64)
            out = [pa.array(sig[keep]), pa.array(hi - lo)]
            for f in range(FRAGMENTS):
                below, upto = (np.append(0, np.cumsum(frag < x)) for x in (f, f + 1))
                out.append(_lists(h, lo + below[hi] - below[lo], lo + upto[hi] - upto[lo]))
            yield pa.RecordBatch.from_arrays(out, ["sig", "n", *[f"f{f}" for f in range(FRAGMENTS)]])


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, na, b, nb) that link: the overlap is counted in each fragment separately, and the partial counts
    are summed per pair."""
    names = [f"f{f}" for f in range(FRAGMENTS)]
    left = full.select(F.col("sig").alias("a"), *[F.col(x).alias(f"a_{x}") for x in names])
    right = full.select(F.col("sig").alias("b"), *[F.col(x).alias(f"b_{x}") for x in names])
    both = pairs.join(left, "a").join(right, "b").select(
        "a", "b", "na", "nb", *[F.size(F.array_intersect(f"a_{x}", f"b_{x}")).alias(x) for x in names])
    return both.where(180 * sum((F.col(x) for x in names), F.lit(0)) >= 80 * (F.col("na") + F.col("nb"))).select("a", "b")


def _alone(members: DataFrame, grams: str) -> DataFrame:
    """(sig, alone): shingles of list column ``grams`` that no other class has."""
    owners = members.select("sig", F.explode(grams).alias("g")).groupBy("g").agg(
        F.min("sig").alias("lo"), F.max("sig").alias("hi"))
    return owners.where("lo = hi").groupBy(F.col("lo").alias("sig")).agg(F.count("*").alias("alone"))


def _apart(at: DataFrame, full: DataFrame) -> DataFrame:
    """Rows (g, sig, n, m, after, comp): the order and prefixes of step 3 anew, for classes that may link to another
    component.

    Only the classes of ``at`` can. Among them a shingle that just one component
    has is lonely for all its classes, and as they are few, whole sets are
    ordered, not fragment 0 first.
    """
    members = stored(at.select("sig", "n", "comp").distinct(), "divided-classes")
    grams = stored(full.join(members, "sig").select(
        "sig", "comp", F.explode(F.concat(*[f"f{f}" for f in range(FRAGMENTS)])).alias("g")), "divided-shingles")
    owners = grams.groupBy("g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("df"))
    own = Window.partitionBy("sig")
    shared = (grams.join(owners.where("c0 != c1").select("g", "df"), "g")
              .withColumn("m", F.count("*").over(own))
              .withColumn("place", F.row_number().over(own.orderBy("df", "g"))))
    first = shared.join(members.select("sig", "n"), "sig").withColumn("after", F.col("m") - F.col("place") + 1)
    return stored(first.where("n - after <= floor(n / 5)").select("g", "sig", "n", "m", "after", "comp"), "apart")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(v, label): the least vertex of each vertex's component. ``edges``: (a, b) in any order.

    Every round takes the least label among neighbours and then jumps to the
    label's label, so long chains shrink in logarithmically many rounds.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")), name)
    while True:
        at = labels.select(F.col("v").alias("b"), F.col("label").alias("near"))
        near = both.join(at, "b").groupBy(F.col("a").alias("v")).agg(F.min("near").alias("near"))
        new = labels.join(near, "v", "left").select("v", F.col("label").alias("old"),
                                                    F.least("label", "near").alias("label"))
        jump = new.select(F.col("v").alias("label"), F.col("label").alias("next"))
        new = stored(new.join(jump, "label", "left").select("v", "old", F.least("label", "next").alias("label")), name)
        moved = new.where("label != old").limit(1).count()
        labels = new.select("v", "label")
        if not moved:
            return labels


def _class_components(sets: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(sig, comp) of the classes that have a link to another class."""
    real = sets.where("n > 0")
    classes = real.groupBy("sig").agg(F.max("n").alias("n"), F.min("key").alias("rep"))
    near = stored(classes.join(_alone(real, "f0"), "sig", "left").where("5 * coalesce(alone, 0) <= n")
                  .select("sig", "n", "rep", F.lit(0).cast("long").alias("rest")), "near-classes")
    # Whole sets of the classes that stay: only their representatives' texts are cut into shingles again.
    reps, _ = split_by_filter(docs.select(F.col(text).alias("text"), "_j_key"), F.col("_j_key"),
                              member_filter(near, "rep"))
    kinds = ", ".join(f"f{f} array<long>" for f in range(FRAGMENTS))
    full = stored(reps.select("text").mapInArrow(tidy(_full_sets), f"sig long, n long, {kinds}"), "near-sets")
    # The other fragments: a class leaves once its lonely shingles in all fragments so far are too many. A filter
    # chooses the sets that still count; a class that it lets through by mistake only makes shingles less lonely.
    for f in range(1, FRAGMENTS):
        members, _ = split_by_filter(full.select("sig", f"f{f}"), F.col("sig"), member_filter(near, "sig"))
        near = stored(near.join(_alone(members, f"f{f}"), "sig", "left")
                      .withColumn("rest", F.col("rest") + F.coalesce("alone", F.lit(0))).where("5 * rest <= n")
                      .select("sig", "n", "rep", "rest"), "near-classes")
    full = stored(full.join(near.select("sig", "rest"), "sig").dropDuplicates(["sig"]), "near-sets")

    # A class's order: lonely shingles of fragment 0, its other shingles from rare to common, then the other fragments.
    # Linked classes share one of the first n / 5 + 1; lonely shingles of other fragments lessen that, where fragment 0
    # is long enough.
    grams = full.select("sig", F.explode("f0").alias("g"))
    owners = stored(grams.groupBy("g").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count("*").alias("df")),
                    "shingle-owners")
    alone = owners.where("lo = hi").groupBy(F.col("lo").alias("sig")).agg(F.count("*").alias("alone"))
    full_size = F.floor(F.col("n") / 5) + 1
    take = F.when(F.size("f0") >= full_size - F.col("rest"), full_size - F.col("rest")).otherwise(full_size)
    sized = full.withColumn("take", take.cast("int"))
    more = F.slice(F.flatten(F.array(*[f"f{f}" for f in range(1, FRAGMENTS)])), F.lit(1),
                   F.greatest(F.lit(0), F.col("take") - F.size("f0")))
    inside = sized.select("sig", "n", "rest", "take", F.explode("f0").alias("g")).join(
        owners.where("lo != hi").select("g", "df"), "g").select("sig", "n", "rest", "take", "g", F.lit(0).alias("frag"), "df")
    beyond = sized.select("sig", "n", "rest", "take", F.explode(more).alias("g")).select(
        "sig", "n", "rest", "take", "g", F.lit(1).alias("frag"), F.lit(0).cast("long").alias("df"))
    unsigned = F.col("g").bitwiseXOR(F.lit(-(1 << 63)))
    place = F.row_number().over(Window.partitionBy("sig").orderBy("frag", "df", unsigned))
    prefix = (inside.unionByName(beyond).withColumn("place", place).join(alone, "sig", "left")
              .withColumn("pos", F.col("place") - 1 + F.coalesce("alone", F.lit(0))).where("pos < take")
              .select("g", "sig", "n", (F.col("n") - F.col("rest") - F.coalesce("alone", F.lit(0))).alias("m"),
                      (F.col("n") - F.col("pos") - F.when(F.col("frag") == 0, F.col("rest")).otherwise(0)).alias("after")))
    prefix = stored(prefix, "prefixes")

    comp = None
    for turn in range(HUB_ROUNDS + 1):
        at = prefix.withColumn("comp", F.col("sig")) if comp is None else (
            prefix.join(comp.withColumnRenamed("v", "sig").withColumnRenamed("label", "comp"), "sig", "left")
            .withColumn("comp", F.coalesce("comp", "sig")))
        at = stored(at, "prefix-components")
        divided = (at.groupBy("g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"),
                                       F.min_by(F.struct("sig", "n", "m", "after", "comp"), F.xxhash64("sig", "g", F.lit(turn))).alias("hub"))
                   .where("c0 != c1"))
        # m shingles of a class are not lonely, so an overlap has min(ma, mb) at most.
        fits = ((F.col("l.comp") != F.col("r.comp")) & (5 * F.col("l.n") >= 4 * F.col("r.n"))
                & (5 * F.col("r.n") >= 4 * F.col("l.n"))
                & (9 * F.least("l.m", "r.m") >= 4 * (F.col("l.n") + F.col("r.n"))))
        if turn < HUB_ROUNDS:
            other = divided.select("g", "hub.*")
        else:
            at = other = _apart(at.join(divided.select("g"), "g", "left_semi"), full)
            # Links share shingles of which one is the first in the order: at most what each class has from there on.
            fits = (fits & (F.col("l.sig") < F.col("r.sig"))
                    & (9 * F.least("l.after", "r.after") >= 4 * (F.col("l.n") + F.col("r.n"))))
        pairs = at.alias("l").join(other.alias("r"), (F.col("l.g") == F.col("r.g")) & fits)
        first = F.col("l.sig") < F.col("r.sig")
        pairs = pairs.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (
            ("l.sig", "r.sig", "a"), ("l.n", "r.n", "na"), ("r.sig", "l.sig", "b"), ("r.n", "l.n", "nb"))]).distinct()
        links = stored(_verified(pairs, full), "links")
        if comp is not None:
            links = links.unionByName(comp.where("v != label").select(F.col("v").alias("a"), F.col("label").alias("b")))
        comp = components(links)
    return comp.select(F.col("v").alias("sig"), F.col("label").alias("comp"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, key, n, sig, component) of each row; n 0 has no sig."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    keyed = docs.select(F.col(key).alias("id"), F.col(text).alias("text"),
                        F.xxhash64(F.col(key), F.col(text)).alias("_j_key"))
    sets = stored(keyed.select("id", F.col("_j_key").alias("key"), "text").mapInArrow(
        tidy(_first_pass), f"id {kind}, key long, n long, sig long, f0 array<long>"), "shingles")
    comp = _class_components(sets, keyed, "text")
    narrow = sets.select("id", "key", "n", "sig")
    return stored(narrow.join(comp, "sig", "left").select(
        "id", "key", "n", "sig", F.coalesce("comp", "sig").alias("comp")), "set-components")


def linked_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id.

    ``component_id`` is the least key reachable by links, the document's own
    included. Null and empty texts have no shingles and stand alone; null keys
    are passed over unless a component has no other; repeated rows stay rows.
    """
    rows = _rows(docs, key, text)
    least = rows.where("n > 0").groupBy(F.col("comp").alias("of")).agg(F.min("id").alias("least"))
    return rows.join(least, F.col("comp") == F.col("of"), "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the least doc_id, with the columns of ``docs``, whatever their names.

    Rows are dropped by an exact join that only rows which may be dropped, by a
    filter of fixed size, take part in; the others are not shuffled. (With far
    more copies than the filter has bits, most rows pass it and are shuffled.)
    Documents without words all stay.
    """
    rows = _rows(docs, "doc_id", "text").where("n > 0")
    best = rows.groupBy("comp").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"), F.count("*").alias("rows"))
    best = best.where("rows > 1").select(F.col("comp").alias("of"), F.col("best.key").alias("keep"))
    several = stored(rows.join(best, F.col("comp") == F.col("of")).select("key", (F.col("key") != F.col("keep")).alias("drop"))
                     .distinct(), "copies")
    whole = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    maybe, sure = split_by_filter(whole, F.col("key"), member_filter(several, "key"))
    maybe = maybe.select("key", "doc")
    kept = maybe.join(several.where("drop").select("key"), "key", "left_anti")
    repeated = several.where("not drop").select("key")
    once = kept.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    rest = kept.join(repeated, "key", "left_anti")
    return sure.unionByName(once).unionByName(rest).select("doc.*")
