"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, links confirmed on full shingle sets.

Two-word shingles of the lower-cased text are hashed to 64 bits; documents with the same set are one class from then on.
A class has a signature of CHUNKS x WIDTH values of BITS bits, where two values agree with the probability of the sets'
Jaccard similarity. A chunk's values lie side by side in one long, so signatures are compared by SQL. If two signatures
differ in at most 2 * CHUNKS - 1 values, then by pigeonhole some chunk has at most one that differs; a chunk's key with each
one of its values left out, WIDTH keys a chunk, therefore meets every such pair in some bucket. At a similarity of 0.8 a
chunk meets with probability 0.655, so all nine miss a pair with 7e-5.

Buckets are not expanded into pairs. Each member is paired with its bucket's leader, which links most of any large group.
Then, in buckets whose members are still of several components, those outside the largest are paired with one member of
it. Only in what is still apart after that are members outside the bucket's largest component paired with those of
other components: each pair in the first bucket that it shares, and where sizes, signatures and parities of the sets do
not rule a link out. A link inside a component changes nothing, so none is lost. Candidates that bitmaps of the sets do
not rule out either are confirmed on the full sets; the bounds by sizes, parities and bitmaps are exact.

Contract: one row per input row. Null, empty and blank texts have no shingles, link with nothing and are their own
component. A text of one word has that word as its only shingle. Repeated rows repeat, in one component. Where a
key repeats with several texts, each row has its text's component, and texts with the same least key are one. A null key
stays null with the component of its text (null if no other row has that text) and is not kept. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, in_arrow, materialize, slices, table, word_hashes

CHUNKS, WIDTH, BITS = 9, 6, 10
VALUES = CHUNKS * WIDTH
#: Signatures of links at 0.8 differ in more values than this with probability 1e-6.
MOST_DIFFERENT = 26
#: Of each value of a chunk, all bits but the highest, and the highest.
LOW = sum(((1 << (BITS - 1)) - 1) << (BITS * k) for k in range(WIDTH))
HIGH = sum(1 << (BITS * k + BITS - 1) for k in range(WIDTH))
#: Bits of a set's parities.
PARITIES = 512
#: Words of 64 bits of the filter of keys, which bounds its broadcast: 2^19 rows of two longs.
FILTER_WORDS = 1 << 19
SCRAMBLE = 0x2545F4914F6CDD1D
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int = 2):
    """For each text, its sorted distinct shingles, hashed."""
    offsets, h = word_hashes(texts)
    for a, b in zip(offsets, offsets[1:]):
        n = min(size, int(b - a))
        out = h[a : b - max(0, n - 1)].copy()
        for k in range(1, n):
            out = _mix(out * _M1 + h[a + k : b - n + 1 + k])
        yield np.unique(out)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_24)
    return rng.integers(1, 2**63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, VALUES, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """CHUNKS longs: BITS bits of the least of each permutation, WIDTH side by side."""
    least = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * a + b
        part ^= part >> np.uint64(32)
        least = np.minimum(least, part.min(axis=0))
    values = (_mix(least) & np.uint64((1 << BITS) - 1)).reshape(CHUNKS, WIDTH)
    return (values << np.arange(0, BITS * WIDTH, BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


WORDS = [*(f"c{k}" for k in range(CHUNKS)), *(f"o{k}" for k in range(PARITIES // 64))]


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """key, n, class (a digest of the set), c0 .. c8 (the signature), o0 .. o7 (the parities) for each row."""

    def run(batches):
        (a, b), none = _coefficients(), np.zeros(len(WORDS), np.int64)
        for batch in slices(batches):
            n, classes, words = [], [], []
            for s in shingle_sets(column(batch, "text"), size):
                n.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                words.append(np.concatenate([signature(s, a, b), parities(s).view(np.int64)]) if len(s) else none)
            words = np.array(words, np.int64).reshape(-1, len(WORDS))
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), *(pa.array(words[:, k]) for k in range(len(WORDS)))], ["key", "n", "class", *WORDS])

    return in_arrow(docs, run, "key long, n long, class binary, " + ", ".join(f"{c} long" for c in WORDS))


def _buckets(classes: DataFrame) -> DataFrame:
    """v, key, rep: VALUES rows for each class, one for each chunk with one of its values (v of all) left out."""
    keys = [F.expr(f"xxhash64({v}, c{v // WIDTH} & {~(((1 << BITS) - 1) << (BITS * (v % WIDTH)))}L)") for v in range(VALUES)]
    return classes.select(F.posexplode(F.array(*keys)).alias("v", "key"), "rep")


def _apart(k: int) -> str:
    """SQL: how many values of chunk k of x and y differ."""
    z = f"(x.c{k} ^ y.c{k})"
    return f"bit_count(((({z} & {LOW}L) + {LOW}L) | {z}) & {HIGH}L)"


def _can_link(percent: int) -> str:
    """SQL: sizes, signatures and parities of x and y allow a link.

    Sizes and parities are exact: sets differ in at least as many shingles as parities. Signatures are not, with 1e-6.
    """
    odd = " + ".join(f"bit_count(x.o{k} ^ y.o{k})" for k in range(PARITIES // 64))
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {' + '.join(map(_apart, range(CHUNKS)))} <= {MOST_DIFFERENT} and {100 + percent} * ({odd}) <= {100 - percent} * (x.n + y.n)"


def _first_bucket() -> str:
    """SQL: of all buckets that x and y share, this one (x.v) is the first."""
    first = " ".join(f"when {_apart(k)} = 0 then x.v = {WIDTH * k} when {_apart(k)} = 1 then x.v div {WIDTH} = {k}" for k in range(CHUNKS))
    return f"case {first} else false end"


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can link."""
    x, y = (classes.select(F.col("rep").alias(c), "n", *WORDS).alias(t) for c, t in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where(_can_link(percent)).select("a", "b")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit a shingle, packed; 8 to 16 times as many bits as shingles, a power of two."""
    m = 1 << max(6, (8 * len(shingles) - 1).bit_length())
    bits = np.zeros(m, np.uint8)
    bits[shingles >> np.uint64(64 - (m.bit_length() - 1))] = 1
    return np.packbits(bits)


def can_link(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m shingles can link by their bitmaps. A shingle whose bit the other lacks is not shared, so no link is lost."""
    while len(x) != len(y):  # the longer at half its length: neighbouring bits share one
        if len(x) < len(y):
            x, y, n, m = y, x, m, n
        pairs = np.unpackbits(x).reshape(-1, 2)
        x = np.packbits(pairs[:, 0] | pairs[:, 1])
    both = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return 100 * both >= percent * (n + m - both)


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose key is in ids (rep), and some others: a filter of FILTER_WORDS words, so that no text is shuffled to find out.

    The filter has a bit for each of 64 * FILTER_WORDS hashes. It lets all of ids through at any size, and more others the
    more ids there are (a fourteenth at 2.5 million).
    """

    place = f"pmod(xxhash64({{}}), {64 * FILTER_WORDS}L)"
    bit = f"shiftleft(1L, cast(pmod({place}, 64) as int))"
    words = ids.groupBy(F.expr(f"shiftright({place.format('rep')}, 6)").alias("word")).agg(F.bit_or(F.expr(bit.format("rep"))).alias("bits"))
    fits = f"word = shiftright({place.format('key')}, 6) and (bits & {bit.format('key')}) <> 0"
    return docs.join(F.broadcast(words), F.expr(fits), "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs with 100 * |intersection| >= percent * |union|. Only the texts of documents in pairs are read out."""

    def sets(batches):
        for batch in slices(batches):
            s = list(shingle_sets(column(batch, "text"), size))
            cols = [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in s], pa.binary()), pa.array([len(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary()), pa.array([bitmap(x).tobytes() for x in s], pa.binary())]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), *cols], ["rep", "class", "n", "set", "bits"])

    def bounded(batches):
        for batch in batches:
            cols = (column(batch, c).to_pylist() for c in ("ba", "bb", "na", "nb"))
            keep = pa.array([can_link(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), n, m, percent) for x, y, n, m in zip(*cols)], pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(keep), column(batch, "b").filter(keep)], ["a", "b"])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "sa").to_pylist(), column(batch, "sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(keep), column(batch, "b").filter(keep)], ["a", "b"])

    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "ids", narrow=True)
    own = in_arrow(_among(docs, ids), sets, "rep long, class binary, n long, set binary, bits binary")
    # Of rows that repeat a key, those with a text that the key represents count, once for each such text.
    wanted = classes.select("rep", "class").join(ids, "rep", "left_semi")
    own = materialize(own.join(wanted, ["rep", "class"], "left_semi").dropDuplicates(["rep", "class"]).select("rep", "n", "set", "bits"), "sets")
    a, b = (own.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}")) for c in "ab")
    bits = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    pairs = materialize(in_arrow(bits.select("a", "b", "ba", "bb", "na", "nb"), bounded, "a long, b long"), "bounded", narrow=True)
    a, b = (own.select(F.col("rep").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
    return in_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles of each of PARITIES classes is odd, packed.

    A shingle that only one of two sets has changes one parity, so sets differ in at least as many shingles as parities.
    """
    return np.packbits((np.bincount((shingles & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8))


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id that can be reached) of all ids in links (a, b).

    In each round a node takes the least label among its own, its neighbours' and its label's, so labels travel twice as far
    from round to round.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v"), "edges", narrow=True)
    labels = materialize(edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("label")), "labels", narrow=True)
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        over = labels.select(F.col("u").alias("label"), F.col("label").alias("over"))
        after = labels.join(near, "u").join(over, "label").select("u", F.least("label", "near", "over").alias("label"), F.col("label").alias("old"))
        labels = materialize(after, "labels", narrow=True)
        if labels.where("label <> old").limit(1).count() == 0:
            return labels.select(F.col("u").alias("id"), F.col("label").alias("component"))
        labels = labels.drop("old")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 2, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id, kept; docs link with 100 * |intersection| >= percent * |union| of shingle sets."""
    docs = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    rows = materialize(_sketches(docs, size), "sketches")
    same = [F.first(c).alias(c) for c in ("n", *WORDS)]
    classes = materialize(rows.where("n > 0 and key is not null").groupBy("class").agg(F.min("key").alias("rep"), *same), "classes")
    buckets = _buckets(classes)
    # Leaders are the least by a scrambled order, so that they are not just the oldest documents.
    order = F.col("rep").bitwiseXOR(F.lit(SCRAMBLE))
    leaders = buckets.groupBy("key").agg(F.min(order).alias("leader"), F.max(order).alias("last")).where("leader <> last")
    leaders = leaders.select("key", F.col("leader").bitwiseXOR(F.lit(SCRAMBLE)).alias("leader"))
    members = materialize(buckets.join(leaders, "key"), "buckets")

    def linked(found: DataFrame, pairs: DataFrame) -> DataFrame:
        """found (rep, component) with components joined by the links among pairs (a, b); components stand for their members, so the edges are few."""
        links = materialize(_confirmed(pairs, docs, classes, size, percent), "links", narrow=True)
        of = [found.select(F.col("rep").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
        joint = links.join(of[0], "a").join(of[1], "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        least = components(joint).select(F.col("id").alias("component"), F.col("component").alias("least"))
        return materialize(found.join(least, "component", "left").select("rep", F.coalesce("least", "component").alias("component")), "found", narrow=True)

    def near(pairs: DataFrame) -> DataFrame:
        return materialize(_near(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, percent), "near", narrow=True)

    def still_apart(found: DataFrame) -> DataFrame:
        """v, key, rep, component, main, one: members of buckets of several components, with the largest, and one member of that."""
        placed = members.select("v", "key", "rep").join(found, "rep")
        other = F.xxhash64("rep", F.lit(SCRAMBLE))
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("m"), F.min(F.struct(other, "rep"))["rep"].alias("one"))
        mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "component", "one")).alias("most")).where("parts > 1")
        return placed.join(mixed.select("key", F.col("most.component").alias("main"), F.col("most.one").alias("one")), "key")

    # A key that represents several texts, since it repeats, is one node: a link of any of them is its link.
    found = classes.select("rep", F.col("rep").alias("component")).distinct()
    found = linked(found, near(members.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))))
    found = linked(found, near(still_apart(found).where("component <> main").select(F.col("rep").alias("a"), F.col("one").alias("b"))))

    # Of the texts that a key represents, the one that is in the bucket.
    own = F.expr(f"key = xxhash64(v, element_at(array({', '.join(WORDS[:CHUNKS])}), int(v div {WIDTH}) + 1) & ~shiftleft({(1 << BITS) - 1}L, {BITS} * (v % {WIDTH})))")
    split = materialize(still_apart(found).join(classes.select("rep", "n", *WORDS), "rep").where(own), "mixed")
    # Columns that cannot be null keep the join's code small enough to be compiled.
    split = split.select(*[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in split.drop("one").dtypes])
    x, y = split.where("component <> main").alias("x"), split.alias("y")
    # Both from outside the main component: once is enough.
    pair = "x.key = y.key and x.component <> y.component and (y.component = y.main or x.rep < y.rep)"
    pairs = x.join(y, F.expr(f"{pair} and {_can_link(percent)} and {_first_bucket()}")).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    found = linked(found, materialize(pairs, "pairs"))

    of_class = classes.select("class", "rep").join(found, "rep").select("class", "component")
    out = rows.select("key", "n", "class").join(of_class, "class", "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of texts: the one of least key, null last. Rows without words stay.

    Where keys are null or repeat, rows have a number of their own instead, so that a key neither drops a row nor stands for others.
    """
    n, distinct = docs.agg(F.count("*"), F.count_distinct(key)).first()
    if n == distinct:
        kept = near_duplicates(docs, text, key, size, percent).where("kept").select(key)
        return docs.join(kept, key, "left_semi").select(docs.columns)
    own = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(own, text, "_row", size, percent).select("_row", "component_id").join(own.select("_row", F.col(key).alias("_key")), "_row")
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("_key").isNull(), F.col("_key"), F.col("_row")))["_row"].alias("_row"))
    return own.join(kept, "_row", "left_semi").select(docs.columns)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM w),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (first(a.n) + first(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, sets.doc_id = component_id AS kept FROM sets JOIN c USING (doc_id)
"""
QUERIES = {"op2_near_duplicates": op2_near_duplicates}
ORACLES = {"op2_near_duplicates": ORACLE}
