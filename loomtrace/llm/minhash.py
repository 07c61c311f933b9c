"""Near duplicates by MinHash with sequential Bayesian verification.

1. One pass gives each document its set size, a 128-bit hash of the set, 160 MinHash values and 40
   band keys of 4 values. Documents of one set hash are one class, a node with the text of its smallest doc_id.
2. Classes that share a band key meet. First each meets one other only: the class that is the smallest
   of most of its buckets (a group of thousands gives thousands of pairs). The pairs' signatures are compared 32
   values at a time; with m of n equal, similarity has a Beta posterior under a uniform prior, and a
   pair whose posterior of reaching the threshold falls below `MISS` is dropped. Survivors are
   verified on their full shingle sets, and linked classes become components.
3. Buckets that still hold several components compare all their classes of different components, block
   against block, by the same bounds. A first pass keeps the members that have a survivor at all; a second one
   gets their texts, verifies survivors on full sets, best first, joins what it confirms and skips what is joined
   already. A block emits the links of a spanning forest, fewer than it has members, never its pairs.
   Blocks of one component are not paired with each other.

A pair at the threshold shares no band with probability (1 - 0.75^4)^40 < 3e-7.

Defined results: texts without a word (NULL too) have an empty set and are linked with nothing;
fewer words than a shingle make one shingle; rows of one doc_id are one document (linked), also with
different texts, each of which links it; rows without doc_id take part in nothing, component NULL, and are kept.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm import base, components

WORDS = 5
PERCENT = 75
BANDS, ROWS, STEP = 40, 4, 32
MISS = 1e-6
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
SMALL = 64  # groups up to this size form their pairs at once
_VALUES = BANDS * ROWS
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.int32())])


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(0, 1 << 63, _VALUES, np.uint64)[:, None], (r.integers(0, 1 << 63, _VALUES, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def shingles(text: bytes | None, memo: base.WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; ASCII letters are folded."""
    words = (text or b"").lower().split()
    return np.unique(base.rolling(memo.of(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    flip, times = _functions()
    out = np.full(_VALUES, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 1024):
        np.minimum(out, ((s[i:i + 1024] ^ flip) * times).min(axis=1), out=out)
    return out


def _short(values: np.ndarray) -> bytes:
    """16 mixed bits of each value: minima of large sets lie near 0, so their top bits coincide without the values being equal."""
    return base.mix(values, np.zeros_like(values)).astype("<u2").tobytes()


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest of n equal values with which the posterior of the threshold is not below `miss`.

    With a uniform prior P(J >= t | m of n) = P(Bin(n + 1, t) <= m).
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _survive(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature matrices that no batch of values rules out, and their equal values."""
    alive, same = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n in range(STEP, _VALUES + 1, STEP):
        same[alive] += (a[alive, n - STEP:n] == b[alive, n - STEP:n]).sum(axis=1, dtype=np.int32)
        alive = alive[same[alive] >= least_matches(n)]
    return alive, same


_SIGNED = "doc_id long, key long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, salt = base.WordHashes(), np.arange(BANDS, dtype=np.uint64)

    def rows() -> Iterator[dict]:
        for doc_id, key, text in base.rows_of(batches, "doc_id", "key", "text"):
            s = shingles(text, memo)
            row = {"doc_id": doc_id, "key": key, "n_shingles": len(s), "s1": None, "s2": None, "bands": None, "sig": None}
            if len(s) and doc_id is not None:
                values = signature(s)
                parts = values.reshape(BANDS, ROWS)
                keys = base.mix(base.mix(base.mix(parts[:, 0], parts[:, 1]), base.mix(parts[:, 2], parts[:, 3])), salt)
                whole = [int(base.mix(s, s + np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for k in (1, 2)]
                row |= {"s1": whole[0], "s2": whole[1], "bands": keys.astype(np.int64).tolist(), "sig": _short(values)}
            yield row

    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
    return base.batched(rows(), schema, 2000)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, _VALUES)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            alive, same = _survive(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive)), pa.array(same[alive])], schema=_PAIR)


@lru_cache(maxsize=SMALL + 1)
def _pairs_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


class _Block:
    """Rows of whole groups; a group is a block with itself (side 2) or two blocks (sides 0 and 1)."""

    def __init__(self, batch: pa.RecordBatch):
        self.node, self.label, self.side = (batch.column(c).to_numpy() for c in ("node", "label", "side"))
        self.sig = _matrix(batch.column("sig"))

    def met(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of rows are to be compared."""
        return (self.label[i] != self.label[j]) & (self.node[i] != self.node[j]) & ((self.side[i] == 2) | (self.side[i] != self.side[j]))

    def survivors(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alive, same = _survive(self.sig[i], self.sig[j])
        return i[alive], j[alive], same[alive]

    def small(self, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of many small groups, some thousands at a time."""
        left, right, held = [], [], 0
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            i, j = _pairs_of(b - a)
            left.append(i + a)
            right.append(j + a)
            held += len(i)
            if held > 20_000:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
        if held:
            yield np.concatenate(left), np.concatenate(right)

    def large(self, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one large group, row by row."""
        for i in range(a, b - 1):
            j = np.arange(i + 1, b)
            yield np.full(len(j), i), j


_NEEDED = "bucket long, lo long, hi long, side int, node long, label long, sig binary"


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of groups (bucket, lo, hi) that have a surviving partner of another component there.

    A pair that shares an earlier band is left to that band's bucket: what decides is the 64-bit keys by
    which buckets are formed (`bands`).
    """
    for batch, starts in base.whole_groups(batches, "bucket", "lo", "hi"):
        block, ends = _Block(batch), np.append(starts[1:], batch.num_rows)
        band, keys = batch.column("band").to_numpy(), batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        needed = np.zeros(batch.num_rows, bool)

        def look(i: np.ndarray, j: np.ndarray, block=block, band=band, keys=keys, needed=needed) -> None:
            ok = block.met(i, j)
            i, j = i[ok], j[ok]
            if len(i):
                ok = ~((keys[i] == keys[j]) & (np.arange(BANDS) < band[i][:, None])).any(axis=1)
                i, j, _ = block.survivors(i[ok], j[ok])
                needed[i] = needed[j] = True

        few = ends - starts <= SMALL
        for i, j in block.small(starts[few], ends[few]):
            look(i, j)
        for a, b in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
            for i, j in block.large(a, b):
                look(i, j)
        take = pa.array(np.flatnonzero(needed))
        yield pa.RecordBatch.from_arrays([batch.column(c.split()[0]).take(take) for c in _NEEDED.split(", ")], [c.split()[0] for c in _NEEDED.split(", ")])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each group that join its components: a spanning forest."""
    memo = base.WordHashes()
    for batch, starts in base.whole_groups(batches, "bucket", "lo", "hi"):
        block, ends = _Block(batch), np.append(starts[1:], batch.num_rows)
        texts, u, v = batch.column("text"), [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            sets: dict[int, np.ndarray] = {}
            up = {x: x for x in block.label[a:b].tolist()}

            def root(x: int, up=up) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            def full(k: int, sets=sets, texts=texts) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingles(texts[k].as_py().encode(), memo)
                return sets[k]

            for i, j in block.small(np.array([a]), np.array([b])) if b - a <= SMALL else block.large(a, b):
                ok = block.met(i, j)
                i, j, same = block.survivors(i[ok], j[ok])
                best = np.argsort(-same, kind="stable")
                for x, y in zip(i[best].tolist(), j[best].tolist(), strict=True):
                    p, q = root(int(block.label[x])), root(int(block.label[y]))
                    if p != q and _linked(full(x), full(y)):
                        up[q] = p
                        u.append(block.node[x])
                        v.append(block.node[y])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of pairs on full sets; rows come ordered by a, whose set is kept."""
    memo, last, held = base.WordHashes(), None, None
    for batch in batches:
        a_ids, b_ids, a_texts, b_texts = batch.column("a"), batch.column("b"), base.text_bytes(batch.column("text_a")), base.text_bytes(batch.column("text_b"))
        keep = []
        for i, a in enumerate(a_ids.to_pylist()):
            if a != last:
                last, held = a, shingles(a_texts[i], memo)
            if _linked(held, shingles(b_texts[i], memo)):
                keep.append(i)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([a_ids.take(take), b_ids.take(take)], ["u", "v"])


def _grouped(met: DataFrame, labels: DataFrame, weights: DataFrame, work: str) -> DataFrame:
    """Members of buckets that hold several components, once for each group (bucket, lo, hi) in which they are compared.

    A bucket of up to `BLOCK` members and `BLOCK_SHINGLES` shingles is one group. A larger one is cut into blocks: a
    component of a block's size or more has its own ones, the others share. Two blocks are a group unless
    they are of one component.
    """
    labelled = met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(weights, "node")
    sizes = labelled.groupBy("bucket").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("members"), F.sum("n_shingles").alias("shingles")).filter("l1 <> l2")
    size = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    sizes = sizes.select("bucket", size.alias("blocks"))
    open_ = base.materialize(labelled.join(sizes, "bucket").select("bucket", "band", "node", "label", "n_shingles", "blocks"), f"{work}/open")
    names = ["bucket", "band", "node", "label"]
    small = open_.filter("blocks = 1").select(*names, F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(2).alias("side"))

    many = open_.filter("blocks > 1")
    per = many.groupBy("bucket", "label").agg(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES).alias("share"))
    per = per.withColumn("own", F.when(F.col("share") >= 1, F.ceil("share").cast("int")))
    # (label, number) of each block; blocks that components share have no label
    cut = per.groupBy("bucket").agg(F.collect_list(F.when(F.col("own").isNotNull(), F.struct(F.col("label").alias("of"), F.col("own").alias("n")))).alias("owners"),
                                    F.ceil(F.coalesce(F.sum(F.when(F.col("own").isNull(), F.col("share"))), F.lit(0.0))).cast("int").alias("common"))
    number = lambda of, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(of.alias("of"), i.alias("n")))
    listed = F.flatten(F.transform("owners", lambda o: number(o["of"], o["n"])))
    common = F.when(F.col("common") > 0, number(F.lit(None).cast("long"), F.col("common"))).otherwise(F.array().cast("array<struct<of:bigint,n:int>>"))
    cut = cut.select("bucket", "common", F.concat(listed, common).alias("all"))
    placed = many.join(per.select("bucket", "label", "own"), ["bucket", "label"]).join(cut, "bucket")
    mine = F.when(F.col("own").isNotNull(), F.struct(F.col("label").alias("of"), (F.pmod(F.xxhash64("node"), F.col("own")) + 1).cast("int").alias("n"))).otherwise(
        F.struct(F.lit(None).cast("long").alias("of"), (F.pmod(F.xxhash64("label"), F.col("common")) + 1).cast("int").alias("n")))
    sent = placed.withColumn("mine", mine).select(*names, "mine", F.explode("all").alias("other")).filter("mine.of is null or other.of is null or mine.of <> other.of")
    a, b = F.xxhash64("mine.of", "mine.n"), F.xxhash64("other.of", "other.n")
    large = sent.select(*names, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(F.col("mine").eqNullSafe(F.col("other")), 2).when(a < b, 0).otherwise(1).alias("side"))
    return small.unionByName(large)


def label(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    work = base.new_work(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    signed = base.materialize(docs.mapInArrow(_sign, _SIGNED), f"{work}/signed")
    used = signed.filter("s1 is not null")
    classes = used.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("s1", "s2", "first.doc_id", "first.key")
    reps = used.join(classes, ["doc_id", "key", "s1", "s2"])
    # a doc_id with several texts may be the smallest of several classes: all but one get a number of their own
    of_id = Window.partitionBy("doc_id")
    reps = reps.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("s1"))).withColumn("nth", F.dense_rank().over(of_id.orderBy("key"))).filter("copy = 1")
    node = F.when(F.col("nth") == 1, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "key", "s1"))
    reps = base.materialize(reps.select(node.alias("node"), "doc_id", "key", "s1", "s2", "n_shingles", "bands", "sig"), f"{work}/reps")
    rows = base.materialize(used.select("doc_id", "s1", "s2").join(reps.select("node", "s1", "s2"), ["s1", "s2"]).select("doc_id", "node"), f"{work}/rows")
    entries = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("bucket", "least")
    met = base.materialize(entries.join(shared, "bucket"), f"{work}/met")  # members of buckets with two classes or more
    ids = reps.select("doc_id", "key", "node").join(met.select("node").distinct(), "node")
    texts = base.materialize(docs.join(ids, ["doc_id", "key"]).dropDuplicates(["node"]).select("node", "text"), f"{work}/texts")
    sigs = reps.select("node", "sig")

    # one partner each: the smallest class of most of its buckets; step 3 meets all others
    votes = met.filter("node <> least").groupBy(F.col("node").alias("b"), F.col("least").alias("a")).agg(F.count("*").alias("n"))
    stars = votes.groupBy("b").agg(F.max_by("a", F.struct("n", (-F.col("a")).alias("x"))).alias("a")).select("a", "b")
    sided = stars.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    pairs = base.materialize(sided.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune, "a long, b long, score int"), f"{work}/stars")
    text_a, text_b = (texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
    sorted_pairs = pairs.select("a", "b").join(text_b, "b").join(text_a, "a").sortWithinPartitions("a")
    links = base.materialize(sorted_pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "u long, v long"), f"{work}/star_links")
    labels = base.materialize(components.label(links, f"{work}/stars_joined"), f"{work}/star_labels")

    keys = ["bucket", "lo", "hi"]
    grouped = _grouped(met, labels, reps.select("node", "n_shingles"), work)
    screened = grouped.join(reps.select("node", "sig", "bands"), "node").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_screen, _NEEDED)
    screened = base.materialize(screened, f"{work}/screened")
    forest = screened.join(texts, "node").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_forest, "u long, v long")
    forest = base.materialize(forest, f"{work}/forest")

    # rows of one doc_id are one document: their classes meet
    several = rows.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("u")).filter("u <> v")
    joined = base.materialize(rows.join(several.select("doc_id", "v"), "doc_id").select(F.col("node").alias("u"), "v").filter("u <> v"), f"{work}/one_id")
    edges = labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(forest).unionByName(joined)
    labels = base.materialize(components.label(edges, f"{work}/joined"), f"{work}/labels")
    placed = rows.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    if not joined.isEmpty():  # labels may be numbers that are no doc_id
        placed = placed.join(placed.groupBy("label").agg(F.min("doc_id").alias("least")), "label").select("doc_id", F.col("least").alias("label"))
    found = placed.groupBy("doc_id").agg(F.min("label").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with all columns, one document of each component (the smallest doc_id)."""
    gone = label(docs).filter("not kept").select(F.col("doc_id").alias(base.fresh(docs, "gone"))).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == gone[gone.columns[0]], "left_anti")


#: label() in SQL, for doc_ids that occur once.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {base.SQL_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + {WORDS - 1}], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(node, other) AS (SELECT x, x FROM e UNION SELECT node, y FROM reach JOIN e ON other = x),
m AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON node = doc_id
"""
