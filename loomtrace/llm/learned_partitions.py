"""Approximate nearest neighbours by learned partitions.

Fitting uses a bounded sample (`SAMPLE` distinct vectors, smallest hash of the id first) in one task: its exact
10-nearest-neighbour graph is cut into equal parts by recursive spectral bisection, then refined by
capacity-bound label propagation; a small network learns, for a vector, how its neighbours spread over the parts.
The number of parts a query visits is the smallest that finds `AIM` of the true neighbours of held-out
sample points.

All rows are indexed: each distinct vector goes to its most probable part, each query to its several
most probable ones. Parts are cut into blocks of bounded size, queries too, and a block ranks its
vectors by exact double-precision distance; partial lists are merged by rank. Equal vectors are one
entry with its eleven smallest ids, so a vector that a third of the rows share costs one comparison.

Defined results: vectors that are NULL, zero, hold NULL or non-finite components, or have another
length than the most frequent one take no part, nor do rows without vec_id; ties go to the smaller vec_id; rows of one
vec_id and vector count once, and a query never finds its own vec_id; fewer candidates give fewer rows.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm import base

TOP = 10
SAMPLE = 16_384
PER_PART = 512
MOST_PARTS = 256
AIM = 0.97
BLOCK, QUERY_BLOCK = 4096, 1024
HIDDEN, EPOCHS = 128, 25


@dataclass
class Router:
    """Standardised vector -> hidden layer -> log-odds of the parts."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts per row, most probable first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def neighbour_graph(x: np.ndarray, k: int = TOP) -> np.ndarray:
    """Exact k nearest neighbours within a bounded sample."""
    k, out = min(k, len(x) - 1), []
    square = (x * x).sum(axis=1)
    for i in range(0, len(x), 128):
        d = x[i:i + 128] @ x.T
        d *= -2
        d += square
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k].copy())  # a view would keep the whole block
    return np.concatenate(out)


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 5) -> np.ndarray:
    """Equal parts of the neighbour graph with few edges between them; parts is a power of two."""
    n = len(near)
    u, v = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    label, count = np.zeros(n, np.int64), 1
    while count < parts:  # all parts are halved at once: edges inside parts only
        inside = label[u] == label[v]
        a, b = u[inside], v[inside]
        degree = np.maximum(np.bincount(a, minlength=n), 1)
        size = np.maximum(np.bincount(label, minlength=count), 1)
        y = rng.standard_normal(n)
        for _ in range(60):  # towards the slowest mode of each part, orthogonal to the constant one
            y = 0.5 * y + 0.5 * np.bincount(a, y[b], n) / degree
            y -= (np.bincount(label, y, count) / size)[label]
            y /= np.sqrt(np.bincount(label, y * y, count) / size + 1e-300)[label]
        order = np.lexsort((y, label))
        start = np.cumsum(size) - size
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - start[label[order]]
        label = 2 * label + (place >= (size[label] + 1) // 2)
        count *= 2
    most = int(np.ceil(1.1 * n / parts))
    size = np.bincount(label, minlength=parts)
    for _ in range(sweeps):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (u, label[v]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        for i in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())]:
            if size[best[i]] < most:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
    return label


def fit(x: np.ndarray, parts: int, seed: int = 5) -> Router:
    """Graph, parts and router of a bounded sample of distinct vectors."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), float(x.std()) or 1.0
    if parts == 1 or len(x) < 3:
        d = x.shape[1]
        return Router(mean, scale, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = neighbour_graph(x)
    label = balanced_parts(near, parts, rng)
    aim = np.zeros((len(x), parts))
    np.add.at(aim, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1.0)
    aim[np.arange(len(x)), label] += 1
    aim /= aim.sum(axis=1, keepdims=True)
    z = (x - mean) / scale
    shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, parts), (parts,)]
    w = [rng.standard_normal(s) * np.sqrt(2 / s[0]) if len(s) == 2 else np.zeros(s) for s in shapes]
    m1, m2, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    order = rng.permutation(len(x))
    held, train = order[:max(1, min(1000, len(x) // 10))], order[max(1, min(1000, len(x) // 10)):]
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for i in range(0, len(train), 256):
            rows = train[i:i + 256]
            h = np.maximum(z[rows] @ w[0] + w[1], 0)
            s = h @ w[2] + w[3]
            p = np.exp(s - s.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - aim[rows]) / len(rows)
            back = (g @ w[2].T) * (h > 0)
            grads = [z[rows].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0)]
            step += 1
            for j, grad in enumerate(grads):
                m1[j] = 0.9 * m1[j] + 0.1 * grad
                m2[j] = 0.999 * m2[j] + 0.001 * grad * grad
                w[j] -= 0.003 * (m1[j] / (1 - 0.9 ** step)) / (np.sqrt(m2[j] / (1 - 0.999 ** step)) + 1e-8)
    router = Router(mean, scale, *w, parts)
    placed = router.parts(x, 1)[:, 0]
    visits = router.parts(x[held], parts)
    where = np.empty_like(visits)
    np.put_along_axis(where, visits, np.broadcast_to(np.arange(parts), visits.shape), axis=1)
    need = np.take_along_axis(where, placed[near[held]], axis=1)  # the visit that meets each true neighbour
    found = [(need < n).mean() for n in range(1, parts + 1)]
    router.probes = next((n for n, r in enumerate(found, 1) if r >= AIM), parts)
    return router


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    df = df.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0))
    # -0.0 and 0.0 are one value
    return df.withColumn("v", F.transform("v", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c)))


def _stack(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


_HITS = "q long, vec_id long, score double"
_HITS_ARROW = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _rank(top: int):
    def rank(found: pa.Table, asked: pa.Table) -> pa.Table:
        """One block of vectors against one block of queries: the best `top` + 1 ids of each query."""
        if not found.num_rows or not asked.num_rows:
            return _HITS_ARROW.empty_table()
        x, q, ids = _stack(found.column("v")), _stack(asked.column("v")), found.column("ids").to_pylist()
        out_q, out_id, out_d = [], [], []
        for name, one in zip(asked.column("q").to_pylist(), q, strict=True):
            d = np.sqrt(((x - one) ** 2).sum(axis=1))
            k = min(top + 1, len(d))
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])  # ties stay in
            hits = sorted((d[i], vec) for i in near for vec in ids[i])[:top + 1]
            out_q += [name] * len(hits)
            out_id += [h[1] for h in hits]
            out_d += [h[0] for h in hits]
        return pa.table([out_q, out_id, out_d], schema=_HITS_ARROW)
    return rank


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of the `top` nearest found for rows whose id meets `is_query` (a function of the id column)."""
    spark = vectors.sparkSession
    work = base.new_work(spark)
    used = _usable(vectors, id_col, vector_col)
    sizes = used.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    used = used.filter(F.size("v") == sizes["n"]).distinct()
    least = used.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(f"nth <= {top + 1}")
    entries = base.materialize(least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), f"{work}/entries")  # at most top + 1 ids
    total = entries.count()
    drawn = entries.withColumn("at", F.xxhash64(F.element_at("ids", 1))).orderBy("at", F.element_at("ids", 1)).limit(SAMPLE).select("v")
    parts = 1
    while parts * 2 <= min(MOST_PARTS, total // PER_PART, SAMPLE // 64):
        parts *= 2

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task holds the sample, at most SAMPLE vectors; the driver gets the weights only."""
        held = [_stack(b.column("v")) for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_pydict({"router": [pickle.dumps(fit(np.concatenate(held), parts))]})

    router = pickle.loads(bytes(drawn.repartition(1).mapInArrow(train, "router binary").first()["router"]))

    def routed(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at = router.parts(_stack(batch.column("v")), n).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(at), pa.list_(pa.int32()))], [*batch.schema.names, "parts"])
        return run

    index = entries.mapInArrow(routed(1), "v array<double>, ids array<long>, parts array<int>").select("v", "ids", F.element_at("parts", 1).alias("part"))
    index = base.materialize(index, f"{work}/index")
    wanted = used.filter(is_query(F.col("vec_id")))
    asked = wanted.groupBy("v").agg(F.min("vec_id").alias("q"))  # one search for equal query vectors
    asked = base.materialize(asked.mapInArrow(routed(router.probes), "v array<double>, q long, parts array<int>"), f"{work}/asked")
    visits = asked.select("v", "q", F.explode("parts").alias("part"))
    blocks = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = visits.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("groups"))
    shape = F.broadcast(blocks.join(groups, "part"))  # at most MOST_PARTS rows
    left = index.join(shape, "part").withColumn("block", F.pmod(F.xxhash64("v"), "blocks").cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = visits.join(shape, "part").withColumn("group", F.pmod(F.xxhash64("q"), "groups").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["part", "block", "group"]
    hits = left.select(*keys, "v", "ids").groupBy(*keys).cogroup(right.select(*keys, "v", "q").groupBy(*keys)).applyInArrow(_rank(top), _HITS)
    best = hits.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(f"nth <= {top + 1}").drop("nth")
    names = wanted.join(asked.select("v", "q"), "v").select(F.col("vec_id").alias("query_id"), "q")
    out = names.join(best, "q").filter("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(f"rank <= {top}")
    return out.select("query_id", "rank", "vec_id", "score")
