"""Prefix trie of conversations as balanced parentheses, shard by shard.

A conversation is the path of its turns; a turn is a 128-bit hash of role and text. Paths are sorted and cut
into ranges of bounded size. A range (shard) writes its part of the trie as balanced parentheses, one pair a
node in preorder, with the excess (open minus closed) and the least excess of each block in a binary tree:
the range min-max blocks. `find_close` walks these for all nodes at once and delimits each subtree; rank over
the pairs `()` counts leaves, running sums over nodes count members and saved bytes.

Nodes that several shards hold lie on the spines where two neighbouring shards meet: the common prefix of the
last path of one and the first path of the next. Each shard is told both neighbouring paths, leaves out what
the shard before has counted (shared nodes as children, their bytes, a leaf that is continued or repeated), and so the
figures of a shared node are plain sums over its shards. Only shared nodes are merged by key.

Texts are hashed where they are read. One conversation is one row of 24 bytes a turn; no group is larger than a
shard, except the ids of conversations that end in one shared node, which pass as a sorted stream into their hash.

Defined results: turns are ordered by turn (NULL first), role, hash; NULL role or text is empty; rows without
conv_id take no part; equal rows are turns each; without conversations there is no node.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm import base

BLOCK = 64
PER_SHARD = 300_000
STEP, MOST = 5, 9  # conversations are rebuilt from the first of five; up to eight turns come from there
_NODES = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ending long, shard int"
_NODES_ARROW = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), *[(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string()), ("ending", pa.int64()), ("shard", pa.int32())])
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path: array of (hash of role and text, UTF-8 bytes of the text) in the order of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                                                               F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("hash"), F.octet_length(text).cast("long").alias("bytes"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").isNotNull(), F.lit(False)).alias("dated"), "turn", "role", "hash", "bytes")))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["hash"].alias("hash"), t["bytes"].alias("bytes"))).alias("path"))


def rebuilt(found: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns from conversation c - c % 5, h = crc32(c) % 9."""
    donors = found.filter(F.col("conv_id") % STEP == 0).select(F.col("conv_id").alias("donor"), F.slice("path", 1, MOST - 1).alias("first"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % MOST).cast("int")
    met = found.withColumn("h", h).withColumn("donor", F.col("conv_id") - F.col("conv_id") % STEP).join(donors, "donor", "left")
    empty = F.array().cast("array<struct<hash:binary,bytes:bigint>>")
    own = F.when(F.size("path") > F.col("h"), F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))).otherwise(empty)
    taken = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), F.col("h"))).otherwise(empty)
    return met.select("conv_id", F.concat(taken, own).alias("path"))


class Parentheses:
    """Balanced parentheses with excess blocks under a binary tree of minima."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = max(1, -(-len(opens) // BLOCK))
        size = 1 << (blocks - 1).bit_length()
        padded = np.full(size * BLOCK, np.iinfo(np.int64).max)
        padded[:len(opens)] = self.excess
        self.rows = padded.reshape(size, BLOCK)
        self.least = [self.rows.min(axis=1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))
        pair = np.zeros(len(opens), np.int64)
        pair[:-1] = opens[:-1] & ~opens[1:]
        self.pairs = np.cumsum(pair)

    def _inside(self, blocks: np.ndarray, start: np.ndarray, aim: np.ndarray) -> np.ndarray:
        """First place from `start` on within each block where the excess is at most `aim`; -1 if there is none."""
        hit = (self.rows[blocks] <= aim[:, None]) & (np.arange(BLOCK) >= start[:, None])
        return np.where(hit.any(axis=1), hit.argmax(axis=1), -1)

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing place of each opening place."""
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 14):
            p = at[i:i + (1 << 14)]
            aim, block = self.excess[p] - 1, p // BLOCK
            within = self._inside(block, p % BLOCK + 1, aim)
            close = block * BLOCK + within
            far = np.flatnonzero(within < 0)
            if len(far):
                close[far] = self._beyond(block[far], aim[far])
            out[i:i + (1 << 14)] = close
        return out

    def _beyond(self, block: np.ndarray, aim: np.ndarray) -> np.ndarray:
        """The same in later blocks: up the tree to a right neighbour low enough, then down to its first such block."""
        node, level = block.copy(), np.zeros(len(block), np.int64)
        climbing = np.ones(len(block), bool)
        for k, least in enumerate(self.least[:-1]):
            c = np.flatnonzero(climbing)
            right = node[c] + 1
            there = (node[c] % 2 == 0) & (least[np.minimum(right, len(least) - 1)] <= aim[c])
            node[c[there]], level[c[there]] = right[there], k
            climbing[c[there]] = False
            node[c[~there]] >>= 1
        for k in range(len(self.least) - 1, 0, -1):
            d = np.flatnonzero((level == k) & ~climbing)
            left = node[d] * 2
            node[d] = np.where(self.least[k - 1][left] <= aim[d], left, left + 1)
            level[d] = k - 1
        return node * BLOCK + self._inside(node, np.zeros(len(node), np.int64), aim)

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Leaf pairs between each opening place and its closing one, both included."""
        return self.pairs[close] - np.where(at > 0, self.pairs[np.maximum(at, 1) - 1], 0)


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths (16 bytes a turn) begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 16
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax()) // 16


def _keys(path: bytes, depth: int) -> list[bytes]:
    """Keys of the nodes at depths 0 to `depth` of a path."""
    h, out = hashlib.blake2b(digest_size=16), []
    for d in range(depth + 1):
        out.append(h.copy().digest())
        h.update(path[16 * d:16 * d + 16])
    return out


def _joined(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def _encode(shard: int, convs: np.ndarray, path: list[bytes], bytes_of: list[np.ndarray], before: bytes | None, after: bytes | None) -> pa.Table:
    """Nodes of one shard of sorted conversations; `before` and `after` are the neighbouring paths."""
    n = len(convs)
    length = np.array([len(p) // 16 for p in path])
    common = np.array([0, *(_common(a, b) for a, b in zip(path, path[1:], strict=False))])
    common[0] = -1  # the first conversation opens the root too
    fresh = length - common
    first = np.cumsum(fresh) - fresh  # number of the first new node of each conversation
    total = int(fresh.sum())
    owner = np.repeat(np.arange(n), fresh)
    depth = np.arange(total) - first[owner] + common[owner] + 1
    parent, end, weight = np.arange(total) - 1, np.empty(n, np.int64), np.zeros(total, np.int64)
    line = np.empty(int(length.max()) + 1, np.int64)  # nodes of the path at hand, by depth
    for i in range(n):
        lo, hi = common[i] + 1, length[i] + 1
        line[lo:hi] = np.arange(first[i], first[i] + hi - lo)
        if hi > lo and lo:
            parent[first[i]] = line[lo - 1]
        end[i] = line[length[i]]
        if hi > lo:
            weight[first[i]:first[i] + hi - lo] = np.concatenate([[0], bytes_of[i]])[lo:hi]
    # opens and closes in order: a conversation closes down to what it shares with the one before, then opens
    closes = np.concatenate([[0], length[:-1] - common[1:]])
    opens = np.repeat(np.tile([False, True], n), np.stack([closes, fresh], axis=1).ravel())
    opens = np.concatenate([opens, np.zeros(int(length[-1]) + 1, bool)])
    tree = Parentheses(opens)
    at = np.flatnonzero(opens)
    close = tree.find_close(at)
    last = np.arange(total) + (close - at + 1) // 2  # one past the subtree in preorder
    ends = np.bincount(end, minlength=total)
    members = np.concatenate([[0], np.cumsum(ends)])
    n_convs = members[last] - members[:-1]
    lowest = np.minimum.reduceat(np.append(convs, np.iinfo(np.int64).max), np.stack([members[:-1], members[last]], axis=1).ravel())[::2]
    children = np.bincount(parent[1:], minlength=total)
    leaves = tree.leaves(at, close)

    shared_before = -1 if before is None else _common(before, path[0])
    shared_after = -1 if after is None else _common(path[-1], after)
    key: list[bytes | None] = [None] * total
    counted = weight.copy()
    for depth_shared, i, earlier in ((shared_before, 0, True), (shared_after, n - 1, False)):
        nodes = []
        walk = end[i]
        while walk >= 0:
            nodes.append(walk)
            walk = parent[walk] if walk else -1
        nodes = nodes[::-1][:depth_shared + 1]
        for node, k in zip(nodes, _keys(path[i], depth_shared), strict=False) if nodes else ():
            key[node] = k
        if earlier and before is not None:  # the shard before has counted them
            counted[nodes] = 0
            children[nodes[:-1]] -= 1
    # a leaf here that the next shard repeats or continues is left to that shard
    if after is not None and shared_after == length[-1]:
        walk = end[n - 1]
        while walk >= 0:
            leaves[walk] -= 1
            walk = parent[walk] if walk else -1
    paid = np.concatenate([[0], np.cumsum(n_convs * weight)])
    once = np.concatenate([[0], np.cumsum(counted)])
    saved = paid[last] - paid[:-1] - (once[last] - once[:-1])

    sha = [_NO_ENDS] * total
    has = np.flatnonzero(ends)
    place = members[:-1]
    # members that end in a node come first in its subtree, ordered by conv_id
    for node in has.tolist():
        if key[node] is None:
            sha[node] = _joined(convs[place[node]:place[node] + ends[node]])
    spine = [i for i in range(total) if key[i] is not None]
    ending = [(i, c) for i in spine if ends[i] for c in convs[place[i]:place[i] + ends[i]].tolist()]
    parent_key = [key[p] if p >= 0 else None for p in parent.tolist()]
    parent_conv = [None if p < 0 or key[p] is not None else int(lowest[p]) for p in parent.tolist()]
    nodes = pa.table([pa.array(key, pa.binary()), pa.array(parent_key, pa.binary()), lowest, depth, pa.array(parent_conv, pa.int64()), n_convs, children, leaves, saved, pa.array(sha, pa.string()),
                      pa.nulls(total, pa.int64()), pa.array([shard] * total, pa.int32())], schema=_NODES_ARROW)
    if not ending:
        return nodes
    m = len(ending)
    more = [pa.array([key[i] for i, _ in ending], pa.binary())] + [pa.nulls(m, t) for t in _NODES_ARROW.types[1:10]] + [pa.array([c for _, c in ending], pa.int64()), pa.array([shard] * m, pa.int32())]
    return pa.concat_tables([nodes, pa.table(more, schema=_NODES_ARROW)])


def _shard(found: pa.Table, near: pa.Table) -> pa.Table:
    if not found.num_rows:
        return _NODES_ARROW.empty_table()
    found = found.sort_by([("path", "ascending"), ("conv_id", "ascending")])
    sizes = [np.frombuffer(b, ">u8").astype(np.int64) for b in found.column("bytes").to_pylist()]
    before, after = (near.column(c)[0].as_py() for c in ("before", "after"))
    return _encode(near.column("shard")[0].as_py(), found.column("conv_id").to_numpy(), found.column("path").to_pylist(), sizes, before, after)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a stream sorted by node and id, hashed node by node."""
    def rows() -> Iterator[dict]:
        key, hashed = None, None
        for k, conv in base.rows_of(batches, "key", "ending"):
            if k != key:
                if key is not None:
                    yield {"key": key, "sha": hashed.hexdigest()}
                key, hashed = k, hashlib.sha256(str(conv).encode())
            else:
                hashed.update(b"," + str(conv).encode())
        if key is not None:
            yield {"key": key, "sha": hashed.hexdigest()}
    return base.batched(rows(), pa.schema([("key", pa.binary()), ("sha", pa.string())]))


def nodes(found: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = found.sparkSession
    work = base.new_work(spark)
    # sizes as 8 bytes each, big endian
    flat = found.select("conv_id", F.concat(F.lit(b""), F.array_join(F.transform("path", lambda t: F.hex(t["hash"])), "").cast("string")).alias("hex"),
                        F.array_join(F.transform("path", lambda t: F.lpad(F.hex(t["bytes"]), 16, "0")), "").alias("sizes"), F.size("path").alias("turns"))
    flat = base.materialize(flat.select("conv_id", F.unhex("hex").alias("path"), F.unhex("sizes").alias("bytes"), "turns"), f"{work}/paths")
    turns = flat.agg(F.sum(F.col("turns") + 1)).first()[0] or 0
    shards = max(base.partitions(spark), -(-turns // per_shard))
    dealt = flat.drop("turns").repartitionByRange(shards, "path", "conv_id").withColumn("shard", F.spark_partition_id())
    dealt = base.materialize(dealt, f"{work}/dealt")
    bounds = dealt.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("shard")  # one row a shard
    near = bounds.select("shard", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    near = base.materialize(near, f"{work}/near")
    local = dealt.groupBy("shard").cogroup(near.groupBy("shard")).applyInArrow(_shard, _NODES)
    local = base.materialize(local, f"{work}/local")

    spine = local.filter("key is not null and ending is null")
    ends = local.filter("ending is not null").select("key", "ending").repartition("key").sortWithinPartitions("key", "ending").mapInArrow(_hash_ends, "key binary, sha string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = spine.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), *sums)
    merged = base.materialize(merged.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_NO_ENDS))).drop("sha"), f"{work}/merged")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # children meet their shared parent within their own shard
    parents = spine.select("shard", "key").join(merged.select("key", F.col("conv_id").alias("merged_conv")), "key").select("shard", F.col("key").alias("parent_key"), "merged_conv")
    single = local.filter("key is null").join(parents, ["shard", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("merged_conv", "parent_conv_id"))
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return single.select(*names).unionByName(merged.join(above, "parent_key", "left").select(*names))


def digest(conversations: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """The trie of rebuilt conversations."""
    work = base.new_work(conversations.sparkSession)
    found = base.materialize(paths(conversations), f"{work}/own")
    return nodes(rebuilt(found), per_shard)


#: digest() in SQL.
SQL = f"""
WITH bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % {MOST})::BIGINT AS h FROM o, bits),
b AS (SELECT h.conv_id, list_concat(coalesce(d.own, [])[1:h.h], h.own[h.h + 1:]) AS path FROM h LEFT JOIN o d ON d.conv_id = h.conv_id - h.conv_id % {STEP}),
p AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM b),
k AS (SELECT conv_id, depth, len(path) AS n, path[1:depth] AS key, CASE WHEN depth > 0 THEN path[1:depth - 1] END AS up, CASE WHEN depth > 0 THEN octet_length(encode(path[depth].t)) ELSE 0 END AS bytes FROM p),
v AS (SELECT key, any_value(depth) AS depth, any_value(up) AS up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM k GROUP BY key),
c AS (SELECT up AS key, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY up),
w AS (SELECT v.*, coalesce(c.n, 0) AS n_children FROM v LEFT JOIN c ON v.key = c.key),
t AS (SELECT key[1:e] AS key, n_children, n_convs, bytes FROM (SELECT *, unnest(range(depth + 1)) AS e FROM w)),
s AS (SELECT key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM t GROUP BY key)
SELECT w.conv_id, w.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved::BIGINT AS saved_tokens, w.ends_sha256 FROM w JOIN s ON s.key = w.key LEFT JOIN v u ON w.depth > 0 AND u.key = w.up
"""
