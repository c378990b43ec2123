"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one node with its smallest ids (one more than asked for, as no others can be among the
nearest), so a vector shared by a third of all rows is one node. Nodes are dealt by a hash to shards of about SHARD_BYTES, as
large as a task can hold, as a query's work grows with the number of shards and hardly with their size; a small table has
as many shards as tasks run at once. Each shard builds its graph in bulk: levels by a hash with one node in FANOUT going up,
candidates from the nearest cells around random nodes and their neighbours' neighbours (all nodes, up to EXACT), neighbours chosen for nearness and spread,
links both ways, all stored as flat arrays in one row of the index table. Nodes are in the order of their ids, so the graph
doesn't depend on partitions. Queries come in blocks of QUERY_BYTES; in a pass over the index, a block is broadcast and
meets every shard, which is read once: it searches top down with a beam and returns its best, and the shards' results are merged by
distance. Distances returned are in double precision.

Every valid row is indexed; nothing is fitted on a sample. Recall against brute force is measured in the tests.

Defined results: vectors null, empty, zero or with null or non-finite components, and null ids, take no part; a
repeated id counts once per distinct vector and is never its own neighbour; vectors of different
lengths never meet; ties go to the smaller id; with fewer candidates all are returned; an empty table
gives no rows; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataframe.llm.common import materialize, mix, slices

#: Bytes of a shard (vectors and links) and of a block of queries; the least nodes that are worth a shard of their own.
SHARD_BYTES, QUERY_BYTES, LEAST_NODES = 48 << 20, 16 << 20, 2048
#: Links per node (twice as many on the ground level), candidates considered for them, nodes per node above.
LINKS, CANDIDATES, FANOUT = 16, 64, 16
#: Nodes that are all compared; beyond, as many as the cells nearest to a node's own have; neighbours whose neighbours are looked at too.
EXACT, AROUND, HOPS = 16_384, 8192, 16
BEAM, TOGETHER = 256, 256
INDEX = "shard long, dim int, n int, vectors binary, id_ends binary, ids binary, level_ends binary, nodes binary, links binary"


def valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """rows: id, v. One row per distinct vector: v and its k + 1 smallest ids."""
    distinct = rows.select("v", "id").distinct()
    first = Window.partitionBy("v").orderBy("id")
    return distinct.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def nearest(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """The k nearest other rows of each row, nearest first."""
    norm, out = (x * x).sum(axis=1), np.zeros((len(x), k), np.int32)
    for at in range(0, len(x), block):
        d = norm[None] - 2 * x[at : at + block] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.argsort(d, axis=1)[:, :k]
        out[at : at + block] = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(axis=1), 1)
    return out


def near_cells(x: np.ndarray, k: int, around: int = AROUND) -> np.ndarray:
    """About the k nearest other rows of each row, nearest first, -1 where there are fewer: those among about `around` rows of the cells
    nearest to its own. Cells are those of rows drawn by place, so where rows are dense, cells are small."""
    x = x.astype(np.float32)
    n = len(x)
    many = 2 * int(np.sqrt(n))
    pivots = x[np.sort(np.argsort(mix(np.arange(n, dtype=np.uint64) + np.uint64(17)))[:many])]
    norm = (pivots * pivots).sum(axis=1)
    own = np.concatenate([(norm - 2 * x[at : at + 4096] @ pivots.T).argmin(axis=1) for at in range(0, n, 4096)])
    order = np.argsort(own, kind="stable")
    start = np.searchsorted(own[order], np.arange(many + 1))
    around = (norm[None] - 2 * pivots @ pivots.T).argsort(axis=1)[:, : max(2, -(-many * around // n))]
    out, size = np.full((n, k), -1, np.int32), (x * x).sum(axis=1)
    for c in range(many):
        rows = order[start[c] : start[c + 1]]
        if not len(rows):
            continue
        some = np.concatenate([order[start[j] : start[j + 1]] for j in around[c]] + ([rows] if c not in around[c] else []))
        for at in range(0, len(rows), 1024):
            mine = rows[at : at + 1024]
            d = size[some][None] - 2 * x[mine] @ x[some].T
            d[some[None] == mine[:, None]] = np.inf
            m = min(k, len(some) - 1)
            if m <= 0:
                continue
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            out[mine, :m] = some[np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(axis=1), 1)]
    return out


def refined(x: np.ndarray, near: np.ndarray, hops: int = HOPS) -> np.ndarray:
    """near, with the nearest neighbours' nearest neighbours looked at too."""
    x, out, k = x.astype(np.float32), np.empty_like(near), near.shape[1]
    size = (x * x).sum(axis=1)
    for at in range(0, len(x), 256):
        own = np.arange(at, min(len(x), at + 256))
        c = np.sort(np.concatenate([near[own], near[near[own, :hops]][:, :, :hops].reshape(len(own), -1)], axis=1), axis=1)
        d = size[c] - 2 * np.einsum("ijk,ik->ij", x[c], x[own])
        d[:, 1:][c[:, 1:] == c[:, :-1]] = np.inf
        d[(c < 0) | (c == own[:, None])] = np.inf
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.take_along_axis(d, best, 1).argsort(axis=1), 1)
        out[own] = np.where(np.isfinite(np.take_along_axis(d, best, 1)), np.take_along_axis(c, best, 1), -1)
    return out


def linked(x: np.ndarray, most: int, candidates: int = CANDIDATES) -> np.ndarray:
    """Flat neighbour array (rows of `most`, padded with -1): a candidate is taken if no neighbour already
    taken is nearer to it than the node is; then links are made mutual, the nearest kept where there are too many."""
    n, k = len(x), min(candidates, len(x) - 1)
    out = np.full((n, most), -1, np.int32)
    if k <= 0:
        return out
    near, edges = nearest(x, k) if n <= EXACT else refined(x, near_cells(x, k)), []
    for at in range(0, n, 128):
        c = near[at : at + 128]
        there = c >= 0
        v = x[c]
        own = np.where(there, ((v - x[at : at + 128, None]) ** 2).sum(axis=2), np.inf)
        norm = (v * v).sum(axis=2)
        among = norm[:, :, None] + norm[:, None] - 2 * v @ v.transpose(0, 2, 1)
        taken = np.zeros(c.shape, bool)
        for j in range(k):
            blocked = (taken[:, :j] & (among[:, j, :j] < own[:, j, None])).any(axis=1)
            taken[:, j] = ~blocked & (taken.sum(axis=1) < most)
        taken[:, : min(k, most // 4)] = True  # the very nearest always
        i, j = np.nonzero(taken & there)
        edges.append(np.stack([i + at, c[i, j]]))
    a, b = np.concatenate(edges, axis=1).astype(np.int64)
    code = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = code // n, code % n
    d = ((x[a] - x[b]) ** 2).sum(axis=1)
    order = np.lexsort((b, d, a))
    a, b = a[order], b[order]
    start = np.searchsorted(a, np.arange(n))
    place = np.arange(len(a)) - start[a]
    fits = place < most
    out[a[fits], place[fits]] = b[fits]
    return out


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """level_ends, nodes and links of a shard, ground level first: level l has nodes[level_ends[l-1]:level_ends[l]], and
    their links (2 * LINKS on the ground, LINKS above) are one after another, as places within the level."""
    x, all_ = vectors.astype(np.float64), np.arange(len(vectors))
    draw = mix(np.arange(len(vectors), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    ends, members, links = [0], [], []
    while True:
        members.append(all_)
        ends.append(ends[-1] + len(all_))
        links.append(linked(x[all_], 2 * LINKS if len(members) == 1 else LINKS).ravel())
        if len(all_) <= 2 * FANOUT:
            break
        up = all_[np.argsort(draw[all_])[: -(-len(all_) // FANOUT)]]
        draw, all_ = mix(draw + np.uint64(len(members))), np.sort(up)
    return np.array(ends[1:], np.int64), np.concatenate(members).astype(np.int32), np.concatenate(links).astype(np.int32)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: places and squared distances of the `width` best found, nearest first."""
    m, n = len(q), len(x)
    width = min(width, n)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    ids = np.full((m, width), n, np.int64)
    dist, done = np.full((m, width), np.inf, np.float32), np.ones((m, width), bool)
    start = start[:, :width]
    ids[:, : start.shape[1]] = start
    d = ((x[np.minimum(start, n - 1)] - q[:, None]) ** 2).sum(axis=2)
    dist[:, : start.shape[1]] = np.where(start < n, d, np.inf)
    done[:, : start.shape[1]] = start >= n
    np.put_along_axis(seen, start, True, 1)
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        at = open_.argmin(axis=1)
        go = np.isfinite(open_[np.arange(len(live)), at])
        live, at = live[go], at[go]
        if not len(live):
            break
        done[live, at] = True
        near = links[ids[live, at]].astype(np.int64)
        near[near < 0] = n
        near[seen[live[:, None], near]] = n
        seen[live[:, None], near] = True
        d = ((x[np.minimum(near, n - 1)] - q[live][:, None]) ** 2).sum(axis=2)
        d[near >= n] = np.inf
        all_d = np.concatenate([dist[live], d], axis=1)
        keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        dist[live] = np.take_along_axis(all_d, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near >= n], axis=1), keep, 1)
    order = dist.argsort(axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def search(vectors: np.ndarray, level_ends: np.ndarray, members: np.ndarray, links: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """The `width` nodes found nearest to each query, a place of n where there are fewer."""
    begins = np.r_[0, level_ends[:-1]]
    offset = np.r_[0, np.cumsum([(e - b) * (2 * LINKS if i == 0 else LINKS) for i, (b, e) in enumerate(zip(begins, level_ends, strict=True))])]
    found = None
    for level in range(len(level_ends) - 1, -1, -1):
        own = members[begins[level] : level_ends[level]]
        flat = links[offset[level] : offset[level + 1]].reshape(len(own), -1)
        if found is None:
            start = np.tile(np.arange(len(own)), (len(q), 1))
        else:
            start = np.append(np.searchsorted(own, above), len(own))[np.minimum(found, len(above))]
        found, _ = beam(vectors[own].astype(np.float32), flat, q.astype(np.float32), start, width if level == 0 else 2 * FANOUT)
        above = own
    return found


def flat(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """A list column of one length as rows."""
    values = column.combine_chunks()
    return np.ascontiguousarray(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1), kind)


def kind_of(vector: Column, rows: DataFrame) -> np.dtype:
    return np.dtype("<f4" if "float" in rows.select(vector).schema[0].dataType.simpleString() else "<f8")


def index(rows: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """The written index: a row per shard, of vectors of one length. shard_rows: nodes of a shard, by default as many as
    SHARD_BYTES hold."""
    kind = kind_of(F.col(vector), rows)
    rows = rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))
    rows = materialize(nodes(rows, k), "ann-nodes")
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    fits = shard_rows or max(LEAST_NODES, SHARD_BYTES // ((dim or 1) * kind.itemsize + 12 * LINKS + 8 * (k + 2)))
    shards = max(1, -(-n // fits), 0 if shard_rows else min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_NODES))

    def made(key: tuple, group: pa.Table) -> pa.Table:
        x, ids = flat(group["v"], kind), group["ids"].to_pylist()
        order = sorted(range(len(x)), key=lambda i: (ids[i], x[i].tobytes()))
        x, ids = x[order], [ids[i] for i in order]
        ends, members, links = build(x)
        row = (key[0].as_py(), key[1].as_py(), len(x), x.tobytes(), np.cumsum([len(i) for i in ids]).astype("<i8").tobytes(), np.concatenate(ids).astype("<i8").tobytes(), ends.tobytes(), members.tobytes(), links.tobytes())
        kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6)
        return pa.table({c.split()[0]: pa.array([v], t) for c, v, t in zip(INDEX.split(", "), row, kinds, strict=True)})

    dealt = rows.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    return materialize(dealt.groupBy("shard", "dim").applyInArrow(made, INDEX), "ann-index")


def lookup(shards: DataFrame, queries: DataFrame, k: int, width: int = BEAM, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """queries: id, v, each valid. The k nearest of each: query_id, rank, vec_id, score."""
    kind = kind_of(F.col("v"), queries)
    queries = materialize(queries.select("id", "v").distinct(), "ann-queries")
    n, dim = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * (dim or 1) * kind.itemsize // query_bytes))

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "q": [flat(group["v"], kind).tobytes()], "own": [group["id"].combine_chunks().to_numpy().astype("<i8").tobytes()]})

    dealt = queries.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    asked = materialize(dealt.groupBy("dim", "block").applyInArrow(packed, "dim int, block long, q binary, own binary"), "ann-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for r in batch.to_pylist():
                yield from found(r)

    def found(r: dict) -> Iterator[pa.RecordBatch]:
        x = np.frombuffer(r["vectors"], kind).reshape(r["n"], r["dim"])
        asked, mine = np.frombuffer(r["q"], kind).reshape(-1, r["dim"]), np.frombuffer(r["own"], "<i8")
        ends, ids = np.frombuffer(r["id_ends"], "<i8"), np.frombuffer(r["ids"], "<i8")
        graph = [np.frombuffer(r[c], t) for c, t in (("level_ends", "<i8"), ("nodes", "<i4"), ("links", "<i4"))]
        for at in range(0, len(asked), TOGETHER):
            q, own, out = asked[at : at + TOGETHER], mine[at : at + TOGETHER], [[], [], []]
            for i, places in enumerate(search(x, *graph, q, width)):
                places = places[places < len(x)]
                d = np.sqrt(((x[places].astype(np.float64) - q[i].astype(np.float64)) ** 2).sum(axis=1))
                begin, end = np.where(places > 0, ends[places - 1], 0), ends[places]
                n = end - begin
                who = ids[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                d = np.repeat(d, n)[who != own[i]]
                who = who[who != own[i]]
                best = np.lexsort((who, d))[:k]
                for c, v in zip(out, (np.full(len(best), own[i]), who[best], d[best]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]), pa.int64()), pa.array(np.concatenate(out[1]), pa.int64()), pa.array(np.concatenate(out[2]), pa.float64())], ["query_id", "vec_id", "score"])

    passes = []
    for block in range(blocks):
        some = F.broadcast(asked.where(F.col("block") == block))  # a row per length, of QUERY_BYTES together
        passes.append(shards.join(some, "dim").mapInArrow(run, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    hits = reduce(DataFrame.unionByName, passes).distinct()
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str, k: int = 10, every: int = 100) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).where((F.col("id") % every == 0) & valid(F.col("v")))
    return lookup(index(rows, k), queries, k)
