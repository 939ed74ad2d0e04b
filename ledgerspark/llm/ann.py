"""Approximate nearest neighbours (operator 4): one navigable small-world graph
per shard, kept as flat neighbour arrays; shard results are merged.

Equal vectors are one point of the index, with all their ids beside it. Points
are dealt by hash to shards of about ``SHARD`` points, so build cost and memory
of a shard stay the same at any size. A point's level is drawn from the hash of
its id. Each level is one int32 array of fixed row length (-1: none); insertion
searches from the top, keeps the neighbours that are closer to the point than
to each other, and trims full rows the same way. Queries go to every shard in
blocks; distances are exact, in double precision on the original vectors, so
merging is a top-k by (distance, id).

Every vector is indexed. Measured recall: see the tests and README. Defined
cases: vectors that are null, empty, all zero or hold a null or non-finite
component take no part; null ids neither; vectors of another length than the
query are no candidates; repeated ids with the same vector count once; fewer
candidates than k are all returned; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD = 4096
LINKS = 16  # neighbours of a new point; rows hold up to 2 (lowest level: 3) times as many
BUILD, SEARCH = 48, 96
BLOCK = 256
K = 10


class SmallWorld:
    """The graph of one shard. ``links[l]`` holds the neighbours on level ``l``."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0):
        self.v = np.ascontiguousarray(vectors, np.float64)
        self.norm = (self.v * self.v).sum(axis=1)
        self.levels, self.entry = levels, entry
        if links is None:
            n, top = len(self.v), int(levels.max()) if len(levels) else 0
            self.links = [np.full((n, LINKS * (3 if lv == 0 else 2)), -1, np.int32) for lv in range(top + 1)]
            self.fill = [np.zeros(n, np.int32) for _ in self.links]
            for i in range(n):
                self._insert(i)
        else:
            self.links = links

    def _far(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances, up to the query's own norm."""
        return self.norm[ids] - 2 * (self.v[ids] @ q)

    def beam(self, q: np.ndarray, start: list[tuple[float, int]], level: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` nearest points found on a level, nearest first."""
        links = self.links[level]
        seen = np.zeros(len(self.v), bool)
        seen[[i for _, i in start]] = True
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            near = links[i]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            far = self._far(q, near)
            if len(best) >= width:
                ok = far < -best[0][0]
                near, far = near[ok], far[ok]
            for x, j in zip(far.tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-x, j))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, j))
                else:
                    continue
                heapq.heappush(todo, (x, j))
        return sorted((-d, i) for d, i in best)

    def _spread(self, cand: list[tuple[float, int]], most: int) -> list[int]:
        """Candidates (nearest first) that are closer to the point than to any taken before; then the nearest others."""
        ids = np.array([i for _, i in cand])
        far = np.array([d for d, _ in cand])
        taken: list[int] = []
        if len(ids):
            own = self.v[ids]
            between = self.norm[ids][:, None] + self.norm[ids][None, :] - 2 * own @ own.T
        open_ = np.ones(len(ids), bool)
        for j in range(len(ids)):
            if open_[j]:
                taken.append(j)
                if len(taken) == most:
                    break
                open_ &= between[j] >= far
        rest = [j for j in range(len(ids)) if j not in set(taken)]
        return ids[taken + rest[: most - len(taken)]].tolist()

    def _insert(self, i: int) -> None:
        if i == 0:
            return
        q, own = self.v[i], int(self.levels[i])
        e = self.entry
        found = [(float(self._far(q, np.array([e]))[0]), e)]
        top = int(self.levels[e])
        for lv in range(top, own, -1):
            found = self.beam(q, found[:1], lv, 1)
        for lv in range(min(own, top), -1, -1):
            found = self.beam(q, found, lv, BUILD)
            links, fill = self.links[lv], self.fill[lv]
            most = links.shape[1] - LINKS  # a full row is trimmed to this many
            base = float(self.norm[i])
            mine = self._spread([(d + base, j) for d, j in found], LINKS)
            links[i, : len(mine)] = mine
            fill[i] = len(mine)
            for j in mine:
                if fill[j] < links.shape[1]:
                    links[j, fill[j]] = i
                    fill[j] += 1
                else:
                    near = np.append(links[j], i)
                    far = self.norm[near] + self.norm[j] - 2 * (self.v[near] @ self.v[j])
                    by = np.argsort(far, kind="stable")
                    links[j] = -1
                    links[j, :most] = self._spread(list(zip(far[by].tolist(), near[by].tolist(), strict=True)), most)
                    fill[j] = most
        if own > top:
            self.entry = i

    def search(self, q: np.ndarray, k: int) -> list[int]:
        if not len(self.v):
            return []
        e = self.entry
        found = [(float(self._far(q, np.array([e]))[0]), e)]
        for lv in range(int(self.levels[e]), 0, -1):
            found = self.beam(q, found[:1], lv, 1)
        return [i for _, i in self.beam(q, found, 0, max(SEARCH, k))[:k]]


def level_of(point: int) -> int:
    """Geometric level with the ratio 1 / ``LINKS``, from the hash of the id."""
    u = (xxhash.xxh3_64_intdigest(int(point).to_bytes(8, "little", signed=True)) + 1) / 2.0**64
    return int(-np.log(u) / np.log(LINKS))


def _build(points: pa.Table) -> pa.Table:
    """One shard's points (of one length) -> one row: ids, vectors, levels, flat links, entry."""
    by = np.argsort(points.column("point").to_numpy(), kind="stable")
    ids = points.column("point").to_numpy()[by]
    v = np.stack(points.column("vector").to_numpy(zero_copy_only=False))[by].astype(np.float64)
    g = SmallWorld(v, np.array([level_of(i) for i in ids.tolist()]))
    return pa.table({
        "shard": pa.array([points.column("shard")[0].as_py()], pa.int32()), "dim": pa.array([v.shape[1]], pa.int32()), "points": pa.array([ids], pa.list_(pa.int64())),
        "vectors": pa.array([v.tobytes()], pa.binary()), "levels": pa.array([g.levels], pa.list_(pa.int64())),
        "links": pa.array([[x.tobytes() for x in g.links]], pa.list_(pa.binary())), "entry": pa.array([g.entry], pa.int64())})


_INDEX = "shard int, dim int, points array<bigint>, vectors binary, levels array<bigint>, links array<binary>, entry long"


def build_index(points: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per shard and vector length; ``points``: point (id), vector (array<double>)."""
    n = points.count()
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("point"), F.lit(max(1, -(-n // shard)))).cast("int"))
    dealt = dealt.withColumn("dim", F.size("vector"))
    # a few partitions per shard: small shards are much work, so they must not be put together by size
    dealt = dealt.repartition(4 * max(1, -(-n // shard)), "shard", "dim")
    return dealt.groupBy("shard", "dim").applyInArrow(_build, _INDEX)


def _search(k: int):
    """Rows in order of shard and length, an index shard before the blocks of queries that meet it -> the shard's k
    nearest points of each. One shard is held at a time; queries of a length that the shard does not have find nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, graph, ids = None, None, None
        for batch in batches:
            for row in range(len(batch)):
                get = lambda c: batch.column(c)[row]  # noqa: B023, E731
                key = (get("shard").as_py(), get("dim").as_py())
                if not get("block").is_valid:
                    last, ids = key, get("points").values.to_numpy()
                    v = np.frombuffer(get("vectors").as_py(), np.float64).reshape(len(ids), key[1])
                    links = [np.frombuffer(x, np.int32).reshape(len(ids), -1) for x in get("links").as_py()]
                    graph = SmallWorld(v, get("levels").values.to_numpy(), links, get("entry").as_py())
                    continue
                if key != last:
                    continue
                out_q, out_p, out_d = [], [], []
                for q in get("block").as_py():
                    vec = np.array(q["vector"], np.float64)
                    near = graph.search(vec, k)
                    d = np.sqrt(((graph.v[near] - vec) ** 2).sum(axis=1))
                    out_q += [q["query_id"]] * len(near)
                    out_p += ids[near].tolist()
                    out_d += d.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_q, pa.int64()), pa.array(out_p, pa.int64()), pa.array(out_d, pa.float64())],
                    names=["query_id", "point", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array<double>) of the vectors that take part."""
    v = vectors.where("vec_id is not null and size(embedding) > 0").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.coalesce(sound, F.lit(False))).where(F.exists("vector", lambda x: x != 0)).distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (query_id, vector) the ``k`` nearest other vectors found.

    ``vectors``: vec_id, vector, as ``usable`` gives them.
    """
    vectors, queries = materialize(vectors), materialize(queries)
    # equal vectors: one point, named by its smallest id; of its ids only the k + 1 smallest can be in a result
    first = materialize(vectors.groupBy("vector").agg(F.min("vec_id").alias("point")))
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = vectors.withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    few = materialize(few.join(first, "vector").select("point", "vec_id"))
    points = first
    index = materialize(build_index(points, shard))

    n = max(1, -(-queries.count() // BLOCK))
    blocks = queries.withColumn("dim", F.size("vector")).withColumn("no", F.pmod(F.xxhash64("query_id"), F.lit(n)))
    blocks = blocks.groupBy("no", "dim").agg(F.collect_list(F.struct("query_id", "vector")).alias("block"))
    # every block meets every shard; no join, which would broadcast all pairs (their size is not that of the queries) and
    # carry a shard's graph beside each of its blocks
    shards = max(1, -(-points.count() // shard))
    asked = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    tasks = index.withColumn("no", F.lit(-1).cast("long")).unionByName(asked, allowMissingColumns=True)
    tasks = tasks.repartition(4 * shards, "shard", "dim").sortWithinPartitions("shard", "dim", "no")
    found = tasks.mapInArrow(_search(k + 1), "query_id long, point long, score double")
    top = Window.partitionBy("query_id").orderBy("score", "point")
    found = found.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k + 1)
    hits = found.join(few, "point").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_hnsw_nearest(spark, sf_dir: str) -> DataFrame:
    """Contract query: the 10 nearest of each vector whose id is divisible by 100."""
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector"))
