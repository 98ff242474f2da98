"""Approximate nearest neighbours by a robust-pruned directed graph in every shard.

Equal vectors are one point of the index.  Points are dealt over shards of about
``SHARD_BYTES`` by a hash of the vector.  In a shard, points join the graph in batches
that grow with it: a greedy search for the point proposes neighbours, and relaxed
distance pruning keeps a diverse few (a candidate goes if a kept neighbour is nearer to
it, by the factor ``ALPHA``, than the point is); each edge is also offered backwards and a
full list is pruned the same way.  A query is a beam search in each shard, whose best
points are measured again in double precision; the shards' lists are merged.

The queries lie in the shared folder as a table, from which each shard's task reads
them block by block, so neither the driver nor a broadcast holds them.  Work for queries
is (queries) x (shards) searches: a shard should be as large as a task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, shared_folder, table
from .op8_tokens import filesystem

#: Bytes of single-precision vectors in a shard.
SHARD_BYTES = 8 << 20
#: Edges a list is pruned to, and that it may grow to before.
DEGREE, FULL = 32, 64
#: Points that a search keeps, while building and for a query.
BUILD, BEAM = 32, 128
ALPHA = 1.2
#: Nodes that every search starts from: the one next to the mean, and the first that joined.
STARTS = 8
#: A search expands this part of its list at a time.
STEPS = 16
#: Searches that run side by side.
TOGETHER = 256
#: Queries that a task holds at a time.
BLOCK = 4096
#: Parts that the rows of one vector are split into where they meet its result.
SALTS = 64

_POINT = "vec binary, dim int, vec_id long"
_HIT = "dim int, vec binary, vec_id long, score double"


class Graph:
    """A directed graph over unit vectors (rows of ``x``, single precision)."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, full: int = FULL, build: int = BUILD, alpha: float = ALPHA):
        self.x, self.degree, self.full, self.alpha = x, degree, full, alpha
        n = len(x)
        # one row more, without edges, stands for "no node"; -1 pads the lists
        self.edges = np.full((n + 1, full), -1, np.int32)
        self.count = np.zeros(n + 1, np.int32)
        order = np.random.default_rng(n).permutation(n)
        middle = int(np.argmax(x @ x.mean(axis=0))) if n else 0
        order = np.concatenate([[middle], order[order != middle]])[:n]
        self.starts = order[:1]
        done = min(1, n)
        while done < n:
            batch = order[done:done + max(1, min(done // 2, 4096))]
            for k in range(0, len(batch), TOGETHER):
                part = batch[k:k + TOGETHER]
                near, sims = self.search(x[part], build)
                self._link(part, near, sims)
            done += len(batch)
            self.starts = order[:min(done, STARTS)]

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that a greedy search with a list of ``width`` ends with, best first, and their cosines;
        node -1 where there are fewer.  Each step expands the best few nodes not yet expanded."""
        m, n = len(q), len(self.x)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True  # where -1 points
        seen[:, self.starts] = True
        w = max(width, len(self.starts))
        ids = np.full((m, w), n, np.int32)
        sims = np.full((m, w), -np.inf, np.float32)
        first = q @ self.x[self.starts].T
        by = np.argsort(-first, axis=1, kind="stable")
        ids[:, :len(self.starts)] = self.starts[by]
        sims[:, :len(self.starts)] = np.take_along_axis(first, by, 1)
        done = ids == n
        live, at_once = np.arange(m), max(2, w // STEPS)
        while len(live):
            row = np.arange(len(live))
            here, held, sim = done[live], ids[live], sims[live]
            fresh_ids, fresh_sims = [held], [sim]
            for _ in range(at_once):
                at = here.argmin(axis=1)
                node = np.where(here[row, at], n, held[row, at])
                here[row, at] = True
                near = self.edges[node]
                new = ~seen[live[:, None], near]
                r, c = np.nonzero(new)
                found = near[r, c]
                seen[live[r], found] = True
                s = np.full(near.shape, -np.inf, np.float32)
                s[r, c] = np.einsum("ij,ij->i", self.x[found], q[live[r]])
                fresh_ids.append(np.where(new, near, n))
                fresh_sims.append(s)
            both, sim = np.concatenate(fresh_ids, 1), np.concatenate(fresh_sims, 1)
            flags = np.concatenate([here, *(x == -np.inf for x in fresh_sims[1:])], 1)
            by = np.argpartition(-sim, w - 1, axis=1)[:, :w]
            by = np.take_along_axis(by, np.argsort(-np.take_along_axis(sim, by, 1), axis=1), 1)
            ids[live] = np.take_along_axis(both, by, 1)
            sims[live] = np.take_along_axis(sim, by, 1)
            done[live] = flags = np.take_along_axis(flags, by, 1)
            live = live[~flags.all(axis=1)]
        ids[ids == n] = -1
        return ids[:, :width], sims[:, :width]

    def _prune(self, near: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Of each row's candidates (best first, -1 for none), the ``degree`` that robust pruning keeps."""
        m, c = near.shape
        rows = np.arange(m)
        v = self.x[near]
        far = 2.0 - 2.0 * np.matmul(v, v.transpose(0, 2, 1))  # squared distances among candidates
        own = 2.0 - 2.0 * sims
        left = near >= 0
        out = np.full((m, self.degree), -1, np.int32)
        for k in range(self.degree):
            at = left.argmax(axis=1)
            some = left[rows, at]
            if not some.any():
                break
            out[:, k] = np.where(some, near[rows, at], -1)
            left &= self.alpha ** 2 * far[rows, at] > own
            left[rows, at] = False
        return out

    def _link(self, part: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        out = self._prune(near, sims)
        self.edges[part, :self.degree] = out
        self.count[part] = (out >= 0).sum(axis=1)
        # the same edges backwards, by their head, nearest first, no more than a full list each
        r, k = np.nonzero(out >= 0)
        tail, head = part[r], out[r, k]
        sim = np.einsum("ij,ij->i", self.x[tail], self.x[head])
        by = np.lexsort((-sim, head))
        tail, head = tail[by], head[by]
        begin = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
        size = np.diff(np.r_[begin, len(head)])
        place = np.arange(len(head)) - np.repeat(begin, size)
        keep = place < self.full
        nodes, size = head[begin], np.minimum(size, self.full)
        offer = np.full((len(nodes), self.full), -1, np.int32)
        offer[np.repeat(np.arange(len(nodes)), size), place[keep]] = tail[keep]
        fits = self.count[nodes] + size <= self.full
        for node_rows, whole in ((np.flatnonzero(fits), False), (np.flatnonzero(~fits), True)):
            node = nodes[node_rows]
            if not len(node):
                continue
            if not whole:
                r, k = np.nonzero(offer[node_rows] >= 0)
                self.edges[node[r], self.count[node[r]] + k] = offer[node_rows[r], k]
                self.count[node] += size[node_rows]
                continue
            cand = np.concatenate([self.edges[node], offer[node_rows]], 1)
            s = np.einsum("ijk,ik->ij", self.x[cand], self.x[node])
            s[cand < 0] = -np.inf
            by = np.argsort(-s, axis=1)[:, :int((cand >= 0).sum(axis=1).max())]
            kept = self._prune(np.take_along_axis(cand, by, 1), np.take_along_axis(s, by, 1))
            self.edges[node] = -1
            self.edges[node, :self.degree] = kept
            self.count[node] = (kept >= 0).sum(axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Shard:
    """The points of one dimension in a shard: distinct vectors, each with its smallest ids."""

    def __init__(self, vecs: list[bytes], ids: list[list[int]], dim: int):
        self.x = np.frombuffer(b"".join(vecs), "<f8").reshape(-1, dim)
        self.norms = np.linalg.norm(self.x, axis=1)
        self.ids = ids
        self.graph = Graph(_unit(self.x))

    def query(self, q: np.ndarray, k: int, beam: int = BEAM) -> Iterator[tuple[int, int, float]]:
        """(row of q, id, cosine) of the k best of each query, best first, ties to the smaller id."""
        step = max(1, min(TOGETHER, (32 << 20) // (len(self.x) + 1)))
        for a in range(0, len(q), step):
            part = q[a:a + step]
            near, _ = self.graph.search(_unit(part), max(beam, k))
            norms = np.linalg.norm(part, axis=1)
            score = np.einsum("ijk,ik->ij", self.x[near], part) / (self.norms[near] * norms[:, None])
            score[near < 0] = -np.inf
            for r in range(len(part)):
                hits = sorted((-s, i) for s, node in zip(score[r].tolist(), near[r].tolist()) if node >= 0 for i in self.ids[node])
                for s, i in hits[:k]:
                    yield a + r, i, -s


def _points(vectors: DataFrame, most: int) -> DataFrame:
    """(vec, dim, vec_id) of the rows that take part, vectors as the bytes of their doubles;
    of the rows of a batch that share a vector, the ``most`` smallest ids."""
    rows = vectors.where("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column("embedding"), batch.column("vec_id").to_numpy()
            held: dict[bytes, list[int]] = {}
            size = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")  # nulls are NaN
            at = np.cumsum(size) - size
            for d in np.unique(size[size > 0]).tolist():
                some = np.flatnonzero(size == d)
                x = flat[at[some][:, None] + np.arange(d)]
                with np.errstate(over="ignore"):
                    norms = np.linalg.norm(x, axis=1)
                good = np.isfinite(norms) & (norms > 0)
                x = x[good] + 0.0  # one zero
                for i, v in zip(ids[some[good]].tolist(), x):
                    held.setdefault(v.tobytes(), []).append(i)
            out = [(v, len(v) // 8, i) for v, mine in held.items() for i in sorted(set(mine))[:most]]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int32()),
                     pa.array([r[2] for r in out], pa.int64())], names=["vec", "dim", "vec_id"])

    return map_arrow(rows, run, _POINT)


def _search_shards(points: DataFrame, queries: str, k: int, shards: int) -> DataFrame:
    """Per shard and query vector of the table at ``queries``, the k nearest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, set[int]] = {}
        for batch in batches:
            for v, i in zip(batch.column("vec").to_pylist(), batch.column("vec_id").to_pylist()):
                held.setdefault(v, set()).add(i)
        if not held:
            return
        by_dim: dict[int, list[bytes]] = {}
        for v in sorted(held):
            by_dim.setdefault(len(v) // 8, []).append(v)
        fs, base = filesystem(queries)
        asked = pads.dataset(base, filesystem=fs, format="parquet")
        for dim, vecs in by_dim.items():
            shard = Shard(vecs, [sorted(held[v])[:k] for v in vecs], dim)
            for block in asked.to_batches(filter=pads.field("dim") == dim, columns=["vec"], batch_size=BLOCK):
                vec = block.column("vec").to_pylist()
                if not vec:
                    continue
                q = np.frombuffer(b"".join(vec), "<f8").reshape(-1, dim)
                row, ids, score = zip(*shard.query(q, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(row), pa.int32()), pa.array([vec[r] for r in row], pa.binary()),
                     pa.array(ids, pa.int64()), pa.array(score, pa.float64())],
                    names=["dim", "vec", "vec_id", "score"])

    return map_arrow(points.repartition(shards, "vec"), run, _HIT)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The k nearest rows (by cosine) that the index finds for each row where ``queries``
    holds: query_id, rank, vec_id, score; the row itself is no candidate.

    Rows whose id is null, or whose embedding is null, empty, zero or holds a null
    or a component that is not finite, take no part (nor those whose squares overflow).
    Vectors of different lengths are no candidates for each other.  Ties go to the
    smaller vec_id; rows that repeat an id and vector are one.  Fewer than k candidates give
    fewer rows, an empty table gives none.  Columns other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    size = vectors.agg(F.sum(F.size("embedding").cast("long") * 4).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_bytes))
    asked = _points(vectors.where(queries), 1 << 30).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    path = shared_folder(spark, "queries")
    asked.write.parquet(f"{path}/rows")
    asked = spark.read.parquet(f"{path}/rows")
    # a hot vector is one row per salt first
    salted = asked.select("vec", "dim", "salt").distinct()
    salted.select("vec", "dim").distinct().write.parquet(f"{path}/vectors")

    # own rows are left out afterwards, so one more than k is kept
    hits = _search_shards(_points(vectors, k + 1), f"{path}/vectors", k + 1, shards)
    best = Window.partitionBy("vec").orderBy(F.desc("score"), "vec_id")
    top = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1) \
        .groupBy("vec").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("hits"))
    lists = salted.select("vec", "salt").join(top, "vec")
    mine = asked.select(F.col("vec_id").alias("query_id"), "vec", "salt").distinct().join(lists, ["vec", "salt"])
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("p", "h")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def op12_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
