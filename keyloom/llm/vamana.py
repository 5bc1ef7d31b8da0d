"""Approximate nearest neighbours over robust-pruned directed graphs.

1. Equal vectors become one *class* with its smallest ids, so thousands of copies are one node. More ids of
   a class than a query can return are never needed (``k + 1``), and the window limit keeps no more.
2. Classes are dealt to shards by hash: ``shard_rows`` or more each, so that there are no more shards than
   shuffle partitions, but never more than about ``SHARD_BYTES`` of vectors: bounded work and memory for a
   task, even under skew, and few shards for each query to visit. Each shard builds its own graph. Points enter in
   growing batches: a greedy search over the graph so far proposes neighbours, relaxed distance pruning
   (factor ``alpha``) keeps diverse edges, and back edges are pruned alike. The graphs are written to the
   shared folder; the index holds every row.
3. Queries (classes with a query id) go to every shard in blocks, behind the shard's graph in one sorted stream:
   a task reads a graph once and holds one graph and one block. A beam search of width ``beam`` answers each, and
   distances are recomputed in double precision on the original vectors.
4. The best of all shards are kept for each class and expanded to ids: nearest first, ties to smaller ids.

Searches run in lockstep over a block of queries, as array operations, with distances in single precision on
vectors scaled by the largest component of shard and block. Exact distances scale each difference by a power of
two, so neither very large nor very small components overflow or vanish; a distance beyond the range of doubles is
infinite, and its row still counts. Where one shard mixes magnitudes 1e38 apart, its smaller vectors look alike to
the search.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors
are compared only with those of the same length; rows with a null id take no part; of rows that repeat an id
the one with the smallest vector stands for it; a query gets all candidates if there are fewer than ``k``;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, shuffle_parts

SHARD_ROWS = 4096
SHARD_BYTES = 64 << 20
DEGREE = 24
BEAM = 64
ALPHA = 1.2
BLOCK = 512


def _unique_rows(ids: np.ndarray, dist: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest ``width`` distinct ids; -1 marks an empty place, and those come last."""
    by = np.argsort(ids, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)
    empty = ids < 0
    empty[:, 1:] |= ids[:, 1:] == ids[:, :-1]
    ids = np.where(empty, -1, ids)
    by = np.lexsort((dist, empty), axis=1)[:, :width]
    return np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows along the last axis, without overflow or underflow on the way."""
    with np.errstate(over="ignore"):
        diff = x - v
        top = np.abs(diff).max(axis=-1)
        shift = np.where(np.isfinite(top), np.frexp(top)[1], 0)
        diff = np.ldexp(diff, -shift[..., None])
        return np.ldexp(np.sqrt((diff * diff).sum(axis=-1)), shift)


class Graph:
    """A directed graph over the rows of ``x`` (float32), with ``edges[i]`` padded by -1."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, edges: np.ndarray | None = None, entry: int = 0):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        self.degree, self.alpha = degree, alpha
        self.edges = np.full((len(x), degree), -1, dtype=np.int32) if edges is None else edges
        self.entry = entry

    def _dist(self, q: np.ndarray, q_sq: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of ids."""
        safe = np.maximum(ids, 0)
        d = q_sq[:, None] + self.sq[safe] - 2 * np.einsum("qd,qkd->qk", q, self.x[safe])
        return np.where(ids < 0, np.inf, np.maximum(d, 0))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beam search for all queries at once: the beam's ids and distances, and every node expanded."""
        q = np.ascontiguousarray(q, dtype=np.float32)
        q_sq = np.einsum("ij,ij->i", q, q)
        m = len(q)
        ids = np.full((m, width), -1, dtype=np.int64)
        ids[:, 0] = self.entry
        dist = np.full((m, width), np.inf, dtype=np.float32)
        dist[:, :1] = self._dist(q, q_sq, ids[:, :1])
        seen = np.zeros((m, len(self.x)), dtype=bool)  # proposed before
        seen[:, self.entry] = True
        done = np.zeros((m, width), dtype=bool)
        active = np.arange(m)
        visited: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            open_dist = np.where(done[active] | (ids[active] < 0), np.inf, dist[active])
            pick = open_dist.argmin(axis=1)
            live = np.isfinite(open_dist[np.arange(len(active)), pick])
            active, pick = active[live], pick[live]
            if not len(active):
                break
            node = ids[active, pick]
            done[active, pick] = True
            visited.append((active, node))
            near = self.edges[node].astype(np.int64)
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            near = np.where(fresh, near, -1)
            rows, cols = np.nonzero(fresh)
            seen[active[rows], near[rows, cols]] = True
            d = self._dist(q[active], q_sq[active], near)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_dist = np.concatenate([dist[active], d], axis=1)
            all_done = np.concatenate([done[active], np.zeros(near.shape, dtype=bool)], axis=1)
            by = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            ids[active] = np.take_along_axis(all_ids, by, 1)
            dist[active] = np.take_along_axis(all_dist, by, 1)
            done[active] = np.take_along_axis(all_done, by, 1)
        count = np.zeros(m, dtype=np.int64)
        log = np.full((m, len(visited)), -1, dtype=np.int64)
        for act, node in visited:
            log[act, count[act]] = node
            count[act] += 1
        return ids, dist, log

    def prune(self, points: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning for many points: keep the nearest candidate, drop those much nearer to it, go on."""
        cand = np.where(cand == points[:, None], -1, cand)
        d = self._dist(self.x[points], self.sq[points], cand)
        cand, d = _unique_rows(cand, d, cand.shape[1])
        out = np.full((len(points), self.degree), -1, dtype=np.int32)
        alive = cand >= 0
        factor = np.float32(self.alpha * self.alpha)
        for k in range(self.degree):
            first = alive.argmax(axis=1)
            rows = np.flatnonzero(alive[np.arange(len(points)), first])
            if not len(rows):
                break
            star = cand[rows, first[rows]]
            out[rows, k] = star
            between = self._dist(self.x[star], self.sq[star], cand[rows])
            alive[rows] &= factor * between > d[rows]
            alive[rows, first[rows]] = False
        return out

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> Graph:
        g = cls(x, degree, alpha)
        n = len(x)
        order = np.argsort((np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11), kind="stable")
        center = g.x.mean(axis=0, dtype=np.float64).astype(np.float32)
        g.entry = int(((g.x - center) ** 2).sum(axis=1).argmin())
        order = np.concatenate(([g.entry], order[order != g.entry]))
        at = 1
        while at < n:
            batch = order[at : at + min(max(at, 1), 512)]
            ids, _, log = g.search(g.x[batch], beam)
            new = g.prune(batch, np.concatenate([ids, log], axis=1))
            g.edges[batch] = new
            # back edges, pruned where a node would get too many
            src, slot = np.nonzero(new >= 0)
            to, frm = new[src, slot].astype(np.int64), batch[src]
            by = np.argsort(to, kind="stable")
            to, frm = to[by], frm[by]
            nodes, first, n_in = np.unique(to, return_index=True, return_counts=True)
            extra = np.full((len(nodes), int(n_in.max()) if len(nodes) else 0), -1, dtype=np.int64)
            extra[np.repeat(np.arange(len(nodes)), n_in), np.arange(len(to)) - np.repeat(first, n_in)] = frm
            both = np.concatenate([g.edges[nodes].astype(np.int64), extra], axis=1)
            many = (both >= 0).sum(axis=1) > degree
            if many.any():
                g.edges[nodes[many]] = g.prune(nodes[many], both[many])
            few = np.flatnonzero(~many)
            if len(few):
                compact = np.argsort(both[few] < 0, axis=1, kind="stable")[:, :degree]
                g.edges[nodes[few]] = np.take_along_axis(both[few], compact, 1)
            at += len(batch)
        return g


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of lists of ``dim`` numbers as a matrix, without Python objects."""
    return np.concatenate([c.flatten().to_numpy().reshape(-1, dim) for c in column.chunks])


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, vec)`` of the rows that take part, in double precision; of several rows with one id the smallest usable vector."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull())
    huge = 1.7976931348623157e308
    rows = rows.filter(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) <= huge)) & F.exists("vec", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    return rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # one zero only


def classes(vectors: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Distinct usable vectors ``(cls, vec, ids)``: ``ids`` are the smallest ``k + 1``; ``cls`` the smallest."""
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = usable(vectors, id_col=id_col, vec_col=vec_col).withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("cls"), "vec", "ids")


def search(vectors: DataFrame, *, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: the ``k`` nearest of each row whose id divides by ``query_every``."""
    spark = vectors.sparkSession
    stage = Stage(spark, "vamana")
    known = stage.put("classes", classes(vectors, k, id_col=id_col, vec_col=vec_col))
    n, dims = known.agg(F.count("*"), F.max(F.size("vec"))).first()
    most = max(256, SHARD_BYTES // (8 * (dims or 1) + 4 * DEGREE))
    shards = max(1, -(-n // most), min(-(-n // shard_rows), shuffle_parts(spark)))

    def build(key, table):
        cls = table.column("cls").to_numpy()
        by = np.argsort(cls, kind="stable")
        x = _matrix(table.column("vec"), key[0].as_py())[by]
        g = Graph.build(x / np.abs(x).max(), beam=beam)  # edges don't depend on the scale; single precision does
        one = lambda v, t: pa.array([v], t)
        return pa.table({"dim": one(x.shape[1], pa.int64()), "shard": one(key[1].as_py(), pa.int64()), "entry": one(g.entry, pa.int64()), "cls": one(cls[by].astype("<i8").tobytes(), pa.binary()), "x": one(x.astype("<f8").tobytes(), pa.binary()), "edges": one(g.edges.astype("<i4").tobytes(), pa.binary())})

    dealt = known.select("cls", "vec", F.size("vec").cast("long").alias("dim"), F.pmod(F.xxhash64("cls"), F.lit(shards)).alias("shard"))
    graphs = stage.put("graphs", dealt.groupBy("dim", "shard").applyInArrow(build, "dim long, shard long, entry long, cls binary, x binary, edges binary"))

    # Queries: every id that divides by query_every, by class. Copies of a query share one search.
    own = usable(vectors.filter(F.col(id_col).cast("long") % query_every == 0), id_col=id_col, vec_col=vec_col)
    own = own.join(known.select("cls", "vec"), "vec").select("id", "cls", "vec")
    own = stage.put("queries", own)
    q = own.select("cls", "vec").distinct().withColumn("dim", F.size("vec").cast("long"))
    q = q.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(max(1, -(-q.count() // BLOCK)))))
    blocks = q.groupBy("dim", "block").agg(F.collect_list("cls").alias("qs"), F.flatten(F.collect_list("vec")).alias("vs"))
    # each block meets each shard, behind its graph: one stream for each shard
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    graphs = graphs.withColumn("block", F.lit(-1).cast("long"))
    stream = graphs.unionByName(blocks, allowMissingColumns=True).repartition(shuffle_parts(spark), "dim", "shard").sortWithinPartitions("dim", "shard", "block")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, x, cls, where = None, None, None, None
        for b in batches:
            for i in range(b.num_rows):
                dim, shard = b.column("dim")[i].as_py(), b.column("shard")[i].as_py()
                if b.column("block")[i].as_py() < 0:
                    where = (dim, shard)
                    x = np.frombuffer(b.column("x")[i].as_buffer(), "<f8").reshape(-1, dim)
                    cls = np.frombuffer(b.column("cls")[i].as_buffer(), "<i8")
                    edges = np.frombuffer(b.column("edges")[i].as_buffer(), "<i4").reshape(len(x), -1)
                    scale = np.abs(x).max()
                    g = Graph(x / scale, edges.shape[1], edges=edges, entry=b.column("entry")[i].as_py())
                    continue
                if where != (dim, shard):  # a shard without vectors
                    continue
                names = b.column("qs")[i].values.to_numpy()
                wanted = b.column("vs")[i].values.to_numpy().reshape(-1, dim)
                for at in range(0, len(names), 256):
                    v = wanted[at : at + 256]
                    top = np.abs(v).max()
                    if top > 1e15 * scale:  # queries far larger than the shard: all of it is near zero then
                        own = Graph(x / top, g.degree, edges=g.edges, entry=g.entry)
                        ids, _, log = own.search(v / top, max(beam, k + 1))
                    else:
                        ids, _, log = g.search(v / scale, max(beam, k + 1))
                    found = np.concatenate([ids, log], axis=1)
                    found, d = _unique_rows(found, distances(x[np.maximum(found, 0)], v[:, None, :]), k + 1)
                    r, c = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 256][r], pa.int64()), pa.array(cls[found[r, c]], pa.int64()), pa.array(d[r, c])], ["q", "cls", "score"])

    near = stream.select("dim", "shard", "block", "x", "cls", "edges", "entry", "qs", "vs").mapInArrow(answer, "q long, cls long, score double")
    best = F.row_number().over(Window.partitionBy("q").orderBy("score", "cls"))
    near = near.withColumn("r", best).filter(F.col("r") <= k + 1).drop("r")
    members = near.join(known.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
    few = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    members = stage.put("answers", members.withColumn("r", few).filter(F.col("r") <= k + 1).drop("r"))
    lists = members.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    mine = own.select(F.col("id").alias("query_id"), F.col("cls").alias("q")).join(lists, "q")
    mine = mine.select("query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return mine.select("query_id", F.posexplode("found").alias("pos", "f")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
