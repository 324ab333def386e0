"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt into shells of norms within a factor of two, and by hash into shards of about SHARD rows, which
bounds a task however many there are and keeps a few very long vectors from making all others look equally near. A shard's
graph has levels of geometrically falling size; on each, a node's links are the nearest of that level, those first that
are nearer to it than to any link already taken, the reverse of these links, and LONG links across the shard at the lowest
level, so that tight clusters stay connected. They are stored as flat arrays (row
starts, neighbours) in a file of the shared folder, beside the vectors. Inner products become distances by one added
coordinate. Queries, in blocks, descend the levels greedily and widen to a pool of POOL at the lowest one; the best of
all shards are merged. Scores are computed in double precision from the original vectors.

Nulls, ties and odd rows: vectors that are null, empty or zero, or hold null or non-finite components, and rows without
vec_id take no part; vectors meet those of equal length only; equal vectors are one node that keeps as many of its
smallest vec_ids as any answer can need; equal scores go to the smaller vec_id; rows that repeat vec_id and vector count
once; an empty table gives no rows. Other columns than vec_id and embedding are not read.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .wacz import filesystem

SHARD, NEAR, POOL, TOP, QUERY_BLOCK = 16_384, 32, 192, 20, 512
#: Long links of a node, and nodes spread over a shard from which every search starts besides the one it descends to.
LONG, ENTRIES = 4, 64
#: Levels: each has one in LEVEL of the nodes of the one below.
LEVEL = 16


def links(points: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Row starts and neighbours: of each point its near links and those that lead to it, at most 2 near."""
    n = len(points)
    k = min(n - 1, near + near // 2)
    if k <= 0:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int32)
    square = (points * points).sum(1)
    forward = np.empty((n, min(k, near)), np.int32)
    weight = np.empty((n, min(k, near)), np.float32)
    for a in range(0, n, 256):
        far = square[None, :] - 2 * (points[a : a + 256] @ points.T)
        rows = np.arange(len(far))
        far[rows, rows + a] = np.inf
        at = np.argpartition(far, k - 1, 1)[:, :k]
        own = np.take_along_axis(far, at, 1)
        order = np.argsort(own, 1, kind="stable")
        at, own = np.take_along_axis(at, order, 1), np.take_along_axis(own, order, 1) + square[a : a + 256, None]
        some = points[at]
        between = square[at][:, :, None] + square[at][:, None, :] - 2 * (some @ some.transpose(0, 2, 1))
        taken = np.zeros(at.shape, bool)
        for j in range(k):
            taken[:, j] = ~((between[:, j, :j] <= own[:, j, None]) & taken[:, :j]).any(1)
        order = np.argsort(~taken, 1, kind="stable")[:, :near]
        forward[a : a + 256], weight[a : a + 256] = np.take_along_axis(at, order, 1), np.take_along_axis(own, order, 1)
    src = np.repeat(np.arange(n), forward.shape[1])
    dst, far = forward.ravel().astype(np.int64), weight.ravel()
    both = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    src, dst = both // n, both % n
    degree = np.bincount(src, minlength=n)
    if degree.max() > 2 * near:  # a hub keeps its nearest
        far = square[dst] - 2 * (points[src] * points[dst]).sum(1)
        order = np.lexsort((far, src))
        src, dst = src[order], dst[order]
        keep = np.arange(len(src)) - np.repeat(np.cumsum(degree) - degree, degree) < 2 * near
        src, dst = src[keep], dst[keep]
        degree = np.bincount(src, minlength=n)
    return np.concatenate([[0], np.cumsum(degree)]), dst.astype(np.int32)


class Graph:
    def __init__(self, arrays) -> None:
        self.vectors, self.points, self.ids, self.id_starts = arrays["vectors"], arrays["points"], arrays["ids"], arrays["id_starts"]
        self.levels = []
        for i in range(int(arrays["levels"])):
            nodes, starts, flat = arrays[f"nodes{i}"], arrays[f"starts{i}"], arrays[f"flat{i}"]
            degree = np.diff(starts)
            table = np.full((len(nodes), max(1, degree.max(initial=0))), -1, np.int32)
            table[np.arange(table.shape[1])[None, :] < degree[:, None]] = flat
            self.levels.append((nodes, table))

    @staticmethod
    def build(vectors: np.ndarray, members: list[list[int]], near: int = NEAR) -> dict[str, np.ndarray]:
        n = len(vectors)
        scaled = vectors / np.abs(vectors).max()
        square = (scaled * scaled).sum(1)
        points = np.concatenate([scaled, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1)
        points = (points / np.sqrt(square.max())).astype(np.float32)
        u = (common.mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(LEVEL)).astype(int)
        out = {"vectors": vectors, "points": points, "ids": np.array([x for m in members for x in m], np.int64), "id_starts": np.cumsum([0] + [len(m) for m in members])}
        for i in range(level.max() + 1):
            nodes = np.flatnonzero(level >= i)
            # Differences between the nodes of a shard, not their common part, are what single precision has to hold.
            starts, flat = links(points[nodes] - points.mean(0), near if i == 0 else near // 2)
            if i == 0 and n > 2 * LONG:
                degree = np.diff(starts)
                far = (common.mix(np.arange(n * LONG, dtype=np.uint64) + np.uint64(n)) % np.uint64(n)).astype(np.int32).reshape(n, LONG)
                flat = np.insert(flat, np.repeat(starts[1:], LONG), far.ravel())
                starts = np.concatenate([[0], np.cumsum(degree + LONG)])
            out |= {f"nodes{i}": nodes, f"starts{i}": starts, f"flat{i}": flat}
        return out | {"levels": np.array(level.max() + 1)}

    def descend(self, q: np.ndarray) -> np.ndarray:
        """Entry nodes of level 0."""
        now = np.full(len(q), self.levels[-1][0][0])
        for nodes, table in self.levels[:0:-1]:
            at = np.searchsorted(nodes, now)
            best = np.einsum("qd,qd->q", q, self.points[now])
            live = np.arange(len(q))
            while len(live):
                near = table[at[live]]
                score = np.where(near >= 0, np.einsum("qd,qkd->qk", q[live], self.points[nodes[near]]), -np.inf)
                to = score.argmax(1)
                top = score[np.arange(len(live)), to]
                up = top > best[live]
                live, to, top, near = live[up], to[up], top[up], near[up]
                at[live], best[live] = near[np.arange(len(live)), to], top
            now = nodes[at]
        return now

    def search(self, queries: np.ndarray, pool: int = POOL, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1: none) and approximate scores of the pool of each query."""
        q = queries / np.abs(queries).max(1, keepdims=True)
        q = np.concatenate([q, np.zeros((len(queries), 1))], 1).astype(np.float32)
        table, m = self.levels[0][1], len(q)
        seen = np.zeros((m, len(self.points) + 1), bool)
        nodes = np.full((m, pool), -1, np.int32)
        score = np.full((m, pool), -np.inf, np.float32)
        done = np.ones((m, pool), bool)
        entry = self.descend(q)
        nodes[:, 0], score[:, 0], done[:, 0] = entry, np.einsum("qd,qd->q", q, self.points[entry]), False
        seen[np.arange(m), entry] = True
        spread = np.unique(np.linspace(0, len(self.points) - 1, min(ENTRIES, pool - 1)).astype(np.int32))
        k = len(spread)
        nodes[:, 1 : k + 1], score[:, 1 : k + 1], done[:, 1 : k + 1] = spread, q @ self.points[spread].T, False
        same = spread[None, :] == entry[:, None]
        nodes[:, 1 : k + 1][same], score[:, 1 : k + 1][same], done[:, 1 : k + 1][same] = -1, -np.inf, True
        seen[:, spread] = True
        live = np.arange(m)
        while len(live):
            open_ = np.where(done[live], -np.inf, score[live])
            pick = np.argsort(-open_, 1, kind="stable")[:, :width]
            good = np.take_along_axis(open_, pick, 1) > -np.inf
            some = good.any(1)
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            rows = live[:, None]
            from_ = np.where(good, nodes[rows, pick], -1)
            done[rows, pick] = True
            near = np.where(from_[:, :, None] >= 0, table[from_], -1).reshape(len(live), -1)
            near = np.where(seen[rows, near], -1, near)
            near = np.sort(near, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[rows, near] = True
            seen[:, -1] = False
            r, c = np.nonzero(near >= 0)
            got = np.full(near.shape, -np.inf, np.float32)
            got[r, c] = np.einsum("kd,kd->k", q[live[r]], self.points[near[r, c]])
            all_score = np.concatenate([score[live], got], 1)
            all_nodes = np.concatenate([nodes[live], near.astype(np.int32)], 1)
            all_done = np.concatenate([done[live], got == -np.inf], 1)
            keep = np.argpartition(-all_score, pool - 1, 1)[:, :pool]
            score[live], nodes[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (all_score, all_nodes, all_done))
        return nodes, score

    def answers(self, queries: np.ndarray, own: np.ndarray, top: int):
        """(query, vec_id, score) of at least the top members found, without the query itself."""
        nodes, _ = self.search(queries, max(POOL, 4 * top))
        for i, found in enumerate(nodes):
            found = found[found >= 0]
            exact = (self.vectors[found] * queries[i]).sum(1)
            order = np.lexsort((self.ids[self.id_starts[found]], -exact))
            ids = [self.ids[self.id_starts[f] : self.id_starts[f + 1]] for f in found[order]]
            scores = np.repeat(exact[order], [len(x) for x in ids])
            ids = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
            use = ids != own[i]
            ids, scores = ids[use], scores[use]
            order = np.lexsort((ids, -scores))[:top]
            yield own[i], ids[order], scores[order]


def usable(rows: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return ok.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def _save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    path, data = f"{root}/{uuid.uuid4().hex}.npz", io.BytesIO()
    np.savez(data, **arrays)
    with files.open_output_stream(path) as out:
        out.write(data.getbuffer())
    return path


def _load(files, path: str) -> dict[str, np.ndarray]:
    with files.open_input_file(path) as f, np.load(io.BytesIO(f.readall())) as data:
        return dict(data)


def nearest(rows: DataFrame, queries: DataFrame | None = None, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the top nearest rows found of every query (default: vec_id divisible by 20)."""
    ok = usable(rows)
    queries = usable(queries) if queries is not None else ok.where("vec_id % 20 = 0")
    folder = f"{common.shared_dir(rows.sparkSession)}/lattica-hnsw-{uuid.uuid4().hex}"
    # The limit on ranks is applied before the shuffle too, so that a vector with very many copies is no hot group.
    ranked = ok.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    most = F.array_max(F.transform("v", F.abs))
    norm = F.log2(most) + F.log2(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most")))) / 2
    distinct = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("most", most)
    distinct = common.stored(distinct.select("v", "ids", F.size("v").alias("dim"), F.floor(norm + 0.5).cast("int").alias("shell")), "vectors")
    # A row per length and power of two, of which doubles have about 2,100.
    shards = {(r["dim"], r["shell"]): -(-r["n"] // shard) for r in distinct.groupBy("dim", "shell").agg(F.count("*").alias("n")).collect()}
    if not shards:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    many = rows.sparkSession.createDataFrame([(*k, n) for k, n in shards.items()], "dim int, shell int, shards int")
    keyed = distinct.join(F.broadcast(many), ["dim", "shell"]).withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def build(key, group):
        dim = key[0].as_py()
        group = group.take(pa.array(np.argsort([x[0] for x in group["ids"].to_pylist()], kind="stable")))
        vectors = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return pa.table({"dim": pa.array([dim], pa.int32()), "path": [_save(folder, Graph.build(vectors, group["ids"].to_pylist()))]})

    graphs = common.stored(keyed.groupBy("dim", "shell", "shard").applyInArrow(build, "dim int, path string"), "graphs")

    def pack(key, group):
        dim = key[0].as_py()
        vectors = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return pa.table({"dim": pa.array([dim], pa.int32()), "queries": [_save(folder, {"v": vectors, "id": group["vec_id"].to_numpy()})]})

    n = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.distinct().withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    blocks = common.stored(asked.groupBy("dim", "block").applyInArrow(pack, "dim int, queries string"), "queries")

    def answer(batches):
        files, _ = filesystem(folder)
        held, graph = None, None
        for batch in batches:
            for path, asked_ in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if path != held:
                    held, graph = path, Graph(_load(files, path))
                block = _load(files, asked_)
                got = list(graph.answers(block["v"], block["id"], top))
                query = np.repeat([g[0] for g in got], [len(g[1]) for g in got]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))], ["query_id", "vec_id", "score"])

    # Paths only: every block of queries meets every shard, and the files are read where they meet.
    work = graphs.join(blocks, "dim").select("path", "queries").repartition(min(10_000, sum(shards.values()) * n))
    found = work.mapInArrow(answer, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
