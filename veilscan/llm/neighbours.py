"""Approximate nearest neighbours by largest inner product, over a hierarchical k-means tree.

With one more component, sqrt(M^2 - |x|^2) for M the largest norm (0 for queries), the largest inner product is the
smallest distance. A tree is fitted to a bounded sample; every vector goes down it to a leaf. A query visits leaves
best bin first: a priority queue holds the branches not taken by their distance. Visits widen (1, 2, 4, ... leaves)
until, for calibration queries held against all vectors, the leaves visited hold ``recall`` of their true neighbours.
A query goes on beyond that width until the leaves it has visited hold k candidates, own rows not counted, or it has
visited all. Candidates are scored on the original vectors in double precision, ties go to the smaller id.

Scale: the tree has ``leaves`` nodes at most and is broadcast. A leaf's vectors are dealt to blocks of bounded size, so
that a leaf of a million equal vectors is as many blocks; its queries too. Blocks keep each query's best k.

Vectors null, zero, of another length than most of the sample's, or holding null or non-finite components take no
part. Rows that repeat a vector are candidates each; those that repeat an id are not their own candidates. Empty
tables give none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.work import Work


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Tree:
    """Inner nodes: (centres, children); a child is a node or, negative, a leaf."""

    def __init__(self, x: np.ndarray, branch: int = 8, leaf: int = 64, leaves: int = 4096, seed: int = 3):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        leaf = max(leaf, len(x) // leaves * 2)
        rng = np.random.default_rng(seed)
        self.nodes.append((np.zeros((0, x.shape[1])), []))
        todo = [(0, x)]
        while todo:
            at, part = todo.pop()
            k = min(branch, len(np.unique(part, axis=0)))
            c = kmeans(part, k, rng)
            near = np.argmin((c * c).sum(1) - 2 * part @ c.T, axis=1)
            kids = []
            for j in range(k):
                own = part[near == j]
                if len(own) > leaf and len(own) < len(part):
                    self.nodes.append((c[:0], []))
                    kids.append(len(self.nodes) - 1)
                    todo.append((kids[-1], own))
                else:
                    self.leaves += 1
                    kids.append(-self.leaves)
            self.nodes[at] = (c, kids)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Each vector's leaf (from 0), nearest centre by nearest centre."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            c, kids = self.nodes[at]
            near = np.argmin((c * c).sum(1) - 2 * x[rows] @ c.T, axis=1)
            for j, kid in enumerate(kids):
                own = rows[near == j]
                if kid < 0:
                    out[own] = -kid - 1
                elif len(own):
                    todo.append((kid, own))
        return out

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first leaves of a best-bin-first search: ``most``, and more until they hold ``need`` vectors by ``held``."""
        heap, out, n = [(0.0, 0, 0)], [], 0
        while heap and (len(out) < most or need > 0):
            _, _, at = heapq.heappop(heap)
            if at < 0:
                out.append(-at - 1)
                need -= 0 if held is None else int(held[-at - 1])
                continue
            c, kids = self.nodes[at]
            d = ((c - q) ** 2).sum(1)
            for x, kid in zip(d.tolist(), kids, strict=True):
                n += 1
                heapq.heappush(heap, (x, n, kid))
        return out


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, and their rows."""
    v = [x for x in enumerate(column.to_pylist()) if x[1] is not None]
    return np.array([x for _, x in v], float).reshape(len(v), -1), np.array([i for i, _ in v], np.int64)


def best(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int):
    """Rows (query id, id, score) of each query's k best among x but its own; equal vectors have equal scores."""
    rough = q @ x.T
    rough[qid[:, None] == ids[None, :]] = -np.inf
    out = []
    for i in range(len(q)):
        r = rough[i]
        at = np.arange(len(r)) if len(r) <= k else np.flatnonzero(r >= np.partition(r, len(r) - k)[len(r) - k] - 1e-9 * (1 + np.abs(r[np.isfinite(r)]).max(initial=0)))
        at = at[np.isfinite(r[at])]
        s = (x[at] * q[i]).sum(axis=1)
        top = np.lexsort((ids[at], -s))[:k]
        out.append((np.full(len(top), qid[i]), ids[at][top], s[top]))
    return [np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3)]


FOUND = "query_id long, vec_id long, score double"


def _found(qid, ids, s) -> pa.Table:
    return pa.table({"query_id": pa.array(qid.astype(np.int64)), "vec_id": pa.array(ids.astype(np.int64)), "score": pa.array(s.astype(float))})


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.97, sample: int = 20_000, calibrate: int = 128, block: int = 4096, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    work = Work(spark, "ann")
    v = vectors.select(vectors[id_col].cast("long").alias("id"), F.transform(vectors[vec_col], lambda c: c.cast("double")).alias("v")).where("id is not null and v is not null")
    v = v.where("size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(v, c -> c <> 0)")
    v = work.save(v.withColumn("norm2", F.expr("aggregate(v, 0D, (a, c) -> a + c * c)")))
    top = v.agg(F.max("norm2"), F.count("*"), F.mode(F.size("v"))).first()
    if not top[1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, largest = top[2], float(top[0])
    v = v.where(F.size("v") == dims)
    longer = v.withColumn("x", F.concat("v", F.array(F.sqrt(F.greatest(F.lit(0.0), F.lit(largest) - F.col("norm2"))))))
    # a sample bounded in rows and in numbers
    fit = np.array([r[0] for r in longer.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(min(sample, max(256, 4_000_000 // dims))).select("x").collect()], float)
    tree = Tree(fit)
    queries = v.where(F.col("id") % every == 0)
    shared = spark.sparkContext.broadcast(tree)

    def leaves(batches):
        for b in batches:
            x, _ = matrix(b.column(2))
            leaf = shared.value.leaf_of(x) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], ["id", "v", "leaf"])

    index = work.save(longer.select("id", "v", "x").mapInArrow(leaves, "id long, v array<double>, leaf long"))
    # calibration: some queries against all vectors, in blocks
    trial = queries.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(calibrate).collect()
    width = 1
    if trial:
        held = spark.sparkContext.broadcast((np.array([r[0] for r in trial]), np.array([r[1] for r in trial], float)))

        def truth(batches):
            for b in batches:
                x, _ = matrix(b.column(1))
                if len(x):
                    t = _found(*best(b.column(0).to_numpy(), x, *held.value, k))
                    leaf = dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
                    yield pa.RecordBatch.from_arrays([t["query_id"].combine_chunks(), t["vec_id"].combine_chunks(), t["score"].combine_chunks(), pa.array([leaf[i] for i in t["vec_id"].to_pylist()], pa.int64())], ["query_id", "vec_id", "score", "leaf"])

        true = _top(index.mapInArrow(truth, FOUND + ", leaf long"), k).select("query_id", "leaf").collect()  # calibrate * k rows
        order = {qid: {leaf: i for i, leaf in enumerate(tree.visits(np.append(q, 0.0), tree.leaves))} for qid, q in zip(*held.value, strict=True)}
        ranks = np.array([order[r[0]][r[1]] for r in true])
        while width < tree.leaves and len(ranks) and (ranks < width).mean() < recall:
            width = min(tree.leaves, width * 2)
        # the last doubling is more than needed: the least number of visits that has the recall
        if len(ranks):
            width = max(1, min(width, int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1))
    held_in = np.zeros(tree.leaves, np.int64)
    for leaf, n in index.groupBy("leaf").count().collect():  # a row a leaf
        held_in[leaf] = n
    spots = spark.sparkContext.broadcast((width, held_in))

    def visit(batches):
        for b in batches:
            x, _ = matrix(b.column(1))
            most, sizes = spots.value
            # rows of the query's own id are no candidates
            lists = [shared.value.visits(np.append(q, 0.0), most, sizes, k + own) for q, own in zip(x, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int64()))], ["query_id", "q", "leaves"])

    seen = work.save(queries.select("id", "v", F.count("*").over(Window.partitionBy("id")).alias("own")).mapInArrow(visit, "query_id long, q array<double>, leaves array<long>").select("query_id", "q", F.explode("leaves").alias("leaf")))
    # a leaf's numbers of blocks, of its vectors and of its visits: a row a leaf
    size = index.groupBy("leaf").agg(F.ceil(F.count("*") / block).alias("nv")).join(seen.groupBy("leaf").agg(F.ceil(F.count("*") / block).alias("nq")), "leaf")
    size = F.broadcast(work.save(size))
    left = index.join(size, "leaf").select("leaf", F.pmod(F.xxhash64("id"), "nv").alias("bv"), "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("bq"))
    right = seen.join(size, "leaf").select("leaf", F.pmod(F.xxhash64("query_id"), "nq").alias("bq"), "query_id", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nv") - 1)).alias("bv"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _found(*[np.zeros(0)] * 3)
        x, q = matrix(a["v"].combine_chunks())[0], matrix(b["q"].combine_chunks())[0]
        ids, qid = a["id"].to_numpy(), b["query_id"].to_numpy()
        parts = [_found(*best(ids, x, qid[i : i + 512], q[i : i + 512], k)) for i in range(0, len(q), 512)]
        return pa.concat_tables(parts)

    keys = ["leaf", "bv", "bq"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)
    return _top(found, k).select("query_id", F.col("r").cast("int").alias("rank"), "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window as W

    return found.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k)
