"""Connected components, and the resolution of buckets of candidates by stars instead of all pairs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.work import Work


#: Rows of a few numbers up to which a table is broadcast, or a graph handled by one task; above, joins shuffle.
SMALL = 200_000
#: Longs of a bitmap.
WORDS = 16


def hint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table, to be broadcast if its size allows it."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SMALL else df


def _union_find(batches):
    """Edges of one small graph -> (node, component) of all nodes but the components' smallest."""
    root: dict[int, int] = {}

    def find(x):
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    for t in batches:
        for u, v in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    rows = [(x, find(x)) for x in list(root)]
    rows = [r for r in rows if r[0] != r[1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["node", "component"])


def components(work: Work, edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node that is reachable; the smallest nodes are left out.

    Alternating large-star and small-star rounds: each keeps every component connected and hangs nodes ever
    closer to their smallest node; a hub's neighbours are aggregated by ``min``, never gathered. Rounds are
    logarithmic in practice. Up to SMALL edges one task joins them instead. Nulls are no nodes; repeated edges
    and loops are harmless.
    """
    e = work.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if e.count() <= SMALL:
        return work.save(e.coalesce(1).mapInArrow(_union_find, "node long, component long"))
    while True:
        # large star: every larger neighbour of u goes to the smallest of u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u's smaller neighbours, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        new = work.save(small.where("u <> v").distinct())
        work.drop(e)
        e = new
        # done when no node's target has a target of its own, and none has two
        if e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def resolve(work: Work, members: DataFrame, linked: Callable[[DataFrame], DataFrame], least_percent: int = 0, bitmaps: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges that connect all that links inside buckets connect, without listing a bucket's pairs.

    members: (bucket, node, n), no repeats; n is the node's size. linked: pairs (a, b) -> the linked ones (a, b);
    it gets pairs whose similarity, the share of common elements in the union, may reach ``least_percent``.
    bitmaps: (node) -> (node, bits), a node's elements as the parities of 64 * WORDS classes: the bits in which two
    nodes differ are no more than the elements that only one of them has, which rules pairs out before they are rows.
    Returns edges (a, b).

    Round by round each bucket has hubs that are held against the members of other components only; then they
    leave the bucket, as all their links are known. Buckets whose members are all connected are done. Hubs grow
    eightfold from round to round, so every pair not connected otherwise is held once at most, in few rounds.
    Hubs are the members with the most company over all buckets: the text that others were copied from.
    """
    size = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    live = members.join(size, "bucket")
    weight = live.groupBy("node").agg(F.sum("c").alias("w"))
    live = work.save(live.join(weight, "node").select("bucket", "node", "n", "w", F.col("node").alias("component")))
    may, extra = f"100 * least(n, hn) >= {least_percent} * greatest(n, hn)", []
    edges, hubs = None, 1
    while True:
        if hubs == 1:
            best = F.struct(F.col("w"), F.bitwise_not("node").alias("minus"), F.col("component"), F.col("n"))
            top = live.groupBy("bucket").agg(F.max(best).alias("t")).select("bucket", F.bitwise_not("t.minus").alias("hub"), F.col("t.component").alias("hc"), F.col("t.n").alias("hn"))
        else:
            top = _top(live, hubs, extra)
        top = work.save(top)
        top_hint = hint(top) if not extra else hint(top, 8 * top.count())
        held = live.join(top_hint, "bucket").where(f"component <> hc and {may}")
        found = work.save(linked(work.save(held.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())))
        edges = found if edges is None else edges.unionByName(found)
        left = live.join(top_hint.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti")
        n = found.count()
        if n:
            # components so far are nodes now: only what this round adds is a graph
            if hubs == 1:
                step = found
            else:
                name = live.select("node", "component").distinct()
                a, b = (name.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
                step = hint(found, n).join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
            comp = hint(components(work, step).select(F.col("node").alias("component"), F.col("component").alias("root")))
            left = left.join(comp, "component", "left").select("bucket", "node", "n", "w", *extra, F.coalesce("root", "component").alias("component"))
        mixed = left.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
        mixed = work.save(mixed)
        rows = mixed.count()
        if not rows:
            return edges.distinct()
        nxt = work.save(left.join(hint(mixed, rows), "bucket", "left_semi"))
        work.drop(live, top)
        live = nxt
        if bitmaps and hubs == 1:
            own = work.save(bitmaps(work.save(live.select("node").distinct())))
            extra = [f"m{i}" for i in range(WORDS)]
            live = work.save(live.join(hint(own), "node", "left").select(*live.columns, *[F.coalesce(F.col("bits")[i], F.lit(0)).alias(m) for i, m in enumerate(extra)]))
            differ = " + ".join(f"bit_count({m} ^ h{m})" for m in extra)
            may = f"{100 + least_percent} * ({differ}) <= {100 - least_percent} * (n + hn)"
            work.drop(nxt)
        hubs *= 8


def bitmap(ids: DataFrame, column: str, most_bits: int = 1 << 26) -> tuple[bytes, int]:
    """A bit for the top bits of each hash, 8 MB at most whatever the number of ids, and log2 of its bits: a filter that passes
    all of them, and a few others, ahead of an exact join. Bits are or-ed by Spark; only words of bits are gathered."""
    import numpy as np

    n = max(1, ids.count())
    log = max(10, min(int(np.log2(most_bits)), int(np.ceil(np.log2(16 * n)))))
    h = F.shiftrightunsigned(F.col(column), 64 - log)
    rows = ids.select(F.shiftrightunsigned(h, 6).alias("w"), F.expr("1L").alias("one"), (h % 64).cast("int").alias("b"))
    rows = rows.groupBy("w").agg(F.expr("bit_or(shiftleft(one, b))").alias("x"))
    words = np.zeros(1 << (log - 6), np.int64)
    for w, x in rows.toLocalIterator():
        words[w] = x
    return words.tobytes(), log


def _top(live: DataFrame, k: int, extra: list[str]) -> DataFrame:
    """The k members of each bucket with the most weight: a partial top k within slices, then of their survivors,
    so no task sorts a whole bucket."""
    from pyspark.sql import Window as W

    part = W.partitionBy("bucket", "s").orderBy(F.desc("w"), "node")
    some = live.withColumn("s", F.pmod(F.hash("node"), F.lit(64))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    full = W.partitionBy("bucket").orderBy(F.desc("w"), "node")
    return some.withColumn("r", F.row_number().over(full)).where(F.col("r") <= k).select("bucket", F.col("node").alias("hub"), F.col("component").alias("hc"), F.col("n").alias("hn"), *[F.col(m).alias(f"h{m}") for m in extra])
