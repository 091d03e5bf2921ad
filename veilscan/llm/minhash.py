"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A text's set: its distinct runs of ``width`` words (A-Z lowered); with fewer words the whole sequence is one
shingle; without words, or null, the set is empty and linked with nothing. Texts are linked if the Jaccard
similarity of their sets is at least ``percent`` / 100, which is confirmed on whole sets; bands only propose. With
128 bins in 32 bands of 4, a pair at 0.75 is proposed with probability 0.99999.

Scale: equal sets meet in one representative before anything else, so large groups of copies cost one row.
Buckets are resolved by stars (graph.resolve): no bucket's pairs are listed. Whole sets travel only for texts that
share a bucket. Every stage is a written table, read again by whatever follows. Shingles are 64-bit hashes of whole
words, and whole when pairs are confirmed; sets are told apart by 128-bit digests. A very long text has one set like
others, held by one task at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm import textvec as tv
from veilscan.llm.graph import SMALL, WORDS, bitmap, components, hint, resolve
from veilscan.llm.work import Work, named

U = np.uint64
BINS, ROWS = 128, 4
#: Densification: the attempt's bin for an empty bin, from a fixed universal hash of (bin, attempt).
_TRIES = (tv.mix(np.arange(64 * BINS, dtype=U) + U(77)) >> U(57)).astype(np.int64).reshape(64, BINS)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j, data, offs in tv.blocks(column):
        s, e, first = tv.word_spans(data, offs)
        wh = tv.span_hash(tv.LOWER[data], s, e)
        grams = tv.ngrams(wh, width)
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield tv.ngrams(wh[a:b], int(b - a))
            else:
                yield np.zeros(0, U)


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted set: each bin's smallest value; empty bins copy a full bin that
    independent hashes of (bin, attempt) find, so copies are as good as fresh samples."""
    lo = np.searchsorted(s, np.arange(BINS, dtype=U) << U(57))
    full = np.append(s, U(0))[np.minimum(lo, len(s))] >> U(57) == np.arange(BINS, dtype=U)
    full &= lo < len(s)
    src = np.arange(BINS)
    empty = np.flatnonzero(~full)
    for t in _TRIES:
        if not len(empty):
            break
        to = t[empty]
        hit = full[to]
        src[empty[hit]] = to[hit]
        empty = empty[~hit]
    if len(empty):  # 64 misses: nearly impossible but for tiny sets; any rule that depends on the full bins alone is sound
        nth = np.flatnonzero(full)
        src[empty] = nth[empty % len(nth)]
    return s[lo[src]]


def bands(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(-1, ROWS)
    out = np.arange(len(x), dtype=U)
    for k in range(ROWS):
        out = tv.mix((out ^ x[:, k]) * U(tv.P) + U(k + 1))
    return out.view(np.int64)


def _sketch(width: int):
    def run(batches):
        for b in batches:
            n, ids, keys = [], [], []
            for s in shingle_sets(b.column(1), width):
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(bands(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "set_id", "bands"])

    return run


def _sets(width: int, words, log: int):
    """(node, set_id, shingles) of the rows whose hash is in the bitmap."""

    def run(batches):
        bits = np.frombuffer(words.value, U)
        for b in batches:
            x = b.column(2).to_numpy().view(U) >> U(64 - log)
            keep = bits[(x >> U(6)).astype(np.int64)] >> (x & U(63)) & U(1)
            b = b.select([0, 1]).filter(pa.array(keep.astype(bool)))
            packed = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), tv.pack(s)) for s in shingle_sets(b.column(1), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in packed], pa.binary()) for i in (0, 1))], ["node", "set_id", "shingles"])

    return run


def _parities(batches):
    """(node, bits): the parity of the number of shingles in each of 64 * WORDS classes."""
    for b in batches:
        out = []
        for x in b.column(1):
            k = tv.mix(tv.unpack(x.as_py()))
            odd = np.bincount((k % U(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) % 2
            out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["node", "bits"])


def _confirm(percent: int):
    """Pairs with both packed sets -> those whose similarity is high enough."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            a, c, sa, sb = (b.column(k) for k in range(4))
            ok = []
            for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
                hub = a[i].as_py()
                if hub not in kept:  # pairs of one hub stand together more often than not
                    kept = {hub: tv.unpack(x.as_py())}
                p, q = kept[hub], tv.unpack(y.as_py())
                both = np.concatenate([p, q])
                both.sort()
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * inter >= percent * (len(p) + len(q) - inter))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), c.filter(keep)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links (its own, if none); kept marks that one. Rows that
    repeat an id give one row (the text whose set sorts first decides); a null id takes no part in linking and
    is its own component (null). Empty tables give none. Extra columns are ignored.
    """
    spark = docs.sparkSession
    work = Work(spark, "minhash")
    docs = named(docs, id_col, text_col).toDF("id", "text")
    sketch = work.save(docs.mapInArrow(_sketch(width), "id long, n long, set_id binary, bands array<long>"))
    one = sketch.groupBy("id").agg(F.min(F.struct("set_id", "n")).alias("x")).select("id", "x.set_id", "x.n")
    real = one.where("id is not null and set_id is not null")
    classes = work.save(real.groupBy("set_id", "n").agg(F.min("id").alias("node")))
    banded = sketch.where("set_id is not null and id is not null").join(classes.select(F.col("node").alias("id"), "set_id"), ["id", "set_id"]).select("id", "set_id", "bands").dropDuplicates(["id"])
    members = work.save(banded.join(classes.select(F.col("node").alias("id"), "n"), "id").select(F.explode("bands").alias("bucket"), F.col("id").alias("node"), "n"))
    shared = members.join(members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "bucket", "left_semi")
    shared = work.save(shared)
    if shared.isEmpty():
        comp = work.save(classes.select("set_id", F.col("node").alias("component")))
    else:
        work.drop(members)
        wanted = work.save(shared.select("node").distinct().join(classes.select("node", "set_id"), "node"))
        # the bitmap keeps texts of no bucket from travelling; the join is exact
        words, log = bitmap(wanted.select(F.xxhash64("node").alias("h")), "h")
        words = spark.sparkContext.broadcast(words)
        sets = docs.withColumn("h", F.xxhash64("id")).mapInArrow(_sets(width, words, log), "node long, set_id binary, shingles binary").join(wanted, ["node", "set_id"], "left_semi").dropDuplicates(["node"]).select("node", "shingles")
        sets = work.save(sets)

        def linked(pairs: DataFrame) -> DataFrame:
            some = sets
            if pairs.count() <= SMALL:
                ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                some = sets.join(F.broadcast(ends), "node", "left_semi")
            a, b = (some.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
            return pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long")

        def bitmaps(nodes: DataFrame) -> DataFrame:
            return sets.join(hint(nodes), "node", "left_semi").mapInArrow(_parities, "node long, bits array<long>")

        edges = resolve(work, shared, linked, percent, bitmaps)
        comp = components(work, edges) if not edges.isEmpty() else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        # the smallest id of a component's classes is the smallest of all its texts: a class goes by its smallest
        comp = work.save(classes.join(comp, "node", "left").select("set_id", F.coalesce("component", "node").alias("component")))
        work.drop(shared, wanted, sets)
    return (
        one.join(comp, "set_id", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
        .withColumn("kept", F.expr(f"`{id_col}` <=> component_id"))
    )
