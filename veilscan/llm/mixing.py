"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets, after complete epochs.

Targets: sources by code point (null last) weigh ``weights``, repeating, and share ``share`` of all words. No target
passes ``most`` times its source's words; what is above goes to the others by weight until none is above, which is
water-filling: target = min(cap, level * weight), with the level read off prefix sums over the sources.
Taken: every document as often as the target holds its whole source, then documents in the order of their
exponential keys -ln(u) / quality until the rest is reached; the document that crosses it is taken if that ends
nearer. u comes from a digest of seed and id, so reruns agree.

Scale: two aggregations by source. No source is sorted: keys fall into ``SLICES`` slices of equal probability,
slices are prefix-summed, and only the one slice that the budget ends in is put in order.

Nulls: a null text has no words; a null source is a source; a null id is hashed as the word null. Rows that
repeat are rows of their own. An empty table gives none. A source without words has the target 0. Extra columns, whatever
their names, are ignored by mix and kept by mixed_documents. A very long text counts whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.llm.work import Work

SLICES = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """From 0.25 to 1: less for texts with many signs of markup."""
    signs = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.greatest(F.lit(0.25), 1 - F.try_divide(4 * signs, F.length(text))), F.lit(0.25))


def uniform(id_: Column, seed: int) -> Column:
    """In (0, 1), from the first 48 bits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, size) rows -> source, source_size, target; one row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = W.orderBy(F.asc_nulls_last("source"))
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size"))
    rise = W.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    up_to, all_ = rise.rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy()
    total = share * F.sum("source_size").over(all_)
    # the level if this source and all that fill up before it are at their caps
    before_cap, before_w = F.sum("cap").over(up_to) - F.col("cap"), F.sum("w").over(up_to) - F.col("w")
    by = by.withColumn("level", (total - before_cap) / (F.sum("w").over(all_) - before_w))
    by = by.withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(all_)["level"]
    return by.select("source", "source_size", F.round(F.coalesce(F.least("cap", level * F.col("w")), "cap"), 6).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken (words), epochs (times taken), source, th (xxhash64 of the text)."""
    work = Work(docs.sparkSession, "mix")
    src = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), words(docs[text_col]).alias("size"), quality(docs[text_col]).alias("q"), F.xxhash64(docs[text_col]).alias("th"))
    src = work.save(src.withColumn("key", -F.log(uniform(F.col("id"), seed)) / F.col("q")))
    # 1 - exp(-key * mean q): slices of about equal probability, in the keys' order
    src = src.withColumn("slice", F.floor((1 - F.exp(-F.col("key") * 0.9)) * SLICES).cast("int"))
    goal = work.save(targets(src, weights, share, most))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "g")
    small = goal.count() <= 10_000  # sources; beyond that the joins shuffle
    by_source = F.broadcast if small else (lambda x: x)
    per = src.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    upto = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = per.withColumn("before", F.sum("n").over(upto) - F.col("n")).join(by_source(goal), F.col("source").eqNullSafe(F.col("g")))
    # one row a source: the first slice that reaches the budget
    end = work.save(per.where("before + n >= rest").groupBy("g").agg(F.min(F.struct("slice", "before")).alias("e")).select("g", F.col("e.slice").alias("last"), F.col("e.before").alias("before")))
    goal = goal.join(by_source(end.withColumnRenamed("g", "g2")), F.col("g").eqNullSafe(F.col("g2")), "left").drop("g2")
    rows = src.join(by_source(goal), F.col("source").eqNullSafe(F.col("g"))).drop("g")
    clear = rows.where("last is null or slice <> last").withColumn("more", F.expr("if(last is null or slice < last, 1, 0)"))
    order = W.partitionBy("source").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = rows.where("slice = last").withColumn("more", (F.col("before") + F.sum("size").over(order) - F.col("size") / 2 <= F.col("rest")).cast("int"))
    out = clear.unionByName(edge).withColumn("epochs", F.col("whole").cast("long") + F.col("more"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"), "epochs", F.col("source").alias(source_col), "th")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them: rows not taken go, rows taken twice stand twice. Rows are told apart by id, source and a hash of
    the text; those that share all three are taken alike."""
    plan = mix(docs, id_col, text_col, source_col, **options).where("epochs > 0")
    plan = plan.groupBy(F.col(id_col).alias("__mix_id"), F.col(source_col).alias("__mix_source"), F.col("th").alias("__mix_text")).agg(F.max("epochs").alias("__mix_times"))
    same = docs[id_col].eqNullSafe(F.col("__mix_id")) & docs[source_col].eqNullSafe(F.col("__mix_source")) & (F.xxhash64(docs[text_col]) == F.col("__mix_text"))
    hit = docs.join(plan, same)
    return hit.withColumn("__mix_k", F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int")))).select(*docs.columns)
