"""Findings brought together: merged, filtered, scored, summed up, written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.text import confidence_label, severity_rank, severity_weight

FINDING = "id string, title string, severity string, file string, line int, code_snippet string, recommendation string, confidence int, evidence array<string>"


def rule(when: Column | bool, id_: str, title: Column | str, severity: Column | str, file: Column, line: Column, snippet: Column, recommendation: str, confidence: Column | int = 80, evidence: Column | None = None) -> Column:
    """A finding where the condition holds, else null; confidence is 100 at most."""
    lit = lambda x: F.lit(x) if not isinstance(x, Column) else x
    empty = F.array().cast("array<string>")
    one = F.struct(
        F.lit(id_).alias("id"), lit(title).alias("title"), lit(severity).alias("severity"), file.alias("file"), line.cast("int").alias("line"), snippet.alias("code_snippet"),
        F.lit(recommendation).alias("recommendation"), F.least(F.lit(100), lit(confidence)).cast("int").alias("confidence"), (evidence if evidence is not None else empty).alias("evidence"),
    )
    return F.when(lit(when), one)


def found(df: DataFrame, rules: list[Column]) -> DataFrame:
    """All findings of the rules, in one pass over df."""
    return df.select(F.explode(F.array_compact(F.array(*rules))).alias("f")).select("f.*")


def finding(df: DataFrame, *args, **more) -> DataFrame:
    """Every row of df as a finding (arguments as of ``rule``)."""
    return found(df, [rule(True, *args, **more)])


def union(parts: list[DataFrame]) -> DataFrame:
    """All findings: a bag, not a set."""
    return reduce(DataFrame.unionByName, parts)


def aggregate_findings(findings: DataFrame, order: str) -> DataFrame:
    """One row per (id, title): the first finding by ``order``, five points of confidence for each other, evidence merged (each once),
    headed by the count and the first five files when there are several."""
    from pyspark.sql import Window as W

    key = ["id", "title"]
    first = F.min_by(F.struct("severity", "file", "line", "code_snippet", "recommendation", "confidence"), order)
    g = findings.groupBy(*key).agg(first.alias("f"), F.count("*").alias("n"))
    said = findings.select(*key, F.explode("evidence").alias("e")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("e")).alias("e"))
    five = findings.select(*key, "file").distinct().withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("file"))).where("r <= 5")
    five = five.groupBy(*key).agg(F.array_sort(F.collect_list("file")).alias("files"))
    g = g.join(said, key, "left").join(five, key, "left")
    none = F.array().cast("array<string>")
    head = F.when(F.col("n") > 1, F.array(F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" times across: "), F.array_join("files", ", ")))).otherwise(none)
    return g.select("id", "title", "f.severity", "f.file", "f.line", "f.code_snippet", "f.recommendation", F.least(F.lit(100), F.col("f.confidence") + 5 * (F.col("n") - 1)).cast("int").alias("confidence"), F.concat(head, F.coalesce("e", none)).alias("evidence"))


def grade(findings: DataFrame) -> DataFrame:
    """One row: score = 100 less the rounded weighted confidences, 0 at least, and its grade."""
    s = findings.agg(F.coalesce(F.sum(severity_weight("severity") * F.col("confidence") / 100.0), F.lit(0.0)).alias("total"))
    return s.select(*grade_of(F.col("total")))


def grade_of(total: Column) -> list[Column]:
    """score and grade of a sum of weighted confidences."""
    c = F.greatest(F.lit(0), F.lit(100) - F.round(total).cast("int")).cast("int")
    return [c.alias("score"), F.when(c >= 90, "A").when(c >= 75, "B").when(c >= 60, "C").when(c >= 40, "D").otherwise("F").alias("grade")]


def summary(findings: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")]
    return findings.agg(*counts, F.countDistinct("file").alias("files"))


def confidence_buckets(findings: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return findings.agg(F.count_if(c >= 90).alias("very_high"), F.count_if((c >= 70) & (c < 90)).alias("high"), F.count_if(c < 70).alias("lower"), F.round(F.avg("confidence"), 6).alias("average"))


def at_least(findings: DataFrame, severity: str, confidence: int) -> DataFrame:
    return findings.where((severity_rank("severity") >= severity_rank(F.lit(severity))) & (F.col("confidence") >= confidence))


def merge_verified(findings: DataFrame, verified: DataFrame) -> DataFrame:
    """Confidence and notes of verifications (id, file, line), read from elsewhere, put into the findings; others stay. A key that is
    verified twice counts with its smallest confidence, so findings never multiply."""
    v = verified.groupBy("id", "file", "line").agg(F.min(F.struct(F.col("verified_confidence").alias("c"), F.col("notes").alias("n"))).alias("_v"))
    out = findings.join(v, ["id", "file", "line"], "left")
    out = out.withColumn("confidence", F.coalesce("_v.c", "confidence")).withColumn("evidence", F.concat("evidence", F.coalesce("_v.n", F.array().cast("array<string>"))))
    return out.select(*findings.columns)


def json_report(findings: DataFrame) -> DataFrame:
    """(part, report): a head with score, grade and summary, and a line of JSON a finding."""
    head = grade(findings).crossJoin(F.broadcast(summary(findings)))  # one row each
    head = head.select(F.lit("head").alias("part"), F.to_json(F.struct("score", "grade", F.struct("critical", "high", "medium", "low", "info", "files").alias("summary"))).alias("report"))
    rows = findings.withColumn("confidence_label", confidence_label("confidence"))
    return head.unionByName(rows.select(F.lit("finding").alias("part"), F.to_json(F.struct(*rows.columns)).alias("report")))


def text_report(findings: DataFrame) -> DataFrame:
    """(place, confidence, text): the report's lines, to be ordered by place, falling confidence and text; the grade is place 0, then
    the severities from the worst on."""
    head = grade(findings).select(F.lit(0).alias("place"), F.lit(100).alias("confidence"), F.format_string("Privacy score %d (%s)", "score", "grade").alias("text"))
    body = F.format_string("[%s] %s %s (%s:%d) %s %d%%", "severity", "id", "title", "file", "line", confidence_label("confidence"), "confidence")
    return head.unionByName(findings.select((5 - severity_rank("severity")).alias("place"), "confidence", body.alias("text"))).orderBy("place", F.desc("confidence"), "text")


def passes_gate(findings: DataFrame, threshold: int) -> DataFrame:
    return grade(findings).withColumn("passed", F.col("score") >= threshold)
