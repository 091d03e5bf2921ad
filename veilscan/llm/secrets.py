"""Secret scans in DataFrame operations only: patterns, and character Markov models of random strings.

Base spans (leftmost, non-overlapping per kind): assignments of a value of 8 or more characters to a name like
password or token, access keys, and long runs of hex digits. The method adds spans of kind ``markov``: runs of 20 or
more token characters, with a digit and a letter, whose mean log-likelihood ratio a character pair, random strings
against ordinary identifiers, passes a threshold. Both chains are trained from labelled samples (text, label).

Positions are code points, end exclusive: what stands between the matches of a pattern, and the matches, add up
to them, so no operation but split and regexp_extract_all is needed.

Scale: one pass, row by row, no shuffle; the model is 65 x 65 numbers. Texts without a match are told by one search.
Nulls: a null text is empty. Rows that repeat give rows that repeat; an empty table none; extra columns, whatever their
names, are ignored. A very long text is searched whole, by one task.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns of the base kinds, with the least length of what must be long enough.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
TOKEN = r"[A-Za-z0-9+/=_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
KINDS = ["assign", "access", "hex", "markov"]
#: Words that names in programs are made of, for the labelled samples.
PARTS = "account address array buffer build cache call channel check client close config connect context count create data default delete device document encode entry error event field file filter find first flag format frame group handle header height host image index init input insert item join key last length level line link list load local lock log main manager map match message method mode model module name next node notify number object offset open option order output page parent parse path point port print process queue range read record render request reset result return role root row run save scan schema score search select send server service session set size sort source stack start state status stop store stream string submit table target task test text thread time title total trace tree type update user value version view wait width window word write".split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, label): n random strings (label 1: digests as hex and base64) and n identifiers (label 0)."""
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    raw = F.expr("substring(base64(unhex(d)), 1, 40)")
    rand = ids.withColumn("d", digest).select(F.when(F.col("id") % 2 == 0, raw).otherwise(F.substring("d", 1, 40)).alias("text"), F.lit(1).alias("label"))
    words = F.array(*[F.lit(w) for w in PARTS])
    part = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    p = [part(k) for k in range(4)]
    number = F.when(F.col("id") % 5 == 0, (F.col("id") % 100).cast("string")).otherwise(F.lit(""))
    forms = [F.concat_ws("_", *p), F.concat(p[0], *[F.initcap(x) for x in p[1:]]), F.concat_ws("-", *p), F.upper(F.concat_ws("_", *p))]
    form = F.element_at(F.array(*forms), (F.col("id") % 4 + 1).cast("int"))
    return rand.unionByName(ids.select(F.concat(form, number).alias("text"), F.lit(0).alias("label")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs (row-wise over ALPHABET), add-half smoothed, from (text, label) rows.
    Gathered: a number for each pair of the alphabet and label."""
    pairs = labelled.select("label", F.explode(F.expr("transform(sequence(1, greatest(length(text) - 1, 1)), i -> substring(text, i, 2))")).alias("p"))
    ok = F.length("p") == 2
    inside = (F.length(F.translate("p", ALPHABET, "")) == 0) & ok
    count: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for label, p, n in pairs.where(inside).groupBy("label", "p").agg(F.count("*")).collect():
        count[1 if label else 0][p] = n
    out = []
    for a in ALPHABET:
        total = {k: sum(count[k].get(a + b, 0) + 0.5 for b in ALPHABET) for k in count}
        for b in ALPHABET:
            out.append(round(math.log((count[1].get(a + b, 0) + 0.5) / total[1]) - math.log((count[0].get(a + b, 0) + 0.5) / total[0]), 4))
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's character pairs."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    n = F.length(token) - 1
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    pair = lambda i: (code(F.substring(token, i, F.lit(1))) - 1) * len(ALPHABET) + code(F.substring(token, i + 1, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + F.element_at(table, pair(i))) / n


def _running(steps: Column) -> Column:
    """Running sums of an array, each round adding what stands twice as far back: n log n steps, for texts of very many matches."""
    far = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(steps))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(far, steps, lambda a, d: F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - d), F.lit(0))))


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """array<struct<start, kind, end>> of the pattern's matches that ``keep``(match, group 2 or None) passes."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    ends = _running(F.zip_with(between, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))))
    places = F.zip_with(found, ends, lambda m, e: F.struct(m.alias("m"), (e - F.length(m)).alias("s")))

    def span(z, ok):
        return F.when(z["m"].isNotNull() & ok, F.struct(z["s"].alias("start"), F.lit(kind).alias("kind"), (z["s"] + F.length(z["m"])).alias("end")))

    if keep.__code__.co_argcount == 2:
        spans = F.zip_with(places, F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda z, v: span(z, keep(z["m"], v)))
    else:
        spans = F.transform(places, lambda z: span(z, keep(z["m"])))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(pattern if kind < 2 or kind == 3 else r"[0-9a-f]{32}"), F.filter(spans, lambda x: x.isNotNull())).otherwise(none)


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_markov, base_spans and all_spans (arrays of
    ``kind:start:end`` by start, then kind as listed)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    found = docs.select(
        docs[id_col].alias(id_col),
        _spans(text, ASSIGN, 0, lambda m, v: F.length(v) >= 8).alias("s0"),
        _spans(text, ACCESS, 1, lambda m: F.length(m) >= 16).alias("s1"),
        _spans(text, r"[0-9a-f]{32,}", 2, lambda m: F.length(m) >= 32).alias("s2"),  # as leftmost runs of HEX, long ones kept
        _spans(text, TOKEN, 3, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (ratio(m, model) > threshold)).alias("s3"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda a: F.transform(F.array_sort(a), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")))
    base = F.concat("s0", "s1", "s2")
    return found.select(id_col, *[F.size(f"s{i}").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)], told(base).alias("base_spans"), told(F.concat(base, F.col("s3"))).alias("all_spans"))
