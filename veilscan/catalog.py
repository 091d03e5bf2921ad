"""Named queries of the operators over the test tables, each with DuckDB SQL that says the same in other words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan import cases, vocab
from veilscan.functions import fields as K
from veilscan.functions import text as T
from veilscan.operators import joins as J
from veilscan.operators import ledger as G
from veilscan.operators import lines as L
from veilscan.operators import report as R
from veilscan.operators import verify as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(t(spark, d, "documents"), "doc_id", "text")


#: doc_lines in SQL
LINES = r"""
p AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents),
q AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM p),
l AS (SELECT doc_id, CAST(unnest(range(1, len(a) + 1)) AS INTEGER) AS line_no, unnest(a) AS text FROM q)
"""


def sql_any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def sql_count(col: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INTEGER)" for w in words) + ")"


def sql_first(col: str, words: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains({col}, '{w}') THEN '{w}' END" for w in words) + ")"


DOMAINS = "(" + "|".join(w.replace(".", "\\.") for w in vocab.PLACEHOLDER_EMAIL_DOMAINS) + ")$"


# ---------------------------------------------------------------- lines and texts


@query(f"WITH {LINES} SELECT doc_id, line_no, text FROM l")
def line_explode(spark, d):
    return doc_lines(spark, d)


@query(f"""WITH {LINES}
SELECT a.doc_id, a.line_no, string_agg(CASE WHEN b.line_no = a.line_no THEN '>' ELSE ' ' END || printf('%4d', b.line_no) || ' | ' || b.text, chr(10) ORDER BY b.line_no) AS snippet
FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 2 AND a.line_no + 2 WHERE contains(a.text, '@') GROUP BY a.doc_id, a.line_no""")
def line_snippet(spark, d):
    return L.around(t(spark, d, "documents"), "doc_id", "text", lambda x: x.contains("@"), 2, 2, "snippet").select("doc_id", "line_no", "snippet")


@query(f"""WITH {LINES}
SELECT a.doc_id, a.line_no, string_agg(CASE WHEN b.line_no = a.line_no THEN '>' ELSE ' ' END || printf('%4d', b.line_no) || ' | ' || b.text, chr(10) ORDER BY b.line_no) AS snippet
FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 1 AND a.line_no + 2 WHERE contains(a.text, 'token =') GROUP BY a.doc_id, a.line_no""")
def flow_snippet(spark, d):
    return L.around(t(spark, d, "documents"), "doc_id", "text", lambda x: x.contains("token ="), 1, 2, "snippet").select("doc_id", "line_no", "snippet")


@query(f"WITH {LINES} SELECT doc_id, line_no, regexp_extract(text, '{vocab.EMAIL}') AS email FROM l WHERE regexp_matches(text, '{vocab.EMAIL}')")
def email_filter(spark, d):
    return doc_lines(spark, d).select("doc_id", "line_no", T.email("text").alias("email")).where("email is not null")


@query(f"WITH {LINES}, e AS (SELECT lower(regexp_extract(text, '{vocab.EMAIL}')) AS email FROM l WHERE regexp_matches(text, '{vocab.EMAIL}')) SELECT regexp_matches(email, '{DOMAINS}') AS placeholder, count(*) AS n FROM e GROUP BY 1")
def placeholder_email_split(spark, d):
    e = doc_lines(spark, d).select(T.email("text").alias("email")).where("email is not null")
    return e.groupBy(T.is_placeholder_email("email").alias("placeholder")).agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, line_no, regexp_extract(text, '{vocab.PHONE}') AS phone FROM l WHERE regexp_matches(text, '{vocab.PHONE}')")
def phone_filter(spark, d):
    return doc_lines(spark, d).select("doc_id", "line_no", T.phone("text").alias("phone")).where("phone is not null")


@query(f"SELECT source, count(*) FILTER (WHERE regexp_matches(text, '{vocab.SSN}')) AS hits, count(*) AS n FROM documents GROUP BY source")
def ssn_filter(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count_if(T.has_ssn("text")).alias("hits"), F.count("*").alias("n"))


@query(f"SELECT doc_id, regexp_extract(text, '{vocab.IPV4}') AS ip FROM documents WHERE regexp_matches(text, '{vocab.IPV4}')")
def ip_log_filter(spark, d):
    return t(spark, d, "documents").where(F.col("text").rlike(vocab.IPV4)).select("doc_id", F.regexp_extract("text", vocab.IPV4, 0).alias("ip"))


@query(f"""WITH {LINES}, f AS (SELECT doc_id, line_no, text, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM l)
SELECT doc_id, line_no, concat_ws(',', CASE WHEN contains(text, '@') AND contains(text, '.') THEN 'email' END, CASE WHEN digits >= 10 THEN 'phone' END, CASE WHEN contains(text, '-') AND digits >= 9 THEN 'ssn' END) AS kinds
FROM f WHERE (contains(text, '@') AND contains(text, '.')) OR digits >= 10 OR (contains(text, '-') AND digits >= 9)""")
def pii_log_types(spark, d):
    return doc_lines(spark, d).select("doc_id", "line_no", F.array_join(T.log_pii_types("text"), ",").alias("kinds")).where("kinds <> ''")


@query(f"SELECT page_id, {sql_any('html', ['debug', 'trace', 'println', 'dbg'])} AS debug FROM pages")
def debug_log(spark, d):
    return t(spark, d, "pages").select("page_id", T.is_debug_output("html").alias("debug"))


HEXES = "SELECT item_id, '0x' || repeat(md5(CAST(item_id AS VARCHAR)), CAST(3 + item_id % 3 AS INTEGER)) || CASE WHEN item_id % 4 = 0 THEN 'zz' ELSE '' END || ' rest' AS text FROM benchmark"


def _hexes(spark, d):
    i = F.col("item_id")
    return t(spark, d, "benchmark").select(i, F.concat(F.lit("0x"), F.repeat(F.md5(i.cast("string")), (3 + i % 3).cast("int")), F.when(i % 4 == 0, "zz").otherwise(""), F.lit(" rest")).alias("text"))


@query(f"WITH h AS ({HEXES}) SELECT item_id, regexp_matches(regexp_replace(regexp_extract(text, '0x([^ ]*)', 1), '[^0-9a-fA-F]+$', ''), '^[0-9a-fA-F]{{120,130}}$') AS key FROM h")
def hex_key(spark, d):
    return _hexes(spark, d).select("item_id", T.looks_like_hex_private_key("text").alias("key"))


@query(f"WITH h AS ({HEXES}) SELECT item_id, regexp_matches(replace(substr(text, 3, 88), '0', 'z'), '^[1-9A-HJ-NP-Za-km-z]{{85,90}}$') AS key FROM h")
def base58_key(spark, d):
    return _hexes(spark, d).select("item_id", T.looks_like_private_key(F.replace(F.substring("text", 3, 88), F.lit("0"), F.lit("z"))).alias("key"))


EVENT_JSON = "'{\"' || event_type || '\": 1, \"image\": \"' || CAST(event_id AS VARCHAR) || CASE WHEN user_id % 2 = 0 THEN '\", \"symbol\": \"X\"}' ELSE '\"}' END"


def _event_json():
    return F.concat(F.lit('{"'), "event_type", F.lit('": 1, "image": "'), F.col("event_id").cast("string"), F.when(F.col("user_id") % 2 == 0, '", "symbol": "X"}').otherwise('"}'))


@query(f"WITH e AS (SELECT event_id, lower({EVENT_JSON}) AS j FROM events) SELECT event_id, {sql_count('j', [chr(34) + f + chr(34) for f in vocab.TOKEN_METADATA_FIELDS])} >= 2 AS described FROM e")
def token_metadata_ctx(spark, d):
    return t(spark, d, "events").select("event_id", T.has_token_metadata_context(_event_json()).alias("described"))


NFT = sql_count("j", [chr(34) + f + chr(34) for f in vocab.NFT_METADATA_FIELDS])


@query(f"WITH e AS (SELECT event_id, lower({EVENT_JSON}) AS j FROM events) SELECT event_id, {NFT} >= 2 OR (contains(j, '\"image\"') AND {NFT} >= 1) AS described FROM e")
def nft_metadata_ctx(spark, d):
    return t(spark, d, "events").select("event_id", T.has_nft_metadata_context(_event_json()).alias("described"))


SAFE_NAME = f"""octet_length(CAST(v AS BLOB)) < 2 OR octet_length(CAST(v AS BLOB)) > 50 OR (regexp_matches(v, '^[A-Z0-9 ]+$') AND octet_length(CAST(v AS BLOB)) <= 10) OR regexp_matches(v, '[0-9]')
 OR regexp_matches(v, '[#@$_/\\\\{{}}\\[\\]|]') OR regexp_matches(lower(v), '^({"|".join(T.NAME_PREFIXES)})') OR {sql_any("lower(v)", T.NAME_KEYWORDS)} OR (NOT contains(v, ' ') AND octet_length(CAST(v AS BLOB)) > 10)"""


@query(f"WITH w AS (SELECT s_suppkey AS k, trim(s_name) AS v FROM supplier UNION ALL SELECT n_nationkey, trim(n_name) FROM nation UNION ALL SELECT p_partkey, trim(p_type) FROM part) SELECT k, v, {SAFE_NAME} AS safe FROM w")
def safe_name_value(spark, d):
    parts = [t(spark, d, n).select(F.col(k).cast("long").alias("k"), F.trim(v).alias("v")) for n, k, v in (("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("part", "p_partkey", "p_type"))]
    return R.union(parts).select("k", "v", T.is_safe_name_value("v").alias("safe"))


VALUES = "SELECT item_id, CASE item_id % 5 WHEN 0 THEN md5(CAST(item_id AS VARCHAR)) WHEN 1 THEN 'a2V5IG51bWJlcg' || CAST(item_id AS VARCHAR) || 'abcde=' WHEN 2 THEN '123e4567-e89b-12d3-a456-4266141740' || CAST(10 + item_id % 90 AS VARCHAR) WHEN 3 THEN '1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2' ELSE 'John Smith' END AS v FROM benchmark"


def _values(spark, d):
    i = F.col("item_id")
    s = i.cast("string")
    v = F.when(i % 5 == 0, F.md5(s)).when(i % 5 == 1, F.concat(F.lit("a2V5IG51bWJlcg"), s, F.lit("abcde="))).when(i % 5 == 2, F.concat(F.lit("123e4567-e89b-12d3-a456-4266141740"), (10 + i % 90).cast("string"))).when(i % 5 == 3, "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2").otherwise("John Smith")
    return t(spark, d, "benchmark").select("item_id", v.alias("v"))


@query(f"WITH w AS ({VALUES}) SELECT item_id, regexp_matches(v, '^[0-9a-fA-F]{{32,}}$') OR regexp_matches(v, '^[1-9A-HJ-NP-Za-km-z]{{32,90}}$') OR (length(v) >= 20 AND regexp_matches(v, '^[A-Za-z0-9+/=]*=$')) OR (length(v) = 36 AND length(v) - length(replace(v, '-', '')) = 4) AS encoded FROM w")
def hash_or_encoded(spark, d):
    return _values(spark, d).select("item_id", T.is_hash_or_encoded("v").alias("encoded"))


@query(f"WITH w AS ({VALUES}) SELECT item_id, regexp_matches(v, '^[1-9A-HJ-NP-Za-km-z]{{32,44}}$') OR (v LIKE '0x%' AND length(v) = 42) OR ((v LIKE '1%' OR v LIKE '3%' OR v LIKE 'bc1%') AND length(v) BETWEEN 26 AND 62) AS address FROM w")
def blockchain_addr(spark, d):
    return _values(spark, d).select("item_id", T.is_blockchain_address_value("v").alias("address"))


@query(f"SELECT conv_id, turn, {sql_any('lower(text)', vocab.FINANCIAL_CONTEXTS)} AS finance FROM conversations")
def financial_ctx(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", T.is_financial_context("text").alias("finance"))


def sql_pick(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"][CAST(event_id % {len(words)} AS INTEGER) + 1]"


def pick(words: list[str]):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % len(words) + 1).cast("int"))


@query(f"WITH e AS (SELECT event_id, 'Now ' || event_type || ' ' || upper({sql_pick(vocab.LOG_WORDS + ['none'])}) AS text FROM events) SELECT event_id, {sql_first('lower(text)', vocab.LOG_WORDS)} AS word FROM e WHERE {sql_any('lower(text)', vocab.LOG_WORDS)}")
def first_sensitive_word(spark, d):
    e = t(spark, d, "events").select("event_id", F.concat(F.lit("Now "), "event_type", F.lit(" "), F.upper(pick(vocab.LOG_WORDS + ["none"]))).alias("text"))
    return e.select("event_id", T.first_contained(F.lower("text"), vocab.LOG_WORDS).alias("word")).where("word is not null")


#: Events as the lines of files: one a user, by event.
EVENT_LINES = "l AS (SELECT user_id AS file, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS line_no, event_type || ' ' || CAST(event_id % 11 AS VARCHAR) AS text FROM events)"


def event_lines(spark, d):
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return t(spark, d, "events").select(F.col("user_id").alias("file"), n.alias("line_no"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 11).cast("string")).alias("text"))


@query(f"""WITH {EVENT_LINES}, m AS (SELECT file, line_no, lead(line_no) OVER (PARTITION BY file ORDER BY line_no) AS nxt FROM l WHERE contains(text, 'purchase')), z AS (SELECT file, max(line_no) AS last FROM l GROUP BY file)
SELECT m.file, m.line_no FROM m JOIN z ON m.file = z.file WHERE coalesce(nxt, 1073741824) > line_no + 6 AND last >= line_no + 6""")
def msg_context_lead(spark, d):
    return L.settled(event_lines(spark, d), "file", F.col("text").contains("purchase")).select("file", "line_no")


@query(f"""WITH {LINES} SELECT a.doc_id, a.line_no, md5(string_agg(b.text, chr(10) ORDER BY b.line_no)) AS body FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no AND a.line_no + 9
WHERE contains(a.text, '@') GROUP BY a.doc_id, a.line_no""")
def emit_frame_concat(spark, d):
    return L.around(t(spark, d, "documents"), "doc_id", "text", lambda x: x.contains("@"), 0, 9, "body", mark=False).select("doc_id", "line_no", F.md5("body").alias("body"))


@query(f"""WITH {EVENT_LINES}, f AS (SELECT file, line_no, text, bool_or(contains(text, ' 7')) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS checked FROM l)
SELECT file, line_no FROM f WHERE contains(text, 'click') AND NOT checked""")
def check_comment_frame(spark, d):
    ls = event_lines(spark, d).withColumn("checked", L.seen_within(F.col("text").contains(" 7"), "file", 9))
    return ls.where(F.col("text").contains("click") & ~F.col("checked")).select("file", "line_no")


@query(f"""WITH {EVENT_LINES}, w AS (SELECT file, line_no, text, bool_or(contains(text, 'purchase')) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS waits FROM l),
f AS (SELECT file, bool_or(waits AND contains(text, 'click 3')) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS flagged FROM w)
SELECT file, count(*) FILTER (WHERE flagged) AS n FROM f GROUP BY file""")
def running_test_flag(spark, d):
    x = F.col("text")
    code = F.when(x.contains("purchase"), "  #[cfg(test)]").when(x.contains("click 3"), "mod tests {").otherwise(x)
    ls = L.in_test_module(event_lines(spark, d).withColumn("text", code), "file", "flagged")
    return ls.groupBy("file").agg(F.count_if("flagged").alias("n"))


# ---------------------------------------------------------------- ledger


def activity(spark, d):
    e = t(spark, d, "events")
    return e.select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("wallet"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))


ACT = "act AS (SELECT 'w' || CAST(user_id AS VARCHAR) AS wallet, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"
PAIRS = f"{ACT}, pr AS (SELECT a.wallet AS wallet_a, b.wallet AS wallet_b, count(*) AS n FROM act a JOIN act b ON a.wallet < b.wallet AND abs(a.t - b.t) < 60 GROUP BY 1, 2 HAVING count(*) >= 3)"
TRANSFERS = "tr AS (SELECT l_orderkey AS tx, l_partkey AS mint, l_suppkey AS src, o_custkey AS dst, l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def transfers(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("mint"), F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("l_extendedprice").alias("amount"))


@query(f"WITH {TRANSFERS}, e AS (SELECT tx, src AS w FROM tr UNION ALL SELECT tx, -dst FROM tr) SELECT tx, count(DISTINCT w) AS wallets FROM e GROUP BY tx HAVING count(DISTINCT w) > 5")
def wallets_per_tx(spark, d):
    e = transfers(spark, d).select("tx", F.explode(F.array("src", -F.col("dst"))).alias("w"))
    return G.wallets_per_tx(e, "tx", "w")


@query(f"WITH {PAIRS} SELECT wallet_a, wallet_b, CAST(n AS BIGINT) AS n FROM pr")
def wallet_cluster_pairs(spark, d):
    return G.cluster_pairs(activity(spark, d))


CLUSTER = f"""{PAIRS}, c AS (SELECT count(DISTINCT w) AS n FROM (SELECT wallet_a AS w FROM pr UNION ALL SELECT wallet_b FROM pr)),
cf AS (SELECT 'PRIV-020' AS id, CASE WHEN n <= 2 THEN 'LOW' WHEN n <= 5 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CASE WHEN n <= 2 THEN 55 WHEN n <= 5 THEN 70 WHEN n <= 10 THEN 80 ELSE 90 END AS confidence, CAST(n AS VARCHAR) || ' wallets with correlated activity' AS code_snippet FROM c WHERE n > 0)"""


@query(f"WITH {CLUSTER} SELECT id, severity, CAST(confidence AS INTEGER) AS confidence, code_snippet FROM cf")
def wallet_cluster_finding(spark, d):
    return G.cluster_finding(G.cluster_pairs(activity(spark, d)), "program").select("id", "severity", "confidence", "code_snippet")


WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 10 WHEN 'LOW' THEN 5 ELSE 0 END"


def sql_grade(of: str) -> str:
    return f"s AS (SELECT greatest(0, 100 - CAST(round(coalesce(sum({WEIGHT} * confidence / 100.0), 0)) AS INTEGER)) AS score FROM {of}), g AS (SELECT CAST(score AS INTEGER) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s)"


@query(f"WITH {CLUSTER}, {sql_grade('cf')} SELECT (SELECT count(*) FROM events) AS transactions, (SELECT n FROM c) AS wallets, score, grade FROM g")
def ledger_report(spark, d):
    """The flagship: clustered wallets of a ledger, scored and graded; always one row."""
    n = V.cluster_evidence(activity(spark, d)).select(F.col("evidence").alias("wallets"))
    severity, confidence = G.cluster_weight(F.col("wallets"))
    total = F.when(F.col("wallets") > 0, T.severity_weight(severity) * confidence / 100.0).otherwise(0.0)
    return t(spark, d, "events").agg(F.count("*").alias("transactions")).crossJoin(n).select("transactions", "wallets", *R.grade_of(total))  # one row each


@query(f"""WITH {TRANSFERS}, n AS (SELECT tx, count(*) FILTER (WHERE amount > 10000) AS large FROM tr GROUP BY tx HAVING count(*) FILTER (WHERE amount > 10000) > 1)
SELECT 'PRIV-021' AS id, 'LOW' AS severity, 'tx:' || CAST(tx AS VARCHAR) AS file, CAST(large AS VARCHAR) || ' large transfers' AS code_snippet, 55 AS confidence FROM n""")
def large_transfer_multi(spark, d):
    g = transfers(spark, d).groupBy(F.col("tx").cast("string").alias("signature")).agg(F.collect_list(F.struct(F.col("amount").cast("string").alias("amount"))).alias("tokenTransfers"))
    return G.large_transfer_findings(g).select("id", "severity", "file", "code_snippet", "confidence")


@query(f"""WITH {TRANSFERS} SELECT a.src AS a_out, b.dst AS a_in, count(*) AS n FROM tr a JOIN tr b ON a.mint = b.mint AND a.amount > 0 AND b.amount > 0 AND abs(a.amount - b.amount) / a.amount < 0.05
WHERE a.src <> b.dst GROUP BY 1, 2 HAVING count(*) >= 2""")
def balance_corr_pairs(spark, d):
    return G.balance_pairs(transfers(spark, d), "mint", "src", "dst", "amount")


def basic(spark, d):
    """Events as basic transactions: logs of event types and properties, calls by type."""
    e = t(spark, d, "events")
    logs = F.array(F.concat(F.lit("Program log: "), "event_type", F.lit(" "), "props"), F.when(F.col("value") > 90, F.lit("debug: predictable seed")).when(F.col("value") < 5, F.lit("warning: ann@mail.example not initialized")).otherwise("able about"))
    return e.select(F.col("event_id").cast("string").alias("signature"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("blockTime"), F.array(F.struct(F.col("event_type").alias("programId"))).alias("instructions"), logs.alias("logs"))


@query("SELECT event_type AS target, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1")
def cpi_target_counts(spark, d):
    return V.call_targets(basic(spark, d), "click")


@query("""WITH w AS (SELECT md5(CAST(user_id AS VARCHAR)) AS address FROM events WHERE value > 50) SELECT address, count(*) AS n FROM w GROUP BY 1 HAVING count(*) > 1""")
def reinit_accounts(spark, d):
    e = t(spark, d, "events").where("value > 50")
    return V.init_addresses(e.select(F.array(F.concat(F.lit("Initialize "), F.md5(F.col("user_id").cast("string")))).alias("logs")))


@query("SELECT count(*) AS n, round(count(*) / ((max(CAST(floor(epoch(ts)) AS BIGINT)) - min(CAST(floor(epoch(ts)) AS BIGINT))) / 604800.0), 6) AS rate FROM events")
def pda_timeline_rate(spark, d):
    return V.weekly_rate(basic(spark, d)).select("n", F.round("rate", 6).alias("rate"))


SEEDY = f"({sql_count('lower(text)', vocab.SEED_WORDS)} >= 2 OR {sql_any('lower(text)', vocab.SEED_PHRASES)})"


@query(f"WITH e AS (SELECT event_id, upper({sql_pick(vocab.SEED_WORDS + ['x', 'y'])}) || ' ' || event_type || ' ' || {sql_pick(vocab.SEED_PHRASES + ['z'] * 7)} AS text FROM events) SELECT event_id FROM e WHERE {SEEDY}")
def seed_phrase_tx(spark, d):
    text = F.concat(F.upper(pick(vocab.SEED_WORDS + ["x", "y"])), F.lit(" "), "event_type", F.lit(" "), pick(vocab.SEED_PHRASES + ["z"] * 7))
    return t(spark, d, "events").where(V.seed_phrase_log(text)).select("event_id")


EVIDENCE = """v AS (SELECT count(*) FILTER (WHERE value > 90) AS debug, count(*) FILTER (WHERE value < 5) AS mail, count(*) FILTER (WHERE event_type <> 'click') AS calls, count(*) FILTER (WHERE value BETWEEN 5 AND 90) AS n FROM events)"""


@query(f"""WITH {EVIDENCE} SELECT 'PRIV-007' AS id, debug AS evidence, CASE WHEN debug > 0 THEN 10 ELSE -10 END AS adjustment FROM v
UNION ALL SELECT 'PRIV-009', calls, CASE WHEN calls = 0 THEN -20 WHEN calls <= 50 THEN -10 WHEN calls <= 500 THEN 0 ELSE 10 END FROM v
UNION ALL SELECT 'PRIV-010', debug, CASE WHEN debug = 1 THEN 20 WHEN debug <= 5 THEN 30 ELSE 40 END FROM v
UNION ALL SELECT 'PRIV-006', mail, CASE WHEN mail = 0 THEN -20 WHEN mail <= 10 THEN 15 WHEN mail <= 100 THEN 25 ELSE 35 END FROM v
UNION ALL SELECT 'PRIV-008', mail, CASE WHEN mail = 0 THEN -15 WHEN mail <= 3 THEN 10 WHEN mail <= 10 THEN 20 ELSE 30 END FROM v
UNION ALL SELECT 'PRIV-002', n, CASE WHEN n = 0 THEN -15 WHEN n = 1 THEN 25 WHEN n <= 5 THEN 35 ELSE 45 END FROM v""")
def transaction_evidence(spark, d):
    return V.transaction_evidence(basic(spark, d), "click")


@query(f"WITH {PAIRS}, c AS (SELECT count(DISTINCT w) AS n FROM (SELECT wallet_a AS w FROM pr UNION ALL SELECT wallet_b FROM pr)) SELECT 'PRIV-020' AS id, n AS evidence, CAST(CASE WHEN n = 0 THEN -10 WHEN n <= 2 THEN 10 WHEN n <= 5 THEN 20 WHEN n <= 10 THEN 30 ELSE 40 END AS INTEGER) AS adjustment FROM c")
def adjust_bucket(spark, d):
    return V.cluster_evidence(activity(spark, d))


@query("""WITH a AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal < 1000) AS bad, count(*) FILTER (WHERE c_custkey % 10 = 0) AS pii FROM customer)
SELECT 'PRIV-004' AS id, pii AS evidence, CASE WHEN pii > 0 THEN 25 ELSE -15 END AS adjustment FROM a UNION ALL SELECT 'PRIV-005', pii, CASE WHEN pii > 0 THEN 25 ELSE -15 END FROM a
UNION ALL SELECT 'PRIV-008', bad, CASE WHEN bad = 0 THEN -20 WHEN bad * 100.0 / n > 50 THEN 30 WHEN bad * 100.0 / n > 20 THEN 20 WHEN bad * 100.0 / n > 5 THEN 10 ELSE 5 END FROM a
UNION ALL SELECT 'PRIV-010', n, CASE WHEN n <= 10 THEN -15 WHEN n <= 100 THEN 10 WHEN n <= 1000 THEN 25 ELSE 35 END FROM a""")
def account_ratio(spark, d):
    text = F.when(F.col("c_custkey") % 10 == 0, F.lit("ann@mail.com of the north")).otherwise(F.lit("nothing of that kind here"))
    a = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("pubkey"), F.lit("encoded").alias("data_kind"), F.base64(F.encode(text, "utf-8")).alias("data"), F.when(F.col("c_acctbal") < 1000, 4).otherwise(100).cast("long").alias("size"))
    return V.account_evidence(a)


@query("""WITH r AS (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) SELECT r.user_id, r.event_id, c.c_name FROM r JOIN customer c ON c.c_custkey = r.user_id WHERE k <= 5""")
def topk_sig_join(spark, d):
    top = J.top_k(t(spark, d, "events"), "user_id", [F.desc("ts"), F.asc("event_id")], 5)
    return top.join(t(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).select("user_id", "event_id", "c_name")


@query("SELECT event_id FROM events WHERE event_type IN ('purchase', 'signup')")
def vocab_semi(spark, d):
    return J.in_vocabulary(t(spark, d, "events"), "event_type", ["purchase", "signup"]).select("event_id")


@query("SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'Vote111111111111111111111111111111111111111' ELSE 'mine' END AS program FROM events WHERE user_id % 7 <> 0")
def system_anti(spark, d):
    p = F.when(F.col("user_id") % 7 == 0, "Vote111111111111111111111111111111111111111").otherwise("mine")
    return G.not_system(t(spark, d, "events").select("event_id", p.alias("program")), "program").select("event_id", "program")


@query("SELECT DISTINCT l_partkey AS mint, p_name AS name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def mint_distinct_lookup(spark, d):
    return G.mint_metadata(t(spark, d, "lineitem"), t(spark, d, "part"), "l_partkey", "p_partkey").select(F.col("l_partkey").alias("mint"), F.col("p_name").alias("name"))


@query("SELECT event_id, CASE WHEN user_id % 3 > 0 THEN event_type END AS name FROM events")
def json_field(spark, d):
    text = F.concat(F.lit('{"id": "x", "'), F.when(F.col("user_id") % 3 > 0, "name").otherwise("title"), F.lit('" : "'), "event_type", F.lit('"}'))
    return t(spark, d, "events").select("event_id", T.field_value(text, "name").alias("name"))


# ---------------------------------------------------------------- fields


FIELD_NAMES = list(dict.fromkeys([*vocab.SAFE_FIELD_NAMES, *vocab.PII_PATTERNS, *vocab.SECRET_PATTERNS, *["home_address", "name", "user_name", "market_name", "email_hash", "client_address", "wallet_address", "auth_token", "pool_id", "memo_text", "my_phone"]]))
FIELD_TYPES, FIELD_STRUCTS = ["String", "Pubkey", "u64", "Vec<u8>"], ["UserProfile", "PoolConfig"]


def field_table(spark):
    return spark.createDataFrame([(n, ty, s) for n in FIELD_NAMES for ty in FIELD_TYPES for s in FIELD_STRUCTS], "field string, type string, struct string")


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_kept(p: str) -> str:
    """Whether a match of the pattern means something, of a field that is not safe."""
    pub, ids = "contains(type, 'Pubkey')", "(contains(type, 'Pubkey') OR contains(type, 'u64') OR contains(type, 'u32'))"
    ledger = sql_any("low", ["market", "pool", "token", "program"])
    return {
        "token": "type = 'String' AND low = 'token'", "key": sql_any("low", ["private", "secret", "api"]), "seed": sql_any("low", ["phrase", "mnemonic"]), "auth": f"NOT ({pub} OR contains(low, 'authority'))",
        "address": f"NOT {pub}", "name": f"NOT ({pub} OR {ledger})", "id": f"NOT {ids}", "user": f"NOT {ids}", "identifier": f"NOT {ids}",
    }.get(p, "false" if p in ("fee", "amount", "balance", "price", "total") else "true")


def sql_kinds(words: list[str], ty: str = "type") -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains(low, '{p}') AND ({sql_kept(p).replace('type', ty)}) THEN '{p}' END" for p in words) + ", NULL)"


def sql_safe(ty: str, struct: str | None) -> str:
    alt = "|".join(vocab.SAFE_TYPES)
    context = f"({sql_any(f'lower({struct})', vocab.SAFE_STRUCT_CONTEXTS)})" if struct else "false"
    return f"""((contains({ty}, 'Pubkey') AND NOT {sql_any('low', vocab.PERSONAL_PREFIXES)}) OR list_contains({sql_list(vocab.SAFE_FIELD_NAMES)}, low) OR {sql_any('low', vocab.SAFE_FIELD_PATTERNS)}
 OR ((regexp_matches({ty}, '^({alt})|<({alt})')) AND NOT contains({ty}, 'String')) OR (low IN ('name', 'title', 'label') AND {context}) OR regexp_matches(low, '({"|".join(vocab.SAFE_SUFFIXES)})$'))"""


PERSON = sql_any("lower(struct)", ["user", "profile", "member", "person", "customer", "identity"])


@query(f"""WITH f AS (SELECT field, type, struct, lower(field) AS low FROM (SELECT unnest({sql_list(FIELD_NAMES)}) AS field) CROSS JOIN (SELECT unnest({sql_list(FIELD_TYPES)}) AS type) CROSS JOIN (SELECT unnest({sql_list(FIELD_STRUCTS)}) AS struct)),
s AS (SELECT *, {sql_safe('type', 'struct')} AS safe, {sql_safe('type', None)} AS safe_alone, {sql_safe("'unknown'", None)} AS safe_untyped FROM f)
SELECT field, type, struct, safe, CASE WHEN safe THEN NULL
 WHEN low IN ('name', 'username', 'user_name') THEN CASE WHEN {PERSON} OR (contains(type, 'String') AND NOT {sql_any('low', ['market', 'pool', 'token', 'program'])}) THEN 'name' END
 WHEN contains(low, 'address') THEN CASE WHEN NOT contains(type, 'Pubkey') AND NOT {sql_any('low', ['wallet', 'token', 'program', 'mint'])} AND contains(type, 'String') THEN 'address' END
 WHEN safe_alone THEN NULL ELSE {sql_kinds(vocab.PII_PATTERNS)} END AS pii,
 CASE WHEN contains(low, 'hash') OR contains(low, 'encrypted') OR safe_untyped THEN NULL ELSE {sql_kinds(vocab.SECRET_PATTERNS, "'unknown'")} END AS secret FROM s""")
def field_rules(spark, d):
    f = field_table(spark)
    return f.select("field", "type", "struct", K.is_safe_field("field", "type", "struct").alias("safe"), K.pii_kind("field", "type", "struct").alias("pii"), K.secret_kind("field").alias("secret"))


# ---------------------------------------------------------------- findings


def findings(spark, d):
    ls = doc_lines(spark, d).withColumn("e", T.email("text"))
    at = (F.col("doc_id").cast("string"), F.col("line_no"), F.col("text"))
    return R.found(ls, [
        R.rule(F.col("e").isNotNull(), "PRIV-006", "E-mail", "CRITICAL", *at, "Remove it.", F.when(T.is_placeholder_email("e"), 75).otherwise(95), F.array("e")),
        R.rule(T.phone("text").isNotNull(), "PRIV-006", "Phone", "HIGH", *at, "Remove it.", 90),
        R.rule(F.col("text").rlike("token = \"[0-9a-f]{40}\""), "PRIV-001", "Token", "CRITICAL", *at, "Remove it.", 80),
        R.rule(F.col("text").rlike(vocab.IPV4), "PRIV-007", "Address", "LOW", *at, "Remove it.", 60),
    ])


FOUND = f"""{LINES}, f AS (
SELECT 'PRIV-006' AS id, 'E-mail' AS title, 'CRITICAL' AS severity, CAST(doc_id AS VARCHAR) AS file, line_no AS line, text AS code_snippet, CASE WHEN regexp_matches(lower(regexp_extract(text, '{vocab.EMAIL}')), '{DOMAINS}') THEN 75 ELSE 95 END AS confidence, [regexp_extract(text, '{vocab.EMAIL}')] AS evidence FROM l WHERE regexp_matches(text, '{vocab.EMAIL}')
UNION ALL SELECT 'PRIV-006', 'Phone', 'HIGH', CAST(doc_id AS VARCHAR), line_no, text, 90, [] FROM l WHERE regexp_matches(text, '{vocab.PHONE}')
UNION ALL SELECT 'PRIV-001', 'Token', 'CRITICAL', CAST(doc_id AS VARCHAR), line_no, text, 80, [] FROM l WHERE regexp_matches(text, 'token = "[0-9a-f]{{40}}"')
UNION ALL SELECT 'PRIV-007', 'Address', 'LOW', CAST(doc_id AS VARCHAR), line_no, text, 60, [] FROM l WHERE regexp_matches(text, '{vocab.IPV4}'))"""


@query(f"WITH {FOUND} SELECT id, title, severity, file, line, CAST(confidence AS INTEGER) AS confidence FROM f")
def finding_union(spark, d):
    return findings(spark, d).select("id", "title", "severity", "file", "line", "confidence")


@query(f"""WITH {FOUND}, o AS (SELECT *, row_number() OVER (PARTITION BY id, title ORDER BY file || ':' || CAST(line AS VARCHAR)) AS k, count(*) OVER (PARTITION BY id, title) AS n FROM f)
SELECT id, title, severity, file, line, CAST(least(100, confidence + 5 * (n - 1)) AS INTEGER) AS confidence FROM o WHERE k = 1""")
def aggregate_findings(spark, d):
    f = findings(spark, d).withColumn("_o", F.concat("file", F.lit(":"), F.col("line").cast("string")))
    return R.aggregate_findings(f, "_o").select("id", "title", "severity", "file", "line", "confidence")


@query(f"WITH {FOUND} SELECT " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")) + ", count(DISTINCT file) AS files FROM f")
def severity_summary(spark, d):
    return R.summary(findings(spark, d))


@query(f"WITH {FOUND} SELECT count(*) FILTER (WHERE confidence >= 90) AS very_high, count(*) FILTER (WHERE confidence >= 70 AND confidence < 90) AS high, count(*) FILTER (WHERE confidence < 70) AS lower, round(avg(confidence), 6) AS average FROM f")
def confidence_buckets(spark, d):
    return R.confidence_buckets(findings(spark, d))


@query(f"WITH {FOUND}, {sql_grade('f')} SELECT score, grade, score >= 50 AS passed FROM g")
def grade_score(spark, d):
    return R.passes_gate(findings(spark, d), 50)


GRADED = "SELECT s_suppkey AS file, CASE CAST(s_suppkey % 4 AS INTEGER) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'LOW' WHEN 2 THEN 'INFO' ELSE 'MEDIUM' END AS severity, 10 + s_suppkey % 80 AS confidence FROM supplier WHERE s_suppkey <= 9"


@query(f"WITH f AS ({GRADED}), {sql_grade('f')} SELECT score, grade, score >= 50 AS passed FROM g")
def grade_of_few(spark, d):
    k = F.col("s_suppkey")
    s = F.when(k % 4 == 0, "CRITICAL").when(k % 4 == 1, "LOW").when(k % 4 == 2, "INFO").otherwise("MEDIUM")
    return R.passes_gate(t(spark, d, "supplier").where(k <= 9).select(s.alias("severity"), (10 + k % 80).cast("int").alias("confidence")), 50)


@query(f"WITH {FOUND} SELECT id, title, file, line FROM f WHERE severity IN ('HIGH', 'CRITICAL') AND confidence >= 80")
def severity_filter(spark, d):
    return R.at_least(findings(spark, d), "HIGH", 80).select("id", "title", "file", "line")


def marks(spark, d):
    f = t(spark, d, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("file")).distinct()
    none, n = F.lit(None).cast("int"), F.lit(None).cast("string")
    return f.select("file", F.lit("file").alias("scope"), none.alias("line"), F.lit("PRIV-006").alias("rule")).unionByName(f.select("file", F.lit("line").alias("scope"), F.lit(1).alias("line"), n.alias("rule")))


@query(f"""WITH {FOUND}, m AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS file FROM labels WHERE quality = 0)
SELECT id, title, file, line FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file = f.file AND (f.id = 'PRIV-006' OR f.line = 1))""")
def suppress_anti(spark, d):
    return J.unsuppressed(findings(spark, d), marks(spark, d)).select("id", "title", "file", "line")


@query(f"""WITH {FOUND}, m AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS file FROM labels WHERE quality = 0)
SELECT count(*) - count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file = f.file AND (f.id = 'PRIV-006' OR f.line = 1))) AS suppressed FROM f""")
def suppress_count(spark, d):
    f = findings(spark, d)
    return f.agg(F.count("*").alias("n")).crossJoin(J.unsuppressed(f, marks(spark, d)).agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("suppressed"))  # one row each


@query(f"""WITH {EVENT_LINES} SELECT file, CASE WHEN contains(text, 'purchase') THEN line_no + 1 ELSE line_no END AS line, CASE WHEN contains(text, 'click 3') THEN 'PRIV-006' END AS rule FROM l WHERE contains(text, 'purchase') OR contains(text, 'click 3')""")
def suppress_line_rule(spark, d):
    x = F.col("text")
    code = F.when(x.contains("purchase"), "// privacy-ignore-next-line").when(x.contains("click 3"), "f(x); // privacy-ignore [priv-006]").otherwise("")
    return J.suppression_marks(event_lines(spark, d).withColumn("text", code)).where("scope = 'line'").select("file", "line", "rule")


EV = "e AS (SELECT id, sum(evidence) AS evidence, sum(adjustment) AS adjustment FROM (VALUES ('PRIV-006', 12, 25), ('PRIV-001', 0, -10), ('PRIV-006', 3, -5)) AS x(id, evidence, adjustment) GROUP BY id)"


@query(f"""WITH {FOUND}, {EV} SELECT f.id, file, line, CAST(confidence AS INTEGER) AS static_confidence, CAST(greatest(5, least(100, confidence + coalesce(adjustment, 0))) AS INTEGER) AS verified_confidence,
coalesce('evidence: ' || CAST(e.evidence AS VARCHAR), 'no ledger check for this rule') AS note FROM f LEFT JOIN e ON f.id = e.id""")
def verify_left_join(spark, d):
    e = spark.createDataFrame([("PRIV-006", 12, 25), ("PRIV-001", 0, -10), ("PRIV-006", 3, -5)], "id string, evidence long, adjustment int")
    return V.verify(findings(spark, d), e).select("id", "file", "line", "static_confidence", "verified_confidence", F.col("notes")[0].alias("note"))


@query(f"""WITH {LINES}, m AS (SELECT doc_id, line_no, text FROM l WHERE contains(text, '.')) SELECT a.doc_id, a.line_no, (SELECT md5(arg_max(m.text, m.line_no)) FROM m WHERE m.doc_id = a.doc_id AND m.line_no <= a.line_no) AS mark FROM l a WHERE contains(a.text, '@')""")
def asof_struct(spark, d):
    ls = doc_lines(spark, d)
    m = ls.where(F.col("text").contains(".")).select("doc_id", "line_no", F.md5("text").alias("mark"))
    return J.as_of(ls.where(F.col("text").contains("@")), m, "doc_id", "line_no", "mark").select("doc_id", "line_no", "mark")


@query(f"WITH {FOUND} SELECT id, title, file, line, CASE WHEN confidence >= 90 THEN 'Very High' WHEN confidence >= 70 THEN 'High' WHEN confidence >= 50 THEN 'Medium' WHEN confidence >= 25 THEN 'Low' ELSE 'Very Low' END AS label FROM f")
def confidence_labels(spark, d):
    return findings(spark, d).select("id", "title", "file", "line", T.confidence_label("confidence").alias("label"))


LABEL = "CASE WHEN confidence >= 90 THEN 'Very High' WHEN confidence >= 70 THEN 'High' WHEN confidence >= 50 THEN 'Medium' WHEN confidence >= 25 THEN 'Low' ELSE 'Very Low' END"
COUNTED = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")) + ", count(DISTINCT file) AS files"


@query(f"""WITH {FOUND}, {sql_grade('f')}, c AS (SELECT {COUNTED} FROM f)
SELECT 'head' AS part, CAST(to_json({{'score': score, 'grade': grade, 'summary': {{'critical': critical, 'high': high, 'medium': medium, 'low': low, 'info': info, 'files': files}}}}) AS VARCHAR) AS report FROM g, c
UNION ALL SELECT 'finding', CAST(to_json({{'id': id, 'title': title, 'severity': severity, 'file': file, 'line': line, 'recommendation': 'Remove it.', 'confidence': confidence, 'evidence': evidence, 'confidence_label': {LABEL}}}) AS VARCHAR) FROM f""")
def json_report(spark, d):
    return R.json_report(findings(spark, d).drop("code_snippet"))


@query(f"""WITH {FOUND}, {sql_grade('f')} SELECT 0 AS place, 100 AS confidence, 'Privacy score ' || CAST(score AS VARCHAR) || ' (' || grade || ')' AS text FROM g
UNION ALL SELECT CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END, confidence, '[' || severity || '] ' || id || ' ' || title || ' (' || file || ':' || CAST(line AS VARCHAR) || ') ' || {LABEL} || ' ' || CAST(confidence AS VARCHAR) || '%' FROM f""")
def text_report(spark, d):
    return R.text_report(findings(spark, d))


# ---------------------------------------------------------------- sources


@query(cases.values("file, line, source_kind, sink, carrier, confidence", cases.SAMPLE_FLOWS))
def taint_flow(spark, d):
    from veilscan.operators.taint import summaries, taint_flows
    from veilscan.sources.samples import sample_files

    files = sample_files(spark)
    return taint_flows(files, summaries(files)).select("file", "line", "source_kind", "sink", "carrier", "confidence")


@query(cases.values("id, file, line, confidence", cases.SAMPLE_FINDINGS))
def static_scan(spark, d):
    from veilscan.operators.static import scan
    from veilscan.sources.samples import sample_files

    return scan(sample_files(spark)).select("id", "file", "line", "confidence")


@query("""SELECT id, CAST(n AS BIGINT) AS n FROM (VALUES ('PRIV-001', 1), ('PRIV-002', 2), ('PRIV-004', 2), ('PRIV-005', 1), ('PRIV-007', 1), ('PRIV-009', 1), ('PRIV-010', 1), ('PRIV-020', 1)) AS t(id, n)""")
def ledger_scan(spark, d):
    from veilscan.plans.scan import scan_ledger
    from veilscan.sources.ledger import assets, rich_transactions, token_metadata
    from veilscan.sources.samples import asset_json, ledger_json, metadata_json

    return scan_ledger(rich_transactions(ledger_json(spark)), assets(asset_json(spark)), token_metadata(metadata_json(spark)), "Prog1").groupBy("id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- known results


def _files(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "file string, content string")


@query(cases.values("file, ids", [(r[0], r[2]) for r in cases.STATIC]))
def static_rules(spark, d):
    from veilscan.operators.static import scan

    files = _files(spark, cases.STATIC)
    ids = scan(files, ["secrets", "pii", "logs", "access", "anchor"]).groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))
    return files.select("file").join(ids, "file", "left").select("file", F.coalesce("ids", F.lit("")).alias("ids"))


@query(cases.values("file, flows", [(r[0], r[2]) for r in cases.FLOWS]))
def taint_rules(spark, d):
    from veilscan.operators.taint import summaries, taint_flows

    files = _files(spark, cases.FLOWS)
    one = F.concat_ws(":", F.col("line").cast("string"), "sink", "source_kind", "carrier", F.col("confidence").cast("string"))
    got = taint_flows(files, summaries(files)).where("sink <> 'return'").groupBy("file").agg(F.array_join(F.array_sort(F.collect_set(one)), ",").alias("flows"))
    return files.select("file").join(got, "file", "left").select("file", F.coalesce("flows", F.lit("")).alias("flows"))


@query(cases.values("code_snippet, adjustment, note", cases.TARGETS))
def target_rules(spark, d):
    f = spark.createDataFrame([(s,) for s, _, _ in cases.TARGETS], "code_snippet string")
    return V.program_risk(f, spark.createDataFrame(cases.PROGRAMS, "program string, owner string, exists boolean")).select("code_snippet", "adjustment", "note")


@query(cases.values("program, static_confidence, verified_confidence", [(g[0], g[4], g[5]) for g in cases.GENERIC]))
def generic_verification(spark, d):
    p = spark.createDataFrame(cases.GENERIC, "program string, owner string, exists boolean, enumerable int, static_confidence int, want int")
    return V.program_evidence(p).select("program", "static_confidence", T.adjusted("static_confidence", F.col("adjustment")).alias("verified_confidence"))


def _case_findings(spark):
    return spark.createDataFrame([(i, "t", "HIGH", "f", n, "", "", c, []) for n, (i, c, _) in enumerate(cases.VERIFIED)], R.FINDING)


@query(cases.values("id, static_confidence, verified_confidence", cases.VERIFIED))
def verify_fixtures(spark, d):
    from veilscan.sources.ledger import BASIC_TX

    tx = spark.createDataFrame([("s", 100, [("T", None, None, [])], cases.LOGS)], BASIC_TX)
    return V.verify(_case_findings(spark), V.transaction_evidence(tx, "P")).select("id", "static_confidence", "verified_confidence")


@query(cases.values("id, confidence", [(i, c) for i, _, c in cases.VERIFIED]))
def verify_and_merge(spark, d):
    from veilscan.plans.scan import verify_findings
    from veilscan.sources.ledger import BASIC_TX

    tx = spark.createDataFrame([("s", 100, [("T", None, None, [])], cases.LOGS)], BASIC_TX)
    return verify_findings(_case_findings(spark), V.transaction_evidence(tx, "P")).select("id", "confidence")


@query(cases.values("name, text, result", cases.VALUES))
def value_rules(spark, d):
    v = spark.createDataFrame([r[:2] for r in cases.VALUES], "name string, text string")
    x, s = F.col("text"), lambda c: c.cast("string")
    tx = G.tx_context(v.withColumn("type", F.substring_index(x, "|", 1)).withColumn("description", F.substring_index(x, "|", -1)))
    n = F.col("name")
    out = F.when(n == "first_address", T.first_address(x)).when(n == "field_value", T.field_value(x, "name")).when(n == "payload_size", s(T.payload_size(x))).when(n == "has_name", s(T.contains_identifier(x, "name")))
    out = out.when(n == "account_pii", s(T.has_account_pii(x))).when(n == "safe_value", s(T.is_safe_name_value(x))).when(n == "tx_context", F.col("context"))
    return tx.select("name", "text", out.alias("result"))


@query(cases.values("file, line, delta", cases.DELTAS))
def context_rules(spark, d):
    from veilscan.operators.static import context_adjustment

    return context_adjustment(L.lines(_files(spark, cases.CONTEXT_FILES), "file", "content")).select("file", F.col("line_no").alias("line"), "delta")


@query(cases.values("id, code_snippet", cases.BARE[2]))
def bare_ledger_findings(spark, d):
    accounts, memos, _ = cases.BARE
    return V.ledger_findings(spark.createDataFrame(accounts, "lamports long, size long"), spark.createDataFrame([(m,) for m in memos], "memo string"), "P").select("id", "code_snippet")


@query("""SELECT * FROM (VALUES ('Deposit', 'holder', 'Account<Holder>', 28, true, false, NULL), ('Deposit', 'book', 'Account<Book>', 30, false, false, 'b"ledger"'), ('Deposit', 'authority', 'AccountInfo<>', 31, false, false, NULL),
('Deposit', 'payer', 'Signer<>', 32, false, true, NULL), ('UserProfile', 'email', 'String', 37, false, false, NULL), ('UserProfile', 'phone_number', 'String', 38, false, false, NULL), ('UserProfile', 'owner', 'Pubkey', 39, false, false, NULL),
('UserProfile', 'password', 'String', 40, false, false, NULL), ('UserProfile', 'balance', 'u64', 41, false, false, NULL)) AS t(struct, field, type, line, is_mut, is_signer, seeds)""")
def struct_parse(spark, d):
    from veilscan.sources.rust import struct_fields
    from veilscan.sources.samples import sample_files

    return struct_fields(sample_files(spark)).select("struct", "field", "type", "line", "is_mut", "is_signer", "seeds")


@query("SELECT * FROM (VALUES ('Deposit', true, false), ('UserProfile', true, false)) AS t(struct, has_authority, unprotected_mut)")
def struct_predicates(spark, d):
    from veilscan.operators.static import struct_predicates as predicates
    from veilscan.sources.rust import struct_fields
    from veilscan.sources.samples import sample_files

    return predicates(struct_fields(sample_files(spark))).select("struct", "has_authority", "unprotected_mut")


ACCOUNT_JSON = '{"lamports": 7, "owner": "o", "data": ["%s", "base64"], "executable": false, "rentEpoch": 1}'
ENVELOPES = {"bare": "[%s]", "result": '{"result": [%s]}', "transactions": '{"transactions": [%s]}', "result.items": '{"result": {"items": [%s]}}', "items": '{"items": [%s]}'}


def _raw(spark, text: str):
    return spark.createDataFrame([("p", text)], "path string, raw string")


@query(cases.values("envelope, signature", [(e, s) for e in ENVELOPES for s in ("a", "b")]))
def json_envelope(spark, d):
    from veilscan.sources.ledger import rich_transactions

    two = '{"signature": "a"}, {"signature": "b"}'
    return R.union([rich_transactions(_raw(spark, x % two)).select(F.lit(e).alias("envelope"), "signature") for e, x in ENVELOPES.items()])


RPC = [("account", "", 7, 3), ("multiple", "0", 7, 66), ("multiple", "1", -1, -1), ("program", "k1", 7, 3), ("sized", "k2", 7, 66), ("matching", "k1", 7, 3), ("tokens", "k1", 7, 3), ("tokens", "k2", 7, 66)]


@query("SELECT call, key, CAST(lamports AS BIGINT) AS lamports, CAST(size AS BIGINT) AS size FROM (" + cases.values("call, key, lamports, size", [*RPC, ("program", "k2", 7, 66)]) + ")")
def rpc_accounts(spark, d):
    from veilscan.sources import ledger as S

    a, b = ACCOUNT_JSON % "AQID", ACCOUNT_JSON % ("A" * 88)
    two = f'[{{"pubkey": "k1", "account": {a}}}, {{"pubkey": "k2", "account": {b}}}]'
    both = _raw(spark, f'{{"result": {two}}}')
    told = lambda df, call, key: df.select(F.lit(call).alias("call"), key.cast("string").alias("key"), *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("lamports", "size")])
    return R.union([
        told(S.account_info(_raw(spark, f'{{"result": {{"value": {a}}}}}')), "account", F.lit("")), told(S.multiple_accounts(_raw(spark, f'{{"result": {{"value": [{b}, null]}}}}')), "multiple", F.col("position")),
        told(S.program_accounts(both), "program", F.col("pubkey")), told(S.program_accounts(both, data_size=66), "sized", F.col("pubkey")), told(S.program_accounts(both, memcmp=(1, "0203")), "matching", F.col("pubkey")),
        told(S.token_accounts(_raw(spark, f'{{"result": {{"value": {two}}}}}')), "tokens", F.col("pubkey")),
    ])


@query("SELECT signature, CAST(slot AS BIGINT) AS slot, memo FROM (VALUES ('a', 3, 'hello'), ('b', 2, NULL)) AS t(signature, slot, memo)")
def rpc_signatures(spark, d):
    from veilscan.sources.ledger import signatures

    rows = ", ".join(f'{{"signature": "{s}", "slot": {n}, "err": null, "memo": {m}, "blockTime": 1}}' for s, n, m in (("c", 1, '"x"'), ("a", 3, '"hello"'), ("b", 2, "null")))
    return signatures(_raw(spark, f'{{"result": [{rows}]}}'), 2).select("signature", "slot", "memo")


@query("SELECT * FROM (VALUES ('PRIV-001', -10), ('PRIV-002', 40), ('PRIV-006', 25), ('PRIV-007', 10)) AS t(id, adjustment)")
def memo_rules(spark, d):
    s = spark.createDataFrame([("a", 3, "private note"), ("b", 2, "seed phrase: x"), ("c", 1, None)], "signature string, slot long, memo string")
    logs = spark.createDataFrame([("a", (["ip: 1.2.3.4", "DEBUG: x"],))], "signature string, meta struct<logMessages: array<string>>")
    return V.memo_evidence(s, logs).select("id", "adjustment")


@query("SELECT 'PRIV-021' AS id, CAST(1 AS BIGINT) AS evidence, 15 AS adjustment")
def balance_rules(spark, d):
    rows = [("x", "A", "B", 100.0), ("x", "A", "B", 101.0), ("y", "A", "B", 500.0), ("x", "C", "D", 900.0)]
    return V.balance_evidence(spark.createDataFrame(rows, "mint string, source string, target string, amount double"), "mint", "source", "target", "amount")
