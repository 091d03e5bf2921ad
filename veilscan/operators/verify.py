"""Findings against ledger evidence: evidence is aggregated once per program, then joined; unknown rules stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan import vocab
from veilscan.functions import text as T
from veilscan.operators.ledger import balance_pairs, cluster_pairs
from veilscan.operators.report import finding, union

#: Adjustments by counts, the first upper bound that holds a count.
ADJUST = {
    "event": [(0, -20), (10, 15), (100, 25), (None, 35)],
    "state": [(0, -15), (3, 10), (10, 20), (None, 30)],
    "calls": [(0, -20), (50, -10), (500, 0), (None, 10)],
    "seeds": [(1, 20), (5, 30), (None, 40)],
    "phrase": [(0, -15), (1, 25), (5, 35), (None, 45)],
    "wallets": [(0, -10), (2, 10), (5, 20), (10, 30), (None, 40)],
    "balance": [(0, -10), (2, 15), (5, 25), (None, 35)],
    "accounts": [(10, -15), (100, 10), (1000, 25), (None, 35)],
}


def seed_phrase_log(log: Column, least: int = 2) -> Column:
    low = F.lower(log)
    return (T.count_contained(low, vocab.SEED_WORDS) >= least) | T.contains_any(low, vocab.SEED_PHRASES)


def init_addresses(tx: DataFrame) -> DataFrame:
    """(address, n): words of 32 to 44 characters in logs of initialisations, seen more than once."""
    logs = tx.select(F.explode("logs").alias("log")).where(T.contains_any(F.lower("log"), ["initialize", "created account"]))
    words = logs.select(F.explode(F.split("log", r"[ \t\r\n]+")).alias("address")).where(F.length("address").between(32, 44))
    return words.groupBy("address").agg(F.count("*").alias("n")).where("n > 1")


def call_targets(tx: DataFrame, program: str) -> DataFrame:
    calls = tx.select(F.explode("instructions").alias("i")).select(F.col("i.programId").alias("target")).where(F.col("target") != program)
    return calls.groupBy("target").agg(F.count("*").alias("n"))


def weekly_rate(tx: DataFrame, t: str = "blockTime") -> DataFrame:
    """One row: transactions a week between the first and the last."""
    a = tx.agg(F.count("*").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"))
    weeks = (F.col("hi") - F.col("lo")) / F.lit(604800.0)
    return a.select("n", F.when(weeks > 0, F.col("n") / weeks).otherwise(F.col("n").cast("double")).alias("rate"))


def transaction_evidence(tx: DataFrame, program: str) -> DataFrame:
    """(id, evidence, adjustment): one row per rule, from basic transactions (signature, blockTime, instructions, logs)."""
    x = lambda name, word: F.exists("logs", lambda log: word(log))  # noqa: E731, ARG005
    low = F.lower
    state = lambda log: T.contains_any(low(log), ["no anchor discriminator", "missing discriminator", "invalid discriminator"]) | (low(log).contains("discriminator") & low(log).contains("warning"))
    fresh = lambda log: T.contains_any(low(log), ["warning", "error"]) & T.contains_any(low(log), ["uninitialized", "not initialized"])
    guess = lambda log: T.contains_any(low(log), ["predictable seed", "predictable pda", "enumerable seed"])
    series = lambda log: T.contains_any(low(log), ["derived pda", "find_program_address"]) & T.contains_any(low(log), ["_1", "_2", "_3", "user1", "user2", "account1", "account2"])
    flags = tx.select(
        x("event", lambda g: F.size(T.log_pii_types(g)) > 0).alias("event"), x("debug", T.is_debug_output).alias("debug"),
        F.size(F.filter("logs", state)).alias("state"), F.size(F.filter("logs", fresh)).alias("fresh"),
        F.size(F.filter("logs", guess)).alias("guess"), F.size(F.filter("logs", series)).alias("series"), x("phrase", seed_phrase_log).alias("phrase"),
        F.size(F.filter("instructions", lambda i: i["programId"] != program)).alias("calls"),
    )
    one = flags.agg(*[F.count_if(c).alias(c) for c in ("event", "debug", "phrase")], *[F.coalesce(F.sum(F.greatest(F.col(c), F.lit(0))), F.lit(0)).alias(c) for c in ("state", "fresh", "guess", "series", "calls")])
    one = one.crossJoin(F.broadcast(weekly_rate(tx))).crossJoin(F.broadcast(init_addresses(tx).agg(F.count("*").alias("again"))))  # one row each
    seeds, state_n = F.col("guess") + F.col("series"), F.col("state") + F.col("fresh") + F.col("again")
    rate = F.when(F.col("rate") < 100, -10).when(F.col("rate") < 1000, 5).otherwise(20)
    rules = [
        ("PRIV-006", F.col("event"), T.bucket("event", ADJUST["event"])), ("PRIV-007", F.col("debug"), F.when(F.col("debug") > 0, 10).otherwise(-10)),
        ("PRIV-008", state_n, T.bucket(state_n, ADJUST["state"])), ("PRIV-009", F.col("calls"), T.bucket("calls", ADJUST["calls"])),
        ("PRIV-010", seeds, F.when(seeds > 0, T.bucket(seeds, ADJUST["seeds"])).otherwise(rate)), ("PRIV-002", F.col("phrase"), T.bucket("phrase", ADJUST["phrase"])),
    ]
    return union([one.select(F.lit(i).alias("id"), n.cast("long").alias("evidence"), a.cast("int").alias("adjustment")) for i, n, a in rules])


def cluster_evidence(activity: DataFrame) -> DataFrame:
    n = cluster_pairs(activity).select(F.explode(F.array("wallet_a", "wallet_b")).alias("w")).agg(F.countDistinct("w").alias("evidence"))
    return n.select(F.lit("PRIV-020").alias("id"), "evidence", T.bucket("evidence", ADJUST["wallets"]).cast("int").alias("adjustment"))


def balance_evidence(transfers: DataFrame, mint: str, source: str, target: str, amount: str) -> DataFrame:
    n = balance_pairs(transfers, mint, source, target, amount).agg(F.count("*").alias("evidence"))
    return n.select(F.lit("PRIV-021").alias("id"), "evidence", T.bucket("evidence", ADJUST["balance"]).cast("int").alias("adjustment"))


def account_evidence(accounts: DataFrame) -> DataFrame:
    """(id, evidence, adjustment) from program accounts (pubkey, data_kind, data, size)."""
    zero = F.when(F.col("data_kind") == "encoded", F.col("data").rlike("^[A=a]*$")).otherwise(F.col("data").rlike("^[0\\x00]*$"))
    bad = (F.col("size") < 8) | zero
    one = accounts.agg(F.count("*").alias("n"), F.count_if(T.has_account_pii("data")).alias("pii"), F.count_if(bad).alias("bad"))
    pct = F.col("bad") * 100.0 / F.col("n")
    state = F.when(F.col("n") == 0, -10).when(F.col("bad") == 0, -20).when(pct > 50, 30).when(pct > 20, 20).when(pct > 5, 10).otherwise(5)
    pii = F.when(F.col("pii") > 0, 25).otherwise(-15)
    rules = [("PRIV-004", F.col("pii"), pii), ("PRIV-005", F.col("pii"), pii), ("PRIV-008", F.col("bad"), state), ("PRIV-010", F.col("n"), T.bucket("n", ADJUST["accounts"]))]
    return union([one.select(F.lit(i).alias("id"), n.alias("evidence"), a.cast("int").alias("adjustment")) for i, n, a in rules])


def memo_evidence(signatures: DataFrame, transactions: DataFrame) -> DataFrame:
    """(id, evidence, adjustment) from signatures (signature, slot, memo) and transactions (signature, meta): memos of all signatures, logs
    of the newest 1, 5 or 10."""
    from pyspark.sql import Window as W

    newest = signatures.withColumn("r", F.row_number().over(W.orderBy(F.desc("slot"), "signature"))).where("r <= 10").select("signature", "r")
    logs = F.broadcast(newest).join(transactions.select("signature", F.explode("meta.logMessages").alias("log")), "signature")
    low = F.lower("memo")
    memo = signatures.agg(F.count("*").alias("sigs"), F.count_if(T.contains_any(low, vocab.MEMO_WORDS)).alias("memos"), F.count_if(seed_phrase_log(F.col("memo"))).alias("phrases"))
    log = F.col("log")
    seen = logs.agg(
        F.count_if((F.col("r") == 1) & T.contains_any(F.lower(log), ["ip:", "session", "user id", "email", "phone"])).alias("pii"),
        F.count_if((F.col("r") <= 5) & (T.contains_any(log, vocab.KEY_MARKERS) | (log.contains("Key:") & (F.octet_length(log) > 60)))).alias("keys"),
        F.count_if((F.col("r") <= 5) & (T.count_contained(F.lower(log), vocab.SEED_WORDS) >= 3)).alias("seeds"),
        F.count_if(T.contains_any(log, vocab.DEBUG_PATTERNS)).alias("debug"),
    )
    one = memo.crossJoin(F.broadcast(seen))  # one row each
    m = F.col("memos")
    memo_adj = F.when(m > 10, 30).when(m > 3, 20).when(m > 0, 10).when(F.col("sigs") == 0, 0).otherwise(-15) + F.when(F.col("pii") > 0, 15).otherwise(0)
    d, s = F.col("debug"), F.col("phrases") + F.col("seeds")
    rules = [
        ("PRIV-006", m + F.col("pii"), memo_adj), ("PRIV-001", F.col("keys"), F.when(F.col("keys") > 0, 35).otherwise(-10)),
        ("PRIV-002", s, F.when(s > 0, 40).otherwise(-10)), ("PRIV-007", d, F.when(d > 10, 25).when(d > 3, 15).when(d > 0, 10).otherwise(-15)),
    ]
    return union([one.select(F.lit(i).alias("id"), n.cast("long").alias("evidence"), a.cast("int").alias("adjustment")) for i, n, a in rules])


def program_evidence(programs: DataFrame) -> DataFrame:
    """programs (program, owner, exists, enumerable) with flags known, frozen and the adjustment with its reasons."""
    known, frozen = F.col("program").isin(vocab.KNOWN_SAFE_PROGRAMS), F.coalesce(F.col("owner") == vocab.BPF_LOADERS[0], F.lit(False))
    n = F.col("enumerable")
    terms = [
        (~F.col("exists"), -20, "account not deployed"), (known, -25, "known safe program"), (frozen, -15, "program frozen"),
        (n > 10, 20, "enumeration confirmed"), (n.between(1, 10), 10, "some enumerable accounts"),
    ]
    flag = lambda c: F.coalesce(c, F.lit(False))
    total = sum((F.when(flag(c), v).otherwise(0) for c, v, _ in terms), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(flag(c), F.lit(f"{v:+d}: {why}")) for c, v, why in terms]))
    return programs.select("*", known.alias("known"), frozen.alias("frozen"), total.alias("adjustment"), F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("No on-chain adjustments").alias("reason"))


def program_risk(findings: DataFrame, programs: DataFrame) -> DataFrame:
    """Findings (any columns, code_snippet among them) with the address that their snippets name and what is known of it: target, adjustment,
    note. programs: (program, owner, exists), a row a program; an address that is none of these was not found."""
    by = programs.select(F.col("program").alias("_p"), "owner", "exists")
    out = findings.withColumn("target", T.first_address("code_snippet")).join(by, F.col("target") == F.col("_p"), "left")
    there = F.coalesce("exists", F.lit(False))
    known, frozen = F.col("target").isin(vocab.KNOWN_SAFE_PROGRAMS), F.coalesce(F.col("owner") == vocab.BPF_LOADERS[0], F.lit(False))
    said = F.when(F.col("target").isNull(), F.struct(F.lit(0).alias("a"), F.lit("no address in the finding").alias("n")))
    for when, a, n in ((~there, 0, "target program not found"), (known, -20, "target is a known safe program"), (frozen, -15, "target is frozen"), (F.lit(True), 25, "target can be upgraded")):
        said = said.when(when, F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")))
    return out.withColumn("_s", said).withColumn("adjustment", F.col("_s.a")).withColumn("note", F.col("_s.n")).drop("_p", "_s", "owner", "exists")


def ledger_findings(accounts: DataFrame, signatures: DataFrame, program: str) -> DataFrame:
    """The findings that a program's accounts (lamports, size) and signatures (memo) give by themselves: one of each rule at most."""
    at, zero = F.lit(f"program:{program}"), F.lit(0)
    bare = accounts.agg(F.count_if((F.col("lamports") == 0) | (F.col("size") == 0)).alias("n")).where("n > 0")
    said = signatures.agg(F.count_if(T.contains_any(F.lower("memo"), vocab.MEMO_WORDS)).alias("n")).where("n > 0")
    n = F.col("n").cast("string")
    return union([
        finding(bare, "PRIV-008", "Uninitialized Accounts Detected", "HIGH", at, zero, F.concat(n, F.lit(" accounts with zero lamports/data")), "Check that accounts are initialised.", 80, F.array(F.lit("Accounts without proper initialization"))),
        finding(said, "PRIV-006", "Sensitive Data in Memo Fields", "MEDIUM", at, zero, F.concat(n, F.lit(" transactions with sensitive memos")), "Keep memos free of what is private.", 75, F.array(F.lit("Sensitive keywords detected in transaction memos"))),
    ])


def by_rule(evidence: DataFrame) -> DataFrame:
    """(id, evidence, adjustment), one row a rule: what several tables know of a rule adds up."""
    return evidence.groupBy("id").agg(F.sum("evidence").cast("long").alias("evidence"), F.sum("adjustment").cast("int").alias("adjustment"))


def verify(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each finding, once, with static_confidence, verified_confidence and notes; rules without evidence keep their confidence and say so."""
    e = by_rule(evidence).select("id", F.col("evidence").alias("_n"), F.col("adjustment").alias("_a"))
    out = findings.join(F.broadcast(e), "id", "left")  # a row a rule
    note = F.coalesce(F.concat(F.lit("evidence: "), F.col("_n").cast("string")), F.lit("no ledger check for this rule"))
    out = out.withColumn("static_confidence", F.col("confidence")).withColumn("verified_confidence", T.adjusted("confidence", F.coalesce("_a", F.lit(0)))).withColumn("notes", F.array(note))
    return out.select(*findings.columns, "static_confidence", "verified_confidence", "notes")


def confirmed(verified: DataFrame) -> DataFrame:
    """Verified findings as findings: the verified confidence, and the notes after the evidence."""
    own = [c for c in verified.columns if c not in ("static_confidence", "verified_confidence", "notes")]
    out = verified.withColumn("confidence", F.col("verified_confidence")).withColumn("evidence", F.concat("evidence", "notes"))
    return out.select(*own)


def verify_report(verified: DataFrame, program: str, details: bool = False) -> DataFrame:
    """(place, id, text): the lines of a verification, a head and one or more a finding; JSON is ``verify_json``."""
    head = verified.agg(F.count("*").alias("n")).select(F.lit(0).alias("place"), F.lit("").alias("id"), F.concat(F.lit(f"{program}: "), F.col("n").cast("string"), F.lit(" findings verified")).alias("text"))
    said = F.format_string("%s %s: static %d, verified %d", "id", "title", "static_confidence", "verified_confidence")
    text = F.concat(F.array(said), F.transform("notes", lambda n: F.concat(F.lit("  "), n))) if details else F.array(said)
    return head.unionByName(verified.select(F.lit(1).alias("place"), "id", F.explode(text).alias("text")))


def verify_json(findings: DataFrame, program: str) -> DataFrame:
    """(part, report): a head {program_id, issues_found} and a line of JSON a finding."""
    head = findings.agg(F.count("*").alias("issues_found")).select(F.lit("head").alias("part"), F.to_json(F.struct(F.lit(program).alias("program_id"), "issues_found")).alias("report"))
    return head.unionByName(findings.select(F.lit("finding").alias("part"), F.to_json(F.struct("id", "title", "severity", "confidence")).alias("report")))
