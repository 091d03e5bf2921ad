"""Detectors over source files. Each takes files (file, content) or what is made of them, and gives findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan import vocab
from veilscan.functions import fields as K
from veilscan.functions import text as T
from veilscan.operators import lines as L
from veilscan.operators import taint
from veilscan.operators.joins import suppression_marks, unsuppressed
from veilscan.operators.report import finding, found, rule, union
from veilscan.sources.rust import matches, struct_fields


def scanned(files: DataFrame, *more: str) -> DataFrame:
    """Files that detectors look at: none of tests (but of test_fixtures) or mocks, nor of ``more``."""
    f = F.col("file")
    out = files.where(~((f.contains("test") & ~f.contains("test_fixtures")) | f.contains("mock")))
    for m in more:
        out = out.where(~f.contains(m))
    return out


def secret_findings(files: DataFrame) -> DataFrame:
    """Keys, mnemonics and seeds written into sources: own rules, as no published ones exist."""
    ls = L.lines(scanned(files), "file", "content").where(~F.ltrim("text").startswith("//"))
    t, at = F.col("text"), (F.col("file"), F.col("line_no"), F.trim(F.col("text")))
    numbers = F.regexp_count(t, F.lit(r"\b[0-9]{1,3}\s*,"))
    key = t.rlike('"[1-9A-HJ-NP-Za-km-z]{87,88}"') | t.rlike('"(0x)?[0-9a-fA-F]{64,128}"') | t.rlike('"[A-Za-z0-9+/]{86}=="') | (numbers >= 31)
    words = F.regexp_extract(t, '"([a-z]+(?: [a-z]+){11,23})"', 1)
    return found(ls, [
        rule(key, "PRIV-001", "Private key in source", "CRITICAL", *at, "Load keys at run time.", 95),
        rule((words != "") & F.size(F.split(words, " ")).isin(12, 15, 18, 21, 24), "PRIV-002", "Mnemonic in source", "CRITICAL", *at, "Load phrases at run time.", 92),
        rule(t.rlike(r'(?i)seed\w*\s*(:[^=]*)?=\s*b"[^"]{8,}"'), "PRIV-003", "Seed bytes in source", "CRITICAL", *at, "Derive seeds from secrets that are not in the source.", 88),
    ])


def pii_findings(files: DataFrame, structs: DataFrame | None = None) -> DataFrame:
    f = structs if structs is not None else struct_fields(scanned(files, "/cli/"))
    public = f.where("is_pub and not (is_context and not is_account)")
    kind, secret = K.pii_kind("field", "type", "struct"), K.secret_kind("field")
    at = (F.col("file"), F.col("line"), F.concat("struct", F.lit("."), "field", F.lit(": "), "type"))
    public = public.withColumn("kind", kind).withColumn("hidden", secret)
    low = F.lower("struct")
    whole = f.where(T.contains_any(low, ["user", "profile", "identity", "member", "person"]) & F.col("is_account") & F.col("is_pub") & F.col("type").contains("String") & ~K.is_safe_field("field", "type", "struct"))
    whole = whole.groupBy("file", "struct").agg(F.min("struct_line").alias("line"))
    return union([
        found(public, [
            rule(F.col("kind").isNotNull(), "PRIV-004", F.concat(F.lit("Personal data in field: "), F.col("kind")), "HIGH", *at, "Keep personal data off the ledger.", K.pii_confidence("field", "type", "struct", F.col("is_account"), "kind"), F.array(F.col("kind"))),
            rule(F.col("hidden").isNotNull(), "PRIV-005", F.concat(F.lit("Secret in field: "), F.col("hidden")), "HIGH", *at, "Never store secrets.", K.secret_confidence("field", "type"), F.array(F.col("hidden"))),
        ]),
        finding(whole, "PRIV-004", "Account of personal data", "HIGH", F.col("file"), F.col("line"), F.col("struct"), "Encrypt or hash personal data.", 85),
    ])


def log_findings(files: DataFrame) -> DataFrame:
    ls = L.lines(scanned(files, "example"), "file", "content")
    tested = L.test_functions(ls, "file")
    ls = L.in_test_module(ls, "file", "module").join(tested, ["file", "line_no"])
    ls = ls.where("not module and not in_test").where(~F.ltrim("text").startswith("//") & ~F.ltrim("text").startswith("*"))
    t, at = F.col("text"), (F.col("file"), F.col("line_no"), F.trim(F.col("text")))
    word = T.first_contained(F.lower(t), vocab.LOG_WORDS)
    ls = ls.withColumn("word", word)
    title = F.concat(F.lit("Sensitive word in log: "), F.col("word"))
    rules = [rule(t.rlike(p) & F.col("word").isNotNull(), "PRIV-006", title, "MEDIUM", *at, "Log no sensitive values.") for p in (r'msg!\s*\(\s*"[^"]*\{[^}]*\}[^"]*"', r"sol_log\s*\([^)]+\)")]
    rules += [rule(t.rlike(p), "PRIV-007", f"Debug output: {n}", "LOW", *at, "Remove debug output.") for n, p in (("println", r"println!\s*\("), ("dbg", r"dbg!\s*\("), ("debug", r"debug!\s*\("))]
    return found(ls, rules)


def access_findings(files: DataFrame) -> DataFrame:
    files = scanned(files)
    m = matches(files, {"struct": (r"#\[derive\([^)]*Accounts[^)]*\)\]\s*pub\s+struct\s+(\w+)[^{]*\{([^}]+)\}", 0, 1 << 20)})
    body = F.col("match")
    open_ = m.where(body.contains("Account<") & ~T.contains_any(body, ["authority", "owner", "admin", "Signer<"]) & T.contains_any(F.lower("group"), ["update", "modify", "transfer", "withdraw"]))
    ls = L.lines(files, "file", "content")
    called = L.settled(ls.withColumn("context", L.context("file", 50, 4)), "file", F.col("text").rlike(r"invoke\s*\(|invoke_signed\s*\("))
    c = F.col("context")
    safe = c.rlike(r"program_id|check_id|crate::ID|ctx\.program_id") | T.contains_any(c, vocab.SAFE_CPI) | (c.contains("&self.") & T.contains_any(c, ["_instruction", "_program"]))
    return union([
        finding(open_, "PRIV-009", "Accounts without authority", "MEDIUM", F.col("file"), F.col("line"), F.col("group"), "Require a signer."),
        finding(called.where(~safe), "PRIV-009", "Call without program check", "MEDIUM", F.col("file"), F.col("line_no"), F.trim(F.col("text")), "Check the program's id."),
    ])


def seed_facts(seeds: Column) -> tuple[Column, Column, Column]:
    """(static seeds, whether any is dynamic, whether one is a global prefix)."""
    static = F.regexp_extract_all(seeds, F.lit(r'b\s*"([^"]+)"'), F.lit(1))
    named = F.regexp_replace(seeds, r'b\s*"[^"]*"', "").rlike(r"\b(" + "|".join(vocab.SEED_NAMES) + r")\b")
    world = F.exists(static, lambda s: F.exists(F.array(*[F.lit(p) for p in vocab.GLOBAL_SEED_PREFIXES]), lambda p: F.lower(s).startswith(p)))
    return static, T.contains_any(seeds, vocab.SEED_CALLS) | named, world


def pda_confidence(seeds: Column, struct: Column, field: Column) -> Column:
    """70 and what the seeds and the names say, within 20 and 95."""
    static, _, world = seed_facts(seeds)
    names = F.lower(F.concat_ws(" ", struct, field))
    score = F.lit(70) + F.when(F.size(static) <= 1, 10).otherwise(0) + F.when(T.contains_any(names, ["user", "profile"]), 15).otherwise(0)
    score = score - F.when(world, 30).otherwise(0) - F.when(T.contains_any(names, vocab.ENUMERABLE_NAMES), 20).otherwise(0)
    return F.greatest(F.lit(20), F.least(F.lit(95), score))


def anchor_findings(files: DataFrame, structs: DataFrame | None = None) -> DataFrame:
    files = scanned(files)
    f = structs if structs is not None else struct_fields(files)
    static, dynamic, world = seed_facts(F.col("seeds"))
    pda = f.where(F.col("is_context") & F.col("seeds").isNotNull() & ~dynamic & ~world)
    m = matches(files, {
        "signer": (vocab.AUTHORITY_FIELD, 200, 200), "mut": (vocab.MUT_ACCOUNT, 0, -2),
        "raw": (vocab.RAW_READ, 300, 300), "cpi": (vocab.CPI_CALL, 500, 300), "close": (vocab.CLOSED, 100, 200),
        "init": (r"#\[account\s*\(\s*init_if_needed[^\]]*\]", 0, 2000), "math": (vocab.MATH, 100, 100),
    })
    around, of = F.concat("before", "after"), lambda r: F.col("rule") == r
    at = (F.col("file"), F.col("line"), F.trim(F.col("line_text")))
    lacks = lambda c, ws: ~T.contains_any(c, ws)
    body = F.regexp_extract(F.expr("substring(after, length(match) + 1)"), "^([^;}]*)", 1)
    ls = L.lines(files, "file", "content")
    marks = L.seen_within(F.lower("text").contains("check:") | F.col("text").contains("CHECK"), "file", 9)
    seeded = L.seen_within(F.col("text").contains("seeds"), "file", 9)
    ls = ls.withColumn("checked", marks).withColumn("seeded", seeded).withColumn("body", L.context("file", 0, 9))
    la = (F.col("file"), F.col("line_no"), F.trim(F.col("text")))
    word = T.first_contained(F.lower(F.regexp_extract("body", r"(?s)emit!\s*\(\s*\w+\s*\{(.*)", 1)), vocab.EVENT_WORDS)
    ls = ls.withColumn("word", F.when(F.col("text").rlike(r"emit!\s*\(\s*(\w+)\s*\{"), word))
    said = F.lower("body")
    emit_conf = F.lit(65) + F.when(F.col("word").isin("user", "owner", "authority", "recipient", "sender"), 15).otherwise(0) - F.when(F.col("word").isin("amount", "fee", "price", "balance"), 10).otherwise(0) + F.when(T.contains_any(said, ["pubkey", "key()"]), 10).otherwise(0)
    return union([
        finding(pda, "PRIV-010", "Predictable address", "MEDIUM", F.col("file"), F.col("line"), F.concat(F.lit("seeds = ["), F.col("seeds"), F.lit("]")), "Add a seed that can't be guessed.", pda_confidence(F.col("seeds"), F.col("struct"), F.col("field"))),
        found(ls, [
            rule(F.col("word").isNotNull(), "PRIV-006", F.concat(F.lit("Sensitive word in event: "), F.col("word")), "MEDIUM", *la, "Emit hashed identifiers.", F.greatest(F.lit(30), F.least(F.lit(90), emit_conf))),
            rule((F.col("text").contains("UncheckedAccount<'info>") & ~F.col("checked") & ~F.col("seeded")), "PRIV-012", "Unchecked account", "MEDIUM", *la, "Say why it needs no check, or check it.", 75),
            rule((F.col("text").contains("AccountInfo<'info>") & ~F.col("checked") & lacks("text", ["system_program", "rent"])), "PRIV-012", "Raw account", "LOW", *la, "Say why it needs no check, or check it.", 55),
        ]),
        found(m, [
            rule(of("signer") & (lacks(around, ["Signer<", "has_one", "constraint"])), "PRIV-011", "Authority without signer", "HIGH", *at, "Require a signer.", 65),
            rule(of("mut") & (lacks(F.concat("match", body), ["init", "constraint", "has_one", "seeds", "close", "Signer<", "Program<", "system_program", "rent"])), "PRIV-008", "State may be uninitialised", "HIGH", *at, "Check that the account is initialised.", F.when(body.contains("Account<"), 70).otherwise(85)),
            rule(of("raw") & (lacks(around, vocab.DISCRIMINATORS)), "PRIV-008", "Data read without discriminator", "MEDIUM", *at, "Check the discriminator.", 75),
            rule(of("cpi") & (~around.rlike(r"Program<'info,\s*\w+>") & lacks(around, ["program.key()", "program_id", "token_program", "system_program", "cpi::"])), "PRIV-013", "Call of an unchecked program", "HIGH", *at, "Check the program.", 60),
            rule(of("close") & (lacks(around, ["discriminator", "is_initialized"])), "PRIV-014", "Closing may be undone", "MEDIUM", *at, "Clear the discriminator.", 55),
            rule(of("init") & (lacks("match", ["constraint", "has_one", "realloc"])), "PRIV-015", "Initialised again", "HIGH", *at, "Add a constraint.", 75),
            rule(of("math") & (lacks(around, ["checked_", "saturating_", "try_", "unwrap_or", "?"]) & lacks("line_text", ["#[test]", "assert"])), "PRIV-016", "Unchecked arithmetic", "MEDIUM", *at, "Use checked arithmetic.", 50),
        ]),
    ])


def taint_findings(files: DataFrame) -> DataFrame:
    flow = taint.taint_flows(files, taint.summaries(files))
    evidence = F.array(F.concat(F.lit("source: "), "source_kind", F.lit(" "), "source"), F.concat(F.lit("sink: "), "sink"), F.concat(F.lit("carrier: "), "carrier"), F.concat(F.lit("path: "), F.array_join("path", " > ")))
    return finding(flow, "PRIV-030", F.concat(F.lit("Data reaches "), F.col("sink")), F.col("severity"), F.col("file"), F.col("line"), F.col("snippet"), "Hash, encrypt or drop the data before it leaves.", F.col("confidence"), evidence)


DETECTORS = {"secrets": secret_findings, "pii": pii_findings, "logs": log_findings, "access": access_findings, "anchor": anchor_findings, "taint": taint_findings}


def scan(files: DataFrame, detectors: list[str] | None = None, marker: str = "privacy-ignore") -> DataFrame:
    """Findings of the named detectors (all; unknown names are ignored) that no comment suppresses."""
    names = [d for d in DETECTORS if detectors is None or d in detectors]
    found = union([DETECTORS[d](files) for d in names])
    return unsuppressed(found, suppression_marks(L.lines(files, "file", "content"), marker))


def context_adjustment(rows: DataFrame, key: str = "file") -> DataFrame:
    """Lines (file, line_no, text; optional struct and function, the names they are in) with what the file and the lines around say:
    (delta, reasons), to be added to a confidence within 10 and 98."""
    for name in ("struct", "function"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    w = W.partitionBy(key)
    c = F.lower(L.context(key, 25, 24))
    whole = lambda words: F.max(T.contains_any(F.lower("text"), words)).over(w)
    struct, function = F.lower("struct"), F.lower("function")
    comment = F.ltrim("text").startswith("///") | F.ltrim("text").startswith("//!")
    documented = F.count_if(comment).over(L.frame(key, 25, 24))
    n = T.count_contained(c, vocab.PII_PATTERNS)
    terms = [
        (T.contains_any(c, ["#[account", "#[instruction"]), 10, "account or instruction"), (T.contains_any(c, ["emit!", "#[event]"]), 15, "event"),
        (T.contains_any(struct, ["user", "profile", "member"]), 15, "struct of users"), (T.contains_any(function, ["user", "register", "profile"]), 10, "function of users"),
        (n >= 3, 20, "personal fields"), (n == 2, 10, "personal fields"), (T.contains_any(c, ["string", "vec<u8>"]), 5, "text"),
        (whole(["#[cfg(test)]", "#[test]"]), -30, "test"), (T.is_financial_context(c), -15, "finance"), (T.has_token_metadata_context(c), -20, "token metadata"),
        (T.has_nft_metadata_context(c), -15, "asset metadata"), (K.is_safe_struct_context("struct"), -15, "safe struct"), (T.contains_any(c, vocab.PROTECTION_WORDS), -10, "protection"),
        (T.contains_any(c, vocab.VALIDATION_WORDS), -5, "validation"), (whole(vocab.MOCK_WORDS), -20, "mock"), (T.contains_any(c, vocab.PLACEHOLDER_WORDS), -25, "placeholder"),
        (documented > 3, -10, "documentation"),
    ]
    flag = lambda t: F.coalesce(t, F.lit(False))
    delta = sum((F.when(flag(t), v).otherwise(0) for t, v, _ in terms), F.lit(0))
    return rows.select("*", delta.alias("delta"), F.array_compact(F.array(*[F.when(flag(t), F.lit(x)) for t, _, x in terms])).alias("reasons"))


def in_context(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with confidences as the lines around them have it, and the reasons as evidence."""
    said = context_adjustment(L.lines(files, "file", "content")).select("file", F.col("line_no").alias("line"), "delta", "reasons")
    out = findings.join(said, ["file", "line"], "left")
    score = F.greatest(F.lit(10), F.least(F.lit(98), F.col("confidence") + F.col("delta")))
    out = out.withColumn("confidence", F.when(F.col("delta").isNotNull(), score).otherwise(F.col("confidence")).cast("int"))
    return out.withColumn("evidence", F.concat("evidence", F.coalesce("reasons", F.array().cast("array<string>")))).select(*findings.columns)


def struct_predicates(structs: DataFrame) -> DataFrame:
    """(file, struct, has_authority, unprotected_mut) of struct_fields rows."""
    own = F.col("is_signer") | T.contains_any("field", ["authority", "owner", "admin"]) | F.col("type").contains("Signer")
    g = structs.groupBy("file", "struct").agg(F.max(own).alias("has_authority"), F.max("is_mut").alias("mut"), F.max("is_context").alias("context"))
    return g.select("file", "struct", "has_authority", (F.col("context") & F.col("mut") & ~F.col("has_authority")).alias("unprotected_mut"))
