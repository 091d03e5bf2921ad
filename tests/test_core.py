"""Ledger and source operators on small inputs with known results."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilscan.functions import fields as K
from veilscan.functions import text as T
from veilscan.operators import joins, ledger, lines, report, static, taint, verify
from veilscan.plans.scan import scan_ledger
from veilscan.session import ship
from veilscan.sources import ledger as src
from veilscan.sources import rust, samples


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "ty", "struct", "kind"),
    [
        ("email", "String", "UserProfile", "email"), ("owner", "Pubkey", "UserProfile", None), ("name", "String", "PoolConfig", None), ("name", "String", "UserProfile", "name"),
        ("home_address", "String", "UserProfile", "address"), ("wallet_address", "String", "X", None), ("email_hash", "String", "UserProfile", None), ("phone", "u64", "X", None),
    ],
)
def test_pii_kind(spark, name, ty, struct, kind):
    assert one(spark, K.pii_kind("n", "t", "s"), n=name, t=ty, s=struct) == kind


@pytest.mark.parametrize(("name", "kind"), [("password", "password"), ("auth_token", None), ("secret_hash", None), ("mnemonic", "mnemonic"), ("amount", None)])
def test_secret_kind(spark, name, kind):
    assert one(spark, K.secret_kind("n"), n=name) == kind


def test_values(spark):
    assert one(spark, T.is_safe_name_value("v"), v="John Smith") is False
    assert one(spark, T.is_safe_name_value("v"), v="BONK") is True
    assert one(spark, T.is_hash_or_encoded("v"), v="a" * 32) is True
    assert one(spark, T.has_account_pii("v"), v="am9obkBleGFtcGxlLmNvbQ==") is True
    assert one(spark, T.has_account_pii("v"), v="not base64") is None
    assert one(spark, T.looks_like_hex_private_key("v"), v="0x" + "ab" * 62 + " x") is True
    assert one(spark, T.looks_like_hex_private_key("v"), v="0x" + "ab" * 31) is False
    assert one(spark, T.first_address("v"), v="at (9W959DqEETiGZocYWCQPaJ6sBmUzgfxXfqGeTEdp3aQP), now") == "9W959DqEETiGZocYWCQPaJ6sBmUzgfxXfqGeTEdp3aQP"
    assert one(spark, T.field_value("v", "name"), v='{"name": "A B"}') == "A B"
    assert one(spark, T.payload_size("v"), v="A" * 88) == 66


def test_lines(spark):
    df = spark.createDataFrame([("a", "x\r\ny\n\nz\n"), ("b", ""), ("c", None)], "file string, content string")
    got = lines.lines(df, "file", "content").collect()
    assert [tuple(r) for r in got] == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, ""), ("a", 4, "z")]


def test_test_functions(spark):
    code = "fn a() {}\n#[test]\nfn t() {\n  x;\n}\nfn b() {}\n"
    ls = lines.lines(spark.createDataFrame([("f", code)], "file string, content string"), "file", "content")
    got = {r.line_no: r.in_test for r in lines.test_functions(ls, "file").collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False}


def moments(spark, pairs):
    return ledger.transfer_ends(src.rich_transactions(samples._raw(spark, {"result": samples.transfers(pairs)})))


def test_clusters(spark):
    near = moments(spark, [("A", "B", 100), ("A", "B", 110), ("A", "C", 120), ("B", "C", 10**6)])
    found = {(r.wallet_a, r.wallet_b): r.n for r in ledger.cluster_pairs(near).collect()}
    assert found[("A", "B")] == 6 and ("A", "C") in found
    far = moments(spark, [("A", "B", 100), ("C", "D", 10000)])
    assert ledger.cluster_pairs(far).count() == 0
    assert ledger.cluster_finding(ledger.cluster_pairs(far), "p").count() == 0
    f = ledger.cluster_finding(ledger.cluster_pairs(near), "p").first()
    assert (f.severity, f.confidence) == ("MEDIUM", 70)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(st.integers(-500, 500), min_size=1, max_size=20), b=st.lists(st.integers(-500, 500), min_size=1, max_size=20))
def test_band_join(spark, a, b):
    x, y = spark.createDataFrame([(i,) for i in a], "ta long"), spark.createDataFrame([(i,) for i in b], "tb long")
    got = sorted(tuple(r) for r in joins.band_join(x, y, "ta", "tb", 60).collect())
    assert got == sorted((i, j) for i in a for j in b if abs(i - j) < 60)


def test_relative_band_join(spark):
    a = spark.createDataFrame([(1, 100.0), (1, 0.0), (2, 50.0)], "k long, va double")
    b = spark.createDataFrame([(1, 104.9), (1, 105.1), (1, 95.2), (2, 100.0)], "j long, vb double")
    assert sorted(r.vb for r in joins.relative_band_join(a, b, [("k", "j")], "va", "vb", 0.05).collect()) == [95.2, 104.9]


def test_suppressions(spark):
    code = "a // privacy-ignore\nb // privacy-ignore [priv-001, PRIV-002]\n// privacy-ignore-next-line\nc\nd /* privacy-ignore [PRIV-003] */\n" + "\n" * 8 + "// privacy-ignore-file [PRIV-009]\n"
    ls = lines.lines(spark.createDataFrame([("f", code)], "file string, content string"), "file", "content")
    got = {(r.scope, r.line, r.rule) for r in joins.suppression_marks(ls).collect()}
    assert got == {("line", 1, None), ("line", 2, "PRIV-001"), ("line", 2, "PRIV-002"), ("line", 4, None), ("line", 5, "PRIV-003")}
    found = spark.createDataFrame([("PRIV-001", "f", 1), ("PRIV-001", "f", 2), ("PRIV-009", "f", 2), ("PRIV-003", "f", 5)], "id string, file string, line int")
    assert [tuple(r) for r in joins.unsuppressed(found, joins.suppression_marks(ls)).collect()] == [("PRIV-009", "f", 2)]


def test_report(spark):
    f = spark.createDataFrame([("P", "t", "HIGH", "b", 1, "", "", 70, ["x"]), ("P", "t", "LOW", "a", 2, "", "", 50, ["y", "x"])], report.FINDING)
    r = report.aggregate_findings(f.withColumn("o", F.concat("file", "line")), "o").first()
    assert (r.severity, r.file, r.confidence, r.evidence) == ("LOW", "a", 55, ["Found 2 times across: a, b", "x", "y"])
    assert tuple(report.grade(f).first()) == (80, "B")  # 25 * .7 + 5 * .5 = 20
    assert tuple(report.grade(f.limit(0)).first()) == (100, "A")
    assert report.at_least(f, "MEDIUM", 60).count() == 1
    assert report.text_report(f).count() == 3
    got = sorted(tuple(r) for r in report.json_report(f).collect())
    assert [g[0] for g in got] == ["finding", "finding", "head"] and '"score":80' in got[2][1] and '"confidence_label":"High"' in got[0][1] + got[1][1]


def test_scan_of_ledger(spark):
    found = scan_ledger(src.rich_transactions(samples.ledger_json(spark)), src.assets(samples.asset_json(spark)), src.token_metadata(samples.metadata_json(spark)), "Prog1")
    ids = sorted(r.id for r in found.collect())
    assert ids == ["PRIV-001", "PRIV-002", "PRIV-002", "PRIV-004", "PRIV-004", "PRIV-005", "PRIV-007", "PRIV-009", "PRIV-010", "PRIV-020"]


def test_transaction_evidence(spark):
    logs = ["user john@mail.example 555-123-4567", "debug: x", "missing discriminator", "predictable seed", "derived pda user1"]
    tx = spark.createDataFrame([("s", 100, [("T", None, None, [])], logs)], src.BASIC_TX)
    got = {r.id: (r.evidence, r.adjustment) for r in verify.transaction_evidence(tx, "P").collect()}
    assert got["PRIV-006"] == (1, 15) and got["PRIV-007"] == (1, 10) and got["PRIV-008"] == (1, 10) and got["PRIV-009"] == (1, -10) and got["PRIV-010"] == (2, 30)
    f = spark.createDataFrame([("PRIV-010", "t", "HIGH", "a", 1, "", "", 80, []), ("X", "t", "HIGH", "a", 2, "", "", 80, [])], report.FINDING)
    v = {r.id: r.verified_confidence for r in verify.verify(f, verify.transaction_evidence(tx, "P")).collect()}
    assert v == {"PRIV-010": 100, "X": 80}
    merged = {r.id: r.confidence for r in report.merge_verified(f, verify.verify(f, verify.transaction_evidence(tx, "P"))).collect()}
    assert merged == v


def test_account_evidence(spark):
    rows = [("a", "encoded", "AAAAAAAAAAAAAAAA", 12), ("b", "encoded", "am9obkBleGFtcGxlLmNvbQ==", 18)]
    got = {r.id: (r.evidence, r.adjustment) for r in verify.account_evidence(spark.createDataFrame(rows, "pubkey string, data_kind string, data string, size long")).collect()}
    assert got["PRIV-004"] == (1, 25) and got["PRIV-008"] == (1, 20) and got["PRIV-010"] == (2, -15)


def test_program_evidence(spark):
    p = spark.createDataFrame([("x", None, False, 0), ("So1endDq2YkqhipRh3WViPa8hdiSpxWy6z3Z6tMCpAo", "BPFLoader2111111111111111111111111111111111", True, 50)], "program string, owner string, exists boolean, enumerable int")
    got = {r.program[:1]: (r.adjustment, r.reason) for r in verify.program_evidence(p).collect()}
    assert got["x"] == (-20, "-20: account not deployed") and got["S"][0] == -20


def test_structs_and_flows(spark):
    ship(spark)
    fields = {(r.struct, r.field): r for r in rust.struct_fields(samples.sample_files(spark)).collect()}
    assert fields["Deposit", "holder"].is_mut and fields["Deposit", "payer"].is_signer and fields["Deposit", "book"].seeds == 'b"ledger"'
    assert fields["UserProfile", "email"].is_account and fields["UserProfile", "email"].line == 37
    files = samples.sample_files(spark)
    got = {(r.line, r.sink, r.source_kind) for r in taint.taint_flows(files, taint.summaries(files)).collect() if r.file == "vault.rs"}
    assert (8, "msg", "parameter") in got and (12, "emit", "account") in got and (19, "msg", "input") in got
    assert not any(line == 11 for line, _, _ in got)  # hashed before it is logged


def test_static_scan(spark):
    ship(spark)
    got = {(r.id, r.file, r.line) for r in static.scan(samples.sample_files(spark)).collect()}
    for want in [("PRIV-003", "quiet.rs", 2), ("PRIV-007", "quiet.rs", 12), ("PRIV-004", "vault.rs", 37), ("PRIV-005", "vault.rs", 40), ("PRIV-008", "vault.rs", 27), ("PRIV-010", "vault.rs", 30), ("PRIV-006", "vault.rs", 8)]:
        assert want in got
    assert not any(f == "quiet.rs" and (i == "PRIV-016" or line == 11) for i, f, line in got)
    assert {r.id for r in static.scan(samples.sample_files(spark), ["pii", "none"]).collect()} == {"PRIV-004", "PRIV-005"}


def test_envelopes(spark):
    for raw in ('[{"signature": "a"}]', '{"result": [{"signature": "a"}]}', '{"transactions": [{"signature": "a"}]}', '{"result": {"items": [{"signature": "a"}]}}', '{"items": [{"signature": "a"}]}'):
        assert [r.signature for r in src.rich_transactions(spark.createDataFrame([("p", raw)], "path string, raw string")).collect()] == ["a"]
    raw = '{"result": {"value": [{"lamports": 1, "owner": "o", "data": ["AAAA", "base64"], "executable": false, "rentEpoch": 18446744073709551615}, null]}}'
    got = src.multiple_accounts(spark.createDataFrame([("p", raw)], "path string, raw string")).orderBy("position").collect()
    assert str(got[0].rentEpoch) == "18446744073709551615" and got[0].size == 3 and got[1].owner is None


def test_streams_equal_batches(spark, tmp_path):
    from veilscan.streaming.clusters import near_pairs, wallet_windows

    rows = spark.createDataFrame([("A", "2024-01-01 00:00:00"), ("B", "2024-01-01 00:00:30"), ("C", "2024-01-01 00:05:00"), ("A", "2024-01-01 00:05:59")], "wallet string, s string").select("wallet", F.col("s").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, f in (("pairs", near_pairs), ("windows", wallet_windows)):
        mode = "append" if name == "pairs" else "complete"
        q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, f(rows).collect()))


def test_source_files(spark, tmp_path):
    from veilscan.plans.scan import analyze
    from veilscan.sources.files import resolve_target, source_files

    root = tmp_path / "tmp" / "project"
    kept = ["lib.rs", "programs/a.rs", "out/b.rs", "vendor/c.rs", "some_test/d.rs"]
    lost = ["target/x.rs", "tests/x.rs", "sdk/x.rs", "near/x.rs", ".git/x.rs", "a/.hidden/x.rs", "wasm.rs", "my_wasm.rs", "cli/x.rs", "note.txt"]
    for p in kept + lost:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("fn say() {\n    println!(\"x\");\n}\n")
    (root / "bad.rs").write_bytes(b"\xff\xfe\x00")
    got = sorted(r.file for r in source_files(spark, str(root)).collect())
    assert got == sorted(kept)
    found, grade = analyze(spark, str(root), ["logs"])
    assert found.count() == 4 and grade.first().score == 84  # a path with "test" in it is not looked at
    with pytest.raises(ValueError):
        resolve_target("https://example.com/x")
    with pytest.raises(FileNotFoundError):
        resolve_target(str(root / "none"))


def test_findings_never_multiply(spark):
    from veilscan.plans.scan import verify_findings

    f = spark.createDataFrame([("P8", t, "HIGH", "a", 1, "", "", 50, ["e"]) for t in ("t", "u")] + [("P9", "t", "HIGH", "a", 1, "", "", 50, [])], report.FINDING)
    one = spark.createDataFrame([("P8", 1, 10), ("P9", 2, 5)], "id string, evidence long, adjustment int")
    two = spark.createDataFrame([("P8", 3, 7)], "id string, evidence long, adjustment int")
    got = sorted((r.id, r.title, r.confidence, r.evidence) for r in verify_findings(f, one, two).collect())
    assert got == [("P8", "t", 67, ["e", "evidence: 4"]), ("P8", "u", 67, ["e", "evidence: 4"]), ("P9", "t", 55, ["evidence: 2"])]
    v = verify.verify(f, one)
    assert report.merge_verified(f, v).count() == 3 and verify.verify_report(v, "P", True).count() == 7
    assert sorted(r.part for r in verify.verify_json(f, "P").collect()) == ["finding"] * 3 + ["head"]


def test_context_of_findings(spark):
    files = spark.createDataFrame([("a", "#[account]\npub struct P {\n    pub x: u64,\n}\n")], "file string, content string")
    f = spark.createDataFrame([("P", "t", "HIGH", "a", 2, "", "", 95, ["e"]), ("P", "t", "HIGH", "b", 2, "", "", 50, [])], report.FINDING)
    got = {r.file: (r.confidence, r.evidence) for r in static.in_context(f, files).collect()}
    assert got == {"a": (98, ["e", "account or instruction"]), "b": (50, [])}


def test_cases_against_sql(spark):
    """Queries over constants: the results are known, whatever the tables."""
    import __spark_entry__ as entry

    con = duckdb.connect()
    for name in ("static_rules", "taint_rules", "target_rules", "generic_verification", "verify_fixtures", "verify_and_merge", "value_rules", "context_rules", "bare_ledger_findings", "struct_parse", "struct_predicates", "json_envelope", "rpc_accounts", "rpc_signatures", "memo_rules", "balance_rules", "field_rules", "taint_flow", "static_scan", "ledger_scan"):
        got = [r.asDict() for r in entry.queries()[name](spark, "").collect()]
        cur = con.execute(entry.oracle_sql()[name])
        names = [c[0] for c in cur.description]
        exp = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
        order = lambda rows: sorted(tuple((k, r[k]) for k in sorted(r)) for r in [{k: str(v) for k, v in x.items()} for x in rows])
        assert order(got) == order(exp), name


def test_queries_against_sql(spark):
    """Some of the catalogue against DuckDB; the driver compares all."""
    import __spark_entry__ as entry

    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("events", "documents", "labels", "lineitem", "orders", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("ledger_report", "email_filter", "finding_union", "suppress_anti", "wallet_cluster_pairs"):
        got = entry.queries()[name](spark, d).toPandas()
        exp = con.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(exp.columns)
        key = sorted(got.columns)
        assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, exp[key].values.tolist())), name
