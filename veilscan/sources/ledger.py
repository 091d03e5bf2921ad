"""Ledger JSON as DataFrames: every envelope the services use, with fixed schemas; malformed parts become nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSTRUCTION = "programId STRING, parsed STRING, data STRING, accounts ARRAY<STRING>"
TOKEN_TRANSFER = "mint STRING, amount STRING, fromTokenAccount STRING, toTokenAccount STRING, fromUserAccount STRING, toUserAccount STRING"
RICH_TX = (
    "signature STRING, timestamp BIGINT, slot BIGINT, blockTime BIGINT, type STRING, source STRING, fee BIGINT, feePayer STRING, "
    f"tokenTransfers ARRAY<STRUCT<{TOKEN_TRANSFER}>>, nativeTransfers ARRAY<STRUCT<fromAddress STRING, toAddress STRING, amount BIGINT>>, "
    f"instructions ARRAY<STRUCT<{INSTRUCTION}>>, accountData STRING, events STRING, transactionError STRING, description STRING, rawLogs ARRAY<STRING>"
)
BASIC_TX = f"signature STRING, blockTime BIGINT, instructions ARRAY<STRUCT<{INSTRUCTION}>>, logs ARRAY<STRING>"
CREATOR = "address STRING, verified BOOLEAN, share INT"
ASSET = f"interface STRING, id STRING, content STRUCT<json_uri STRING, metadata STRING>, authorities ARRAY<STRUCT<address STRING, scopes ARRAY<STRING>>>, ownership STRUCT<frozen BOOLEAN, delegated BOOLEAN, delegate STRING, owner STRING>, creators ARRAY<STRUCT<{CREATOR}>>"
TOKEN_METADATA = f"mint STRING, name STRING, symbol STRING, decimals INT, supply STRING, uri STRING, creators ARRAY<STRUCT<{CREATOR}>>, onChainData STRUCT<name STRING, symbol STRING, uri STRING, updateAuthority STRING>, offChainData STRUCT<name STRING, description STRING, attributes STRING>"
ACCOUNT = "lamports BIGINT, owner STRING, data STRING, executable BOOLEAN, rentEpoch DECIMAL(20,0), space BIGINT"
SIGNATURE = "signature STRING, slot BIGINT, err STRING, memo STRING, blockTime BIGINT"
TRANSACTION = "slot BIGINT, blockTime BIGINT, transaction STRUCT<signatures ARRAY<STRING>, message STRING>, meta STRUCT<err STRING, fee BIGINT, preBalances ARRAY<BIGINT>, postBalances ARRAY<BIGINT>, logMessages ARRAY<STRING>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): whole JSON files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def rows(raw: DataFrame, ddl: str) -> DataFrame:
    """Elements of ``[..]``, ``{result: [..]}``, ``{transactions: [..]}``, ``{result: {items: [..]}}`` or ``{items: [..]}``: the first that parses."""
    text = F.col("raw")
    array = lambda x: F.from_json(x, f"ARRAY<STRUCT<{ddl}>>")
    at = lambda p: F.get_json_object(text, p)
    bare = F.when(F.ltrim(text).startswith("["), array(text))
    nested = [F.when(at(p).startswith("["), array(at(p))) for p in ("$.result", "$.transactions", "$.result.items", "$.items", "$.result.value")]
    return raw.select(F.explode(F.coalesce(bare, *nested)).alias("r")).select("r.*")


def rich_transactions(raw: DataFrame, limit: int | None = None) -> DataFrame:
    out = rows(raw, RICH_TX)
    return out if limit is None else out.orderBy(F.desc("blockTime"), "signature").limit(limit)


def basic_transactions(raw: DataFrame) -> DataFrame:
    return rows(raw, BASIC_TX)


def assets(raw: DataFrame) -> DataFrame:
    return rows(raw, ASSET)


def token_metadata(raw: DataFrame) -> DataFrame:
    """On-chain name, symbol and address are hoisted where the outer ones are missing; a bare object or {metadata: ..} is one row."""
    one = F.coalesce(F.get_json_object("raw", "$.metadata"), F.when(F.get_json_object("raw", "$.mint").isNotNull(), F.col("raw")))
    single = raw.where(one.isNotNull()).select(F.from_json(one, f"STRUCT<{TOKEN_METADATA}>").alias("r")).select("r.*")
    m = rows(raw, TOKEN_METADATA).unionByName(single)
    for c in ("name", "symbol", "uri"):
        m = m.withColumn(c, F.coalesce(c, F.col("onChainData")[c]))
    return m


def account_data(account) -> tuple:
    """(kind, payload) of an account's data: [base64, encoding] or a raw string."""
    d = account["data"]
    encoded = d.startswith("[")
    return F.when(encoded, "encoded").otherwise("raw"), F.when(encoded, F.get_json_object(d, "$[0]")).otherwise(d)


def _accounts(df: DataFrame, account, *keys) -> DataFrame:
    kind, payload = account_data(account)
    size = F.when(kind == "encoded", F.floor(F.octet_length(payload) * 3 / 4)).otherwise(F.octet_length(payload)).cast("long")
    return df.select(*keys, *[account[c].alias(c) for c in ("lamports", "owner", "executable", "rentEpoch")], kind.alias("data_kind"), payload.alias("data"), size.alias("size"))


def account_info(raw: DataFrame) -> DataFrame:
    parsed = raw.select(F.from_json(F.get_json_object("raw", "$.result.value"), f"STRUCT<{ACCOUNT}>").alias("a")).where("a is not null")
    return _accounts(parsed, F.col("a"))


def multiple_accounts(raw: DataFrame) -> DataFrame:
    """One row per position; a missing account is a row of nulls."""
    parsed = raw.select(F.posexplode_outer(F.from_json(F.get_json_object("raw", "$.result.value"), f"ARRAY<STRUCT<{ACCOUNT}>>")).alias("position", "a"))
    return _accounts(parsed, F.col("a"), "position")


def program_accounts(raw: DataFrame, data_size: int | None = None, memcmp: tuple[int, str] | None = None) -> DataFrame:
    """(pubkey, account columns); filters by payload size and by bytes (hex) at an offset."""
    parsed = rows(raw, f"pubkey STRING, account STRUCT<{ACCOUNT}>").where("pubkey is not null")
    out = _accounts(parsed, F.col("account"), "pubkey")
    if data_size is not None:
        out = out.where(F.col("size") == data_size)
    if memcmp:
        out = out.where(F.hex(F.substring(F.try_to_binary("data", F.lit("base64")), memcmp[0] + 1, len(memcmp[1]) // 2)) == memcmp[1].upper())
    return out


def signatures(raw: DataFrame, limit: int | None = None) -> DataFrame:
    out = rows(raw, SIGNATURE)
    return out if limit is None else out.orderBy(F.desc("slot"), "signature").limit(limit)


def transactions(raw: DataFrame) -> DataFrame:
    parsed = raw.select(F.from_json(F.get_json_object("raw", "$.result"), f"STRUCT<{TRANSACTION}>").alias("t")).where("t.slot is not null")
    return parsed.select(F.col("t.transaction.signatures")[0].alias("signature"), "t.slot", "t.blockTime", "t.meta")


def token_accounts(raw: DataFrame) -> DataFrame:
    return program_accounts(raw)
