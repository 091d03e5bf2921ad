"""What a field's name and type say about it: safe on a ledger, personal data, or a secret."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan import vocab
from veilscan.functions.text import col, contains_any


def is_safe_field_name(name: Column | str) -> Column:
    low = F.lower(col(name))
    return low.isin(vocab.SAFE_FIELD_NAMES) | contains_any(low, vocab.SAFE_FIELD_PATTERNS)


def is_safe_type(ty: Column | str) -> Column:
    alt = "|".join(vocab.SAFE_TYPES)
    return col(ty).rlike(f"^({alt})|<({alt})")


def is_safe_struct_context(struct: Column | str) -> Column:
    return contains_any(F.lower(col(struct)), vocab.SAFE_STRUCT_CONTEXTS)


def is_safe_field(name: Column | str, ty: Column | str, struct: Column | str | None = None) -> Column:
    name, ty = col(name), col(ty)
    low = F.lower(name)
    context = F.coalesce(is_safe_struct_context(struct), F.lit(False)) if struct is not None else F.lit(False)
    return (
        (ty.contains("Pubkey") & ~contains_any(low, vocab.PERSONAL_PREFIXES)) | is_safe_field_name(name) | (is_safe_type(ty) & ~ty.contains("String"))
        | (low.isin("name", "title", "label") & context) | low.rlike("(" + "|".join(vocab.SAFE_SUFFIXES) + ")$")
    )


def ignored(name: Column | str, ty: Column | str, pattern: str) -> Column:
    """Whether a match of the pattern in a field that is not safe by itself means nothing on a ledger."""
    name, ty = col(name), col(ty)
    low = F.lower(name)
    rule = {
        "token": ~((ty == "String") & (low == "token")),
        "key": ~contains_any(low, ["private", "secret", "api"]),
        "seed": ~contains_any(low, ["phrase", "mnemonic"]),
        "auth": ty.contains("Pubkey") | low.contains("authority"),
        "address": ty.contains("Pubkey"),
        "name": ty.contains("Pubkey") | contains_any(low, ["market", "pool", "token", "program"]),
        "id": contains_any(ty, ["Pubkey", "u64", "u32"]),
        "user": contains_any(ty, ["Pubkey", "u64", "u32"]),
        "identifier": contains_any(ty, ["Pubkey", "u64", "u32"]),
    }.get(pattern, F.lit(pattern in ("fee", "amount", "balance", "price", "total")))
    return rule


def _first(name: Column, ty: Column, patterns: list[str]) -> Column:
    low = F.lower(name)
    found = F.coalesce(*[F.when(low.contains(p) & ~ignored(name, ty, p), F.lit(p)) for p in patterns])
    return F.when(~is_safe_field(name, ty), found)


def pii_kind(name: Column | str, ty: Column | str, struct: Column | str | None = None) -> Column:
    """The pattern that makes a field personal data, or null."""
    name, ty = col(name), col(ty)
    low = F.lower(name)
    person = contains_any(F.lower(col(struct)), ["user", "profile", "member", "person", "customer", "identity"]) if struct is not None else F.lit(False)
    ledger = contains_any(low, ["market", "pool", "token", "program"])
    named = F.when(F.coalesce(person, F.lit(False)) | (ty.contains("String") & ~ledger), F.lit("name"))
    place = F.when(~ty.contains("Pubkey") & ~contains_any(low, ["wallet", "token", "program", "mint"]) & ty.contains("String"), F.lit("address"))
    return (
        F.when(is_safe_field(name, ty, struct), F.lit(None).cast("string"))
        .when(low.isin("name", "username", "user_name"), named)
        .when(low.contains("address"), place)
        .otherwise(_first(name, ty, vocab.PII_PATTERNS))
    )


def secret_kind(name: Column | str) -> Column:
    """The pattern that makes a field a secret, or null."""
    name = col(name)
    hashed = contains_any(F.lower(name), ["hash", "encrypted"])
    return F.when(hashed, F.lit(None).cast("string")).otherwise(_first(name, F.lit("unknown"), vocab.SECRET_PATTERNS))


def pii_confidence(name, ty, struct, is_account, kind) -> Column:
    low, s = F.lower(col(name)), F.lower(col(struct))
    score = (
        F.lit(70) + F.when(is_account, 15).otherwise(0) + F.when(col(ty).contains("String"), 10).otherwise(0) + F.when(contains_any(s, ["user", "profile"]), 10).otherwise(0)
        + F.when(low == col(kind), 5).otherwise(0) - F.when(contains_any(low, ["hash", "encrypted"]), 30).otherwise(0) - F.when(~is_account & ~s.contains("state"), 10).otherwise(0)
    )
    return F.greatest(F.lit(20), F.least(F.lit(98), score))


def secret_confidence(name, ty) -> Column:
    low = F.lower(col(name))
    score = F.lit(75) + F.when(contains_any(ty, ["String", "Vec<u8>"]), 15).otherwise(0) + F.when(low.isin("password", "secret_key", "private_key", "api_key", "mnemonic"), 10).otherwise(0) - F.when(low.contains("hash"), 40).otherwise(0)
    return F.greatest(F.lit(20), F.least(F.lit(98), score))
