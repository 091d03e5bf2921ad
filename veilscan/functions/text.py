"""Column functions over text: patterns, vocabularies, values. ASCII classes only, so engines agree."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan import vocab


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def contains_any(text: Column | str, words: list[str]) -> Column:
    text, hit = col(text), F.lit(False)
    if len(words) > 6:  # one alternation is less code than many searches
        return text.rlike("|".join(re.escape(w) for w in words))
    for w in words:
        hit = hit | text.contains(w)
    return hit


def count_contained(text: Column | str, words: list[str]) -> Column:
    return sum((col(text).contains(w).cast("int") for w in words), F.lit(0))


def first_contained(text: Column | str, words: list[str]) -> Column:
    """The first word of the list, in its order, that the text has; else null."""
    return F.coalesce(*[F.when(col(text).contains(w), F.lit(w)) for w in words])


def ends_with_any(text: Column | str, words: list[str]) -> Column:
    return F.lower(col(text)).rlike("(" + "|".join(re.escape(w) for w in words) + ")$")


def email(text: Column | str) -> Column:
    """The first e-mail address, or null."""
    found = F.regexp_extract(col(text), vocab.EMAIL, 0)
    return F.when(found != "", found)


def is_placeholder_email(x: Column | str) -> Column:
    return ends_with_any(x, vocab.PLACEHOLDER_EMAIL_DOMAINS)


def phone(text: Column | str) -> Column:
    found = F.regexp_extract(col(text), vocab.PHONE, 0)
    return F.when(found != "", found)


def has_ssn(text: Column | str) -> Column:
    return col(text).rlike(vocab.SSN)


def log_pii_types(log: Column | str) -> Column:
    """email, phone, ssn as far as a log line may hold them: signs and numbers of digits only."""
    log = col(log)
    digits = F.length(F.regexp_replace(log, "[^0-9]", ""))
    kinds = F.array(F.when(log.contains("@") & log.contains("."), F.lit("email")), F.when(digits >= 10, F.lit("phone")), F.when(log.contains("-") & (digits >= 9), F.lit("ssn")))
    return F.array_compact(kinds)


def is_debug_output(log: Column | str) -> Column:
    return contains_any(log, ["debug", "trace", "println", "dbg"])


def looks_like_hex_private_key(text: Column | str) -> Column:
    """The token after the first 0x, without a tail that is no hex, has 120 to 130 hex digits."""
    token = F.regexp_extract(col(text), r"0x([^ \t\r\n]*)", 1)
    token = F.regexp_replace(token, "[^0-9a-fA-F]+$", "")
    return token.rlike("^[0-9a-fA-F]{120,130}$")


def looks_like_private_key(text: Column | str) -> Column:
    return col(text).rlike("^[1-9A-HJ-NP-Za-km-z]{85,90}$")


def _json_fields(text: Column | str, fields: list[str]) -> Column:
    return count_contained(F.lower(col(text)), [f'"{f}"' for f in fields])


def has_token_metadata_context(text: Column | str) -> Column:
    return _json_fields(text, vocab.TOKEN_METADATA_FIELDS) >= 2


def has_nft_metadata_context(text: Column | str) -> Column:
    n = _json_fields(text, vocab.NFT_METADATA_FIELDS)
    return (n >= 2) | (F.lower(col(text)).contains('"image"') & (n >= 1))


def is_financial_context(text: Column | str) -> Column:
    return contains_any(F.lower(col(text)), vocab.FINANCIAL_CONTEXTS)


#: Values that are no person's name.
NAME_SIGNS = r"[#@$_/\\{}\[\]|]"
NAME_PREFIXES = "0x sol token nft dao defi meta ape punk degen".split()
NAME_KEYWORDS = "token coin nft dao protocol finance swap pool vault staking yield farm dex amm edition collection".split()


def is_safe_name_value(value: Column | str) -> Column:
    v = F.trim(col(value))
    n, low = F.octet_length(v), F.lower(v)
    return (
        (n < 2) | (n > 50) | (v.rlike("^[A-Z0-9 ]+$") & (n <= 10)) | v.rlike("[0-9]") | v.rlike(NAME_SIGNS)
        | low.rlike("^(" + "|".join(NAME_PREFIXES) + ")") | contains_any(low, NAME_KEYWORDS) | (~v.contains(" ") & (n > 10))
    )


def is_hash_or_encoded(value: Column | str) -> Column:
    v = F.trim(col(value))
    n = F.octet_length(v)
    dashes = F.length(v) - F.length(F.translate(v, "-", ""))
    return v.rlike("^[0-9a-fA-F]{32,}$") | v.rlike("^[1-9A-HJ-NP-Za-km-z]{32,90}$") | ((n >= 20) & v.rlike("^[A-Za-z0-9+/=]*=$")) | ((n == 36) & (dashes == 4))


def is_blockchain_address_value(value: Column | str) -> Column:
    v = F.trim(col(value))
    n = F.octet_length(v)
    return v.rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$") | (v.startswith("0x") & (n == 42)) | ((v.startswith("1") | v.startswith("3") | v.startswith("bc1")) & n.between(26, 62))


def is_safe_field_value(name: Column | str, value: Column | str) -> Column:
    low = F.lower(col(name))
    return F.when(is_hash_or_encoded(value), True).when((low == "name") | low.endswith("_name"), is_safe_name_value(value)).when(low.contains("address"), is_blockchain_address_value(value)).otherwise(False)


def has_account_pii(data: Column | str) -> Column:
    """Personal data in a base64 payload; malformed payloads give null, bytes that are no UTF-8 are replaced."""
    data = col(data)
    raw = F.when(F.length(data) % 4 == 0, F.try_to_binary(data, F.lit("base64")))
    low = F.lower(F.make_valid_utf8(raw.cast("string")))
    hit = F.lit(False)
    for p in vocab.ACCOUNT_PII:
        hit = hit | low.rlike(p)
    return F.when(raw.isNotNull(), hit)


def payload_size(data: Column | str) -> Column:
    return F.floor(F.octet_length(col(data)) * 3 / 4).cast("long")


def field_value(text: Column | str, field: str) -> Column:
    """The first string value of a JSON key, or null."""
    found = F.regexp_extract(col(text), f'"{re.escape(field)}"[ \\t\\r\\n]*:[ \\t\\r\\n]*"([^"]*)"', 1)
    return F.when(found != "", found)


def contains_identifier(text: Column | str, name: str) -> Column:
    return col(text).rlike(f"(^|[^A-Za-z0-9_]){re.escape(name)}([^A-Za-z0-9_]|$)")


def first_address(text: Column | str) -> Column:
    """The first word that, without signs around it, is 32 to 44 base58 characters."""
    words = F.transform(F.split(col(text), r"[ \t\r\n]+"), lambda w: F.regexp_replace(w, "^[^1-9A-HJ-NP-Za-km-z]+|[^1-9A-HJ-NP-Za-km-z]+$", ""))
    return F.try_element_at(F.filter(words, lambda w: w.rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$")), F.lit(1))


def confidence_label(c: Column | str) -> Column:
    c = col(c)
    return F.when(c >= 90, "Very High").when(c >= 70, "High").when(c >= 50, "Medium").when(c >= 25, "Low").otherwise("Very Low")


def severity_rank(s: Column | str) -> Column:
    """0 to 4; an unknown severity counts as INFO."""
    s, out = F.upper(col(s)), F
    for i, name in enumerate(vocab.SEVERITIES):
        out = out.when(s == name, i)
    return out.otherwise(0)


def severity_weight(s: Column | str) -> Column:
    s, out = F.upper(col(s)), F
    for name, w in zip(vocab.SEVERITIES, vocab.WEIGHTS, strict=True):
        out = out.when(s == name, w)
    return out.otherwise(0)


def adjusted(confidence: Column | str, by: Column) -> Column:
    """Confidence after verification: within 5 and 100."""
    return F.greatest(F.lit(5), F.least(F.lit(100), col(confidence) + by)).cast("int")


def bucket(n: Column | str, steps: list[tuple[int | None, int]]) -> Column:
    """An adjustment by count: the first (upper bound, value) that holds n; the last has no bound."""
    n, out = col(n), F
    for upper, value in steps[:-1]:
        out = out.when(n <= upper, value)
    return out.otherwise(steps[-1][1])
