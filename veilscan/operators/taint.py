"""Flows of sensitive data from sources to sinks within functions, and through functions that return what they read.

A first pass over all files makes a table of function summaries, joined by the names that a file calls: its own functions
count first. A second folds each function's statements in order, which no aggregate of SQL can: an assignment replaces
what a name holds.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan import vocab
from veilscan.sources.rust import functions

#: Types whose values may carry data from outside.
TAINTABLE = ["Vec<u8>", "[u8]", "&[u8]", "String", "&str", "Vec<", "Box<", "&mut", "Pubkey", "AccountInfo"]
#: Sinks with their severities, and what sources and sinks add to a flow's confidence.
SINKS = [
    ("emit", r"\bemit(?:_cpi)?!\s*\((.*)", "HIGH"), ("msg", r"\bmsg!\s*\((.*)", "MEDIUM"), ("debug", r"\b(?:println|dbg|eprintln)!\s*\((.*)", "LOW"),
    ("sol_log", r"\bsol_log\w*\s*\((.*)|\blog_\w*\s*\((.*)", "MEDIUM"), ("cpi", r"\binvoke(?:_signed)?\s*\((.*)|(?:CpiContext|cpi::)(.*)", "HIGH"),
    ("serialize", r"([\w.]+\.(?:try_)?serialize\s*\(.*|[\w.]+\.pack(?:_into_slice)?\s*\(.*)", "HIGH"), ("account_write", r"^(?!self\.)[\w]+(?:\.\w+)+\s*=(?!=)\s*(.*)", "HIGH"), ("return", r"^return\b(.*)", "MEDIUM"),
]
SOURCE_TERM = {"data": 15, "field": 10, "instruction": 15, "input": 15, "cpi": 5, "call": -5, "account": 5, "parameter": 0}
SINK_TERM = {"emit": 15, "msg": 10, "account_write": 10, "debug": -10, "return": -5, "sol_log": 10, "cpi": 15, "serialize": 10}
FLOWS = "file string, function string, line int, source string, source_kind string, sink string, severity string, carrier string, confidence int, snippet string, path array<string>"


def sanitized(expr: str) -> bool:
    """Whether the expression hides what it reads, or ends as one that tells a length or a yes or no only."""
    e = expr.replace(" ", "").strip().rstrip(";")
    if e.endswith(")") and e.count(")") > e.count("("):  # of the call around it
        e = e[:-1]
    return any(s in e for s in vocab.SANITIZERS) or any(e.endswith(s) or s[-1] != ")" and re.search(re.escape(s) + r"\([^()]*\)$", e) for s in vocab.SAFE_ENDINGS)


def taintable(ty: str) -> bool:
    return any(t in ty for t in TAINTABLE)


def words(expr: str) -> set[str]:
    return set(re.findall(r"\w+", expr))


def source_of(expr: str, calls: dict[str, bool]) -> tuple[str, str] | None:
    """(kind, name) that an expression reads by itself; the first rule that holds."""
    e = re.sub(r"\s+", "", expr)
    if m := re.search(r"ctx\.accounts\.(\w+)", e):
        return "account", m[1]
    if m := re.search(r"(\w+)\.(?:data\.borrow|try_borrow_data|try_borrow_mut_data)\(", e):
        return "data", m[1]
    if m := re.search(r"(\w+)\.(?:owner|lamports|key)\b(?!\()", e):
        return "field", m[1]
    if re.search(r"\b(?:instruction_data|ix_data)\b", e):
        return "instruction", "instruction_data"
    if m := re.search(r"(\w+)::(?:try_)?(?:deserialize|unpack|try_from_slice)\(", e):
        return "input", m[1]
    if re.search(r"\binvoke(?:_signed)?\(", e):
        return "cpi", "invoke"
    for name in re.findall(r"(\w+)\(", e):
        if calls.get(name):
            return "call", name
    return None


def confidence(kind: str, sink: str, carrier: str, raw: bool = False) -> int:
    """70 and what source (raw: bytes of a parameter), sink and carrier add."""
    low = carrier.lower()
    score = 70 + SOURCE_TERM.get(kind, 0) + SINK_TERM.get(sink, 0) + (10 if raw else 0)
    if low in vocab.GENERIC_CARRIERS or low.endswith("_name") and "user" not in low:
        score -= 25
    elif any(x in low for x in vocab.PERSONAL_CARRIERS):
        score += 10
    return max(20, min(98, score))


def flows(name: str, params: list[tuple[str, str]], statements: list[tuple[int, str]], calls: dict[str, bool]):
    """Flows of one function: the environment is folded over its statements."""
    held: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {}
    for p, ty in params:
        if "Context<" not in ty and taintable(ty):
            held[p] = [("parameter", p, (p,))]
    raw = {p for p, ty in params if "Vec<u8>" in ty or "[u8]" in ty}
    for line, text in statements:
        if m := re.match(r"let\s+(?:mut\s+)?(\w+)\s*(?::[^=]+)?=\s*(.*)", text, re.S):
            target, expr = m[1], m[2]
            if s := source_of(expr, calls):
                held[target] = [(*s, (s[1], target))]
            elif not sanitized(expr):
                some = next((v for v in held if v in words(expr)), None)
                if some:
                    held[target] = [(k, n, (*path, target)) for k, n, path in held[some]]
            continue
        for sink, pattern, severity in SINKS:
            m = re.search(pattern, text, re.S)
            if not m:
                continue
            inside = next((g for g in m.groups() if g), "")
            if sanitized(inside):
                continue
            seen = words(inside)
            for carrier, sources in held.items():
                if carrier in seen:
                    for kind, source, path in sources:
                        yield {"function": name, "line": line, "source": source, "source_kind": kind, "sink": sink, "severity": severity, "carrier": carrier, "confidence": confidence(kind, sink, carrier, kind == "parameter" and source in raw), "snippet": text, "path": [*path, sink]}
            direct = source_of(inside, {})
            if direct and not any(c in seen for c in held):
                yield {"function": name, "line": line, "source": direct[1], "source_kind": direct[0], "sink": sink, "severity": severity, "carrier": "unknown", "confidence": confidence(direct[0], sink, "unknown"), "snippet": text, "path": [direct[1], sink]}


SUMMARY = "file string, name string, tainted_params array<int>, reads_accounts boolean, has_sinks boolean, returns_tainted boolean"


def summaries(files: DataFrame, descend: bool = True) -> DataFrame:
    """A row a function: which parameters may carry data, whether it reads accounts, has sinks, and may return what it reads."""

    def run(batches):
        for b in batches:
            rows = []
            for file, src in zip(b["file"], b["content"], strict=True):
                try:
                    found = list(functions(src or "", descend))
                except (ValueError, IndexError):
                    continue
                for name, _, params, statements in found:
                    body = " ".join(t for _, t in statements)
                    tainted = [i for i, (_, ty) in enumerate(params) if "Context<" not in ty and taintable(ty)]
                    reads = bool(re.search(r"ctx\s*\.\s*accounts|try_borrow|data\.borrow", body))
                    sinks = any(re.search(p, t, re.S) for _, t in statements for s, p, _ in SINKS if s not in ("return", "account_write"))
                    rows.append((file, name, tainted, reads, sinks, bool(statements) and (bool(tainted) or reads)))
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in SUMMARY.split(", ")])

    return files.select("file", "content").mapInPandas(run, SUMMARY)


def taint_flows(files: DataFrame, registry: DataFrame | None = None, descend: bool = True) -> DataFrame:
    """Flows of all files; registry: summaries. A name that a file calls has the summary of the file's own function, or else
    that of the first file that has one. Files with ``test`` in their path are skipped."""
    plain = files.where(~F.col("file").contains("test")).select("file", "content")
    if registry is None:
        plain = plain.withColumn("names", F.array().cast("array<string>"))
    else:
        called = plain.select("file", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(\w+)\s*\("), F.lit(1)))).alias("name"))
        first = registry.groupBy("name").agg(F.min_by("returns_tainted", "file").alias("any"))
        own = registry.groupBy("file", "name").agg(F.max("returns_tainted").alias("own"))
        known = called.join(first, "name").join(own, ["file", "name"], "left").where(F.coalesce("own", "any"))
        names = known.groupBy("file").agg(F.collect_set("name").alias("names"))
        plain = plain.join(names, "file", "left").select("file", "content", F.coalesce("names", F.array().cast("array<string>")).alias("names"))

    def run(batches):
        for b in batches:
            rows = []
            for file, src, known in zip(b["file"], b["content"], b["names"], strict=True):
                try:
                    found = list(functions(src or "", descend))
                except (ValueError, IndexError):
                    continue
                calls = dict.fromkeys(known, True)
                for name, _, params, statements in found:
                    rows += [{"file": file, **x} for x in flows(name, params, statements, calls)]
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in FLOWS.split(", ")])

    return plain.mapInPandas(run, FLOWS)
