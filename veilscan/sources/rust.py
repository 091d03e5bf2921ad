"""A small scanner for Rust sources: structs with fields, functions with parameters and statements, regex matches with places.

It knows comments, strings, attributes, balanced brackets and items; what it can't read gives no rows. It is the
one place that needs row code: statements and nested items have no pattern that SQL could split them by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CLOSE = {"(": ")", "[": "]", "{": "}"}


def blank(src: str) -> str:
    """The same length and lines, with comments and the insides of strings blanked."""
    keep = lambda m: re.sub(r"[^\n]", " ", m[0])
    quoted = lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[0][0] in "\"'" else keep(m)
    return re.sub(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\'', quoted, src, flags=re.S)


def uncommented(src: str) -> str:
    """The same length and lines, with comments blanked only."""
    return re.sub(r'"(?:\\\\.|[^"\\\\])*"|//[^\n]*|/\*.*?\*/', lambda m: m[0] if m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0]), src, flags=re.S)


def balanced(code: str, at: int) -> int:
    """The place behind the bracket that closes the one at ``at``; -1 if none does."""
    depth = 0
    for i in range(at, len(code)):
        if code[i] in "([{":
            depth += 1
        elif code[i] in ")]}":
            depth -= 1
            if not depth:
                return i + 1
    return -1


def items(src: str, code: str, start: int, end: int, descend: bool = True) -> Iterator[tuple[str, str, list[str], int, int, int]]:
    """(kind, name, attributes, head, body, end) of structs and functions, those of impl blocks and, if ``descend``, of modules too."""
    i, attrs = start, []
    while i < end:
        if code[i].isspace():
            i += 1
        elif code.startswith("#[", i) or code.startswith("#![", i):
            e = balanced(code, code.index("[", i))
            if e < 0:
                return
            attrs.append(src[i:e])
            i = e
        else:
            m = re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(struct|fn|impl|mod)\b\s*(\w*)").match(code, i)
            stop = re.compile(r"[;{(]" if m and m[1] == "fn" else r"[;{]").search(code, m.end() if m else i)
            if not stop:
                return
            at = stop.start()
            if m and m[1] == "fn" and code[at] == "(":
                shut = balanced(code, at)
                stop = re.compile(r"[;{]").search(code, shut) if shut > 0 else None
                if not stop:
                    return
                at = stop.start()
            e = balanced(code, at) if code[at] == "{" else at + 1
            if e < 0:
                return
            if m and m[1] in ("struct", "fn") and code[at] == "{":
                yield m[1], m[2], attrs, i, at, e
            elif m and code[at] == "{" and (m[1] == "impl" or m[1] == "mod" and descend):
                yield from items(src, code, at + 1, e - 1, descend)
            i, attrs = e, []


def pieces(code: str, start: int, end: int, sign: str = ",") -> Iterator[tuple[int, int]]:
    """Ranges between signs outside all brackets."""
    depth, at = 0, start
    for i in range(start, end):
        c = code[i]
        if c in "([{" or c == "<" and sign == ",":
            depth += 1
        elif c in ")]}" or c == ">" and sign == "," and code[i - 1] not in "-=":
            depth -= 1
        elif c == sign and not depth:
            yield at, i
            at = i + 1
    if code[at:end].strip():
        yield at, end


def _line(src: str, at: int) -> int:
    return src.count("\n", 0, at) + 1


def structs(src: str, descend: bool = True) -> Iterator[dict]:
    code = blank(src)
    for kind, name, attrs, head, body, end in items(src, code, 0, len(code), descend):
        if kind != "struct":
            continue
        text = " ".join(attrs)
        for a, e in pieces(code, body + 1, end - 1):
            own = []
            i = a
            while (m := re.compile(r"\s*#\[").match(code, i)) and (shut := balanced(code, m.end() - 1)) > 0:
                own.append(src[m.start() : shut].strip())
                i = shut
            m = re.compile(r"\s*(pub(?:\s*\([^)]*\))?\s+)?(\w+)\s*:\s*(.+?)\s*$", re.S).match(code, i, e)
            if not m:
                continue
            marks = [x[x.find("(") + 1 : x.rfind(")")] for x in own if "account" in x]
            seeds = next((x[x.find("[") + 1 : x.find("]")] for x in marks if "seeds" in x and "[" in x), None)
            ty = re.sub(r"'\w+\s*,?\s*", "", re.sub(r"\s+", " ", m[3]))
            yield {
                "struct": name, "struct_line": _line(src, head), "is_account": any("account" in x for x in attrs), "is_context": "derive" in text and "Accounts" in text,
                "field": m[2], "type": ty, "line": _line(src, m.start(2)), "is_pub": bool(m[1]), "constraints": marks,
                "is_mut": any("mut" in x for x in marks), "is_signer": "Signer" in ty or any("signer" in x for x in marks), "seeds": seeds,
            }


STRUCTS = "file string, struct string, struct_line int, is_account boolean, is_context boolean, field string, type string, line int, is_pub boolean, constraints array<string>, is_mut boolean, is_signer boolean, seeds string"


def functions(src: str, descend: bool = True) -> Iterator[tuple[str, int, list[tuple[str, str]], list[tuple[int, str]]]]:
    """(name, line, parameters, statements with lines); blocks within a body are walked in order."""
    code = blank(src)
    for kind, name, _, head, body, end in items(src, code, 0, len(code), descend):
        if kind != "fn":
            continue
        src = uncommented(src)
        open_ = code.index("(", head)
        params = []
        for a, e in pieces(code, open_ + 1, balanced(code, open_) - 1):
            n, _, t = src[a:e].partition(":")
            if t:
                params.append((n.replace("mut ", "").strip(), t.strip()))
        out, at, depth = [], body + 1, 0
        for i in range(body + 1, end):
            c = code[i]
            depth += (c in "([") - (c in ")]")
            if not depth and c in ";{}" or i == end - 1:
                text = src[at:i].strip()
                if text:
                    out.append((_line(src, at + len(src[at:i]) - len(src[at:i].lstrip())), text + ("" if c != ";" else ";")))
                at = i + 1
        yield name, _line(src, head), params, out


def _each(parse, columns: list[str], descend: bool):
    def run(batches):
        for b in batches:
            rows = []
            for file, content in zip(b["file"], b["content"], strict=True):
                try:
                    rows += [{"file": file, **x} for x in parse(content or "", descend)]
                except (ValueError, IndexError):  # a file that can't be read gives no rows
                    continue
            yield pd.DataFrame(rows, columns=columns)

    return run


def struct_fields(files: DataFrame, descend: bool = True) -> DataFrame:
    """files (file, content) -> a row a field."""
    names = [c.strip().split(" ")[0] for c in STRUCTS.split(", ")]
    return files.select("file", "content").mapInPandas(_each(structs, names, descend), STRUCTS)


#: Rows of ``matches``.
MATCH = "file string, rule string, line int, start int, match string, group string, before string, after string, line_text string"


def matches(files: DataFrame, patterns: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Matches of named patterns {rule: (regex, characters before, characters after)} with their places and surroundings; a number
    after of -n is up to the n-th line's end."""
    compiled = {k: (re.compile(p, re.S), a, b) for k, (p, a, b) in patterns.items()}

    def run(batches):
        for batch in batches:
            rows = []
            for file, src in zip(batch["file"], batch["content"], strict=True):
                src = src or ""
                for rule, (p, a, b) in compiled.items():
                    for m in p.finditer(src):
                        s, e = m.span()
                        lo, hi = src.rfind("\n", 0, s) + 1, src.find("\n", s)
                        end = s + b
                        if b < 0:
                            end = e
                            for _ in range(-b):
                                end = src.find("\n", end) + 1 or len(src) + 1
                            end -= 1
                        rows.append((file, rule, _line(src, s), s, m[0], m[1] if m.re.groups else None, src[max(0, s - a) : s], src[s : min(len(src), end)], src[lo : hi if hi >= 0 else len(src)]))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in MATCH.split(", ")])

    return files.select("file", "content").mapInPandas(run, MATCH)
