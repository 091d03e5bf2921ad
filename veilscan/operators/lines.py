"""Lines of files and texts, snippets, and context along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _parts(text: str) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, text): split at newlines, one carriage return off each, no empty last line."""
    return df.select(key, F.posexplode(_parts(text)).alias("p", "text")).select(key, (F.col("p") + 1).alias("line_no"), "text")


def frame(key: str, before: int, after: int) -> W:
    return W.partitionBy(key).orderBy("line_no").rowsBetween(-before, after)


def snippet(key: str, before: int = 2, after: int = 2) -> Column:
    """The lines around a line, numbered, the line itself marked."""
    around = F.collect_list(F.struct("line_no", "text")).over(frame(key, before, after))
    own = F.col("line_no")
    return F.array_join(F.transform(around, lambda x: F.format_string("%s%4d | %s", F.when(x["line_no"] == own, ">").otherwise(" "), x["line_no"], x["text"])), "\n")


def context(key: str, before: int, after: int) -> Column:
    """The texts of a frame of lines as one."""
    return F.array_join(F.collect_list("text").over(frame(key, before, after)), "\n")


def in_test_module(file_lines: DataFrame, key: str, name: str) -> DataFrame:
    """Lines and whether they come from the first test or debug module on: the rest of the file. A mark opens one on its own line, or
    waits for a line that starts with one."""
    upto = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    line = F.trim(F.col("text"))
    mark = line.contains("#[cfg(test)]") | line.contains("#[cfg(debug_assertions)]")
    out = file_lines.withColumn("_mark", mark).withColumn("_waits", F.max("_mark").over(upto))
    opens = (F.col("_mark") & line.contains("mod ")) | (F.col("_waits") & (line.startswith("mod ") | line.startswith("pub mod ")))
    return out.withColumn(name, opens).withColumn(name, F.max(name).over(upto)).drop("_mark", "_waits")


def seen_within(when: Column, key: str, before: int) -> Column:
    """Whether a line, or one of the lines before it, is one of those."""
    return F.max(when).over(frame(key, before, 0))


def settled(file_lines: DataFrame, key: str, when: Column, gap: int = 6) -> DataFrame:
    """Marked lines that are followed by ``gap`` lines, none of them marked."""
    ordered = W.partitionBy(key).orderBy("line_no")
    m = file_lines.withColumn("last", F.max("line_no").over(W.partitionBy(key))).where(when).withColumn("next", F.lead("line_no").over(ordered))
    return m.where((F.coalesce("next", F.lit(1 << 30)) > F.col("line_no") + gap) & (F.col("last") >= F.col("line_no") + gap)).drop("last", "next")


def around(df: DataFrame, key: str, text: str, when, before: int, after: int, name: str, mark: bool = True) -> DataFrame:
    """(key, line_no, text, name) of the lines that ``when`` holds for, with the lines around: as a numbered snippet, or (mark
    False) as they are. Cut from each text's own lines, so nothing is shuffled."""
    ls = F.transform(_parts(text), lambda x, i: F.struct((i + 1).alias("i"), x.alias("x")))
    own = df.select(key, ls.alias("_ls"))

    def told(m):
        some = F.slice("_ls", F.greatest(m["i"] - before, F.lit(1)), F.least(m["i"], F.lit(before + 1)) + after)
        if not mark:
            return F.array_join(F.transform(some, lambda y: y["x"]), "\n")
        return F.array_join(F.transform(some, lambda y: F.format_string("%s%4d | %s", F.when(y["i"] == m["i"], ">").otherwise(" "), y["i"], y["x"])), "\n")

    hits = F.transform(F.filter("_ls", lambda m: when(m["x"])), lambda m: F.struct(m["i"].alias("line_no"), m["x"].alias("text"), told(m).alias(name)))
    return own.select(key, F.explode(hits).alias("_h")).select(key, "_h.*")


def test_functions(file_lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, in_test): lines in ``#[test]`` functions, by a fold over the file's lines that counts braces and never
    goes below none; the line that closes a function is outside."""
    row = F.struct("line_no", "text")
    ordered = file_lines.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("ls"))
    state = "named_struct('seen', false, 'depth', 0, 'out', cast(array() as array<struct<line_no:int,in_test:boolean>>))"
    opened = "(length(x.text) - length(translate(x.text, '{', '')))"
    closed = "(length(x.text) - length(translate(x.text, '}', '')))"
    depth = f"if(s.seen, greatest(s.depth + {opened} - {closed}, 0), 0)"
    step = f"""(s, x) -> named_struct('seen', if(contains(x.text, '#[test]'), true, if(s.seen and {opened} + s.depth > 0 and {depth} = 0, false, s.seen)), 'depth', {depth},
        'out', concat(s.out, array(named_struct('line_no', x.line_no, 'in_test', contains(x.text, '#[test]') or (s.seen and not ({opened} + s.depth > 0 and {depth} = 0))))))"""
    return ordered.select(key, F.explode(F.expr(f"aggregate(ls, {state}, {step}, s -> s.out)")).alias("r")).select(key, "r.line_no", "r.in_test")
