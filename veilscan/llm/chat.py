"""Chat formatting from reply trees, in DataFrame operations only.

A message has a tree, an id, its parent's id, a role, a text and a score. Root-to-leaf paths are enumerated by
self-joins that double the distance they bridge (ids only, so rounds are logarithmic in depth). Branches of a tree
are ranked by their mean score, ties by leaf id, and the best ``branches`` are formatted, each as one conversation.

Template: ``<s>`` then a turn each: ``[INST] text [/INST]`` (user), ``[ASST] text </s>`` (assistant), ``[SYS] text [/SYS]``
(system) and ``[ROLE name] text [/ROLE]`` (any other). In texts ``~``, ``[``, ``]`` and ``<`` become ``~0`` to ``~3``, so that no
control string can stand in one, and the way back is unique. The loss mask covers the texts of [ASST] turns.

Nulls: a null text is empty, a null role is the role ''. A message whose parent is null or missing is a root; messages
of a cycle have no root and are in no path. Rows that repeat an id within a tree are told apart before
(see ``chains``). An empty table gives none. Scale: every step is an equi-join or an aggregation by tree and message;
only the messages of one path meet in one row.

Extra columns, whatever their names, are ignored. A very long text is one turn like others; a conversation is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.llm.work import Work

#: Escapes, in the order in which they are applied.
ESCAPES = [("~", "~0"), ("[", "~1"), ("]", "~2"), ("<", "~3")]
OPEN = {"user": "INST", "assistant": "ASST", "system": "SYS"}
TURN = r"\[(INST|ASST|SYS|ROLE [^\[\]<]*)\] ([^\[<]*) (?:\[/(?:INST|SYS|ROLE)\]|</s>)"


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def turn(role: Column, text: Column) -> Column:
    text = F.concat(F.lit("] "), escape(F.coalesce(text, F.lit(""))), F.lit(" "))
    return (
        F.when(role == "user", F.concat(F.lit("[INST"), text, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("[ASST"), text, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("[SYS"), text, F.lit("[/SYS]")))
        .otherwise(F.concat(F.lit("[ROLE "), escape(F.coalesce(role, F.lit(""))), text, F.lit("[/ROLE]")))
    )


def chains(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rows of linear conversations as messages (tree, id, parent, role, text, score): each answers the one before;
    equal turns are ordered by role, then text, nulls first."""
    named = rows.select(F.col(tree).alias("tree"), F.col(order).alias("o"), "role", "text")
    out = named.withColumn("id", F.row_number().over(W.partitionBy("tree").orderBy("o", "role", "text")).cast("long"))
    return out.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def paths(work: Work, messages: DataFrame) -> DataFrame:
    """(tree, leaf, id, depth from the leaf, score) of every root-to-leaf path's messages."""
    # a tree's key is never null in joins
    ids = work.save(messages.select(F.struct("tree").alias("t"), "id", "parent", "score"))
    known = ids.select("t", F.col("id").alias("parent"))
    up = ids.select("t", "id", "parent").join(known, ["t", "parent"], "left_semi")
    roots = ids.select("t", "id").join(up.select("t", "id"), ["t", "id"], "left_anti")
    leaves = ids.select("t", "id").join(up.select("t", F.col("parent").alias("id")), ["t", "id"], "left_anti")
    found = work.save(leaves.select("t", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("depth")))
    jump, step = work.save(up.select("t", "id", F.col("parent").alias("to"))), 1
    most = ids.count()
    while step <= most and not jump.isEmpty():
        more = found.join(jump, ["t", "id"]).select("t", "leaf", F.col("to").alias("id"), (F.col("depth") + step).alias("depth"))
        found = work.save(found.unionByName(more))
        second = jump.select("t", F.col("id").alias("to"), F.col("to").alias("far"))
        jump, step = work.save(jump.join(second, ["t", "to"]).select("t", "id", F.col("far").alias("to"))), step * 2
    whole = found.join(roots, ["t", "id"], "left_semi").select("t", "leaf").distinct()
    return found.join(whole, ["t", "leaf"], "left_semi").join(ids.select("t", "id", "score"), ["t", "id"])


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, branch (from 1), score, formatted: the best branches of each tree as conversations."""
    work = Work(messages.sparkSession, "chat")
    messages = work.save(messages)
    every = work.save(paths(work, messages))
    ranked = every.groupBy("t", "leaf").agg(F.avg("score").alias("score"))
    ranked = ranked.withColumn("branch", F.row_number().over(W.partitionBy("t").orderBy(F.desc("score"), "leaf"))).where(F.col("branch") <= branches)
    chosen = every.drop("score").join(ranked, ["t", "leaf"])
    texts = messages.select(F.struct("tree").alias("t"), "id", turn(F.col("role"), F.col("text")).alias("turn"))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("place"), "turn")))
    out = chosen.join(texts, ["t", "id"]).groupBy("t", "leaf", "branch", "score").agg(turns.alias("turns"))
    return out.select("t.tree", "leaf", "branch", "score", F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda x: x["turn"]), "")).alias("formatted"))


def read_back(formatted: Column) -> tuple[Column, Column]:
    """Roles and texts of a formatted conversation's turns."""
    marks, texts = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(g)) for g in (1, 2))
    role = lambda m: F.when(m == "INST", "user").when(m == "ASST", "assistant").when(m == "SYS", "system").otherwise(unescape(F.substring(m, 6, 1 << 30)))
    return F.transform(marks, role), F.transform(texts, unescape)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Read back from the output: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    roles, texts = read_back(F.col("formatted"))
    both = formatted.select(F.col("tree").alias(id_col), "formatted", roles.alias("r"), texts.alias("x"))
    every = F.array_join(F.zip_with("r", "x", lambda r, x: F.concat(r, F.lit("\n"), x, F.lit("\n"))), "")
    marks = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1))
    loss = F.array_join(F.zip_with(marks, "x", lambda m, x: F.when(m == "ASST", x).otherwise("")), "")
    return both.select(id_col, F.size("r").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
