"""Source files as (file, content)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan import vocab

def resolve_target(target: str) -> str:
    """A directory or file; addresses of repositories need a network and are refused."""
    if target.startswith(("https://", "git@")):
        raise ValueError("only local or shared paths can be read here")
    if "://" not in target and not os.path.exists(target):
        raise FileNotFoundError(target)
    return target


def source_files(spark: SparkSession, root: str, skipped: list[str] = vocab.SKIPPED_DIRS, glob: str = "*.rs", depth: int = vocab.MAX_DEPTH) -> DataFrame:
    """(file, content) below root, files by their paths below it: no skipped folder (those that the root is given by included), no hidden one below the root, no
    generated bindings, none deeper than ``depth``; files that are no UTF-8 are left out."""
    resolve_target(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    given = root.rstrip("/")
    base = given.split("://", 1)[-1] if "://" in given else os.path.abspath(given)
    # the rest of the path below the root
    below = F.split(F.regexp_replace("path", r"^.*?\Q" + base + r"\E/?", ""), "/")
    kept = raw.where(~F.arrays_overlap(below, F.array(*[F.lit(s) for s in skipped])) & ~F.exists(below, lambda p: p.startswith(".") & (p != "..") & (F.length(p) > 1)))
    kept = kept.where(~F.col("path").rlike(r"(/|_)wasm\.rs$") & (F.size(below) <= depth) & F.lit(not set(given.split("/")) & set(skipped)))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    name = F.array_join(below, "/")
    return kept.select(F.when(name == "", F.substring_index("path", "/", -1)).otherwise(name).alias("file"), text.alias("content")).where("content is not null")
