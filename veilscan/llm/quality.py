"""Quality rules: counts over whole texts, and language-specific bands of n-gram perplexity.

Base rules reject texts of fewer than 50 words, or with more than half of their words in 3-word windows that the
text has twice or more. Of the others, the mean negative log-probability a word under the modified Kneser-Ney model
of their language (kneser_ney) must lie within the language's band: median +- ``reach`` robust deviations (1.4826
times the median absolute deviation, at least ``floor``) over that language's texts that pass the base rules. A
text too repetitive to surprise falls below the band, one of unknown or shouted words above it.

Scale: counts and scores travel as arrays (kneser_ney); a text's loss is found again by its language and two 64-bit
hashes of the text, and what the rules reject goes by an anti-join on these. The band comes from a histogram in steps
of 0.001.

Nulls: a null text has no words, and fails; a null language is the language ''. Rows that repeat count as rows.
An empty table gives none. Extra columns, whatever their names, are ignored by quality and kept by kept_documents. A very
long text is counted and scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilscan.llm import kneser_ney as kn
from veilscan.llm import textvec as tv
from veilscan.llm.graph import hint
from veilscan.llm.work import Work

U = np.uint64
SIGNS = np.zeros(256, bool)
SIGNS[list(b"#*$%&|<>")] = True


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a block."""
    n = len(offs) - 1
    s, e, first = tv.word_spans(data, offs)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
    out = {"n_words": np.diff(first), "word_chars": total(~tv.SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(SIGNS[data])}
    # words in repeated 3-word windows
    doc = np.repeat(np.arange(n), out["n_words"])
    w3 = tv.ngrams(tv.span_hash(data, s, e), 3)
    own = doc[:-2] == doc[2:] if len(doc) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(own)
    key = tv.mix(w3[at] ^ tv.mix(doc[at].astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(s) + 3, bool)
    start = at[twice]
    hit[start] = hit[start + 1] = hit[start + 2] = True
    out["n_repeat_words"] = np.bincount(doc[hit[: len(s)]], minlength=n)
    # lines with a word that equal an earlier line of their text
    raw = data.tobytes()
    dup = np.zeros(n, np.int64)
    for k in range(n):
        a, b = offs[k], offs[k + 1]
        lines = raw[a:b].split(b"\n")
        if len(lines) > 1:
            seen, d = set(), 0
            for x in lines:
                if x in seen:
                    d += bool(x.strip(b" \t\n\v\f\r"))
                else:
                    seen.add(x)
            dup[k] = d
    out["n_dup_lines"] = dup
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _counted(batches):
    for b in batches:
        got = {c: [] for c in COUNTS}
        for _, _, data, offs in tv.blocks(b.column(1)):
            for c, v in base_counts(data, offs).items():
                got[c].append(v)
        arrays = [b.column(0), *(b.column(i) for i in (2, 3, 4)), *(pa.array(np.concatenate(got[c]) if got[c] else np.zeros(0, np.int64), pa.int64()) for c in COUNTS)]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "lang", "t1", "t2", *COUNTS])


def _keys(text, lang) -> list:
    """What a loss is found by: the language and two hashes of the text."""
    return [F.coalesce(lang, F.lit("")).alias("lang"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def bands(scored: DataFrame, reach: float, floor: float) -> DataFrame:
    """lang, low, high: from exact medians of a histogram in steps of 0.001."""

    def middle(cells: DataFrame) -> DataFrame:
        cells = cells.groupBy("lang", "cell").agg(F.sum("n").alias("n"))
        run = W.partitionBy("lang").orderBy("cell")
        cells = cells.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(W.partitionBy("lang")))
        return cells.where("2 * upto >= all").groupBy("lang").agg(F.min("cell").alias("mid"))

    cells = scored.groupBy("lang", F.round(F.col("loss") * 1000).cast("long").alias("cell")).agg(F.count("*").alias("n"))
    mid = middle(cells)
    dev = middle(cells.join(mid, "lang").select("lang", F.abs(F.col("cell") - F.col("mid")).alias("cell"), "n")).withColumnRenamed("mid", "dev")
    width = reach * F.greatest(F.lit(floor), 1.4826 * F.col("dev") / 1000)
    return mid.join(dev, "lang").select("lang", (F.col("mid") / 1000 - width).alias("low"), (F.col("mid") / 1000 + width).alias("high"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = 50, most_repeated: int = 50, reach: float = 5.0, floor: float = 0.05) -> DataFrame:
    """One row per row of docs: id, the five counts, base_failed, loss (mean negative log-probability), low, high, kept."""
    scored = _judged(docs, id_col, text_col, lang_col, least_words, most_repeated, reach, floor)
    return scored.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "kept", "loss", "low", "high", "lang")


def _judged(docs, id_col, text_col, lang_col, least_words, most_repeated, reach, floor):
    work = Work(docs.sparkSession, "quality")
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *_keys(docs[text_col], docs[lang_col]))
    loss = kn.losses(work, src)
    counted = src.mapInArrow(_counted, "id long, lang string, t1 long, t2 long, " + ", ".join(f"{c} long" for c in COUNTS))
    scored = counted.join(loss, ["lang", "t1", "t2"], "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))
    scored = work.save(scored.withColumn("base_failed", F.expr(f"n_words < {least_words} or 100 * n_repeat_words > {most_repeated} * n_words")))
    band = work.save(bands(scored.where("not base_failed"), reach, floor))
    return scored.join(hint(band), "lang", "left").withColumn("kept", F.expr("coalesce(not base_failed and loss between low and high, false)"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = 50, most_repeated: int = 50, reach: float = 5.0, floor: float = 0.05) -> DataFrame:
    """The rows of docs that ``quality`` keeps."""
    judged = _judged(docs, id_col, text_col, lang_col, least_words, most_repeated, reach, floor)
    gone = Work(docs.sparkSession, "quality").save(judged.where("not kept").select(*[F.col(c).alias(f"__{c}") for c in ("lang", "t1", "t2")]).distinct())
    same = [k == gone[f"__{c}"] for k, c in zip(_keys(docs[text_col], docs[lang_col]), ("lang", "t1", "t2"), strict=True)]
    return docs.join(hint(gone), same, "left_anti").select(*docs.columns)
