"""Wallet activity as a stream: pairs within a band, and sessions, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_pairs(activity: DataFrame, wallet: str = "wallet", ts: str = "ts", width: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """(wallet_a, wallet_b, ta, tb): two wallets active less than ``width`` apart; a stream-stream join whose state the watermark bounds."""
    a, b = (activity.select(F.col(wallet).alias(f"wallet_{x}"), F.col(ts).alias(f"t{x}")).withWatermark(f"t{x}", late) for x in "ab")
    # buckets make the band an equi-join, as in operators.joins
    bucket = lambda c: F.floor(F.unix_seconds(c) / 60)
    a = a.withColumn("k", bucket(F.col("ta")))
    b = b.withColumn("j", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(F.col("tb")) + d)))
    span = F.expr(f"interval {width}")
    return a.join(b, (F.col("k") == F.col("j")) & (F.col("tb") > F.col("ta") - span) & (F.col("tb") < F.col("ta") + span) & (F.col("wallet_a") < F.col("wallet_b"))).drop("k", "j")


def wallet_windows(activity: DataFrame, wallet: str = "wallet", ts: str = "ts", window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Transactions of each wallet in tumbling windows."""
    return activity.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), wallet).agg(F.count("*").alias("n")).select("w.start", "w.end", wallet, "n")


def wallet_sessions(activity: DataFrame, wallet: str = "wallet", ts: str = "ts", gap: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """Sessions of each wallet's activity."""
    return activity.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), wallet).agg(F.count("*").alias("n")).select("w.start", "w.end", wallet, "n")
