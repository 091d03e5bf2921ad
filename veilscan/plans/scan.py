"""What users run: analyse sources, scan a ledger, verify findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscan.operators import ledger, report, static, verify
from veilscan.session import ship
from veilscan.sources.files import source_files


def analyze(spark: SparkSession, root: str, detectors: list[str] | None = None, severity: str = "INFO", confidence: int = 0, marker: str = "privacy-ignore") -> tuple[DataFrame, DataFrame]:
    """(findings, grade) of the sources below root; the grade is of all findings, before the filter."""
    ship(spark)
    found = static.scan(source_files(spark, root), detectors, marker)
    return report.at_least(found, severity, confidence), report.grade(found)


def scan_ledger(tx: DataFrame, assets: DataFrame, metadata: DataFrame, program: str) -> DataFrame:
    """Findings of a program's transactions, assets and token metadata, merged by rule and title."""
    from pyspark.sql import functions as F

    parts = [ledger.raw_log_findings(tx), ledger.instruction_findings(tx), ledger.asset_findings(assets), ledger.metadata_findings(metadata)]
    if program not in static.vocab.SYSTEM_PROGRAMS:
        ends = ledger.transfer_ends(tx)
        parts += [ledger.many_wallets_findings(tx), ledger.large_transfer_findings(tx), ledger.cluster_finding(ledger.cluster_pairs(ends), program)]
    found = report.union(parts).withColumn("_o", F.concat_ws("|", "file", "line", "code_snippet"))
    return report.aggregate_findings(found, "_o")


def verify_findings(findings: DataFrame, *evidence: DataFrame) -> DataFrame:
    """Findings, each once, with confidence confirmed or discounted by ledger evidence."""
    return verify.confirmed(verify.verify(findings, report.union(list(evidence))))
