"""Writers for findings and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.sources.corpus import scan_files

MANIFEST_FILES = ("file_inventory_and_checksums.csv", "checksums_sha256.txt", "manifest_checksum.txt")


def write_findings(findings: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet, one folder per check, so one check is read without the others."""
    findings.write.mode(mode).partitionBy("check").parquet(path)


def manifest_lines(inventory: DataFrame) -> DataFrame:
    """``hash  path`` per file. The manifest's own files are never listed."""
    own = F.element_at(F.split("file", "/"), -1).isin(*MANIFEST_FILES)
    return inventory.where(~own).select(
        "file", "bytes", F.concat("sha256", F.lit("  "), F.col("file")).alias("line")
    )


def write_manifest(inventory: DataFrame, folder: str) -> DataFrame:
    """Inventory CSV and checksum lines in path order; returns the digest of each written part."""
    folder = folder.rstrip("/")
    lines = manifest_lines(inventory)
    inventory.orderBy("file").write.csv(f"{folder}/{MANIFEST_FILES[0]}", header=True)
    lines.orderBy("file").select("line").write.text(f"{folder}/{MANIFEST_FILES[1]}")
    digest = scan_files(inventory.sparkSession, folder, "part-*").select("file", "sha256")
    digest.orderBy("file").select(F.concat("sha256", F.lit("  "), F.col("file"))).write.text(f"{folder}/{MANIFEST_FILES[2]}")
    return digest


def verify_manifest(now: DataFrame, before: DataFrame) -> DataFrame:
    """Per file OK, FAILED, missing or unlisted."""
    a = now.select("file", F.col("sha256").alias("now_sha"))
    b = before.select("file", F.col("sha256").alias("before_sha"))
    status = (
        F.when(F.col("now_sha").isNull(), "missing")
        .when(F.col("before_sha").isNull(), "unlisted")
        .when(F.col("now_sha") == F.col("before_sha"), "OK")
        .otherwise("FAILED")
    )
    return a.join(b, "file", "full_outer").select("file", status.alias("status"))
