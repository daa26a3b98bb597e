"""Report sinks: JSON or Parquet tables, write-once tables, validated artifacts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_report(report: DataFrame, path: str, form: str = "json") -> DataFrame:
    """Write a tidy report with its columns in sorted order and read it back."""
    ordered = report.select(*sorted(report.columns))
    ordered.write.mode("errorifexists").format(form).save(path)
    return ordered.sparkSession.read.schema(ordered.schema).format(form).load(path)


def sink_pack(files: DataFrame, path: str) -> str:
    """Write small text files (path, value) as rows of a pack, which the scans of ``files`` read; its folder.

    A file is one row here; files too large for a row stay loose, where scans read their lines in splits.
    """
    files.select(F.col("path").cast("string"), F.col("value").cast("string")).write.mode("errorifexists").parquet(path)
    return path


def table_digest(df: DataFrame) -> DataFrame:
    """Row count and an order-insensitive digest of a table.

    Each row's digest is cut to 60 bits and summed exactly, so the result needs
    one partial aggregate and does not depend on the order of the rows.
    """
    row = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(bits.alias("_d")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("_d"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS"))


def sink_immutable(df: DataFrame, path: str) -> str:
    """Write once; an equal rewrite is a no-op and a different one is refused."""
    spark = df.sparkSession
    if not _exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
        return "written"
    stored = spark.read.parquet(path)
    same = sorted(stored.columns) == sorted(df.columns) and (
        table_digest(stored).first() == table_digest(df).first()
    )
    if not same:
        raise FileExistsError(f"refusing to change immutable table: {path}")
    return "unchanged"


def complete_artifacts(records: DataFrame, key: Sequence[str], expected: str) -> DataFrame:
    """Artifacts whose every expected record is present and valid.

    ``records(valid, <expected>)``: the expected number rides on each record.
    """
    counts = records.groupBy(*key).agg(
        F.every("valid").alias("_all"), F.count(F.lit(1)).alias("_n"), F.max(expected).alias("_want")
    )
    return counts.filter(F.col("_all") & (F.col("_n") == F.col("_want"))).select(*key)


def _version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and data folder of the newest manifest of a published table; (0, None) if it has none."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(jvm.org.apache.hadoop.fs.Path(target, "manifest-*")) or []
    names = sorted(f.getPath().getName() for f in found)
    if not names:
        return 0, None
    return int(names[-1].removeprefix("manifest-")), spark.read.text(f"{path}/{names[-1]}").first()[0]


def _publish(spark: SparkSession, path: str, number: int, folder: str) -> None:
    """Make a data folder the newest version by moving a finished manifest to its place, which only one writer can."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(target, f"_draft-{folder}")
    final = jvm.org.apache.hadoop.fs.Path(target, f"manifest-{number:010d}")
    out = system.create(draft, False)
    out.writeBytes(folder)
    out.close()
    if system.exists(final) or not system.rename(draft, final):
        raise FileExistsError(f"another writer has published version {number} of {path}")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest published version; folders that no manifest names are never read."""
    _, folder = _version(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{folder}")


def sink_score_atomic(
    records: DataFrame, key: Sequence[str], expected: str, path: str, replace: bool = False
) -> DataFrame:
    """Publish only complete artifacts, all at once.

    Rows go to a folder of their own; a manifest that names it appears last, and readers follow the newest manifest
    (``read_published``). A writer that dies before leaves the published version as it was. A published table
    is refused, or gets a new version with ``replace``. Returns the published rows.
    """
    spark = records.sparkSession
    number, folder = _version(spark, path)
    if folder is not None and not replace:
        raise FileExistsError(f"{path} is published already")
    whole = complete_artifacts(records, key, expected)
    name = f"data-{uuid.uuid4().hex}"
    records.join(whole, list(key), "left_semi").write.mode("errorifexists").parquet(f"{path}/{name}")
    _publish(spark, path, number + 1, name)
    return read_published(spark, path)
