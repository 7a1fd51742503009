"""Scanning saved files as a stream, with the same line and syntax rules as a batch scan.

A save event is (path, version, ts, content). Two uses:

* :func:`scan_saves` appends the findings of every save, as a batch scan gives them.
* :func:`maintain_findings` keeps the findings of the latest version per path. Every batch
  appends the newest version it saw of each path and its findings, in a folder named
  after the batch, so a repeated batch replaces itself. :func:`current_findings` reads the
  newest version per path: a later save replaces an earlier one, a clean save clears the
  path, and a late older version changes nothing. :func:`compact` writes the state so far as
  one snapshot; readers take the last snapshot and the batches after it.

A save that arrives twice in a batch is one save.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gritline.plans.scans import scan_files
from gritline.schemas import FINDING_COLUMNS, FINDINGS
from gritline.sources.files import buffers
from gritline.sources.requests import request_units, validate_requests

VERSIONS = T.StructType([T.StructField("path", T.StringType()), T.StructField("version", T.LongType())])
VERSIONED = T.StructType([T.StructField("version", T.LongType()), *FINDINGS.fields])


def save_units(saves: DataFrame) -> DataFrame:
    """Save events as buffers to scan; the version stands in for the repository."""
    return buffers(saves.select(F.col("version").alias("repo_id"), "path", "content"))


def scan_save_batch(saves: DataFrame) -> DataFrame:
    """Findings of every save event, as (version, findings columns), capped per save."""
    found = scan_files(save_units(saves.dropDuplicates(["path", "version"])))
    return found.withColumn("version", F.col("repo_id")).select("version", *FINDING_COLUMNS)


def scan_saves(saves: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the findings of each arriving save, one folder per batch; runs until the input is used up."""

    def write(df: DataFrame, batch_id: int) -> None:
        scan_save_batch(df).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        saves.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_saves(saves: DataFrame) -> DataFrame:
    """The newest version per path, once; contents stay behind until the versions are known."""
    newest = saves.groupBy("path").agg(F.max("version").alias("version"))
    return saves.join(newest, ["path", "version"], "left_semi").dropDuplicates(["path", "version"])


def _write_batch(saves: DataFrame, batch_id: int, target: str) -> None:
    latest = latest_saves(saves).persist()
    try:
        found = scan_files(save_units(latest)).withColumn("version", F.col("repo_id"))
        found.select("version", *FINDING_COLUMNS).write.mode("overwrite").parquet(
            f"{target}/findings/batch_id={batch_id}"
        )
        # Versions come last: findings without their version are not yet visible.
        latest.select("path", "version").write.mode("overwrite").parquet(f"{target}/versions/batch_id={batch_id}")
    finally:
        latest.unpersist()


def maintain_findings(saves: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the findings of the latest version per path below ``target``."""
    return (
        saves.writeStream.foreachBatch(lambda df, batch_id: _write_batch(df, batch_id, target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _stored(spark: SparkSession, target: str, kind: str, schema: T.StructType) -> DataFrame:
    """Rows of the last snapshot and of the batches after it."""
    last = _last_snapshot(spark, target)
    parts = spark.read.schema(schema.add("batch_id", T.LongType())).option("basePath", f"{target}/{kind}")
    batches = parts.parquet(f"{target}/{kind}/batch_id=*").where(F.col("batch_id") > last).drop("batch_id")
    if last < 0:
        return batches
    return batches.unionByName(spark.read.schema(batches.schema).parquet(f"{target}/snapshots/upto={last}/{kind}"))


def _last_snapshot(spark: SparkSession, target: str) -> int:
    """The last batch that a finished snapshot covers, -1 without one. Its versions are written last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/snapshots/upto=*/versions/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((int(f.getPath().toString().split("/upto=")[-1].split("/")[0]) for f in found), default=-1)


def current_versions(spark: SparkSession, target: str) -> DataFrame:
    stored = _stored(spark, target, "versions", T.StructType(VERSIONS.fields))
    return stored.groupBy("path").agg(F.max("version").alias("version"))


def current_findings(spark: SparkSession, target: str) -> DataFrame:
    """Findings of the newest version of every path."""
    stored = _stored(spark, target, "findings", T.StructType(VERSIONED.fields))
    newest = current_versions(spark, target).withColumnRenamed("path", "file")
    return stored.join(newest, ["file", "version"], "left_semi").dropDuplicates(["file", "version", "emit_seq"])


def compact(spark: SparkSession, target: str) -> None:
    """Write the state so far as a snapshot, from which readers go on.

    Run it between batches. The folders of the batches that it covers may be removed afterwards.
    """
    rows = spark.read.schema("path string, version bigint, batch_id bigint").option("basePath", f"{target}/versions")
    last = rows.parquet(f"{target}/versions/batch_id=*").agg(F.max("batch_id")).first()[0]
    if last is None or last <= _last_snapshot(spark, target):
        return
    folder = f"{target}/snapshots/upto={last}"
    current_findings(spark, target).select("version", *FINDING_COLUMNS).write.mode("overwrite").parquet(f"{folder}/findings")
    current_versions(spark, target).write.mode("overwrite").parquet(f"{folder}/versions")


def scan_requests(requests: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Scan a stream of request bodies: findings of valid ones, and a table of rejects.

    ``requests`` has (repo_id, body); a request id serves as ``repo_id``.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        checked = validate_requests(df)
        units = request_units(checked)
        focus = units.select("repo_id", "path", F.explode("focus_lines").alias("line_no"))
        scan_files(units, focus=focus).write.mode("overwrite").parquet(f"{target}/findings/batch_id={batch_id}")
        rejects = checked.where(F.col("status") != "ok").select("repo_id", "status")
        rejects.write.mode("overwrite").parquet(f"{target}/rejects/batch_id={batch_id}")

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
