"""File sources and the filters that decide which files are scanned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritline.functions import paths as px
from gritline.functions import text as tx
from gritline.operators.skew import gathered, keyed_join, shared_dir, stage
from gritline.vocab import EXTENSION_LANGUAGE, MAX_BYTES


def read_repository(
    spark: SparkSession,
    root: str,
    *,
    repo_id: int = 0,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    max_bytes: int = MAX_BYTES,
    manifest: DataFrame | None = None,
    on_error: str = "row",
) -> DataFrame:
    """Source files below a root folder as (repo_id, path, language, content).

    All filters, on size, name, globs and folders, are settled from the listing, so other files are never opened.
    A file that is listed but can't be read has a null content, from which :func:`read_errors` makes
    its error row. For that, the contents are read once, written to the shared folder, and compared with the
    listing by path. With ``on_error="fail"`` nothing is written, and such a file ends the read.
    """
    if on_error not in ("row", "fail"):
        raise ValueError(f"on_error is row or fail, not {on_error}")

    def chosen(tolerant: str) -> DataFrame:
        raw = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", extension_glob())
            .option("ignoreCorruptFiles", tolerant)
            .option("ignoreMissingFiles", tolerant)
            .load(root)
            .where(F.col("length") <= max_bytes)
        )
        # The path as the listing knows it, so that a filter on it drops files before they are opened.
        listed = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        named = raw.select(
            F.lit(repo_id).cast("bigint").alias("repo_id"), px.relative_to(_plain(listed), _plain_root(root)).alias("path"), "content"
        )
        return select_files(named, include=include, exclude=exclude, manifest=manifest).select(
            "repo_id", "path", "language", tx.decode_source(F.col("content")).alias("content")
        )

    if on_error == "fail":
        return chosen("false")
    listed = chosen("true")
    read = stage(gathered(listed))
    missing = gathered(listed.drop("content")).join(read.select("path"), "path", "left_anti")
    return read.unionByName(missing.withColumn("content", F.lit(None).cast("string")))


def _plain(path: Column) -> Column:
    """A path without its scheme and store."""
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?", ""), "/+", "/")


def _plain_root(root: str) -> str:
    return root.split(":", 1)[-1] if "://" not in root else "/" + root.split("://", 1)[1].split("/", 1)[-1]


BUCKETS = 32


def save_contents(files: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Write files as a table in buckets of (repo_id, path), and read it.

    Diffs, answers and focus lists that name files by these two meet the contents bucket by bucket, so no join moves a
    content again. Choose ``buckets`` so that one holds some hundred megabytes. The table lies in the shared folder, under
    ``name`` in the session's catalogue; one of that name is replaced. Null keys and repeated files stay as they are.
    """
    spark = files.sparkSession
    by = ["repo_id", "path"]
    dealt = files.repartition(buckets, *by)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).option("path", shared_dir(spark))
    writer.saveAsTable(name)
    return spark.table(name)


def extension_glob() -> str:
    """Glob of the file names with a known extension, in any case; others are never opened."""
    ends = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in EXTENSION_LANGUAGE]
    return "*.{" + ",".join(ends) + "}"


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", px.language_for(F.col("path")))


def buffers(files: DataFrame) -> DataFrame:
    """Buffers given directly: own language, then the detected one, then ``text``."""
    given = F.nullif(F.col("language"), F.lit("")) if "language" in files.columns else F.lit(None).cast("string")
    return files.withColumn("language", F.coalesce(given, px.language_for(F.col("path")), F.lit("text")))


def passes_globs(path: Column, include: Sequence[str] | None, exclude: Sequence[str] | None) -> Column:
    keep = px.matches_any(path, include) if include else F.lit(True)
    return keep & ~px.matches_any(path, exclude) if exclude else keep


def select_files(
    files: DataFrame,
    *,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """Supported files that pass the globs and the manifest, or else the directory skip list."""
    known = with_language(files).where(F.col("language").isNotNull())
    known = known.where(passes_globs(F.col("path"), include, exclude))
    if manifest is None:
        return known.where(~px.in_skipped_dir(F.col("path")))
    return tracked(known, manifest)


def tracked(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files named by the manifest table (repo_id, path)."""
    named = manifest.select("repo_id", tx.strip(F.col("path")).alias("path"))
    return files.join(named, ["repo_id", "path"], "left_semi")


def manifest_entries(listing: DataFrame) -> DataFrame:
    """Listing lines to manifest entries: stripped, not empty, each once."""
    return (
        listing.select("repo_id", tx.strip(F.col("path")).alias("path"))
        .where(F.col("path") != "")
        .dropDuplicates(["repo_id", "path"])
    )


def within_size(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    return files.where(F.octet_length("content") <= max_bytes)


def within_policy_size(files: DataFrame, policies: DataFrame) -> DataFrame:
    """Files within the size limit of their repository's policy; without one, the usual limit."""
    limits = policies.select("repo_id", F.col("max_bytes").alias("_max"))
    joined = keyed_join(files, limits, ["repo_id"], ["path"], "left")
    return joined.where(F.octet_length("content") <= F.coalesce("_max", F.lit(MAX_BYTES))).drop("_max")


def first_files(files: DataFrame, max_files: int) -> DataFrame:
    """At most ``max_files`` files per repository, in path order.

    Each task keeps that many per repository before the shuffle.
    """
    in_repo = Window.partitionBy("repo_id").orderBy("path")
    return files.withColumn("_n", F.row_number().over(in_repo)).where(F.col("_n") <= max_files).drop("_n")


def read_errors(files: DataFrame) -> DataFrame:
    """Error rows of files whose content could not be read."""
    return files.where(F.col("content").isNull()).select(
        "repo_id", "path", F.concat(F.col("path"), F.lit(": unreadable")).alias("error")
    )
