"""Exact deduplication through recipes of content-defined chunks, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.operators.skew import stage

# A chunk ends after white space between two letters of the middle of the alphabet, about every
# 30 to 100 characters of prose, but not before 400 characters; at most after 4,000.
CHUNK = r"(?s).{400,3999}?(?<=[d-mD-M]\s)(?=[l-tL-T])|.{1,4000}"


def chunks_of(text: Column) -> Column:
    """A text's chunks; their concatenation is the text. Empty: no chunk."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_hash(chunk: Column, bits: int) -> Column:
    hashed = F.xxhash64(chunk)
    return hashed if bits == 64 else F.shiftrightunsigned(hashed, 64 - bits)


def recipes(df: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """``id``, ``text_sha256`` and ``recipe``, the ordered hashes of the chunks of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.sha2(text, 256).alias("text_sha256"),
        F.transform(chunks_of(text), lambda c: chunk_hash(c, bits)).alias("recipe"),
    )


def ambiguous_chunks(df: DataFrame, repeated: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """``h``, ``chunk``, ``nth`` of chunks whose hash also belongs to another chunk.

    Only rows in ``repeated`` (``id``) are read again, and of each chunk one copy leaves a task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("t"))
    again = repeated.select(F.col("id").alias("of")).distinct()
    chunks = (
        rows.join(again, F.col("id").eqNullSafe(F.col("of")), "left_semi")
        .select(F.explode(chunks_of(F.col("t"))).alias("chunk"))
        .select(chunk_hash(F.col("chunk"), bits).alias("h"), "chunk")
        .distinct()
    )
    several = chunks.groupBy("h").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("chunk")).alias("all"))
    return several.where("n > 1").select("h", F.posexplode("all").alias("nth", "chunk"))


def refine(df: DataFrame, known: DataFrame, clashes: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """Add ``marks`` to the recipes: which of the chunks with equal hash each chunk is.

    ``clashes`` has the few chunks whose hash is not theirs alone. A row is read again only if its
    recipe has such a hash; all other rows have no marks.
    """
    hashes = clashes.select("h").distinct()
    touched = (
        known.select(F.col("id").alias("of"), F.explode(F.array_distinct("recipe")).alias("h"))
        .join(hashes, "h", "left_semi")
        .select("of")
        .distinct()
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = (
        df.select(F.col(id_col).cast("bigint").alias("id"), F.sha2(text, 256).alias("text_sha256"), text.alias("t"))
        .join(touched, F.col("id").eqNullSafe(F.col("of")), "left_semi")
        .select("id", "text_sha256", F.posexplode(chunks_of(F.col("t"))).alias("k", "chunk"))
        .withColumn("h", chunk_hash(F.col("chunk"), bits))
        .join(clashes, ["h", "chunk"])
        .groupBy("id", "text_sha256")
        .agg(F.array_sort(F.collect_set(F.struct("k", "nth"))).alias("marks"))
    )
    same = [known[c].eqNullSafe(marks[c]) for c in ("id", "text_sha256")]
    return known.join(marks, reduce(and_, same), "left").select(
        known["id"], known["text_sha256"], "recipe", "marks"
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of every row.

    Rows with the same text, unchanged, are a group; the row with the largest id stays. Null
    text is empty, and empty texts are equal. An id that comes twice with the same text counts
    twice and both rows are ``kept``. A null id stays only if its group has no other. Other
    columns are not read; an empty table gives an empty one.

    A text becomes a recipe: the ordered identifiers of its content-defined chunks. Groups are
    rows with equal recipes, so long texts aren't moved to be compared. A hash of ``bits`` bits
    identifies a chunk once it is verified that no other chunk among the candidates has it;
    candidates are rows whose lists of hashes come more than once. Where a hash does stand for
    several chunks, their order tells them apart.
    """
    known = stage(recipes(df, id_col, text_col, bits))
    sizes = known.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1 AND size(recipe) > 0")
    # Row by row, the list goes with its hash: lists in full are compared only where that agrees.
    key = F.xxhash64("recipe")
    repeated = stage(
        known.select("id", "recipe", key.alias("key"))
        .join(sizes.select(key.alias("key"), "recipe"), ["key", "recipe"], "left_semi")
        .select("id")
    )
    clashes = stage(ambiguous_chunks(df, repeated, id_col, text_col, bits))
    if clashes.isEmpty():
        refined = known.withColumn("marks", F.lit(None).cast("array<struct<k:int,nth:int>>"))
    else:
        refined = stage(refine(df, known, clashes, id_col, text_col, bits))
    refined = refined.withColumn("key", F.xxhash64("recipe", "marks"))
    groups = stage(
        refined.groupBy("key", "recipe", "marks")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    # Both sides are tables, so that a key with a third of all rows is split by the skew join.
    a, b = refined.alias("a"), groups.alias("b")
    same = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.recipe") == F.col("b.recipe"))
        & F.col("a.marks").eqNullSafe(F.col("b.marks"))
    )
    alone = F.col("b.group_size").isNull()
    keep = F.when(alone, F.col("a.id")).otherwise(F.col("b.keep_id"))
    return a.join(b, same, "left").select(
        F.col("a.id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("b.group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("a.id").eqNullSafe(keep).alias("kept"),
        F.col("a.text_sha256").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat an id and a text, one stays.

    Decisions are matched to rows by id and text hash. Null text is empty, a null id is an id like another, and an
    empty table gives an empty one. Rows travel as one struct, so no name of a column is in the way.
    """
    groups = exact_groups(df, id_col, text_col)
    gone = groups.where(~F.col("kept")).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"))
    keyed = df.select(
        F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("own"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text"),
    )
    kept = keyed.join(gone, F.col("own").eqNullSafe(F.col("id")) & (F.col("text") == F.col("sha")), "left_anti")
    doubled = groups.where("kept AND group_size > 1").groupBy(id_col, "text_sha256").count().where("count > 1")
    if doubled.isEmpty():
        return kept.select("row.*")
    twice = doubled.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("text") == F.col("sha"))
    once = kept.join(twice, same, "left_semi").dropDuplicates(["own", "text"])
    return kept.join(twice, same, "left_anti").unionByName(once).select("row.*")
