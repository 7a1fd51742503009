"""Group operators that stay balanced when one group holds much of the data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 16
FEW = 20_000  # rows of a table that every task may hold


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``, or below the warehouse if there is none.

    All executors share either of them. A warehouse on a local disk is only shared in local mode, so
    elsewhere it is refused. Inside ``scratch`` the folder is below that one.
    """
    root = _scratch.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        local = spark.sparkContext.master.startswith("local")
        if not local and (warehouse.startswith("file:") or "://" not in warehouse and not _has_file_system(spark)):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{warehouse}/_staged"
    return f"{root.rstrip('/')}/gritline-{uuid.uuid4().hex}"


def _has_file_system(spark: SparkSession) -> bool:
    """Whether paths without a scheme are on a shared store."""
    return not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")


def make_dir(spark: SparkSession, folder: str) -> None:
    """Make a folder on whatever store it is, so that it can be read even if no file comes into it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete what is staged inside, at the end; gives a ``stage`` for the result, which stays."""
    before, folder = _scratch.get(), shared_dir(spark)

    def result(df: DataFrame) -> DataFrame:
        inside = _scratch.set(before)
        try:
            return stage(df)
        finally:
            _scratch.reset(inside)

    token = _scratch.set(folder)
    try:
        yield result
    finally:
        _scratch.reset(token)
        delete(spark, folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal narrow rows that are about to grow, or to cost much time each, over all tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def gathered(df: DataFrame) -> DataFrame:
    """Read many small files in as many tasks as the session shuffles to; nothing is moved.

    Spark makes a task of a few files, however small they are, so a folder of a million would start a hundred thousand.
    """
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def stage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder once and read it from there; ``compression`` is the session's unless given."""
    folder = shared_dir(df.sparkSession)
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stage_each(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """Write tables of one schema, at least one, to the same staged table one after the other, and read it.

    Whatever is staged while a part is made and written is deleted before the next is asked for, so the shared folder
    holds one part's at a time. A part of many small partitions gives few files.
    """
    folder, rest = shared_dir(spark), iter(parts)
    schema = None
    while True:
        with scratch(spark):
            part = next(rest, None)
            if part is None:
                return spark.read.schema(schema).parquet(folder)
            schema = part.schema
            part.hint("rebalance").write.mode("append").parquet(folder)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on an ordinary new column is moved below it and repeats its expression, which
    is costly when the expression parses text. A generated column stops that.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def position_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of every row in its group, without one task per group.

    Rows are range-partitioned on group and order, so a large group spreads over
    many tasks. Its position is the local offset plus the rows of the group in the
    partitions before. The sorted rows are written once, because partition
    numbers must not change between the two reads of them.
    """
    keys = [F.col(c) for c in group]
    ordered = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    placed = stage(ordered).withColumn("_part", F.shiftright("_seq", 33))
    spans = placed.groupBy(*group, "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    spans = spans.drop("_n").withColumnsRenamed({c: f"_of_{c}" for c in (*group, "_part")})
    # Null is a group like any other.
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, "_part")])
    joined = placed.join(spans, same)
    position = F.col("_seq") - F.col("_first") + F.col("_before") + 1
    return joined.withColumn(name, position).select(*df.columns, name)


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], salt: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi join that splits each key of ``big`` into ``salts`` keys.

    ``small`` has one row per key and is repeated once per salt, so a key with a
    third of all rows is joined by ``salts`` tasks.
    """
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def apart(df: DataFrame) -> DataFrame:
    """A side that grows with the input: a join with it moves both sides and never sends it to every task.

    Left alone, the planner would go by the size of the compressed files below, or of the rows before they are repeated.
    """
    return df.hint("merge")


def counted(staged: DataFrame) -> DataFrame:
    """A staged table for the right of a join: it goes to every task if it has few rows, else both sides are moved."""
    return F.broadcast(staged) if staged.count() <= FEW else apart(staged)


def keyed_join(big: DataFrame, small: DataFrame, on: Sequence[str], salt: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join with a table of one row per key that may hold few keys or millions.

    ``small`` is written down and counted. A few rows go to every task, so ``big`` stays where it is; more are
    met by :func:`salted_join`, without being collected.
    """
    known = stage(small)
    if known.count() <= FEW:
        return big.join(F.broadcast(known), on, how)
    return salted_join(big, apart(known), on, salt, how)
