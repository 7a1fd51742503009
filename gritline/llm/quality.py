"""Quality of documents: graded ratings, ordered thresholds, selection by the tail probability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritline.llm import ordinal

GRADES = 3  # poor, sound but toxic, sound
SELECT_FROM = 0.5


def ratings(labels: DataFrame) -> DataFrame:
    """``id`` and ``grade``: 0 for poor text, 1 for sound text that is toxic, 2 for sound text.

    A label without a quality has no grade; one without a toxicity counts as not toxic.
    """
    toxic = F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    grade = F.when(F.col("quality").cast("int") == 0, 0).when(F.col("quality").cast("int") == 1, 2 - toxic)
    return labels.select(F.col("doc_id").cast("bigint").alias("id"), grade.cast("int").alias("grade"))


def train(df: DataFrame, labels: DataFrame, per_grade: int = ordinal.SAMPLE) -> ordinal.Model:
    """Fit the ratings of at most ``per_grade`` labelled documents of each grade.

    Without any label the model rates all documents as sound, so that none is rejected.
    """
    return ordinal.train(ordinal.sample(df, ratings(labels), per_grade), GRADES, power=0.75, telling=8.0)


def quality(df: DataFrame, model: ordinal.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``expected_grade`` (0 to 2), ``tail_probability`` (grade 1 or 2) and ``selected``.

    Whole texts are scored, one row for each row, repeated ones too. A null or empty text has no
    features: its grade is that of the thresholds alone. Other columns are not read.
    """
    tails = ordinal.predict(df, model, id_col, text_col)
    return tails.select(
        id_col,
        ordinal.expected(F.col("tails")).alias("expected_grade"),
        F.col("tails")[0].alias("tail_probability"),
        (F.col("tails")[0] >= SELECT_FROM).alias("selected"),
    )


def drop_poor(df: DataFrame, model: ordinal.Model, text_col: str = "text") -> DataFrame:
    """The rows that are selected, with all their columns; see ``ordinal.keep_rows`` for nulls, repeats and empty tables."""
    return ordinal.keep_rows(df, model, SELECT_FROM, text_col)
