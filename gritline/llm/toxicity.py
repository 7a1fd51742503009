"""Severity of toxic text: ordered grades that share the weights of sparse text features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritline.llm import ordinal

GRADES = 3  # none, mild, severe
TOXIC_FROM = 0.5
FITTED = {"power": 0.25, "telling": 6.0}


def train(df: DataFrame, labels: DataFrame, per_grade: int = ordinal.SAMPLE) -> ordinal.Model:
    """Fit severity on at most ``per_grade`` labelled documents that are toxic, and as many that aren't.

    Labels say only whether a document is toxic. How severe it is comes from its text: a token that toxic
    documents of the sample have far more often than others marks it, and toxic documents with more such tokens than
    the middle one are the severe grade. So the second threshold learns a count on labelled rows, no model's score. All
    thresholds share the weights of the buckets that tell toxic text from other text.
    """
    graded = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("grade"))
    data = ordinal.sample(df, graded.where("grade IN (0, 1)"), per_grade)
    chosen = ordinal.telling_buckets(data, 2, FITTED["telling"])
    marks = ordinal.marked_tokens(data, chosen)
    toxic = data.grades == 1
    if toxic.any() and not toxic.all():
        data.grades = data.grades + (toxic & (marks > np.median(marks[toxic])))
        data.share = 1 / np.maximum(np.bincount(data.grades), 1)[data.grades]
    return ordinal.train(data, GRADES, **FITTED, among=np.flatnonzero(chosen))


def severity(df: DataFrame, model: ordinal.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``severity`` (expected grade, 0 to 2), ``p_toxic``, ``p_severe`` and ``toxic``.

    Whole texts are scored, one row for each row, repeated ones too. A null or empty text has no
    features: its severity is that of the thresholds alone. Other columns are not read.
    """
    tails = ordinal.predict(df, model, id_col, text_col)
    return tails.select(
        id_col,
        ordinal.expected(F.col("tails")).alias("severity"),
        F.col("tails")[0].alias("p_toxic"),
        F.col("tails")[1].alias("p_severe"),
        (F.col("tails")[0] >= TOXIC_FROM).alias("toxic"),
    )
