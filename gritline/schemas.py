"""Explicit schemas; nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("content", T.StringType()),
])

FOCUS_LINES = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("line_no", T.IntegerType()),
])

FINDINGS = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("suggestion", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("emit_seq", T.LongType()),
])
FINDING_COLUMNS = FINDINGS.fieldNames()

# One row per syntax node a rule looks at; children are nested in their node, so
# parent-child conditions need no shuffle.
SYNTAX_FACTS = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("walk_seq", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("code", T.StringType()),
    T.StructField("has_type", T.BooleanType()),
    T.StructField("children", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("code", T.StringType()),
    ]))),
])

POLICY_LAYERS = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("file_fail_on", T.StringType()),
    T.StructField("env_fail_on", T.StringType()),
    T.StructField("flag_fail_on", T.StringType()),
    T.StructField("file_min_confidence", T.DoubleType()),
    T.StructField("flag_min_confidence", T.DoubleType()),
    T.StructField("file_max_bytes", T.LongType()),
    T.StructField("flag_max_bytes", T.LongType()),
    T.StructField("file_include", T.ArrayType(T.StringType())),
    T.StructField("flag_include", T.ArrayType(T.StringType())),
    T.StructField("file_exclude", T.ArrayType(T.StringType())),
    T.StructField("flag_exclude", T.ArrayType(T.StringType())),
    T.StructField("file_model", T.StringType()),
    T.StructField("env_model", T.StringType()),
    T.StructField("flag_model", T.StringType()),
    T.StructField("file_max_tokens", T.IntegerType()),
    T.StructField("flag_max_tokens", T.IntegerType()),
    T.StructField("file_max_workers", T.IntegerType()),
    T.StructField("flag_max_workers", T.IntegerType()),
    T.StructField("file_no_ai", T.BooleanType()),
    T.StructField("env_no_ai", T.StringType()),
    T.StructField("flag_no_ai", T.BooleanType()),
])
