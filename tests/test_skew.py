"""Operators that must give the same rows whether or not a group is hot."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gritline.operators import findings, policy, skew
from gritline.plans import scans
from gritline.sinks import documents
from gritline.sources import responses as rs
from gritline.sources.files import within_policy_size

LAYERS = {
    **{f"{layer}_fail_on": "string" for layer in ("file", "env", "flag")},
    **{f"{layer}_{name}": kind for layer in ("file", "flag") for name, kind in (
        ("min_confidence", "double"), ("max_bytes", "bigint"), ("include", "array<string>"), ("exclude", "array<string>"),
        ("model", "string"), ("max_tokens", "int"), ("max_workers", "int"), ("no_ai", "boolean"),
    )},
    "env_model": "string",
    "env_no_ai": "string",
}


def sample(spark):
    """One group with two thirds of the rows, and many small ones."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, F.lit(7).cast("bigint")).otherwise(F.col("id")).alias("g"),
        (F.col("id") * 7919 % 3001).alias("v"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_positions_equal_the_window(spark):
    df = sample(spark)
    for order in (F.col("v"), F.col("v").desc()):
        want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(order)).cast("bigint"))
        assert rows(skew.position_in_group(df, ["g"], [order], "n")) == rows(want)


def test_position_uses_many_tasks(spark):
    placed = skew.position_in_group(sample(spark).repartition(8), ["g"], [F.col("v")], "n")
    assert placed.agg(F.max("n")).first()[0] == 2000


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (2, 5)], "g long, v long")
    got = skew.position_in_group(df, ["g"], [F.col("v")], "n").collect()
    assert {(r["g"], r["v"]): r["n"] for r in got} == {(None, 1): 1, (None, 3): 2, (2, 5): 1}


def test_salted_join(spark):
    df = sample(spark)
    small = df.select("g").distinct().where("g % 2 = 1").withColumn("w", F.col("g") * 2)
    for how in ("inner", "left"):
        assert rows(skew.salted_join(df, small, ["g"], ["v"], how).na.fill(-1)) == rows(df.join(small, "g", how).na.fill(-1))


def test_once_is_not_repeated_by_a_filter(spark):
    df = skew.once(sample(spark), {"d": F.regexp_replace(F.col("v").cast("string"), "1", "2")})
    plan = df.where(F.col("d") != "2")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_shared_dir_comes_from_the_session(spark):
    folder = skew.shared_dir(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert folder != skew.shared_dir(spark)


def joins(df):
    """The joins that Spark plans for a table, before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {name for name in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin") if name in plan}


def test_keyed_join_counts_the_keys(spark):
    df = sample(spark)
    for keys, plan in ((3000, "BroadcastHashJoin"), (skew.FEW + 1, "SortMergeJoin")):
        small = skew.stage(spark.range(keys).select(F.col("id").alias("g"), F.lit(1).alias("w")).where("g % 2 = 1 OR g > 3000"))
        small = small.union(small.where("g = 7"))
        for how in ("inner", "left"):
            got = skew.keyed_join(df, small, ["g"], ["v"], how)
            assert rows(got.na.fill(-1)) == rows(df.join(small, "g", how).na.fill(-1))
        many = skew.keyed_join(df, spark.range(keys).withColumnRenamed("id", "g"), ["g"], ["v"])
        assert joins(many) == {plan}


def test_many_policies_are_not_sent_to_all_tasks(spark):
    ids = spark.range(skew.FEW + 1).withColumnRenamed("id", "repo_id")
    layers = skew.stage(ids.select("repo_id", *[F.lit(None).cast(kind).alias(name) for name, kind in LAYERS.items()]))
    policies = policy.resolve_policies(layers, layers)
    assert joins(policies) == {"SortMergeJoin"}
    files = ids.select("repo_id", F.lit("src/a.py").alias("path"), F.lit("x").alias("content"))
    found = ids.select("repo_id", F.lit("a.py").alias("file"), F.lit(1).alias("line"), F.lit(0.5).alias("confidence"))
    for kept in (
        policy.filter_by_policy(files, policies), within_policy_size(files, policies), findings.policy_confidence(found, policies)
    ):
        assert joins(kept) == {"SortMergeJoin"}
        assert kept.count() == skew.FEW + 1


def many_reports(spark):
    """A finding, a path and an error for each of many scans."""
    ids = spark.range(skew.FEW + 2).withColumnRenamed("id", "repo_id")
    found = ids.select(
        "repo_id", F.lit("a.py").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("end_line"), F.lit("high").alias("severity"),
        *[F.lit(name).alias(name) for name in ("category", "title", "description", "suggestion", "rule_id", "source", "code")],
        F.lit(0.5).alias("confidence"), F.lit(0).cast("bigint").alias("emit_seq"),
    )
    paths = ids.withColumn("path", F.lit("a.py"))
    return skew.stage(found), skew.stage(paths), skew.stage(paths.withColumn("error", F.lit("e")))


def test_many_scans_are_not_sent_to_all_tasks(spark):
    found, paths, errors = many_reports(spark)
    headers = scans.scan_headers(paths, found, errors)
    assert joins(headers) == {"SortMergeJoin"}
    for kind, each in (("json", 7), ("markdown", 4), ("sarif", 5)):
        parts = documents.report_parts(kind, headers, found, paths, errors)
        assert joins(parts) == {"SortMergeJoin"}
        assert parts.count() == each * (skew.FEW + 2)
        assert parts.where("body LIKE ',%'").isEmpty()
    assert joins(documents.file_reports(paths, found)) == {"SortMergeJoin"}


def test_many_files_without_answer_are_not_sent_to_all_tasks(spark):
    _, paths, _ = many_reports(spark)
    files = skew.stage(paths.withColumn("content", F.lit("x")))
    parsed = rs.parse_responses(skew.stage(paths.select("repo_id", "path", (F.col("repo_id") == 1).alias("ok"), F.lit('{"findings":[]}').alias("payload"))))
    for some, plan in ((files, "SortMergeJoin"), (files.where("repo_id < 9"), "BroadcastHashJoin")):
        missing = rs.without_response(some, parsed)
        assert joins(missing) == {plan}
        assert missing.count() == some.count() - 1
