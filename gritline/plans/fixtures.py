"""Tables of code, diffs, responses and saves, derived from the given tables.

The SQL expressions in this module run in Spark and in DuckDB alike, so that the
queries and their SQL counterparts start from the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritline.functions import paths as px
from gritline.operators.lines import fold_lines
from gritline.operators.skew import delete, make_dir, shared_dir, spread
from gritline.sinks.folders import write_files

N_REPOS = 40

# --- F1: order lines as source lines, one file per order --------------------------------
PATH_SQL = """case l_orderkey % 7 when 0 then 'src/' when 1 then 'src/app/' when 2 then 'lib/' when 3 then 'vendor/'
  when 4 then 'web/vendor/x/' when 5 then 'node_modules/p/' else 'tests/' end
 || 'm' || cast(l_orderkey as string) ||
 case l_orderkey % 9 when 0 then '.py' when 1 then '.js' when 2 then '.ts' when 3 then '.go' when 4 then '.PY'
  when 5 then '.min.js' when 6 then '.sql' when 7 then '.txt' else '' end"""

TEXT_SQL = """case l_partkey % 18
  when 0 then 'key_id = "AKIA' || lpad(cast(l_partkey as string),16,'0') || '"'
  when 1 then '-----BEGIN RSA PRIVATE KEY-----'
  when 2 then 'db_password = "s3cr3t-' || cast(l_partkey as string) || '"'
  when 3 then 'API_KEY = "your-api-key-here"'
  when 4 then '    return eval(x_' || cast(l_suppkey as string) || ')'
  when 5 then 'h = hashlib.md5(b_' || cast(l_suppkey as string) || ')'
  when 6 then 'el.innerHTML = v' || cast(l_suppkey as string)
  when 7 then 'document.write(v' || cast(l_suppkey as string) || ')'
  when 8 then '  console.log(v' || cast(l_suppkey as string) || ')'
  when 9 then '  var x' || cast(l_suppkey as string) || ' = 1'
  when 10 then '# TODO handle ' || cast(l_suppkey as string)
  when 11 then 'my.console.log(1)'
  when 12 then 'auth_token: "xxXX..**"'
  when 13 then 'password = "example1"; client_secret = "realvalue99"'
  when 14 then 'evaluate(x)'
  when 15 then ''
  when 16 then '  var t = eval(s) // FIXME'
  else 'x = ' || cast(l_suppkey as string) end"""

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")

# --- F3: one response item per line ------------------------------------------------------
ITEM_SQL = """case l_partkey % 10
  when 0 then '{"line":' || cast(line_no as string) || ',"severity":"high","category":"bug","title":"T0","description":"d","suggestion":"s","confidence":0.9}'
  when 1 then '{"line":' || cast(line_no as string) || ',"severity":" HIGH ","category":"bug","title":" T1 ","description":"d","suggestion":"","confidence":1.5}'
  when 2 then '{"line":' || cast(line_no as string) || ',"severity":"urgent","category":"style","title":"T2","confidence":"0.25"}'
  when 3 then '{"line":' || cast(line_no as string) || ',"severity":"low","title":"T3","description":null,"confidence":-1}'
  when 4 then '{"line":' || cast(line_no as string) || ',"severity":"info","category":"Security","title":"T4","confidence":null}'
  when 5 then '{"line":' || cast(line_no as string) || ',"severity":"info","category":"docs","title":""}'
  when 6 then '{"line":"1","severity":"critical","category":"performance","title":"T6","confidence":"1d"}'
  when 7 then '{"line":9999,"severity":"medium","category":"testing","title":"T7","end_line":10000}'
  when 8 then '{"line":' || cast(line_no as string) || ',"end_line":-3,"severity":"medium","category":"complexity","title":"T8"}'
  else '{"line":1.75,"end_line":"2","severity":"low","category":"nonsense","title":"T9","confidence":0.5}' end"""

# --- F6: one Python module per order ------------------------------------------------------
MODULE_SQL = """case o_orderkey % 6
  when 0 then 'def f(a, b=[], *, c={}):' || chr(10) || '    return a' || chr(10)
  when 1 then 'try:' || chr(10) || '    pass' || chr(10) || 'except:' || chr(10) || '    pass' || chr(10)
  when 2 then 'try:' || chr(10) || '    pass' || chr(10) || 'except ValueError:' || chr(10) || '    pass' || chr(10)
  when 3 then 'def g(x):' || chr(10) || '    return x == None' || chr(10)
  when 4 then 'def h(x):' || chr(10) || '    return None == x' || chr(10)
  else 'def long_' || cast(o_orderkey as string) || '():' || chr(10) || repeat('    y = 1' || chr(10), 80) end"""

# --- F7: events as saved files ------------------------------------------------------------
SAVE_PATH_SQL = "'u' || cast(user_id as string) || '/' || event_type || '.js'"
SAVE_SQL = """case event_id % 4
  when 0 then 'eval(x)' || chr(10) || 'var a = 1' || chr(10)
  when 1 then 'console.log(' || cast(event_id as string) || ')'
  when 2 then 'let ok = 1' || chr(10)
  else '// TODO' || chr(10) || 'document.write(x)' || chr(10) || 'el.innerHTML = y' end"""
BODY_SQL = """case event_id % 6
  when 0 then '{"path":"u' || cast(user_id as string) || '.js","content":"var a = 1"}'
  when 1 then '{"path":"a.js","content":"eval(x)","focus_lines":[1,1]}'
  when 2 then '{"path":"a.js","content":"eval(x)","focus_lines":[]}'
  when 3 then '{"path":"a.js"}'
  when 4 then '{"content":null}'
  else '{"content": ' || cast(event_id as string) end"""

# --- F8: settings of every customer's repository ---------------------------------------------
SEGMENT_SQL = """case c_mktsegment when 'BUILDING' then null when 'MACHINERY' then 'severe' when 'AUTOMOBILE' then 'none'
  when 'FURNITURE' then ' Critical ' else 'low' end"""
ENV_SQL = "case c_nationkey % 5 when 0 then 'medium' when 1 then '' when 2 then 'bogus' else null end"
FLAG_SQL = "case c_nationkey % 7 when 0 then 'none' when 1 then 'info' else null end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with the part key, numbered per file.

    Paths and texts are made after the shuffle that numbers the lines: only keys travel.
    """
    keys = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER), "l_orderkey")
    order = [F.col(c) for c in LINE_ORDER]
    # An order stands for a file, and a file's lines are numbered in one task, as its text is one value.
    numbered = keys.withColumn("line_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    return numbered.select(
        F.col("l_orderkey").alias("file_id"),
        (F.col("l_orderkey") % N_REPOS).alias("repo_id"),
        F.expr(PATH_SQL).alias("path"),
        F.col("line_no").cast("int").alias("line_no"),
        "l_partkey",
        F.expr(TEXT_SQL).alias("text"),
    )


def code_lines(spark: SparkSession, sf_dir: str, *, known: bool = True) -> DataFrame:
    """file_id, repo_id, path, language, line_no, text; by default of known languages."""
    lines = raw_lines(spark, sf_dir).drop("l_partkey").withColumn("language", px.language_for(F.col("path")))
    return lines.where(F.col("language").isNotNull()) if known else lines


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of F1 without their lines: file_id, repo_id, path, language."""
    orders = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return orders.select(
        F.col("l_orderkey").alias("file_id"),
        (F.col("l_orderkey") % N_REPOS).alias("repo_id"),
        F.expr(PATH_SQL).alias("path"),
    ).withColumn("language", px.language_for(F.col("path")))


def code_files(spark: SparkSession, sf_dir: str, *, known: bool = True) -> DataFrame:
    """file_id, repo_id, path, language, content."""
    return fold_lines(code_lines(spark, sf_dir, known=known), ["file_id", "repo_id", "path", "language"])


UNREADABLE = 17  # of so many files, the checksum of one is wrong
FOLDER_FILES = 50_000  # a folder has about so many files, each of which takes a block of the disk at least


def code_folders(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    """F4 as files of shared folders, below the number of their repository; some of them can't be read.

    The files are dealt to folders by their paths. A folder is deleted when the next one is asked for, so the disk holds
    one at a time, however many files there are.
    """
    n_files = file_list(spark, sf_dir).where(F.col("language").isNotNull()).count()
    n_folders = max(1, -(-n_files // FOLDER_FILES))
    files = code_files(spark, sf_dir).select(
        F.concat_ws("/", F.col("repo_id").cast("string"), "path").alias("path"), "content",
        F.when(F.col("file_id") % UNREADABLE == 3, F.unhex(F.lit("63726300000002000000000000"))).alias("wrong"),
    ).withColumn("folder", F.pmod(F.xxhash64("path"), F.lit(n_folders)).cast("int"))
    kept = shared_dir(spark)
    files.repartition(n_folders, "folder").write.partitionBy("folder").parquet(kept)
    dealt = spark.read.schema(files.schema).parquet(kept)

    def written() -> Iterator[str]:
        for k in range(n_folders):
            folder = shared_dir(spark)
            make_dir(spark, folder)
            try:
                write_files(spread(dealt.where(F.col("folder") == k)), folder, "wrong")
                yield folder
            finally:
                delete(spark, folder)
        delete(spark, kept)

    return written()


# A diff covers the files of a repository among 400 consecutive orders, ten at most, and
# 1000 lines of each; longer files continue in the next part. No diff grows beyond that.
DIFF_SPAN = 400
DIFF_LINES = 1000


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zero-context diffs: repo_id, diff_id, part, diff_text. One file in five is deleted."""
    deleted = F.col("file_id") % 5 == 0
    hunks = (
        raw_lines(spark, sf_dir)
        .groupBy("repo_id", "file_id", "path", F.floor((F.col("line_no") - 1) / DIFF_LINES).cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("lines"))
        .withColumn("n", F.size("lines").cast("string"))
    )
    start = (F.col("file_id") % 50 + 1 + F.col("part") * DIFF_LINES).cast("string")
    gone = F.concat(F.lit("\n+++ /dev/null\n@@ -1,"), F.col("n"), F.lit(" +0,0 @@\n"))
    new = F.concat(F.lit("\n+++ b/"), F.col("path"), F.lit("\n@@ -0,0 +"), start, F.lit(","), F.col("n"), F.lit(" @@\n"))
    sign = F.when(deleted, "-").otherwise("+")
    body = F.array_join(F.transform(F.col("lines.text"), lambda x: F.concat(sign, x)), "\n")
    block = F.concat(F.lit("--- a/"), F.col("path"), F.when(deleted, gone).otherwise(new), body)
    diff_id = F.floor(F.col("file_id") / DIFF_SPAN).cast("bigint")
    return (
        hunks.select("repo_id", diff_id.alias("diff_id"), "part", "file_id", block.alias("block"))
        .groupBy("repo_id", "diff_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("file_id", "block"))).alias("blocks"))
        .select(
            "repo_id", "diff_id", "part", F.concat(F.array_join(F.col("blocks.block"), "\n"), F.lit("\n")).alias("diff_text")
        )
    )


def diff_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of F2's diffs as rows: repo_id, diff_id, part, file_id, at (place in the file's part), text."""
    # A file's lines are in one task and in order, so they are counted there and bring the headers along.
    part = F.floor((F.col("line_no") - 1) / DIFF_LINES).cast("int")
    lines = raw_lines(spark, sf_dir).withColumns(
        {
            "part": part,
            "diff_id": F.floor(F.col("file_id") / DIFF_SPAN).cast("bigint"),
            "n": F.least(F.lit(DIFF_LINES), F.count("*").over(Window.partitionBy("file_id")) - part * DIFF_LINES).cast("string"),
        }
    )
    deleted = F.col("file_id") % 5 == 0
    start = (F.col("file_id") % 50 + 1 + F.col("part") * DIFF_LINES).cast("string")
    target = F.when(deleted, "/dev/null").otherwise(F.concat(F.lit("b/"), F.col("path")))
    hunk = F.when(deleted, F.concat(F.lit("@@ -1,"), F.col("n"), F.lit(" +0,0 @@"))).otherwise(
        F.concat(F.lit("@@ -0,0 +"), start, F.lit(","), F.col("n"), F.lit(" @@"))
    )
    body = F.concat(F.when(deleted, "-").otherwise("+"), F.col("text"))
    texts = [F.concat(F.lit("--- a/"), F.col("path")), F.concat(F.lit("+++ "), target), hunk, body]
    places = [F.lit(0), F.lit(1), F.lit(2), F.col("line_no") + 2]
    rows = [F.struct(at.cast("bigint").alias("at"), text.alias("text")) for at, text in zip(places, texts)]
    first = (F.col("line_no") - 1) % DIFF_LINES == 0
    return lines.select(
        "repo_id", "diff_id", "part", "file_id", F.inline(F.when(first, F.array(*rows)).otherwise(F.array(rows[-1])))
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, ok, payload; one message per file, every eleventh call failed."""
    lines = raw_lines(spark, sf_dir).withColumn("text", F.expr(ITEM_SQL))
    items = fold_lines(lines, ["file_id", "repo_id", "path"], sep=",")
    head = '{"content":[{"type":"text","text":"ok"},{"type":"tool_use","name":"report_findings","input":{"findings":['
    return items.select(
        "repo_id",
        "path",
        (F.col("file_id") % 11 != 0).alias("ok"),
        F.concat(F.lit(head), F.col("content"), F.lit(']}},{"type":"tool_use","name":"report_findings","input":{}}]}')).alias("payload"),
    )


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inline scripts of every page, one JavaScript file each."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(bodies).alias("n", "content")).select(
        F.col("page_id").alias("repo_id"),
        F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit("-"), F.col("n").cast("string"), F.lit(".js")).alias("path"),
        F.lit("javascript").alias("language"),
        "content",
    )


def py_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one Python module per order."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return orders.select(
        (F.col("o_orderkey") % N_REPOS).alias("repo_id"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"),
        F.lit("python").alias("language"),
        F.expr(MODULE_SQL).alias("content"),
    )


# Python files whose lines and syntax both break rules; the last kind has more findings than the cap.
MIXED_SQL = """case o_orderkey % 3
  when 0 then 'def f(a, b=[]):' || chr(10) || '    # TODO x' || chr(10) || '    return eval(a)' || chr(10)
  when 1 then 'try:' || chr(10) || '    exec(x)' || chr(10) || 'except:' || chr(10) || '    pass' || chr(10)
  else repeat('# TODO n' || chr(10), 100) || 'def g(a={}):' || chr(10) || '    return a' || chr(10) end"""


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return py_files(spark, sf_dir).withColumn("content", F.expr(MIXED_SQL.replace("o_orderkey", "cast(substring(path, 2, length(path) - 4) as bigint)")))


# Number, id, pattern, severity, category, title, description, suggestion, confidence, languages, value group.
USER_RULES = [
    (0, "own/0", r'token = "[0-9a-fA-F]{40}"', "critical", "security", "Token", "", "", 0.9, None, None),
    (7, "own/7", r"Licensed under the [A-Z]", "info", "docs", "License line", "", "", 0.9, ["text"], 0),
    (2048, "own/2048", r"(?:^|[^0-9])[0-9]{16}(?:[^0-9]|$)", "high", "security", "Long number", "", "", 0.5, ["text", "html"], None),
    (2049, "own/2049", r"(?i)<h[1-6][ >]", "low", "style", "Heading", "", "", 0.5, ["html"], None),
    (2050, "own/2050", r"@mail[0-9]\.example\.com", "medium", "security", "Address", "", "", 0.5, [], None),
]


# Four shapes of rules on a word, by the word's place; the last two rules have no text that all matches hold.
WORD_RULES = (
    r"(?:^|[^A-Za-z]){}(?:[^A-Za-z]|$)",
    r"(?i)(?:^|[^A-Za-z]){}[.,]",
    r"(?:^|[^A-Za-z])(?:{0}|zz{0}), ",
    r"(?:^|[^A-Za-z]){}\.$",
)
BARE_RULES = [
    (5000, "own/5000", r"[0-9]{6}", "low", "style", "Digits", "", "", 0.5, None, None),
    (5001, "own/5001", r"<[a-z][a-z0-9]?>", "low", "style", "Tag", "", "", 0.5, ["html"], None),
]


def word_rules(spark: SparkSession, sf_dir: str, count: int = 2000) -> DataFrame:
    """Rules on the commonest words of all documents, as a rule table."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), 0)).alias("word"))
    common = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(count)
    rows = [
        (k, f"own/{k}", WORD_RULES[k % 4].format(r["word"]), "low", "style", f"Word {k}", "", "", 0.5, ["text"] if k % 3 == 0 else None, None)
        for k, r in enumerate(common.collect())
    ]
    return spark.createDataFrame(rows + BARE_RULES, "rule_idx int, rule_id string, pattern string, severity string, category string, "
        "title string, description string, suggestion string, confidence double, languages array<string>, value_group int")  # fmt: skip


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (1), conversations (2) and pages (3) as files: repo_id, path, language, content."""
    turn = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parts = [
        (1, "documents", F.col("doc_id").cast("string"), "text", "text"),
        (2, "conversations", turn, "text", "text"),
        (3, "pages", F.col("page_id").cast("string"), "html", "html"),
    ]
    frames = [
        table(spark, sf_dir, name).select(
            F.lit(number).cast("bigint").alias("repo_id"), path.alias("path"), F.lit(language).alias("language"),
            F.col(column).alias("content"),
        )
        for number, name, path, column, language in parts
    ]
    return reduce(DataFrame.unionByName, frames)


def save_columns(events: DataFrame) -> DataFrame:
    """F7 rows from events, batch or stream: path, version, ts, content."""
    return events.select(
        F.expr(SAVE_PATH_SQL).alias("path"), F.col("event_id").alias("version"), "ts", F.expr(SAVE_SQL).alias("content")
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, be it one file or a folder, as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")


def save_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 as a stream."""
    return save_columns(event_stream(spark, sf_dir))


def policy_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: settings layers, one row per customer as a repository."""
    null_text = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("repo_id"),
        F.expr(SEGMENT_SQL).alias("file_fail_on"),
        F.expr(ENV_SQL).alias("env_fail_on"),
        F.expr(FLAG_SQL).alias("flag_fail_on"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(0.6)).alias("file_min_confidence"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(0.75)).alias("flag_min_confidence"),
        F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") - 100).alias("file_max_bytes"),
        F.when(F.col("c_custkey") % 9 == 0, F.lit(500).cast("bigint")).alias("flag_max_bytes"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("src/*"), F.lit("*.ts"))).alias("file_include"),
        F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit("*.js"))).alias("flag_include"),
        F.when(F.col("c_custkey") % 3 == 1, F.array(F.lit("**/vendor/**"), F.lit("m?.*"))).alias("file_exclude"),
        F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("*[02468].[jt]s"))).alias("flag_exclude"),
        F.when(F.col("c_custkey") % 6 == 0, F.lit("file-model")).alias("file_model"),
        F.when(F.col("c_custkey") % 8 == 0, F.lit("env-model")).alias("env_model"),
        null_text.alias("flag_model"),
        F.when(F.col("c_custkey") % 4 == 1, F.lit(100)).alias("file_max_tokens"),
        F.lit(None).cast("int").alias("flag_max_tokens"),
        F.when(F.col("c_custkey") % 4 == 2, F.lit(0)).alias("file_max_workers"),
        F.when(F.col("c_custkey") % 12 == 0, F.lit(3)).alias("flag_max_workers"),
        (F.col("c_custkey") % 13 == 0).alias("file_no_ai"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit("Yes")).otherwise(F.lit("0")).alias("env_no_ai"),
        F.lit(None).cast("boolean").alias("flag_no_ai"),
    )
