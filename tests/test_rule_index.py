"""Rules found through texts that their matches contain, against every rule on every line."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gritline.functions.factors import mandatory_factors
from gritline.functions.shapes import fixed_shapes
from gritline.operators import rule_index
from gritline.operators import rules as rl
from gritline.operators.lines import explode_lines
from gritline.plans import fixtures as fx
from gritline.plans.queries import QUERIES


@pytest.mark.parametrize(
    ("pattern", "texts"),
    [
        ("abc|defg", ["abc", "defg"]), ("a?bcd+e", ["bcd"]), ("(?:foo|bar)baz|qux!", ["baz", "qux!"]), ("(foo|ba)z", []),
        (r"abc\.d\(", ["abc.d("]), ("x{2}yzw", ["yzw"]), ("(?:abcd){2,}", ["abcd"]), ("[]abc]xyz[^]]", ["xyz"]), (r"\p{L}abc\d", ["abc"]),
        ("abc(?=defg)", ["abc"]), ("(?<!defg)abc", ["abc"]), ("(?<name>hello) w", ["hello"]), ("a.b.c", []), ("abc*", []), ("abcd*?", ["abc"]),
        ("(?:abc)?de", []), ("abc|", []), ("(?:abc|d?)", []), (r"\Qabc", []), ("(?i:abc)def", []), ("(?s)abc", []), ("abc)", []), ("(abc", []), ("[abc", []),
        (r"(?:abc\ndefg)", ["defg"]), (r"(a)\1bcd", []), (r"\x41bcd", ["bcd"]), (r"\tabc", ["\tabc"]),
    ],
)
def test_factors(pattern, texts):
    assert mandatory_factors(pattern) == (False, texts)
    assert mandatory_factors("(?i)" + pattern)[0]


def test_folded_factors_are_ascii():
    assert mandatory_factors("(?i)HelloÉcoles") == (True, ["hello"])
    assert mandatory_factors("(?i)éàü") == (True, [])


def made_pattern(pick, depth=2):
    """A pattern of the constructs that Java and Python read alike."""
    atoms = ["abc", "ab", "b", "ca", r"\.", "[ab]", "[^c]", ".", r"\d", "^", "$", "bca"]
    parts = []
    for _ in range(pick.randint(1, 4)):
        if depth and pick.random() < 0.35:
            atom = pick.choice(["(?:{})", "({})"]).format("|".join(made_pattern(pick, depth - 1) for _ in range(pick.randint(1, 3))))
        else:
            atom = pick.choice(atoms)
        parts.append(atom + (pick.choice(["", "", "", "?", "+", "*", "{1,2}", "+?"]) if atom not in "^$" else ""))
    return "".join(parts)


def test_matches_hold_a_factor():
    pick, some = random.Random(1), 0
    for _ in range(1000):
        pattern = made_pattern(pick, 1)
        _, texts = mandatory_factors(pattern)
        some += bool(texts)
        for _ in range(20):
            line = "".join(pick.choice("aabbcc.d1") for _ in range(pick.randint(0, 9)))
            found = re.search(pattern, line)
            assert not found or not texts or any(t in found[0] for t in texts), (pattern, line)
    assert some > 100


def test_hits_are_those_of_every_rule(spark, files):
    """Rules with and without factors, languages and placeholder tests, on lines of any letters."""
    pick = random.Random(2)
    rows = []
    for k in range(50):
        pattern = ("(?i)" if k % 3 == 0 else "") + made_pattern(pick)
        languages = [None, ["text"], ["other", "text"], ["other"], []][k % 5]
        rows.append((k * 11, f"own/{k}", pattern, "low", "style", f"T{k}", "", "", 0.5, languages, None))
    rows.append((9000, "own/key", 'token = "([^"]+)"', "low", "style", "Key", "", "", 0.5, None, 1))
    rows.append((9001, "own/key", '(?i)api_key "([a-z]+)"', "low", "style", "Key", "", "", 0.5, None, 1))
    rows.append((9002, "own/kin", "(?i)skin", "low", "style", "Key", "", "", 0.5, None, 0))
    rules = spark.createDataFrame(rows, rl.rule_table(spark).schema)
    texts = ["".join(pick.choice("aabbccABC.d1é") for _ in range(pick.randint(0, 14))) for _ in range(200)]
    texts += ['token = "abcd"', 'token = "changeme"', 'API_KEY "real"', 'APİ_KEY "real"', 'apı_key "example"', "ſKİn", "ſKIN", "", " "]
    lines = explode_lines(files({"a.txt": "\n".join(texts)}).withColumn("language", F.lit("text")))
    known = [rule for _, rule in rl.user_rules(rules)]
    want = sorted((r["line_no"], rows[r["rule_idx"]][0]) for r in rl.line_hits(lines, known).collect())
    got = sorted((r["line_no"], r["rule_idx"]) for r in rl.table_rule_hits(lines, rules).collect())
    assert got == want and len(want) > 300


def test_no_rule_has_a_factor(spark, files):
    rows = [(k, f"own/{k}", f"[a{k % 10}]b", "low", "style", "T", "", "", 0.5, None, None) for k in range(60)]
    rules = spark.createDataFrame(rows, rl.rule_table(spark).schema)
    lines = explode_lines(files({"a.txt": "xab\n7b"}).withColumn("language", F.lit("text")))
    got = sorted((r["line_no"], r["rule_idx"]) for r in rl.table_rule_hits(lines, rules).collect())
    assert got == [*((1, k) for k in range(60)), *((2, k) for k in range(60) if k % 10 == 7)]


def test_each_table_is_read_once(spark):
    sf = "/root/testdata/sf0.001"
    rules = fx.word_rules(spark, sf)
    hits = rl.table_rule_hits(explode_lines(fx.text_files(spark, sf)), rules)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert rules.count() > 2000 and plan.count("FileScan parquet") == 3
    assert QUERIES["user_rule_index"](spark, sf).count() > 0


def test_texts_of_one_row_group_are_dealt_over_tasks(spark, tmp_path):
    """A table that comes as one row group is one task; the rules run on all of them."""
    words = "alpha beta gamma delta, epsilon. zeta"
    tables = {
        "documents": spark.range(64).select(F.col("id").alias("doc_id"), F.lit(words).alias("text")),
        "conversations": spark.range(3).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("alpha").alias("text")),
        "pages": spark.range(3).select(F.col("id").alias("page_id"), F.lit("<a>").alias("html")),
    }
    for name, table in tables.items():
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    found = QUERIES["user_rule_index"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(8)" in plan
    assert found.where("repo_id = 1").agg(F.max("n_files")).first()[0] == 64


@pytest.mark.parametrize(
    "pattern",
    ["abc+", "ab.cd", "a|bcd", r"\bword", "[a-z&&[b]]word", "(?=word)", "word^x", "word$x", "(?:wo|x)$rd", "wo[é]rd", "(?i)[A-Z]word", "[^-x]word", "wor{2}d", "(word", "word)", "(?i)éword", "éa[ab]word"],
)
def test_no_fixed_shapes(pattern):
    assert not fixed_shapes(pattern)


def test_rules_of_fixed_shapes_need_no_regex(spark):
    """Which rules match is settled where their texts are found, without a regex for each of them."""
    patterns = [shape.format("word") for shape in fx.WORD_RULES] + [r"(?:x|yz)\[word\]?", "wörd!", "(?i)(?:^|[^A-Za-z])[kK]iss[.,]$", "word[0-9][^0-9]"]
    texts = ["word", "a word.", "words", "sword.", "WORD,", "Word. word", "zzword, x", "azzword, x", "word, ", "x word.\r", "word.\u2028", "éword.",
             "\U0001f600word.", "ſword,", "wörd!", "wwörd!", "\u212aiss.", "KIſſ,", "1kiss,\u0085", "xkiss.", "İkiss.", "word12", "word1é", "word1", "yz[word]", "", None]
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line_no int, text string")
    column, rest = rule_index.candidates(patterns, F.col("text"))
    found = {(r["line_no"], p["place"]): p["fixed"] for r in lines.select("line_no", column.alias("c")).collect() for p in r["c"]}
    marks = F.array(*[F.col("text").rlike(rl._java(p)) for p in patterns])
    want = {(r["line_no"], k) for r in lines.select("line_no", marks.alias("m")).collect() for k, hit in enumerate(r["m"]) if hit}
    assert not rest and len(want) > 25 and want <= set(found)
    assert {key for key, fixed in found.items() if fixed} <= want
    unsure = {key for key, fixed in found.items() if not fixed}
    assert {place for _, place in unsure} == {3, 4, 6} and {texts[k] for k, place in unsure if place != 4} == {"x word.\r", "word.\u2028", "1kiss,\u0085"}


def test_fixed_shapes_are_those_of_the_pattern():
    pick, some = random.Random(4), 0
    atoms = ["abc", "bca", "ab", r"\.", "[ab]", "[^c]", "[a-c]", "^", "$", "(?:^|[^a-c])", "(a|bb)", "(?:c|$)"]
    for _ in range(3000):
        pattern = "".join(pick.choice(atoms) for _ in range(pick.randint(1, 4)))
        shapes = fixed_shapes(pattern)
        some += bool(shapes)
        if shapes:
            texts = sorted({s.text for s in shapes})
            index = rule_index._Index(tuple((t, tuple((0, s) for s in shapes if s.text == t)) for t in texts))
            lines = ["".join(pick.choice("aabbcc.d1é") for _ in range(pick.randint(0, 9))) for _ in range(30)]
            rows, _, sure = index.find(lines)
            assert set(rows.tolist()) == {k for k, line in enumerate(lines) if re.search(pattern, line)} and sure.all(), pattern
    assert some > 500
