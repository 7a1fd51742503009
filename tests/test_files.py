"""File sources and file filters."""

import fnmatch
import os

import pytest
from pyspark.sql import functions as F

from gritline.functions import paths as px
from gritline.functions.text import decode_source, number_lines
from gritline.operators import policy as pol
from gritline.sources import files as fs


def test_read_repository(spark, tmp_path):
    tree = {
        "a.py": b"x = 1\r\ny = 2\r",
        "sub/b.JS": b"var \xff x",
        "vendor/c.py": b"x",
        "notes.txt": b"x",
        "big.py": b"x" * 300,
        ".hidden": b"x",
    }
    for name, data in tree.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    got = fs.read_repository(spark, str(tmp_path), repo_id=3, max_bytes=200)
    rows = {r["path"]: (r["repo_id"], r["language"], r["content"]) for r in got.collect()}
    assert rows == {"a.py": (3, "python", "x = 1\ny = 2\n"), "sub/b.JS": (3, "javascript", "var � x")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,200)" in plan
    only = fs.read_repository(spark, str(tmp_path), include=["sub/*"])
    assert [r["path"] for r in only.collect()] == ["sub/b.JS"]
    manifest = spark.createDataFrame([(0, "vendor/c.py"), (0, " a.py ")], "repo_id long, path string")
    listed = fs.read_repository(spark, str(tmp_path), manifest=fs.manifest_entries(manifest))
    assert {r["path"] for r in listed.collect()} == {"vendor/c.py", "a.py"}


def test_decode_matches_python(spark):
    raws = [b"ok", b"\xff\xfe", b"a\xc3", b"\xe2\x82x", b"a\r\nb\rc\n", b"\xf0\x9f\x98\x80", b""]
    rows = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, raw binary")
    got = rows.select("i", decode_source(F.col("raw")).alias("t")).orderBy("i").collect()
    want = [r.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for r in raws]
    assert [r["t"] for r in got] == want


PATHS = ["a.py", "src/a.py", "src/x/B.ts", "vendor/m.js", "web/vendor/m1.js", "m1.min.js", "a[1].py", "x/..py", ".py", "b.", "a.tar.GZ", "q/[z", "a[x.py", "^b", "-c", "b&", "é!"]
GLOBS = ["*.py", "src/*", "**/vendor/**", "m?.*", "*[0-9].js", "[!a]*", "a[[]1].py", "*.min.js", "q/[z", "b.", "*[!s]", "[]a]*", "x/..?y", "a[[]1[]].py", "[z-a]*", "[!z-a]*", "[z-ab]*", "[a-]*", "*[--.]py", "[!]]*", "[^a]*", "a[1\\].py", "*[a&&b]*", "é?"]


def test_globs_match_fnmatch(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    for glob in GLOBS:
        want = sorted(p for p in PATHS if fnmatch.fnmatchcase(p, glob) or fnmatch.fnmatchcase(os.path.basename(p), glob))
        got = sorted(r["path"] for r in df.where(px.matches_any(F.col("path"), [glob])).collect())
        assert got == want, glob


@pytest.mark.parametrize("globs", [GLOBS[13:], ["[z-a]"], [None, "*.py"], GLOBS[:2], GLOBS[2:6], ["*[02468].[jt]s"], ["q/[z"], []])
def test_policy_globs_match_fnmatch(spark, globs):
    df = spark.createDataFrame([(1, p) for p in PATHS], "repo_id long, path string")
    policies = spark.createDataFrame([(1, globs, None)], "repo_id long, include array<string>, exclude array<string>")
    want = sorted(
        p for p in PATHS
        if not globs or any(fnmatch.fnmatchcase(p, g) or fnmatch.fnmatchcase(os.path.basename(p), g) for g in globs if g)
    )
    assert sorted(r["path"] for r in pol.filter_by_policy(df, policies).collect()) == want


def test_languages_and_skipped_directories(spark):
    df = spark.createDataFrame([(p,) for p in [*PATHS, "a/.git/x.py", "vendor", "dist/a/b.go"]], "path string")
    rows = {
        r["path"]: (r["l"], r["s"])
        for r in df.select("path", px.language_for(F.col("path")).alias("l"), px.in_skipped_dir(F.col("path")).alias("s")).collect()
    }
    assert rows["src/x/B.ts"] == ("typescript", False)
    assert rows[".py"] == (None, False) and rows["x/..py"][0] == "python" and rows["b."][0] is None
    assert rows["vendor/m.js"][1] and rows["a/.git/x.py"][1] and rows["dist/a/b.go"] == ("go", True)
    assert rows["vendor"] == (None, False)


def test_number_lines(spark):
    df = spark.createDataFrame([("\n".join("abcdefghij"),), ("",), ("x\n",)], "c string")
    got = [r[0] for r in df.select(number_lines(F.col("c"))).collect()]
    assert got[0].splitlines()[0] == " 1| a" and got[0].splitlines()[9] == "10| j"
    assert got[1:] == ["1| ", "1| x"]


def test_policy_layers_and_gate(spark, files):
    from gritline.plans.scans import scan_buffers
    from gritline.schemas import POLICY_LAYERS

    names = POLICY_LAYERS.fieldNames()

    def layer(repo_id, **given):
        return tuple({"repo_id": repo_id, **given}.get(n) for n in names)

    rows = [
        layer(1, file_fail_on="none"),
        layer(2, file_fail_on="low", env_fail_on="bogus"),
        layer(3, file_fail_on="low", env_fail_on="", flag_fail_on="none"),
        layer(4, file_max_tokens=1, file_max_workers=0, file_max_bytes=0, file_include=[], env_no_ai="YES"),
    ]
    layers = spark.createDataFrame(rows, POLICY_LAYERS)
    got = {r["repo_id"]: r for r in pol.resolve_policies(layers, layers).collect()}
    assert [got[i]["fail_on"] for i in (1, 2, 3, 4)] == ["high", "high", None, "high"]
    four = got[4]
    assert (four["max_tokens"], four["max_workers"], four["max_bytes"], four["include"], four["no_ai"]) == (1024, 1, 1, None, True)

    bad = scan_buffers(files({"x.py": "def f(x=[]):\n    return eval(x)\n"}))
    minor = scan_buffers(files({"y.py": "x = (1 == None)\n"}, repo_id=3))
    gates = {r["repo_id"]: r["gate"] for r in pol.gate(bad.union(minor), pol.resolve_policies(layers, layers)).collect()}
    assert gates == {1: "fail", 2: "pass", 3: "pass", 4: "pass"}
    one = files({}).select("repo_id").union(spark.createDataFrame([(1,)], "repo_id long"))
    assert pol.render_gate(bad, one, None).first()["gate"] == "pass"
    assert pol.render_gate(bad, one, "high").first()["gate"] == "fail"
    assert pol.render_gate(bad, one, "critical").first()["gate"] == "pass"
