"""Top-k, classifiers and personal data against plain versions and held-out labels."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from gritline.llm import ordinal, pii, quality, topk, toxicity
from tests.llm import plain
from tests.llm.conftest import document_rows

SF = "/root/testdata/sf0.1"


def best(rows, k, every=20):
    """Per query the best rows by plain integers, in order."""
    valid = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    asking = {}
    for i, v in valid:
        if i % every == 0:
            asking[i] = min(v, asking.get(i, v))
    out = []
    for q, a in asking.items():
        found = sorted((-min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), i) for i, b in valid if i != q and len(a) == len(b))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    pick = random.Random(3)
    rows = [(k, [float(np.float32(pick.uniform(-1, 1))) for _ in range(6)]) for k in range(300)]
    rows += [(k, rows[0][1]) for k in range(300, 330)]  # ties
    rows += [(400, None), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (440, [float("nan")] * 6), (460, [float("inf")] * 6)]
    rows += [(480, []), (None, rows[1][1]), (500, [0.5, 0.5]), (501, [0.25, 1.0]), (520, [0.0] * 6), rows[20], rows[21], (22, rows[5][1]), (40, rows[6][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 AS id", "'x' AS vec")
    for sizes in ({}, {"query_rows": 5, "tile_rows": 32}):
        assert sorted(tuple(r) for r in topk.top_k(df, 20, **sizes).collect()) == best(rows, 20)
    assert topk.top_k(df.limit(0), 20).count() == 0


def test_top_k_of_large_numbers(spark):
    rows = [(k, [float(2**40 + k * 2**20), float(-(2**39))]) for k in range(41)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, 3).collect()) == best(rows, 3)


def test_trees_cover_their_points():
    points = np.random.default_rng(1).normal(size=(1500, 5))
    order, root = topk.build(points)
    assert sorted(order.tolist()) == list(range(1500))
    todo = [root]
    while todo:
        node = todo.pop()
        inside = points[order[node.start : node.end]]
        assert np.sqrt(((inside - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        assert not node.children or sum(c.end - c.start for c in node.children) == node.end - node.start
        todo += node.children


def test_ordinal_gradient_and_fit():
    make = np.random.default_rng(0)
    x = make.normal(size=(400, 4))
    grades = np.digitize(x @ np.array([2.0, -1, 0.5, 0]) + make.logistic(size=400), [-1, 0.5, 2])
    rows, columns = np.repeat(np.arange(400), 4), np.tile(np.arange(4), 400)
    weight = np.full(400, 1 / 400)
    at = make.normal(size=7) * 0.3
    _, slope = ordinal._loss(at, rows, columns, x.ravel(), grades, weight, 4, 0.01)
    for k in range(7):
        step = np.eye(7)[k] * 1e-5
        up, down = (ordinal._loss(at + s, rows, columns, x.ravel(), grades, weight, 4, 0.01)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - slope[k]) < 1e-4
    w, thresholds = ordinal.fit(rows, columns, x.ravel(), grades, np.ones(400), 4)
    assert (np.diff(thresholds) > 0).all() and np.abs(w - [2, -1, 0.5, 0]).max() < 0.5


@pytest.fixture(scope="module")
def halves(spark):
    """Documents, labels to learn from and labels held out."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    first = F.xxhash64("doc_id", F.lit(1)) % 2 == 0
    return docs, labels.where(first), labels.where(~first)


def test_toxicity_on_held_out_labels(halves):
    docs, known, held = halves
    scored = toxicity.severity(docs, toxicity.train(docs, known)).withColumnRenamed("toxic", "found").join(held, "doc_id")
    rows = scored.groupBy("toxic").agg(F.avg(F.col("found").cast("int")), F.avg("severity")).collect()
    share = {r[0]: r[1:] for r in rows}
    assert share[1][0] > 0.85 and share[0][0] < 0.03 and share[1][1] > share[0][1] + 0.8


def test_quality_on_held_out_labels(halves):
    docs, known, held = halves
    scored = quality.quality(docs, quality.train(docs, known)).join(held, "doc_id")
    rows = scored.groupBy("quality").agg(F.avg(F.col("selected").cast("int")), F.avg("expected_grade")).collect()
    share = {r[0]: r[1:] for r in rows}
    assert share[1][0] > 0.98 and share[0][0] < 0.12 and share[1][1] > share[0][1] + 1


WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def plain_tails(model, text):
    """P(grade > k) of one text, token by token."""
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    tokens = WORDS.findall(text)
    counts = Counter()
    for token in tokens:
        shape = (
            ("upper" if len(token) > 1 else "initial") if token.isupper() else "title" if token.istitle()
            else "lower" if token.isalpha() else "number" if token.isnumeric() else "mark"
        )
        counts[xxhash.xxh32_intdigest(token.lower().encode(), 1) % ordinal.REPEATED] += 1
        counts[xxhash.xxh32_intdigest(f"{shape} {min(len(token), 12)}".encode(), 2) % ordinal.REPEATED] += 1
    counts[ordinal.REPEATED] = sum(n - 1 for n in Counter(zip(tokens, tokens[1:])).values())
    score = sum(weight.get(k, 0.0) * n for k, n in counts.items()) / max(1, len(tokens)) ** model.power
    return [1 / (1 + math.exp(min(40.0, max(-40.0, t - score)))) for t in model.thresholds]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_against_plain(halves, module):
    """Both queries' columns, on all documents of a table, odd texts among them."""
    docs, known, _ = halves
    model = module.train(docs, known)
    some = docs.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, ""), (-2, None), (-3, "İstanbul's ΣΑΣ 12 ½ ---  it's it's 'll"), (-4, "word " * 5000), (None, "A b"), (-3, "twice")]
    df = some.union(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    want = sorted((repr(i), *plain_tails(model, t)) for i, t in texts)
    if module is toxicity:
        got = [(repr(r["doc_id"]), r["p_toxic"], r["p_severe"], r["severity"], r["toxic"]) for r in toxicity.severity(df, model).collect()]
    else:
        got = [(repr(r["doc_id"]), r["tail_probability"], r["expected_grade"] - r["tail_probability"], r["expected_grade"], r["selected"]) for r in quality.quality(df, model).collect()]
    assert len(got) == len(want) > 200
    for (i, first, second, mean, chosen), (j, *tails) in zip(sorted(got), want):
        assert i == j and abs(first - tails[0]) < 1e-5 and abs(second - tails[1]) < 1e-5
        assert abs(mean - sum(tails)) < 1e-5 and (chosen == (tails[0] >= 0.5) or abs(tails[0] - 0.5) < 1e-5)


def test_classifiers_on_odd_input(documents, spark):
    rows = [*document_rows(["good text", "", None, "x" * 100_000]), (None, "bad", "en", "s", 3), (0, "good text", "en", "s", 9)]
    labels = spark.createDataFrame([(0, 1, 0), (4, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        df = documents(rows, extra=True)
        assert quality.quality(df, quality.train(df, given)).where("selected").count() == 6
        assert quality.drop_poor(df, quality.train(df, given)).columns == df.columns
        assert toxicity.severity(df, toxicity.train(df, given)).count() == 6
    none = documents([])
    assert quality.quality(none, quality.train(none, labels)).count() == 0
    assert toxicity.severity(none, toxicity.train(none, labels)).count() == 0


def test_base_spans():
    pick = random.Random(4)
    letters = "0123456789" * 3 + "..@@+- ()ab%é\n-"
    for _ in range(4000):
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, 60)))
        text += pick.choice(["", " 4111111111111111 a.b@c.d.e@f.g 1.2.3.4.5.6.7.8 ", "+1 (017) 555-7713"])
        assert [(pii.KINDS[y - 1], a, b) for y, a, b, _ in pii.base_spans(text)] == plain.base_spans(text)


def test_long_runs_end():
    for text in ("1" * 200_000 + "@", "a" * 200_000 + "@", "1." * 100_000, "+1" + "-" * 100_000, "+1 " * 50_000):
        pii.base_spans(text)
        pii.Field().add(0, text, [])


def test_skip_links_spread_a_label():
    pairs = np.zeros((3, 5, 5))
    pairs[pii.SAME] = np.eye(5) * 8
    model = pii.Model({}, np.log([0.9, 0.025, 0.025, 0.025, 0.025]), pairs)
    text = "call +1 (017) 555-7713 today, or 555-7713 later; 555-7714 is another"
    kinds = [(pii.KINDS[y - 1], text[a:b], base) for y, a, b, base in pii.find_spans(model, [text])[0]]
    assert kinds == [("phone", "+1 (017) 555-7713", True), ("phone", "555-7713", False)]
    assert pii.masked(text, pii.find_spans(model, [text])[0]) == "call [PHONE] today, or [PHONE] later; 555-7714 is another"


def test_a_label_reaches_all_repeats():
    """A chain of repeats far longer than the rounds that short documents need."""
    pairs = np.zeros((3, 5, 5))
    pairs[pii.SAME] = np.eye(5) * 8
    model = pii.Model({}, np.log([0.21, 0.1975, 0.1975, 0.1975, 0.1975]), pairs)
    text = "+1 (017) 555-7713" + " or 555-7713" * 60
    assert len(pii.find_spans(model, [text])[0]) == 61
    alone = pii.find_spans(model, [text])
    assert pii.find_spans(model, ["other 555-7713", text, "+1 (017) 555-7713"])[1] == alone[0]


def test_messages_give_the_marginals_of_a_tree():
    """On a chain without loops the beliefs are exact."""
    make = np.random.default_rng(3)
    field = pii.Field(
        doc=[0] * 4, start=[0] * 4, end=[1] * 4, shape=["a", "b", "a", "c"], given=[0, 0, 2, 0],
        links=[(0, 1, pii.NEXT), (1, 2, pii.SAME), (2, 3, pii.NEXT)],
    )
    pairs = make.normal(size=(3, 5, 5))
    pairs = pairs + pairs.transpose(0, 2, 1)
    model = pii.Model({s: make.normal(size=5) for s in "ab"}, make.normal(size=5), pairs)
    total = np.zeros((5, 5, 5, 5))
    for labels in np.ndindex(total.shape):
        if labels[2] == 2:
            score = sum(model.shapes.get(s, model.other)[y] for s, y in zip(field.shape, labels) if y != 2 or s != "a")
            total[labels] = np.exp(score + sum(pairs[k][labels[a], labels[b]] for a, b, k in field.links))
            if labels[0] == 2:
                total[labels] *= np.exp(model.shapes["a"][2])
    want = [total.sum(axis=tuple(j for j in range(4) if j != k)) / total.sum() for k in range(4)]
    assert np.abs(pii.beliefs(model, field) - want).max() < 1e-5


def test_personal_data_table(documents):
    texts = ["mail a.b@c.de or 10.0.0.1", "", None, "card 4111 1111-11111111 x", "nothing", "é +44 20 7946 0958 é", "300.1.1.1 1234"]
    rows = [*document_rows(texts), (None, "a@b.c", "en", "s", 5), (0, texts[0], "en", "s", 1)]
    df = documents(rows, extra=True)
    model = pii.train(df)
    found = pii.personal_data(df, model).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t or "" for k, t, *_ in rows if k == r["doc_id"])
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == plain.base_spans(text)
    clean = pii.redact(df, model)
    assert clean.columns == df.columns and clean.count() == len(rows)
    by_id = {r["doc_id"]: r for r in clean.where("source = 's'").collect()}
    assert by_id[3]["text"] == "card [CARD] x" and by_id[3]["n_chars"] == len("card [CARD] x")
    assert by_id[2]["text"] is None and by_id[4]["text"] == "nothing"
    assert not any(re.search("@", r["text"] or "") for r in by_id.values())
    none = documents([])
    assert pii.personal_data(none, pii.train(none)).count() == 0
