"""Exact and near copies, components and repeated passages against plain versions."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritline.llm import components as components_of
from gritline.llm import exact, near_copies, passages, simhash
from gritline.llm.components import components
from gritline.operators import skew
from tests.llm import plain
from tests.llm.conftest import document_rows


def prose(pick, n):
    return " ".join("".join(pick.choice("aeioulmnrst") for _ in range(pick.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def copies():
    pick = random.Random(5)
    texts = [prose(pick, pick.randint(1, 900)) for _ in range(30)]
    texts += [pick.choice(texts[:6]) for _ in range(40)] + [texts[0]] * 40
    texts += ["", None, "", " ", "\n", "x" * 9000, "x" * 9000, "x" * 9001, "Ab", "ab", texts[1] + " "]
    return texts


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(documents, copies, bits):
    """With three bits, nearly every chunk shares its hash with others."""
    rows = [*document_rows(copies), (None, "lone", "en", "s", 4), (None, "Ab", "en", "s", 2), (2, copies[2], "de", "t", 0)]
    groups = {}
    for k, text, *_ in rows:
        groups.setdefault(text or "", []).append(k)
    got = exact.exact_groups(documents(rows, extra=True), bits=bits).collect()
    assert len(got) == len(rows)
    want = sorted(
        (str(k), str(max([x for x in groups[t or ""] if x is not None], default=None)), len(groups[t or ""]),
         hashlib.sha256((t or "").encode()).hexdigest())
        for k, t, *_ in rows
    )
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_chunks_are_the_text(spark):
    pick = random.Random(1)
    text = prose(pick, 3000)
    rows = [(1, text), (2, "start of another kind. " + text), (3, "")]
    df = spark.createDataFrame(rows, "k int, text string").select("k", exact.chunks_of(df_text()).alias("c"))
    found = {r["k"]: r["c"] for r in df.collect()}
    assert "".join(found[1]) == text and found[3] == [] and max(map(len, found[1])) <= 4000
    assert len(set(found[1]) & set(found[2])) > len(found[1]) // 2  # cuts come from the content


def df_text():
    from pyspark.sql import functions as F

    return F.col("text")


def test_drop_copies(documents, copies):
    rows = [*document_rows(copies), (2, copies[2], "de", "t", 0)]
    kept = exact.drop_copies(documents(rows, extra=True)).collect()
    last = {}
    for k, text, *_ in rows:
        last[text or ""] = max(k, last.get(text or "", k))
    assert sorted(r["doc_id"] for r in kept) == sorted(last.values())
    assert {r["doc_id"]: r["text"] for r in kept} == {k: copies[k] for k in last.values()}


def test_drop_copies_keeps_any_column(documents):
    df = documents(document_rows(["a", "a", None, "", "b"])).selectExpr("*", "1 AS _own", "2 AS own", "3 AS row", "4 AS sha")
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["_own"], r["own"], r["row"], r["sha"]) for r in kept.collect()) == [(k, 1, 2, 3, 4) for k in (1, 3, 4)]


def test_exact_empty_table(documents):
    assert exact.exact_groups(documents([])).count() == 0
    assert exact.drop_copies(documents([])).count() == 0


@pytest.mark.parametrize("window", [1 << 20, 11])
def test_fingerprints(monkeypatch, window):
    monkeypatch.setattr(simhash, "WINDOW", window)
    pick = random.Random(3)
    for n in (0, 1, 3, 4, 5, 60):
        text = "".join(pick.choice(["Ab ", "c\n", "d\t", "é ", "zz  ", " "]) for _ in range(n))
        assert simhash.majority(simhash.shingle_hashes(text, 4)) & (1 << 64) - 1 == plain.fingerprint(text)


def test_flips_keep_to_the_budgets():
    ring = simhash.Ring(4, 3)
    sizes = ring.chain(3, 3)[1]
    masks = ring.flips(sizes)
    edges = np.cumsum(sizes)
    want = [
        m for n in range(3) for bits in combinations(range(edges[-1]), n) if (m := sum(1 << b for b in bits)) is not None
        and all(bin(m & (1 << int(e)) - 1).count("1") <= ring.budget(j) for j, e in enumerate(edges, 1))
    ]
    assert sorted(masks) == sorted(want)


@pytest.mark.parametrize("dense_bucket", [128, 1])
def test_links_have_the_components_of_all_pairs(spark, dense_bucket):
    pick = random.Random(dense_bucket)
    codes = set()
    for _ in range(25):
        code = pick.getrandbits(64)
        for _ in range(8):
            codes.add(code)
            for _ in range(pick.randint(0, 5)):
                code ^= 1 << pick.randrange(64)
    signed = sorted(c - (1 << 64) * (c >> 63) for c in codes)
    near = [(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.linked(df, simhash.Ring(), dense_bucket).collect()}
    assert {tuple(sorted(p)) for p in got} <= set(near)
    assert plain.smallest_reachable(list(got), signed) == plain.smallest_reachable(near, signed)


def test_components(spark):
    pick = random.Random(9)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(5, 5)]
    links += [(pick.randrange(1000, 1200), pick.randrange(1000, 1200)) for _ in range(120)]
    pick.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long")
    nodes = sorted({x for p in links if p[0] != p[1] for x in p})
    assert {r["node"]: r["root"] for r in components(df).collect()} == plain.smallest_reachable(links, nodes)
    assert components(df.where("a = b")).count() == 0


def test_near_components(documents):
    pick = random.Random(4)
    base = prose(pick, 400)
    texts = [prose(pick, 50) for _ in range(20)] + [base] * 5 + [base + " end", "first " + base, "", None, " \t", "one", "One"]
    rows = [*document_rows(texts), (None, "one", "en", "s", 3)]
    codes = [plain.fingerprint(t or "") for _, t, *_ in rows]
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if bin(codes[a] ^ codes[b]).count("1") <= 4]
    root = plain.smallest_reachable(near, list(range(len(rows))))
    got = simhash.near_components(documents(rows, extra=True)).collect()
    want = [(k, f"{codes[n]:016x}", root[n]) for n, (k, *_) in enumerate(rows)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_components(documents([])).count() == 0


def test_drop_near_copies(documents):
    pick = random.Random(8)
    base = [prose(pick, 500) for _ in range(12)]
    texts = list(base)
    for text in base:
        w = text.split()
        texts += [" ".join([*w[:100], "changed", *w[101:]]), " ".join([*w, "added"]), text.upper()]
    texts += ["", None, "few words here", "other words there"]
    rows = [*document_rows(texts), (None, base[0], "en", "s", 0)]
    kept = near_copies.drop_near_copies(documents(rows, extra=True)).collect()
    ids = {r["doc_id"] for r in kept}
    assert {*range(12), None, len(texts) - 2, len(texts) - 1} <= ids
    assert len(ids & {len(texts) - 4, len(texts) - 3}) == 1  # texts without words are alike
    assert not ids & set(range(12, 48))
    assert near_copies.drop_near_copies(documents([])).count() == 0


def test_crowded_buckets_keep_groups_together(documents):
    pick = random.Random(8)
    w = prose(pick, 600).split()
    texts = [" ".join([*w[:k], "changed", *w[k + 1 :]]) for k in range(0, 600, 20)]
    df = documents(document_rows([*texts, *[prose(pick, 80) for _ in range(10)]]))
    kept = near_copies.drop_near_copies(df, dense_bucket=2).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [0, *range(30, 40)]


def test_passages(documents):
    pick = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    shared = [[pick.choice(vocabulary) for _ in range(n)] for n in (20, 49, 50, 51, 60, 120)]
    texts = []
    for _ in range(50):
        w = [pick.choice(vocabulary) for _ in range(pick.randint(0, 150))]
        for _ in range(pick.randint(0, 2)):
            at = pick.randint(0, len(w))
            w[at:at] = pick.choice(shared)
        texts.append(pick.choice([" ", "\n", "  ", "\té "]).join(w))
    texts += ["", None, " ", texts[0], texts[0].upper(), "again " * 200]
    rows = document_rows(texts)
    df = documents([*rows, rows[7], (None, texts[0], "en", "s", 0)], extra=True)
    found = passages.repeated_passages(df)
    got = found.collect()
    assert {tuple(r) for r in got} == plain.passages({k: t or "" for k, t, *_ in rows}, 50)
    assert len(got) == len(set(got)) and passages.repeated_passages(documents([])).count() == 0
    sizes = {(r["doc_id"], r["passage"]): r["n_words"] for r in got}
    for r in passages.passage_texts(documents(rows), found).collect():
        assert len(plain.words(r["text"])) == sizes.pop((r["doc_id"], r["passage"]))
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["text"] == r["text"].strip()
    assert not sizes


def test_neighbours_across_batches(spark):
    """Rows with an equal neighbour stay, wherever batches and partitions end."""
    pick = random.Random(2)
    keys = [pick.randrange(400) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(keys)), "id long, key long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = passages.neighbours(df.repartitionByRange(5, "key").sortWithinPartitions("key", "id")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    want = {k for k, key in enumerate(keys) if keys.count(key) > 1}
    got = [r["id"] for r in found]
    assert want <= set(got) and len(got) == len(set(got)) and len(set(got) - want) <= 10


def similarity(a, b):
    a, b = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (plain.words(a), plain.words(b)))
    return len(a & b) / len(a | b)


def of_template(pick, words, n, changes):
    """``n`` texts, each with words of its own in ``changes`` places."""
    out = []
    for k in range(n):
        places = set(pick.sample(range(len(words)), changes))
        out.append(" ".join(f"c{k}x{p}" if p in places else w for p, w in enumerate(words)))
    return out


def test_texts_of_a_template_that_are_not_alike_stay(documents):
    pick = random.Random(3)
    texts = of_template(pick, prose(pick, 400).split(), 40, 7)
    assert all(0.66 < similarity(a, b) < 0.8 for a, b in combinations(texts, 2))
    assert near_copies.drop_near_copies(documents(document_rows(texts))).count() == 40


def kept_by_similarity(texts):
    near = [p for p in combinations(range(len(texts)), 2) if similarity(texts[p[0]], texts[p[1]]) >= 0.8]
    return sorted(set(plain.smallest_reachable(near, list(range(len(texts)))).values()))


def test_near_copies_of_0_8_to_0_9_meet(documents):
    pick = random.Random(12)
    texts = []
    while len(texts) < 120:
        pair = of_template(pick, prose(pick, pick.randint(60, 400)).split(), 2, pick.randint(1, 6))
        if 0.78 <= similarity(*pair) <= 0.9:
            texts += pair
    want = kept_by_similarity(texts)
    assert 60 < len(want) < 100
    kept = near_copies.drop_near_copies(documents(document_rows(texts))).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == want


@pytest.mark.parametrize("sample", [1, 64])
def test_groups_of_a_template_go_by_its_pivot(documents, monkeypatch, sample):
    """Texts with no to six changes: some are alike to the pivot, some to others only, some to none."""
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    pick = random.Random(31)
    texts = []
    for _ in range(2):
        words = prose(pick, 150).split()
        for k in range(90):
            places = set(pick.sample(range(0, 150, 3), k % 7))
            texts.append(" ".join(f"c{pick.randint(0, 1)}" if p in places else w for p, w in enumerate(words)))
    want = kept_by_similarity(texts)
    assert 20 < len(want) < 150
    rows = document_rows(texts) + [(0, "a text of its own that shares its id", "en", "s", 1), (1, texts[1], "en", "s", 1)]
    kept = near_copies.drop_near_copies(documents(rows, extra=True), dense_bucket=4).collect()
    again = [1] if 1 in want else []
    assert sorted(r["doc_id"] for r in kept) == sorted([*want, 0, *again])
    assert [r["doc_id"] for r in kept if r["text"].startswith("a text of its own")] == [0]


def test_near_copies_in_dense_buckets_of_others_meet(documents, monkeypatch):
    """Each place has one of two words, so that about half of all texts share any shingle."""
    monkeypatch.setattr(near_copies, "BLOCK", 16, raising=False)
    pick = random.Random(21)
    words = prose(pick, 400).split()
    codes = [[pick.randint(0, 1) for _ in range(40)] for _ in range(50)]
    for code in codes[10:25]:
        flipped = set(pick.sample(range(40), 7))
        codes.append([1 - bit if p in flipped else bit for p, bit in enumerate(code)])
    texts = [" ".join(f"v{c[p // 10]}" if p % 10 == 5 else w for p, w in enumerate(words)) for c in codes]
    want = kept_by_similarity(texts)
    assert want == list(range(50))
    df = documents(document_rows(texts))
    kept = near_copies.drop_near_copies(df, dense_bucket=4).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == want


def test_near_copies_meet_by_their_fingerprints(documents, monkeypatch):
    """Without keys of least shingles, chains of fingerprints alone find texts that differ in few bits."""
    pick = random.Random(41)
    base = [prose(pick, 300) for _ in range(25)]
    texts = base + [" ".join([*t.split()[: 40 + k], "changed", *t.split()[41 + k :]]) for k, t in enumerate(base)] + [""]
    rows = near_copies._shingled(documents(document_rows(texts)), 5, "doc_id", "text").withColumnRenamed("id", "row").cache()
    prints = {r["row"]: r["fp"] for r in rows.collect()}
    for k, text in enumerate(texts):
        words = plain.words(text)
        found = {plain.xxhash.xxh64_intdigest(b" ".join(words[at : at + 5]), 42) for at in range(len(words) - 4)}
        assert prints[k] % 2**64 == sum((2 * sum(h >> bit & 1 for h in found) > len(found)) << bit for bit in range(64))
    close = {(a, b) for a, b in combinations(range(50), 2) if 0 < bin((prints[a] ^ prints[b]) % 2**64).count("1") <= 4}
    assert 8 < len(close) < 25 and {tuple(r) for r in near_copies.fingerprint_pairs(rows).collect()} == close
    equal = {(a, b) for a, b in combinations(range(50), 2) if prints[a] == prints[b]}
    meet = near_copies._meetings
    monkeypatch.setattr(near_copies, "_meetings", lambda rows, *rest: meet(rows.withColumn("keys", F.slice("keys", -1, 1)), *rest))
    kept = near_copies.drop_near_copies(documents(document_rows(texts))).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(range(51)) - {b for _, b in close | equal})


def test_tables_that_grow_are_not_sent_to_every_task(documents, monkeypatch):
    """Tables are small on disk here, so the planner alone would send them, however many rows they stand for."""
    plans = []

    def recorded(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, *args)

    stage = skew.stage
    for module in (skew, simhash, near_copies, components_of):
        monkeypatch.setattr(module, "stage", recorded)
    for module in (skew, components_of):
        monkeypatch.setattr(module, "FEW", -1)  # no count of rows is few
    pick = random.Random(8)
    base = prose(pick, 200).split()
    texts = [" ".join([*base[: 200 - k], *prose(pick, k % 5).split()]) for k in range(30)] + [prose(pick, 60) for _ in range(20)]
    groups = near_copies.near_groups(documents(document_rows(texts)), dense_bucket=4)
    assert groups.count() > 5
    assert len(plans) > 20 and sum("SortMergeJoin" in plan for plan in plans) > 10
    assert not [plan for plan in plans if "BroadcastExchange" in plan]
