"""Importance resampling against a version in plain Python, and the checksums of word runs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from gritline.llm import importance
from tests.llm.conftest import document_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [
        zlib.crc32(" ".join(words[k : k + n]).encode()) for n in range(1, longest + 1) for k in range(len(words) - n + 1)
    ]


def plain(rows, target, percent=10, longest=1, buckets=10_000, least=20, seed=2024):
    source = [(i, *grams(t, longest)) for i, t in rows]
    s = Counter(g % buckets for _, _, gs in source for g in gs)
    t = Counter(g % buckets for text in target for g in grams(text, longest)[1])
    ratio = [(t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)) for b in range(buckets)]
    gain = [math.floor(1000 * math.log(r)) for r in ratio]
    out = []
    for i, words, gs in source:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[g % buckets] for g in gs)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((len(words) >= least, i, len(gs), weight, score))
    fits = sum(r[0] for r in out)
    out.sort(key=lambda r: (not r[0], -r[4], r[1] is not None, r[1] or 0, r[2], r[3]))
    drawn = percent * fits // 100
    return sorted(((*r[1:], k + 1 if k < drawn else None) for k, r in enumerate(out)), key=repr)


def made(count):
    pick = random.Random(4)
    words = [f"{a}{b}{c}" for a in "aBé" for b in "xyz9" for c in ("", "漢", "Q", "-q", "\n")]
    return [" ".join(pick.choice(words) for _ in range(pick.choice([0, 3, 19, 20, 21, 60]))) for _ in range(count)]


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_against_plain(spark, documents, longest):
    rows = document_rows([*made(200), None, "", "   ", "word " * 300_000])
    rows += [rows[7], rows[7], (None, rows[9][1], "en", "s", 0), (7, "another text " * 15, "en", "s", 0)]
    target = spark.createDataFrame([(1, t) for t in made(9)] + [(2, None), (3, "")], "item_id long, text string")
    got = answer(importance.resample(documents(rows, extra=True), target, longest=longest, buckets=500))
    want = plain([(r[0], r[1]) for r in rows], [r["text"] for r in target.collect()], longest=longest, buckets=500)
    assert got == want
    assert sum(r[4] is not None for r in got) > 5


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = document_rows(made(60))
    assert importance.resample(documents([]), none).count() == 0
    assert answer(importance.resample(documents(rows), none)) == plain([(r[0], r[1]) for r in rows], [])


def test_ties_go_to_the_smaller_id_and_all_equal_rows_stay(spark, documents):
    text = "same words here " * 7
    rows = [(5, text, "en", "s", 0)] * 30 + [(4, text, "en", "s", 0)] * 30
    target = spark.createDataFrame([(1, "same")], "item_id long, text string")
    got = answer(importance.resample(documents(rows), target, percent=50))
    assert got == plain([(r[0], r[1]) for r in rows], ["same"], percent=50)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 31))


@pytest.mark.parametrize("skip", [0, 3])
def test_checksums_of_runs(awkward, skip):
    batch = pa.record_batch([pa.array(range(len(awkward))), pa.array(awkward)], names=["id", "text"]).slice(skip)
    scanned = importance.scan(batch)
    for longest in (1, 2, 5):
        crcs, ends = scanned.grams(longest)
        for k, text in enumerate(awkward[skip:]):
            if len(text) < 10_000:
                assert sorted(crcs[ends[k] : ends[k + 1]].tolist()) == sorted(grams(text, longest)[1])
