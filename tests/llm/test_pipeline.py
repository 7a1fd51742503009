"""The registered queries of the subpackage, and the pipeline stage by stage."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from gritline.llm import queries
from gritline.session import ship
from tests.llm import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage of the pipeline returns."""
    from gritline.operators.skew import stage

    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, work in corpus_pipeline.STAGES:
        out.append(stage(work(spark, out[-1], SF)))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_registered(spark):
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(queries.QUERIES)
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14))


def test_columns_stay(stages):
    for df in stages[1:5]:
        assert df.columns == stages[0].columns


def test_quality_stage_takes_documents_away(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) <= set(before) and all(after[k] == before[k] for k in after) and len(after) > 0.7 * len(before)


def test_exact_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    last = {}
    for k, r in before.items():
        last[r["text"]] = max(k, last.get(r["text"], k))
    assert set(after) == set(last.values())


def test_near_stage_keeps_one_of_each_group(stages):
    before, after = rows(stages[2]), rows(stages[3])

    def shingles(k):
        w = plain.words(before[k]["text"])
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingles(k) for k in before}
    for gone in set(before) - set(after):
        near = max(len(sets[gone] & sets[k]) / len(sets[gone] | sets[k]) for k in before if k != gone)
        assert near > 0.6, gone
    kept = sorted(after)
    close = [(a, b) for a in kept for b in kept if a < b and sets[a] and len(sets[a] & sets[b]) > 0.95 * len(sets[a] | sets[b])]
    assert not close


def test_personal_data_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for k, r in after.items():
        assert not plain.base_spans(r["text"] or "")
        if not plain.base_spans(before[k]["text"]):
            assert "[" in r["text"] or r["text"] == before[k]["text"]


def test_packing_stage(stages):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: len(tool.encode(r["text"], add_special_tokens=False).ids) + 1 for k, r in rows(stages[4]).items()}
    got, used = {}, {}
    for r in stages[5].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert got == want and max(used.values()) <= 2048


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()
