"""Each stage on its own input, and the run as a whole."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tests.conftest import SF
from tests.llm.fixtures import docs_df
from tests.llm.test_exact import brute_components, brute_print, brute_repeats
from tonearm.llm import decontaminate
from tonearm.llm.common import read


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read(spark, SF, "documents"), []
    for _, stage in pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes
    assert steps[-1][1].columns[: len(steps[-1][0].columns)] == steps[-1][0].columns


def test_quality_keeps_labelled_good_documents(spark, steps):
    before, after = map(ids, steps[0])
    good = {r["doc_id"] for r in read(spark, SF, "labels").filter("quality = 1").collect()} & set(before)
    assert after < before and len(good & set(after)) >= 0.9 * len(good)


def test_one_document_of_each_group(steps):
    before = {r["doc_id"]: brute_print(r["text"] or "") for r in steps[1][0].collect()}
    assert set(ids(steps[1][1])) == {c for _, c in brute_components(before).values()}


def test_one_row_of_each_group_whatever_its_id(spark):
    texts = {k: " ".join(f"{k}{i % 89}x{i}" for i in range(60)) for k in "abcdef"}
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, "a"), (None, "d"), (None, "d"), (None, "c"), (None, "e"), (3, "f"), (None, None), (None, "")]
    docs = docs_df(spark, [(i, texts.get(k, k), "en", "web", 1) for i, k in rows])
    kept = Counter((r["doc_id"], r["text"] or "") for r in pipeline.keep_one_of_each_group(spark, docs, SF).collect())
    assert kept == Counter([(1, texts["a"]), (1, texts["b"]), (2, texts["c"]), (None, texts["d"]), (None, texts["e"]), (3, texts["f"]), (None, "")])


def test_repeats_go(steps):
    before = sorted((r["doc_id"], r["text"] or "") for r in steps[2][0].collect())
    want = brute_repeats(before)
    got = {r["doc_id"]: r for r in steps[2][1].collect()}
    for i, text in before:
        n, gone, _, _ = want[i]
        assert (i not in got) == (gone == n > 0)
        if i in got and not gone:
            assert (got[i]["text"] or "") == text


def test_no_item_is_left(spark, steps):
    bench = read(spark, SF, "benchmark")
    hit = {r["doc_id"] for r in decontaminate.find_leaks(steps[3][0], bench).filter("size(hits) > 0").collect()}
    assert set(ids(steps[3][1])) == set(ids(steps[3][0])) - hit


def test_mix_takes_words(steps):
    rows = steps[4][1].collect()
    assert rows and all(0 < r["taken"] <= 2 * r["size"] for r in rows)


def test_run(spark, steps):
    want = {(r["doc_id"], r["taken"]) for r in steps[4][1].collect()}
    assert {(r["doc_id"], r["taken"]) for r in pipeline.run(spark, SF).collect()} == want


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_awkward_and_empty_tables(spark, name, stage):
    out = stage(spark, docs_df(spark, extra=True), SF)
    assert len(set(out.columns)) == len(out.columns) and out.count() <= docs_df(spark).count()
    assert stage(spark, docs_df(spark, []), SF).collect() == []
