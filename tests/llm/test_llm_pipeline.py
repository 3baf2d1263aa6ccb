"""The stages one by one, each against what its own input calls for, and the whole."""

import re

import pytest

import corpus_pipeline
from tidemark.llm import toxicity
from tidemark.llm.common import table, written
from test_llm_queries import brute_force_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [table(spark, sf_dir, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_toxic_documents_go(spark, sf_dir, stages):
    model = toxicity.fit(stages[0], table(spark, sf_dir, "labels"))
    clean = toxicity.score_toxicity(stages[0], model).where("predicted = 0")
    assert sorted(texts(stages[1])) == sorted(r["doc_id"] for r in clean.collect())


def test_one_of_equal_texts_stays(stages):
    last = {}
    for i, t in texts(stages[1]).items():
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        last[key] = max(i, last.get(key, i))
    assert sorted(texts(stages[2])) == sorted(last.values())


def test_one_of_near_copies_stays(stages):
    found = brute_force_components({i: t or "" for i, t in texts(stages[2]).items()}, 5)
    assert sorted(texts(stages[3])) == sorted(i for i, (_, top) in found.items() if i == top)


def test_secrets_are_masked_and_documents_kept(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert sorted(before) == sorted(after)
    for i, t in after.items():
        assert not re.search("[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}", t or "")
        if "[SECRET]" not in (t or ""):
            assert t == before[i]


def test_all_words_are_packed(stages):
    words = {i: len((t or "").encode().split()) for i, t in texts(stages[4]).items()}
    packed = {}
    for r in stages[5].collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["n_tokens"]
    assert packed == words


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.select("doc_id", "piece", "n_tokens").collect())) == sorted(map(tuple, stages[5].select("doc_id", "piece", "n_tokens").collect()))


def test_odd_rows(spark, sf_dir):
    rows = [(None, "a b c", None, None, None), (1, None, None, None, None), (2, "", None, None, 0), (3, "x y z", "en", "s", 5), (3, "x y z", "en", "s", 5), (4, "password=abcdefghijkl1", "en", "s", 22)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == COLUMNS
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["2", "3", "4", "None"]
    assert docs.where("doc_id = 4").head()["text"] == "[SECRET]"


def test_columns_of_private_names(spark, sf_dir):
    """Columns named as the operators' own ones come through every stage as they are."""
    own = ["span_id", "span_key", "spans_of", "row_key", "row_id", "row_digest", "kept_id", "kept_digest", "copies", "gone", "digest", "key", "spans", "component_id", "a.b", "kept"]
    rows = [(i, t, "en", "s", len(t), *[f"{c}{i}" for c in own]) for i, t in ((1, "one two three four five six"), (2, "password=abcdefghijkl1"), (3, "ONE two three four five six"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in own))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [*COLUMNS, *own]
    got = {r["doc_id"]: [r[c] for c in own] for r in docs.collect()}
    assert got == {i: [f"{c}{i}" for c in own] for i in (2, 3)}
