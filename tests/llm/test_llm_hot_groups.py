"""Words whose bytes alone tell them apart, and buckets that a header fills."""

import numpy as np
import pytest

from tidemark.llm import near_dedup, substring_dedup
from test_llm_queries import brute_force_components, windows_brute_force
from test_llm_units import thue_morse


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


@pytest.mark.parametrize("n", [1024, 4096])
def test_balanced_words(spark, n):
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    plain = [f"w{i}" for i in range(41)]
    texts = {1: " ".join([*plain[:20], a, *plain[21:]]), 2: " ".join([*plain[:20], b, *plain[21:]]), 3: " ".join([a] * 41), 4: " ".join([b] * 41)}
    rows = substring_dedup.substring_dedup(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == windows_brute_force(texts)
    rows = near_dedup.near_dedup(frame(spark, texts), 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_force_components(texts, 2)


def with_header(n, seed=0):
    """Documents that share sixty words and little else, some of them with a near copy."""
    rng = np.random.default_rng(seed)
    header = " ".join(f"head{i}" for i in range(60))
    texts = {i: header + " " + " ".join(f"x{x}" for x in rng.integers(0, 10**9, 80)) for i in range(n)}
    for i in range(0, n, 10):
        words = texts[i].split()
        words[100] = "changed"
        texts[n + i] = " ".join(words)
    return texts


def test_documents_of_one_header(spark, monkeypatch):
    texts = with_header(250)
    want = brute_force_components(texts, 2)
    for few in (near_dedup.FEW, 1):
        monkeypatch.setattr(near_dedup, "FEW", few)
        rows = near_dedup.near_dedup(frame(spark, texts), 2).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def test_a_crowd_just_below_the_similarity(spark, monkeypatch):
    """Copies that differ too much to be linked, with a few that are links, in buckets and lists of any length."""
    rng = np.random.default_rng(7)
    texts = {}
    for i in range(160):
        words = [f"t{j}" for j in range(120)]
        for j in rng.choice(120, 16 if i % 5 else 3, replace=False):
            words[j] = f"e{rng.integers(0, 10**6)}"
        texts[i] = " ".join(words)
    want = brute_force_components(texts, 2)
    for few, short in ((64, 16), (4, 2), (4, 1000)):
        monkeypatch.setattr(near_dedup, "FEW", few)
        monkeypatch.setattr(near_dedup, "SHORT", short)
        rows = near_dedup.near_dedup(frame(spark, texts), 2).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def test_pairs_grow_in_proportion(spark):
    """Of documents that share a header, the prefix filter gives few pairs, not all of them."""
    pairs = []
    for n in (2000, 8000):
        texts = with_header(n)
        docs = frame(spark, texts)
        members = docs.selectExpr("doc_id", "doc_id AS c")
        found, dense = near_dedup.prefix_pairs(members, docs, 2, 80)
        pairs.append(found.count())
        assert pairs[-1] >= n // 10 and dense.count() == 0
    assert pairs[1] <= 8 * pairs[0] < 8 * 2000


def test_prefix_filter_loses_no_link(spark):
    """Against all pairs, of sets drawn from few words, where every list is long."""
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"v{i}" for i in range(12)], 40)) for _ in range(30)]
    texts = {}
    for i in range(150):
        words = base[i % 30].split()
        for j in rng.choice(40, int(rng.integers(0, 6)), replace=False):
            words[j] = f"v{rng.integers(0, 14)}"
        texts[i] = " ".join(words)
    docs = frame(spark, texts)
    pairs, dense = near_dedup.prefix_pairs(docs.selectExpr("doc_id", "doc_id AS c"), docs, 2, 80)
    found, dense = {(r["u"], r["v"]) for r in pairs.collect()}, {r["doc_id"] for r in dense.collect()}
    for a in texts:
        for b in range(a + 1, 150):
            if near_dedup.alike(texts[a], texts[b], 2, 80):
                assert (a, b) in found or {a, b} <= dense
