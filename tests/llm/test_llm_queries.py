"""The registered queries over the given tables: against their SQL, or against brute force, held-out labels, round trips."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import bpe, near_dedup, queries, substring_dedup
from tidemark.llm.common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", ["op4_fm_substring_dedup", "op5_warc_archive", "op6_odd_sketch_dedup", "op7_exact_dedup", "op9_topk_search"])
def test_query_matches_sql(spark, sf_dir, oracle, rows_of, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == oracle(queries.ORACLES[name])


def test_all_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if re.match(r"op\d+_", x)}
    assert "pipeline" in names


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    p = label.sum()
    return (order[label].sum() - p * (p + 1) / 2) / (p * (~label).sum())


@pytest.mark.parametrize("name, column, cut", [("op1_pu_quality", "quality", 0.3), ("op2_birnn_toxicity", "toxic", 0.5)])
def test_scores(spark, name, column, cut):
    """Held-out accuracy, at a size whose held-out fold has both labels."""
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in table(spark, sf, "documents").select("doc_id").collect())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    label = {r["doc_id"]: r[column] for r in table(spark, sf, "labels").collect()}
    held = [(r["score"], r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
    score, predicted, true = (np.array(x) for x in zip(*held, strict=True))
    assert auc(score, true == 1) > 0.85
    assert (predicted == true).mean() > 0.9


def test_secrets_base_spans(spark, sf_dir, documents):
    patterns = [
        ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    rows = queries.QUERIES["op3_secret_scan"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        spans = sorted((m.start(), i, m.end(), kind) for i, (kind, p, ok) in enumerate(patterns) for m in p.finditer(documents[r["doc_id"]]) if ok(m))
        counts = Counter(s[3] for s in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def windows_brute_force(texts, window=35):
    words = {k: t.encode().split() for k, t in texts.items()}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_substrings(spark, sf_dir, documents, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 5_000)
    rows = queries.QUERIES["op4_fm_substring_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == windows_brute_force(documents)


def test_archives(spark, sf_dir):
    import base64

    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, sf_dir, "pages").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    rows = queries.QUERIES["op5_warc_archive"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        payload = pages[r["page_id"]]
        original = first[payload]
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if original == r["page_id"] else ("revisit", original))


def test_packing_holds_every_token(spark, sf_dir, documents):
    from tidemark.llm.packing import CAPACITIES

    rows = queries.QUERIES["op8_best_fit_packing"](spark, sf_dir).collect()
    size = Counter()
    bins = {}
    for r in rows:
        size[r["doc_id"]] += r["n_tokens"]
        if r["n_tokens"]:
            bins.setdefault(r["bin_id"], []).append(r)
    assert size == Counter({k: len(t.encode().split()) for k, t in documents.items()})
    for own in bins.values():
        (capacity,) = {r["capacity"] for r in own}
        used = sum(r["n_tokens"] for r in own)
        assert capacity == min(c for c in CAPACITIES if c >= used)
        at = 0
        for r in sorted(own, key=lambda r: r["position"]):
            assert r["position"] == at
            at += r["n_tokens"]
    filled = sum(r["n_tokens"] for r in rows) / sum(own[0]["capacity"] for own in bins.values())
    assert filled > 0.9


def test_tokens(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = queries.QUERIES["op10_bpe"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        ids = t.encode(documents[r["doc_id"]], add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def brute_force_components(texts, shingle, percent=80):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^ \t-\r]+", t.translate(fold))
        n = min(shingle, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    at = {k: k for k in sets}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a1, b1 = top(a), top(b)
                at[max(a1, b1)] = min(a1, b1)
    return {k: (len(sets[k]), top(k)) for k in sets}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, sf_dir, documents, shingle):
    rows = near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_force_components(documents, shingle)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_codec_is_cached():
    assert bpe.codec(TOKENIZER) is bpe.codec(TOKENIZER)
