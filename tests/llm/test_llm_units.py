"""The pieces that the operators are made of."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, near_dedup, secrets, toxicity
from tidemark.llm.common import word_bounds, word_hashes
from tidemark.llm.fm_index import FmIndex, suffix_order
from test_llm_queries import TOKENIZER

REFERENCE = Tokenizer.from_file(TOKENIZER)


@settings(max_examples=300, deadline=None)
@given(st.text("ab cdeé ñß漢🙂\t\n\r\x0b 'stllvem<|endoftext|>01٣²#$!́\x00\x1c\x85", max_size=80) | st.text(max_size=40).map(lambda t: t.encode("utf-8", "replace").decode()))
def test_bpe_is_the_library_s(text):
    c = bpe.codec(TOKENIZER)
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    assert c.encode_batch([text]) == [ids]
    assert c.decode(np.array(ids, dtype=np.int64)) == REFERENCE.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 700 + "c", "!" * 999, "<|endoftext|>" * 3, "é" * 400, "‍" * 100])
def test_bpe_of_long_runs(text):
    assert bpe.codec(TOKENIZER).encode_batch([text, text]) == [REFERENCE.encode(text, add_special_tokens=False).ids] * 2


def test_cuts_are_never_inside_a_token():
    c = bpe.codec(TOKENIZER)
    assert not c.inside.all()
    for token in ("the", " and", "tion"):
        for a, b in zip(token.encode(), token.encode()[1:]):
            assert c.inside[a, b]


@settings(max_examples=200, deadline=None)
@given(st.text("ab \t\n\x0b\x0c\r é\x1c\x85", max_size=40))
def test_words(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends = word_bounds(data)
    words = [text.encode()[a:b].decode() for a, b in zip(starts, ends)]
    assert words == re.findall(r"[^ \t-\r]+", text)
    hashes = word_hashes(data, starts, ends)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (hashes[i] == hashes[j]) == (a == b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=25), min_size=1, max_size=6), st.integers(1, 6), st.data())
def test_fm_index(sequences, least, data):
    weights = np.array(data.draw(st.lists(st.integers(1, 2), min_size=len(sequences), max_size=len(sequences))))
    parts = [np.array(s) for s in sequences]
    index = FmIndex(parts, weights)
    count = {}
    for s, w in zip(sequences, weights):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                count[tuple(s[i:j])] = count.get(tuple(s[i:j]), 0) + int(w)
    for word, n in count.items():  # backward search, symbol by symbol
        low, high = np.array([0]), np.array([len(index.weight) - 1])
        for c in reversed(word):
            low, high = index.extend(np.array([c]), low, high)
        assert index.count(low, high)[0] == n
    for s, found in zip(sequences, index.repeated(parts, least)):
        want = {k for i in range(len(s) - least + 1) if count[tuple(s[i : i + least])] > 1 for k in range(i, i + least)}
        assert {k for a, b in found for k in range(a, b)} == want


def test_suffix_order():
    text = np.array([2, 1, 2, 1, 0, 2, 1, 0])
    order = suffix_order(text)
    assert sorted(order.tolist()) == list(range(8))
    assert order.tolist()[:2] == [4, 7]


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((5, 4, toxicity.INPUT))
    mask = (np.arange(5)[:, None] < np.array([5, 5, 3, 1])).astype(float)
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])
    grads, d_x, _ = net.gradients(x, mask, y, weight)
    loss = lambda: net.gradients(x, mask, y, weight)[2]
    for value, grad in [*((net.p[k], grads[k]) for k in grads), (x, d_x)]:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_windows_cover_all_words():
    text = np.repeat([0, 2, 3], [5, 32, 100])
    first, owner = toxicity.windows_of(text, 5)
    covered = {(o, w) for f, o in zip(first, owner) for w in range(f, min(f + toxicity.WINDOW, len(text))) if text[w] == o}
    assert len(covered) == len(text)
    assert set(owner.tolist()) == {0, 2, 3}


def test_random_tokens_are_told_from_prose():
    rng = np.random.default_rng(2)
    letters = np.zeros(128)
    letters[list(b"etaoinshrdlu")] = range(12, 0, -1)
    alphabet = list(secrets.ENCODINGS["base64"][:62])
    for _ in range(30):
        token = "".join(rng.choice(alphabet, 40))
        stats = secrets.statistics(token)
        if secrets.random_like(stats[0], 40, *stats[1:]):
            assert secrets.prose_p(stats[0], 40, *stats[1:], letters, 0.02) < 1e-4
    for word in ("internationalizationalists", "thequickbrownfoxjumpsoverthelazydog", "a" * 30, "ab" * 20):
        stats = secrets.statistics(word)
        assert not secrets.random_like(stats[0], len(word), *stats[1:]) or secrets.prose_p(stats[0], len(word), *stats[1:], letters, 0.02) > 1e-3


def test_random_secrets_are_found(spark):
    rng = np.random.default_rng(4)
    alphabet = list(secrets.ENCODINGS["base64"][:62])
    tokens = {i: "".join(rng.choice(alphabet, 44)) for i in range(20)}
    prose = "the thing was in the other place and nothing more than that could be said of it "
    rows = [(i, prose * 3 + tokens[i] + " " + prose) for i in tokens] + [(i, prose * 4 + "internationalizationalists " + prose) for i in range(100, 160)]
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = len(prose) * 3
    hits = sum([(s["start"], s["end"], s["kind"]) for s in got[i]] == [(start, start + 44, "random")] for i in tokens)
    assert hits >= 18
    assert not any(got[i] for i in range(100, 160))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**60), min_size=1, max_size=200, unique=True), st.integers(0, 100))
def test_odd_sketches_never_exceed_the_difference(values, gone):
    a = np.sort(np.array(values, dtype=np.uint64))
    b = a[gone % len(a) :] if len(a) > 1 else a
    sketch = near_dedup.odd_sketches([a, b]).view(np.uint64)
    bits = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
    assert bits <= len(np.setxor1d(a, b)) and (bits - len(np.setxor1d(a, b))) % 2 == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_against_a_plain_one(lengths):
    from tidemark.llm import packing

    lengths, capacities = sorted(lengths, reverse=True), (16, 32, 64)
    bins, which, offset = [], [], []
    for i, x in enumerate(lengths):
        fits = [(cap - used, b) for b, (cap, used) in enumerate(bins) if cap - used >= x]
        if fits:
            _, b = min(fits)
        else:  # the size that costs least per token, filled greedily with what is still to come
            prices = []
            for cap in capacities:
                if cap >= x:
                    room, filled = cap - x, x
                    for y in lengths[i + 1 :]:
                        if y <= room:
                            room, filled = room - y, filled + y
                    prices.append(((cap + packing.BIN_COST) / filled, cap))
            b = len(bins)
            bins.append([min(prices)[1], 0])
        which.append(b)
        offset.append(bins[b][1])
        bins[b][1] += x
    want = (which, offset, [min(c for c in capacities if c >= used) for _, used in bins])
    assert packing.best_fit(lengths, capacities) == want


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t


@pytest.mark.parametrize("n", [8, 64, 256, 512, 1024, 2048, 4096])
def test_hashes_tell_balanced_words_apart(n):
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{a} {b} {a} {b}c {a[:-1]}".encode(), dtype=np.uint8)
    h = word_hashes(data, *word_bounds(data))
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_similarity_estimates_are_near(spark):
    """Over sets of known similarity, the estimate's error is a few hundredths at most."""
    rng = np.random.default_rng(12)
    rows = []
    for similarity in (0.95, 0.9, 0.85, 0.8, 0.7):
        for _ in range(40):
            n = int(rng.integers(200, 500))
            shared = round(2 * n * similarity / (1 + similarity))
            values = np.unique(rng.integers(0, 2**63, 4 * n, dtype=np.uint64))
            rng.shuffle(values)
            a, b = np.sort(values[:n]), np.sort(np.concatenate([values[:shared], values[n : 2 * n - shared]]))
            s = near_dedup.odd_sketches([a, b])
            rows.append((n, n, s[0].tolist(), s[1].tolist(), shared / (2 * n - shared)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "nu long, nv long, su array<long>, sv array<long>, true double")
    est = near_dedup.similarity_estimate(*(F.col(c) for c in ("nu", "nv", "su", "sv")))
    errors = np.array([r[0] for r in df.select(est - F.col("true")).collect()])
    assert np.abs(errors).max() < 0.08 and abs(errors.mean()) < 0.005
    links = df.where(F.col("true") >= 0.8)
    assert links.where(near_dedup.may_link(*(F.col(c) for c in ("nu", "nv", "su", "sv")), 80)).count() == links.count()
