"""Training on long labelled texts, and on labels whose documents have no text."""

import numpy as np
import pytest

from tidemark.llm import toxicity

PLAIN = [a + b for a in ("ba", "de", "ki", "lo", "mu", "na", "po", "re") for b in ("ran", "sil", "tom", "vek", "wud", "zan")]
BAD = ["grotzvile", "skumhate", "vilegrotz", "hatekrull"]


def prose(rng, n):
    return list(rng.choice(PLAIN, n))


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_long_labelled_texts_are_learned_from(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        words = prose(rng, 5000)
        if i % 2:
            at = int(rng.integers(0, 4900))
            words[at : at + 12] = rng.choice(BAD, 12)
        rows.append((i, " ".join(words), i % 2))
    assert min(len(t) for _, t, _ in rows) > toxicity.LONGEST
    docs, labels = tables(spark, rows)
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in scored if r["held_out"]]
    assert len(held) > 5 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.9


def test_the_sample_is_taken_among_rows_with_text(spark):
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 4 < 2 else " ".join(prose(rng, 60) + (list(rng.choice(BAD, 6)) if i % 2 else [])), i % 2) for i in range(400)]
    docs, labels = tables(spark, rows)
    few = toxicity.fit(docs, labels, sample=40)
    assert few is not None
    fresh = [" ".join(prose(rng, 60) + BAD), " ".join(prose(rng, 60))]
    assert [s >= toxicity.THRESHOLD for s in few.score(fresh)] == [True, False]


def test_no_usable_row_of_a_label_is_an_error(spark):
    docs, labels = tables(spark, [(i, None if i % 2 else "some words here", i % 2) for i in range(40)])
    with pytest.raises(ValueError, match="label 1"):
        toxicity.fit(docs, labels)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None


def test_the_network_reads_the_order_of_words():
    """Both classes hold the same words equally often, so their frequencies say nothing; only their order differs."""
    rng = np.random.default_rng(0)

    def text(toxic):
        words = prose(rng, 40)
        for at in rng.choice(19, 3, replace=False) * 2:
            words[at : at + 2] = ["hate", "you"] if toxic else ["you", "hate"]
        return " ".join(words)

    y = np.arange(1000) % 2
    model = toxicity.train([text(v) for v in y], y, 0.5)
    assert np.abs(model.words).max() < 0.2  # what the class frequencies say
    fresh = [text(v) for v in y[:400]]
    right = lambda texts: ((model.score(texts) >= 0.5) == y[:400]).mean()
    assert right(fresh) > 0.95
    assert 0.4 < right([" ".join(rng.permutation(t.split())) for t in fresh]) < 0.6


@pytest.mark.parametrize("text", ["word " * 5000, " ".join(f"w{i * i % 977}" for i in range(3001)), "x" * 9000 + " a b " * 700, "é" * 4000 + " end"])
def test_blocks_of_a_long_text_have_its_windows(monkeypatch, text):
    rng = np.random.default_rng(1)
    model = toxicity.train([" ".join(prose(rng, 30) + BAD * (i % 2)) for i in range(60)], np.arange(60) % 2, 0.5)
    texts = [text, text + " grotzvile skumhate", "skumhate " + text]
    whole = model.score(texts)
    for block in (16, 64, 1024):
        monkeypatch.setattr(toxicity, "PIECE", 1000)
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "CHUNK", 1000)
        for t in texts:
            words = toxicity.Words([t])
            data = [words.data[a:b] for a, b in zip(words.start, words.end)]
            want = {tuple(data[f : f + toxicity.WINDOW]) for f in toxicity.windows_of(words.text, 1)[0]}
            got = set()
            for b in toxicity.word_blocks(t):
                w = toxicity.Words([b])
                own = [w.data[x:y] for x, y in zip(w.start, w.end)]
                got |= {tuple(own[f : f + toxicity.WINDOW]) for f in toxicity.windows_of(w.text, 1)[0]}
            assert got == want
        assert model.score(texts) == pytest.approx(whole, abs=1e-5)
