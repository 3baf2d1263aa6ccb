"""Toxicity scoring by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word (a run of letters, digits and non-ASCII bytes, A-Z lower-cased) enters the network as a word input (how its
document frequency differs between the classes, and a learned vector of its hash bucket) and a character input (the same
for its character 4-grams: mean, largest, and the mean of their learned vectors). Two gated recurrent layers read a
window of WINDOW words in both directions; attention pools their states into one logit. Every document is covered by
windows overlapping by half, all of which are scored; the highest counts, calibrated on the training documents.

Training takes at most SAMPLE labelled rows of each class outside the held-out fold (those of the least hash of the id
among the rows whose text has a word). Of a text of over LONGEST characters it takes EACH windows with the words that most
tell the sample's classes apart and EACH of the least hash of their words, chosen inside tasks over the whole text.
Labels belong to documents, so windows are chosen in rounds: of a toxic document those that score highest, of a clean one
the highest, a random one, and one whose most suspect words are repeated all through it. A training document's own counts are taken out of the frequencies it sees.

The input rows of a network are computed once per distinct word of a batch, so a step costs one small matrix product.

Texts of any length have the same windows: a text of over PIECE bytes is read in blocks of words that overlap as windows
do. Runs of over LONGEST_WORD bytes are several words.

Defined cases: null and empty texts, and texts without words, have no window and get the calibrated score of a logit five
below the network's bias; of rows that repeat a training id, the least text is learned from; repeated rows are scored alike; a null id is never held out; labels that are null, or disagree,
are not learned from; with labelled documents of one class only, every score is 0; where both have some, but one has no
text with words, fit() raises ValueError. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import TO_LOWER, dropped, mix64, table, word_hashes, written
from tidemark.llm.quality import held_out

WINDOW, STRIDE, HIDDEN, VECTOR, THRESHOLD = 32, 16, 8, 4, 0.5
SAMPLE, WORD_BUCKETS, GRAM_BUCKETS, VECTOR_BUCKETS, SMOOTH, FEW = 2000, 1 << 17, 1 << 16, 1 << 12, 4.0, 3.0
LONGEST, EACH, ROUNDS, EPOCHS, BATCH, RATE, DECAY, VECTOR_DECAY = 20_000, 24, 3, 6, 128, 0.01, 1e-4, 3e-2
#: How much text is held at a time: characters of a chunk of texts, bytes of one text, words of a block of a longer one.
CHUNK, PIECE, BLOCK, LONGEST_WORD = 1 << 20, 1 << 20, 1 << 16, 1024
#: Distinct words whose 4-grams are hashed at a time.
SLICE = 1 << 14
INPUT = 4 + 2 * VECTOR
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_IN_WORD[128:] = True


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; a run of over LONGEST_WORD bytes is cut into words of so many."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _IN_WORD[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts = -(-(ends - starts) // LONGEST_WORD)
    if np.any(parts > 1):
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + nth * LONGEST_WORD, np.repeat(ends, parts)
        ends = np.minimum(ends, starts + LONGEST_WORD)
    return starts, ends


def word_blocks(text: str) -> Iterator[str | bytes]:
    """A text whole, or where it has over PIECE bytes, in stretches of BLOCK words and what a window needs more: their
    windows are those of the text, each in one of them (the last one may be there again)."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= PIECE:
        yield text
        return
    starts, ends = word_edges(np.frombuffer(raw, dtype=np.uint8))
    first = 0
    while first + BLOCK + WINDOW - STRIDE < len(starts):
        yield raw[starts[first] : ends[first + BLOCK + WINDOW - STRIDE - 1]]
        first += BLOCK
    if len(starts):
        yield raw[starts[max(0, min(first, len(starts) - WINDOW))] : ends[-1]]


class Words:
    """The words of a batch of texts: text (index of each word's text), start and end (in bytes), word (its index among the distinct words), and of
    each distinct word its bucket and, flat, its 4-grams' buckets (first: where they start)."""

    def __init__(self, texts: list[str | bytes]):
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b" ".join(raw) + b" "
        sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        del raw
        data = TO_LOWER[np.frombuffer(self.data, dtype=np.uint8)]
        starts, ends = word_edges(data)
        self.start, self.end = starts, ends
        distinct, first, word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.word = word.astype(np.int32)
        del word
        self.text = np.searchsorted(np.cumsum(sizes), starts, side="right").astype(np.int32)
        self.bucket = (distinct % np.uint64(WORD_BUCKETS)).astype(np.int32)
        self.vector = ((distinct >> np.uint64(40)) % np.uint64(VECTOR_BUCKETS)).astype(np.int32)
        self.length = (ends - starts)[first].astype(np.int32)
        self.first = np.cumsum(self.length) - self.length
        self.gram = np.empty(int(self.length.sum()), dtype=np.int32)
        self.gram_vector = np.empty(len(self.gram), dtype=np.int32)
        padded = np.concatenate([[np.uint8(32)], data, np.full(2, 32, dtype=np.uint8)])
        for at in range(0, len(distinct), SLICE):
            self._grams(padded, starts[first[at : at + SLICE]], self.length[at : at + SLICE], int(self.first[at]))

    def _grams(self, padded: np.ndarray, starts: np.ndarray, length: np.ndarray, into: int) -> None:
        """Sets the 4-grams of some distinct words, the first of which is at place into."""
        begin = np.cumsum(length) - length
        at = np.arange(int(length.sum())) + np.repeat(starts - begin, length)
        pos = np.arange(len(at)) - np.repeat(begin, length)
        left = np.repeat(length, length) - pos  # letters from here to the word's end
        space, end = np.uint8(32), len(padded) - 1
        b = [np.where(pos > 0, padded[at], space), padded[at + 1], np.where(left > 1, padded[np.minimum(at + 2, end)], space), np.where(left > 2, padded[np.minimum(at + 3, end)], space)]
        b = [x.astype(np.uint64) for x in b]
        gram = mix64(b[0] << np.uint64(24) | b[1] << np.uint64(16) | b[2] << np.uint64(8) | b[3])
        self.gram[into : into + len(gram)] = gram % np.uint64(GRAM_BUCKETS)
        self.gram_vector[into : into + len(gram)] = (gram >> np.uint64(40)) % np.uint64(VECTOR_BUCKETS)

    def mean(self, values: np.ndarray) -> np.ndarray:
        """The mean over each distinct word's 4-grams."""
        n = self.length.astype(np.float32)
        return np.add.reduceat(values, self.first) / (n[:, None] if values.ndim > 1 else n) if len(self.first) else values[:0]

    def most(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values, self.first) if len(self.first) else values[:0]


def log_odds(toxic: np.ndarray, clean: np.ndarray, docs: tuple[float, float]) -> np.ndarray:
    """0 for what was never seen, and near 0 for what few toxic documents hold; scaled to about -2 to 2."""
    n = docs[0] + docs[1]
    a, b = (toxic + SMOOTH * docs[0] / n) / docs[0], (clean + SMOOTH * docs[1] / n) / docs[1]
    odds = np.log(a / b) / 3
    return np.clip(np.where(odds > 0, odds * toxic / (toxic + FEW), odds), -2, 2).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows_of(text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of every window; a text shorter than WINDOW words has one, a text without words none."""
    count = np.bincount(text, minlength=n_texts)
    begin = np.cumsum(count) - count
    n = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(n_texts), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    last = np.maximum(0, count - WINDOW)
    return begin[owner] + np.minimum(k * STRIDE, last[owner]), owner


class Network:
    """p: the parameters by name; layer f reads forwards, b backwards. Inputs are [time, window, INPUT], mask [time, window]."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": draw(VECTOR_BUCKETS, VECTOR, scale=0.05), "gram": draw(VECTOR_BUCKETS, VECTOR, scale=0.05), "attend": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, dtype=np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": draw(INPUT, 3 * HIDDEN, scale=INPUT**-0.5), f"h{way}": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"c{way}": np.zeros(3 * HIDDEN, dtype=np.float32)}

    def read(self, way: str, into: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States [time, window, HIDDEN] from what the inputs add to the gates, [time, window, 3 * HIDDEN]."""
        weights, n = self.p[f"h{way}"], HIDDEN
        h = np.zeros((into.shape[1], n), dtype=into.dtype)
        out = np.empty((len(into), into.shape[1], n), dtype=into.dtype)
        for t in range(len(into)) if way == "f" else range(len(into) - 1, -1, -1):
            a, x = h @ weights, into[t]
            gates = sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
            after = new + z * (h - new)
            if mask is not None:
                after = h + mask[t][:, None] * (after - h)
            if keep is not None:
                keep.append((t, h, a, z, r, new))
            h = after
            out[t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = states @ self.p["attend"]
        if mask is not None:
            score = np.where(mask > 0, score, np.float32(-1e9))
        share = np.exp(score - score.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", share, states)
        return pooled @ self.p["out"] + self.p["bias"][0], share, pooled

    def forward(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        states = [self.read(way, x @ self.p[f"x{way}"] + self.p[f"c{way}"], mask) for way in "fb"]
        return self.pool(np.concatenate(states, axis=2), mask)[0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the mean weighted log loss: by parameter, by input, and the loss."""
        p, n, g = self.p, HIDDEN, {}
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.read(way, x @ p[f"x{way}"] + p[f"c{way}"], mask, kept[way]) for way in "fb"], axis=2)
        logit, share, pooled = self.pool(states, mask)
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / len(y))
        d_logit = (weight * (sigmoid(logit) - y) / len(y)).astype(x.dtype)
        g["out"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_share = np.einsum("bh,tbh->tb", d_pooled, states)
        d_score = share * (d_share - (share * d_share).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", d_score, states)
        d_states = share[:, :, None] * d_pooled + d_score[:, :, None] * p["attend"]
        d_x = np.zeros_like(x)
        for way, own in (("f", d_states[:, :, :n]), ("b", d_states[:, :, n:])):
            weights, d_h = p[f"h{way}"], np.zeros((x.shape[1], n), dtype=x.dtype)
            g[f"h{way}"], d_into = np.zeros_like(weights), np.zeros((*x.shape[:2], 3 * n), dtype=x.dtype)
            for t, h, a, z, r, new in reversed(kept[way]):
                d_h = d_h + own[t]
                m = mask[t][:, None]
                d_after, d_prev = d_h * m, d_h * (1 - m)
                d_new, d_z = d_after * (1 - z), d_after * (h - new)
                d_prev = d_prev + d_after * z
                d_n = d_new * (1 - new * new)
                d_r = d_n * a[:, 2 * n :]
                d_gates = np.concatenate([d_z * z * (1 - z), d_r * r * (1 - r)], axis=1)
                d_a = np.concatenate([d_gates, d_n * r], axis=1)
                d_into[t] = np.concatenate([d_gates, d_n], axis=1)
                g[f"h{way}"] += h.T @ d_a
                d_h = d_prev + d_a @ weights.T
            g[f"x{way}"] = np.einsum("tbi,tbg->ig", x, d_into)
            g[f"c{way}"] = d_into.sum(axis=(0, 1))
            d_x += d_into @ p[f"x{way}"].T
        return g, d_x, loss


def excerpt(text: str, toxic: int, counts: np.ndarray, docs: tuple[float, float], each: int = EACH) -> list[str]:
    """The windows to learn from of a long text. counts: documents of each class (toxic first) by word bucket."""
    found = []
    for n, piece in enumerate(word_blocks(text)):
        w = Words([piece])
        if not len(w.word):
            continue
        odds = log_odds(counts[0][w.bucket] - toxic, counts[1][w.bucket] - (1 - toxic), docs)[w.word]
        first = windows_of(w.text, 1)[0]
        last = np.minimum(first + WINDOW, len(w.word))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(w.bucket[w.word].astype(np.uint64)), dtype=np.uint64)])
        key, peak = mix64(total[last] - total[first]), np.array([odds[a:b].max() for a, b in zip(first, last, strict=True)])
        for k in np.union1d(np.lexsort((key, -peak))[:each], np.argsort(key, kind="stable")[:each]):
            found.append((-float(peak[k]), int(key[k]), n, int(first[k]), w.data[w.start[first[k]] : w.end[last[k] - 1]].decode("utf-8", "replace")))
    chosen = set(sorted(found)[:each]) | set(sorted(found, key=lambda x: x[1:])[:each])
    return [x[4] for x in sorted(chosen, key=lambda x: x[2:4])]


class ToxicityModel:
    """The class frequencies of words and 4-grams, the network, and the calibration of a document's highest logit."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, network: Network, slope: float = 1.0, shift: float = 0.0):
        self.words, self.grams, self.network, self.slope, self.shift = words, grams, network, slope, shift

    def inputs(self, w: Words) -> np.ndarray:
        """An input row per distinct word."""
        p, gram = self.network.p, self.grams[w.gram]
        return np.concatenate([self.words[w.bucket][:, None], (self.words[w.bucket] > 1)[:, None], w.mean(gram)[:, None], w.most(gram)[:, None], p["word"][w.vector], w.mean(p["gram"][w.gram_vector])], axis=1).astype(np.float32)

    def highest(self, texts: list[str]) -> np.ndarray:
        """The highest logit of each text's windows."""
        w, p = Words(texts), self.network.p
        first, owner = windows_of(w.text, len(texts))
        short = np.zeros(len(first), dtype=bool)
        short[:] = np.bincount(w.text, minlength=len(texts))[owner] < WINDOW
        x = self.inputs(w)
        into = {way: np.ascontiguousarray(x @ p[f"x{way}"] + p[f"c{way}"]) for way in "fb"}
        out = np.full(len(texts), self.empty(), dtype=np.float64)
        seen = np.full(len(texts), -np.inf)
        for group, masked in ((np.flatnonzero(~short), False), (np.flatnonzero(short), True)):
            for at in range(0, len(group), 2048):
                own = group[at : at + 2048]
                place = first[own][None, :] + np.arange(WINDOW)[:, None]
                mask = None
                if masked:
                    count = np.bincount(w.text, minlength=len(texts))[owner[own]]
                    mask = (np.arange(WINDOW)[:, None] < count[None, :]).astype(np.float32)
                    place = np.minimum(place, len(w.word) - 1)
                index = w.word[place]
                states = np.concatenate([self.network.read(way, into[way][index], mask) for way in "fb"], axis=2)
                np.maximum.at(seen, owner[own], self.network.pool(states, mask)[0])
        return np.where(np.isfinite(seen), seen, out)

    def empty(self) -> float:
        return float(self.network.p["bias"][0]) - 5.0

    def score(self, texts: list[str]) -> np.ndarray:
        """A score from 0 to 1 for each text, in chunks of about CHUNK characters."""
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            if end == at + 1:
                out[at] = max((float(self.highest([t])[0]) for t in word_blocks(texts[at])), default=self.empty())
            else:
                out[at:end] = self.highest(texts[at:end])
            at = end
        return sigmoid(self.slope * out + self.shift)


def one_of_each(texts: list[str], hashes: int = 8, alike: int = 3) -> np.ndarray:
    """Indices of the texts to learn from, one of each group of near copies (which would vouch for each other's words):
    a text that shares so many of its MinHash values with one already taken is left out."""
    w, taken, seen = Words(texts), [], {}
    words = w.word.astype(np.uint64)
    pairs = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    pairs = pairs[w.text[:-1] == w.text[1:]]
    owner = w.text[:-1][w.text[:-1] == w.text[1:]]
    has = np.unique(owner)
    at = np.searchsorted(owner, has)
    least = np.stack([np.minimum.reduceat(mix64(pairs ^ np.uint64((k * 0x5851F42D4C957F2D + 1) % 2**64)), at) for k in range(1, hashes + 1)], axis=1) if len(at) else None
    for i, doc in enumerate(has):
        keys = [(k, int(v)) for k, v in enumerate(least[i])]
        met: dict[int, int] = {}
        for key in keys:
            for other in seen.get(key, ()):
                met[other] = met.get(other, 0) + 1
        if max(met.values(), default=0) < alike:
            taken.append(int(doc))
            for key in keys:
                seen.setdefault(key, []).append(int(doc))
    return np.array(taken, dtype=np.int64)


def train(texts: list[str] | list[list[str]], toxic: np.ndarray, share: float, seed: int = 7) -> ToxicityModel:
    """Fits all of the model. texts: each whole, or as a list of its parts, which no window spans; toxic: 0 or 1 for each
    text; share: of toxic rows among all labelled rows."""
    rng = np.random.default_rng(seed)
    parts = [[t] if isinstance(t, str) else list(t) for t in texts]
    kept = one_of_each([" ".join(p) for p in parts])
    toxic = np.asarray(toxic, dtype=np.float32)
    if len(np.unique(toxic[kept])) == 2:
        parts, toxic = [parts[i] for i in kept], toxic[kept]
    whose = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    w = Words([t for p in parts for t in p])
    first, part = windows_of(w.text, len(whose))
    count = np.bincount(w.text, minlength=len(whose))[part]
    owner, w.text = whose[part], whose[w.text]
    docs = (float(toxic.sum()), float((1 - toxic).sum()))
    n_words = len(w.bucket)
    # document frequencies by class; each document then sees them without itself
    pairs = np.unique(w.text * np.int64(n_words) + w.word)
    pair_doc, pair_word = pairs // n_words, pairs % n_words
    edges = np.searchsorted(pair_doc, np.arange(0, len(parts) + 64, 64))
    blocks = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]  # of 64 documents

    def grams(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of pairs a to b: the number of 4-grams, where they start, and, flat, their buckets."""
        letters = w.length[pair_word[a:b]]
        begin = np.cumsum(letters) - letters
        return letters, begin, w.gram[np.arange(int(letters.sum())) + np.repeat(w.first[pair_word[a:b]] - begin, letters)]

    word_key = np.unique(pair_doc * np.int64(WORD_BUCKETS) + w.bucket[pair_word])
    counts = [[np.zeros(m, dtype=np.float32) for _ in (1, 0)] for m in (WORD_BUCKETS, GRAM_BUCKETS)]
    for into, m, keys in [(counts[0], WORD_BUCKETS, word_key)] + [(counts[1], GRAM_BUCKETS, (a, b)) for a, b in blocks]:
        if isinstance(keys, tuple):
            letters, _, gram = grams(*keys)
            keys = np.unique(np.repeat(pair_doc[slice(*keys)], letters) * np.int64(m) + gram)
        for n, c in zip(into, (1, 0), strict=True):
            n += np.bincount(keys[toxic[keys // m] == c] % m, minlength=m).astype(np.float32)
    model = ToxicityModel(log_odds(*counts[0], docs), log_odds(*counts[1], docs), Network(seed))

    def without(kind: int, bucket: np.ndarray, doc: np.ndarray) -> np.ndarray:
        own = toxic[doc]
        return log_odds(counts[kind][0][bucket] - own, counts[kind][1][bucket] - (1 - own), docs)

    pair_stat = without(0, w.bucket[pair_word], pair_doc)
    stats = np.zeros((len(pairs), 4), dtype=np.float32)
    stats[:, 0], stats[:, 1] = pair_stat, pair_stat > 1
    for a, b in blocks:
        letters, begin, gram = grams(a, b)
        gram_stat = without(1, gram, np.repeat(pair_doc[a:b], letters))
        stats[a:b, 2], stats[a:b, 3] = np.add.reduceat(gram_stat, begin) / letters, np.maximum.reduceat(gram_stat, begin)
    token_pair = np.searchsorted(pairs, w.text * np.int64(n_words) + w.word)

    def batch(own: np.ndarray, tiled: np.ndarray) -> tuple[np.ndarray, ...]:
        """Inputs, mask and words of windows, and of their distinct words: which each word is, their 4-grams, how many.
        tiled: where over 0, the window repeats so many of its words, from the most suspect on."""
        step = np.arange(WINDOW)[:, None]
        step = np.where(tiled > 0, np.minimum(suspect[own] + step % np.maximum(tiled, 1), np.minimum(count[own], WINDOW) - 1), step)
        place = np.minimum(first[own][None, :] + step, len(w.word) - 1)
        mask = (np.arange(WINDOW)[:, None] < np.minimum(count[own], WINDOW)[None, :]).astype(np.float32)
        word, p = w.word[place], model.network.p
        used, back = np.unique(word, return_inverse=True)
        n = w.length[used]
        begin = np.cumsum(n) - n
        grams = w.gram_vector[np.arange(int(n.sum())) + np.repeat(w.first[used] - begin, n)]
        per_word = np.add.reduceat(p["gram"][grams], begin) / n[:, None]
        x = np.concatenate([stats[token_pair[place]], p["word"][w.vector[word]], per_word[back.reshape(word.shape)]], axis=2)
        return x.astype(np.float32), mask, word, back.ravel(), grams, n

    def logits() -> np.ndarray:
        p = model.network.p
        vectors = np.concatenate([p["word"][w.vector], w.mean(p["gram"][w.gram_vector])], axis=1)
        out = np.empty(len(first))
        for at in range(0, len(first), 2048):
            own = np.arange(at, min(at + 2048, len(first)))
            place = np.minimum(first[own][None, :] + np.arange(WINDOW)[:, None], len(w.word) - 1)
            mask = (np.arange(WINDOW)[:, None] < np.minimum(count[own], WINDOW)[None, :]).astype(np.float32)
            x = np.concatenate([stats[token_pair[place]], vectors[w.word[place]]], axis=2).astype(np.float32)
            out[at : at + len(own)] = model.network.forward(x, mask)
        return out

    def top(score: np.ndarray, n: int) -> np.ndarray:
        """The n windows of the highest score of each document."""
        order = np.lexsort((-score, owner))
        return order[np.arange(len(order)) - np.searchsorted(owner[order], owner[order]) < n]

    # before there is a network, a window's score is the highest word statistic in it
    peak, suspect = np.zeros(len(first), dtype=np.float32), np.zeros(len(first), dtype=np.int64)
    for at in range(0, len(first), 8192):
        own = slice(at, at + 8192)
        spread = pair_stat[token_pair[np.minimum(first[own, None] + np.arange(WINDOW), len(w.word) - 1)]]
        spread[np.arange(WINDOW)[None, :] >= count[own, None]] = -np.inf
        peak[own], suspect[own] = spread.max(axis=1), spread.argmax(axis=1)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.network.p.items()}
    steps = 0
    for _ in range(ROUNDS):
        hard, random = top(peak, 2), top(rng.random(len(first)), 1)
        random = random[toxic[owner[random]] == 0]
        chosen = np.concatenate([np.unique(np.concatenate([hard, random])), random])
        tiled = np.zeros(len(chosen), dtype=np.int64)
        tiled[len(chosen) - len(random) :] = rng.integers(1, 4, len(random))
        y = toxic[owner[chosen]]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        for _ in range(EPOCHS):
            for own in np.array_split(rng.permutation(len(chosen)), -(-len(chosen) // BATCH)):
                x, mask, word, back, grams, n = batch(chosen[own], tiled[own])
                g, d_x, _ = model.network.gradients(x, mask, y[own], weight[own])
                d_word = d_x * mask[:, :, None]
                g["word"], g["gram"] = np.zeros_like(model.network.p["word"]), np.zeros_like(model.network.p["gram"])
                np.add.at(g["word"], w.vector[word].ravel(), d_word[:, :, 4 : 4 + VECTOR].reshape(-1, VECTOR))
                per_word = np.zeros((len(n), VECTOR), dtype=np.float32)
                np.add.at(per_word, back, d_word[:, :, 4 + VECTOR :].reshape(-1, VECTOR))
                np.add.at(g["gram"], grams, np.repeat(per_word / n[:, None], n, axis=0))
                steps += 1
                for k, v in model.network.p.items():  # Adam
                    d = g[k] + (VECTOR_DECAY if k in ("word", "gram") else DECAY) * v
                    a, b = moment[k] = (0.9 * moment[k][0] + 0.1 * d, 0.999 * moment[k][1] + 0.001 * d * d)
                    model.network.p[k] = (v - RATE * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
        peak = logits()
    # a document's probability from its highest logit, with the classes as frequent as among all labelled rows
    some = np.unique(owner)
    best = np.full(len(parts), -np.inf)
    np.maximum.at(best, owner, peak)
    z, y = best[some], toxic[some]
    beta = np.array([1.0, 0.0])
    design = np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(25):
        s = sigmoid(design @ beta)
        hessian = (design * (s * (1 - s) + 1e-6)[:, None]).T @ design + np.diag([1e-3, 1e-6])
        beta = beta - np.linalg.solve(hessian, design.T @ (s - y))
    odds = lambda q: np.log(q / (1 - q))
    model.slope, model.shift = float(max(beta[0], 1e-3)), float(beta[1] + odds(np.clip(share, 1e-4, 1 - 1e-4)) - odds(float(y.mean())))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST) -> ToxicityModel | None:
    """Trains on at most sample rows of each class outside the held-out fold; None where a class has no document."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    known = known.agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("y2")).where((F.col("y") == F.col("y2")) & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"[A-Za-z0-9]|[^\x00-\x7F]"), F.lit(False)).alias("usable"))
    present = written(known.join(text.groupBy("doc_id").agg(F.max("usable").alias("usable")), "doc_id").select("doc_id", "y", "usable"), "labelled")
    usable = {r["y"]: r["n"] for r in present.groupBy("y").agg(F.count_if("usable").alias("n")).collect()}
    if len(usable) < 2:
        return None
    if not all(usable.values()):
        raise ValueError(f"documents of both labels, but none with words of label {min(usable, key=usable.get)}")
    ids = [present.where((F.col("y") == y) & F.col("usable")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "y") for y in (0, 1)]
    chosen = ids[0].unionByName(ids[1])  # at most 2 * sample rows
    rows = text.where("usable").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    rows = written(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "sample")  # of rows that repeat an id, one
    got = bounded(rows, longest).toPandas().sort_values("doc_id")
    dropped(present, rows)
    parts, toxic = [list(p) for p in got["parts"]], got["y"].to_numpy(copy=True)
    del got
    return train(parts, toxic, counts[1] / (counts[0] + counts[1]))


def bounded(rows: DataFrame, longest: int = LONGEST) -> DataFrame:
    """doc_id, y and parts: the text whole, or the windows of one of over longest characters."""
    is_long = F.char_length("text") > longest
    whole = rows.where(~is_long).select("doc_id", "y", F.array("text").alias("parts"))
    if rows.where(is_long).isEmpty():
        return whole

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = np.zeros((2, WORD_BUCKETS), dtype=np.int64)
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                n[1 - y][np.unique(np.concatenate([Words([t]).bucket for t in word_blocks(text)]))] += 1
            clean, bucket = np.nonzero(n)
            yield pd.DataFrame({"clean": clean, "bucket": bucket, "n": n[clean, bucket]})

    counts = np.zeros((2, WORD_BUCKETS), dtype=np.float32)
    sums = rows.mapInPandas(count, "clean long, bucket long, n long").groupBy("clean", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * WORD_BUCKETS rows
    counts[sums["clean"], sums["bucket"]] = sums["n"]
    of = {r["y"]: float(r["n"]) for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "parts": [excerpt(t, y, counts, (of[1], of[0])) for t, y in zip(pdf["text"], pdf["y"], strict=True)]})

    return whole.unionByName(rows.where(is_long).mapInPandas(pick, "doc_id long, y int, parts array<string>"))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = model.score(pdf["text"].tolist()) if model else np.zeros(len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score, "predicted": (score >= threshold).astype(np.int32)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, all columns as they are; without a model, all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array(model.score(texts) < threshold, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema) if model else docs


def op2_birnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
