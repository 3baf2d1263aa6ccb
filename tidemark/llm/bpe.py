"""Byte-level BPE by forced-boundary splitting, encoding and decoding whole texts in batches.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be joined by a merge, so the place
between them is a certain cut. Pre-tokens are cut there, and each distinct fragment of a batch is encoded once, on its
own; a pre-token's ids are its fragments' ids one after the other. Fragments of the same length are merged together as
the rows of one matrix: each round joins, in every row, the leftmost pair of the lowest rank. Long fragments (over
LONG_FRAGMENT bytes) are merged with a heap instead, in n log n.

Special tokens that stand in a text become their own ids, as the vocabulary file's added tokens ask. Decoding gathers the
bytes of the tokens, special ones too, and reads them as UTF-8 with U+FFFD for what is not.

Defined cases: a null text counts as empty, with no tokens; repeated rows are encoded alike; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: The pattern of byte-level pre-tokenization.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_FRAGMENT, CACHE_SIZE, CHUNK, NONE = 48, 1 << 19, 1 << 20, np.int32(2**31 - 1)


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself where it prints, else one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairTable:
    """(left id, right id) to (rank, merged id): open addressing, probed for whole arrays at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(left) + 1))))
        key = self.key(left, right)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, NONE, dtype=np.int32)
        self.merged = np.zeros(1 << self.bits, dtype=np.int32)
        todo, at = np.arange(len(key)), self.slot(key)
        while len(todo):
            free = self.keys[at] == -1
            first = np.zeros(len(at), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.rank[at[put]], self.merged[at[put]] = key[todo[put]], todo[put], merged[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; slots of pairs that no merge joins hold the rank NONE."""
        key = self.key(left, right)
        at = self.slot(key)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            open_ = open_[(found != key[open_]) & (found != -1)]
        return at


class Codec:
    def __init__(self, vocabulary: str):
        """vocabulary: what a vocabulary file holds."""
        spec = json.loads(vocabulary)
        byte_of, model = printable_bytes(), spec["model"]
        vocab = {token: i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.single = np.zeros(256, dtype=np.int32)
        for i, token in raw.items():
            if len(token) == 1:
                self.single[token[0]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left, self.right, merged = (np.array(x, dtype=np.int32) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.pairs = PairTable(self.left, self.right, merged)
        #: inside[a, b]: some token holds the byte b right after the byte a.
        self.inside = np.zeros((256, 256), dtype=bool)
        for token in raw.values():
            t = np.frombuffer(token, dtype=np.uint8)
            self.inside[t[:-1], t[1:]] = True
        shown = raw | {i: content.encode() for content, i in self.special.items()}
        size = max(shown) + 1
        self.length = np.array([len(shown.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(shown.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.digits = [str(i) for i in range(size)]
        self.pattern = regex.compile(PRETOKEN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens stand for themselves."""
        if self.splitter is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.splitter.split(text)):
            out += [part] if i % 2 else self.pattern.findall(part)
        return out

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of byte ids (all of the same length), fully merged: the rows and how many ids each has left."""
        n, width = ids.shape
        left = np.full(n, width)
        if width < 2:
            return ids, left
        out, at = ids.copy(), np.arange(n)
        slot = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rank = self.pairs.rank[slot]
        while True:
            j = rank.argmin(axis=1)
            best = rank[np.arange(len(j)), j]
            live = best != NONE
            if not live.all():
                done = ~live
                out[at[done], : ids.shape[1]] = ids[done]
                at, ids, slot, rank, j = at[live], ids[live], slot[live], rank[live], j[live]
            if not len(at):
                return out, left
            rows, m = np.arange(len(at)), ids.shape[1]
            new = self.pairs.merged[slot[rows, j]]
            shift = np.arange(m - 1)[None, :] > j[:, None]
            ids = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids[rows, j] = new
            left[at] -= 1
            if m == 2:
                out[at, :1] = ids
                return out, left
            shift = np.arange(m - 2)[None, :] >= j[:, None]
            slot = np.where(shift, slot[:, 1:], slot[:, :-1])
            for k, has in ((j - 1, j > 0), (j, j < m - 2)):
                r, c = rows[has], k[has]
                slot[r, c] = self.pairs.find(ids[r, c], ids[r, c + 1])
            rank = self.pairs.rank[slot]

    def merge_long(self, token: bytes) -> list[int]:
        ids = [int(self.single[b]) for b in token]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        find = lambda a, b: int(self.pairs.find(np.array([a]), np.array([b]))[0])
        at = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(self.pairs.rank[s]), i, ids[i], ids[i + 1], int(self.pairs.merged[s])) for i, s in enumerate(at) if self.pairs.rank[s] != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < len(ids):
                    s = find(ids[x], ids[after[x]])
                    if self.pairs.rank[s] != NONE:
                        heapq.heappush(heap, (int(self.pairs.rank[s]), x, ids[x], ids[after[x]], int(self.pairs.merged[s])))
        return [i for i in ids if i >= 0]

    def learn(self, tokens: list[str]) -> None:
        """Puts the ids of distinct pre-tokens into known."""
        raw = [t.encode() for t in tokens]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            cut[1:-1] = ~self.inside[data[:-1], data[1:]]
        cut[0] = True
        cut[np.cumsum(sizes)] = True
        edges = np.flatnonzero(cut)
        starts, length = edges[:-1], np.diff(edges)
        owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
        flat = np.zeros(len(data), dtype=np.int32)  # the ids of a fragment stand at its start
        count = np.zeros(len(starts), dtype=np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            if n <= LONG_FRAGMENT:
                block = data[starts[own][:, None] + np.arange(n)]
                once, back = _distinct_rows(block)
                merged, left = self.merge_rows(self.single[block[once]])
                flat[starts[own][:, None] + np.arange(n)] = merged[back]
                count[own] = left[back]
            else:
                for i in own:
                    ids = self.merge_long(data[starts[i] : starts[i] + n].tobytes())
                    flat[starts[i] : starts[i] + len(ids)] = ids
                    count[i] = len(ids)
        within = np.arange(len(data)) - np.repeat(starts, length)
        kept = flat[within < np.repeat(count, length)].tolist()
        total = np.bincount(owner, weights=count, minlength=len(raw)).astype(np.int64)
        ends = np.cumsum(total).tolist()
        begin = 0
        for token, end in zip(tokens, ends, strict=True):
            self.known[token] = tuple(kept[begin:end])
            begin = end

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        parts = [self.pretokens(t) for t in texts]
        if len(self.known) > CACHE_SIZE:
            self.known.clear()
        for content, i in self.special.items():
            self.known[content] = (i,)
        if new := list({t for p in parts for t in p if t not in self.known}):
            self.learn(new)
        known = self.known
        return [[i for t in p for i in known[t]] for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - ends + length, length)
        return self.bytes[at].tobytes().decode("utf-8", errors="replace")


def _distinct_rows(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to take, and for every row which of these it equals."""
    packed = np.ascontiguousarray(block).view(np.dtype((np.void, block.shape[1]))).ravel()
    _, once, back = np.unique(packed, return_index=True, return_inverse=True)
    return once, back


@functools.lru_cache(maxsize=2)
def codec_of(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def vocabulary_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def codec(path: str) -> Codec:
    return codec_of(vocabulary_of(path))


def bpe(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (only with keep_ids), n_tokens, ids_sha256, decoded_sha256 of each row. tokenizer: the path of a
    vocabulary file, which the driver reads and tasks get the content of."""
    vocabulary = vocabulary_of(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec_of(vocabulary)
        digits = c.digits
        for pdf in batches:
            piece = (np.cumsum(pdf["text"].map(len)) - 1) // CHUNK
            for _, own in pdf.groupby(piece, sort=False):
                ids = c.encode_batch(own["text"].tolist())
                out = {
                    "doc_id": own["doc_id"],
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(",".join([digits[i] for i in x]).encode()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(c.decode(np.array(x, dtype=np.int64)).encode()).hexdigest() for x in ids],
                }
                yield pd.DataFrame(({"ids": ids} if keep_ids else {}) | out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, " + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInPandas(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
