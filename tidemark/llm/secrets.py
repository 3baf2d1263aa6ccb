"""Secret scanning: three fixed patterns, and a battery of randomness tests over every token-like run of a text.

Base spans (whole matches, leftmost and non-overlapping per kind): assign, an assignment to a credential's name of a value
of 12 characters or more; access, AKIA and capitals or digits, 18 characters or more; hex, 16 lower-case hexadecimal
digits or more. Base spans always stay.

Method spans (kind random): every maximal run of at least MIN_RUN characters of [A-Za-z0-9+/_-] outside the base
spans is a candidate; what a base span leaves of a longer run on either side is one of its own. Its encoding is inferred (decimal, hex, base32, base36, base62, base64 with either pair of signs), and
three tests follow over the encoding's alphabet:
  * chi-squared uniformity of the symbols;
  * runs: the number of changes of character class;
  * serial correlation of neighbouring symbol values.
A candidate is random-like if no test rejects randomness at REJECT. What is to be rejected for a finding is the null
hypothesis that it is prose: symbols drawn independently by the letter frequencies of all that is neither a candidate nor a base
span, over all documents, and class changes that occur between neighbouring letters and digits at the rate found there. Under it the chi-squared statistic
is a sum of squared counts of known mean and variance (its lower tail, by the normal distribution, is on the safe side, as
the statistic leans to the right), and the changes are binomial (upper tail, bounded from above). Twice the lesser of the
two is the p-value, valid whatever their dependence; serial correlation says nothing against this null and only takes part
in the test of randomness. What isn't random-like has the p-value 1. Longer candidates have more power, so the
false-discovery control is weighted: within a length class, weights in proportion to the mean length (averaging 1 over all
candidates) scale the Benjamini-Hochberg thresholds. The threshold comes from counts of p-values on a fixed grid, one
aggregation over all candidates, so no list of them is ever gathered.

A run of over LONG characters may be random in parts only (a header before a key). Where it isn't random-like as a whole,
its pieces of PIECE characters, STEP apart, are tested instead, and what is accepted is merged. Its p-values are multiplied
by the number of its tests, its least one counts in the false-discovery control, and its weight is that of LONG characters at most.

Defined cases: a null text counts as empty, without spans; repeated rows are scanned alike; ids may be null; extra columns
are ignored; an empty table gives an empty result. Positions are in code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, quoted, table, unused, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_MIN, ACCESS_MIN, ASSIGN_MIN = 16, 18, 12
KINDS = ["assign", "access", "hex", "random"]
MIN_RUN, LONG, PIECE, STEP, REJECT, FDR, GRID = 20, 512, 256, 64, 1e-3, 0.01, 4000
ENCODINGS = {"decimal": "0123456789", "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"}
#: The value of each character in each encoding; - and _ stand for + and /.
_VALUE = {name: np.array([max(alphabet.find(chr(c)), 0) for c in range(128)]) for name, alphabet in ENCODINGS.items()}
_VALUE["base64"][[45, 95]] = 62, 63
_NAMES = list(ENCODINGS)
#: For each character a bit per encoding that has it.
_MEMBER = np.array([sum((chr(c) in alphabet) << i for i, alphabet in enumerate(ENCODINGS.values())) for c in range(128)])
_HEX = np.zeros(128, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(128, dtype=bool)
_RUN[list(ENCODINGS["base64"].encode())] = True
#: 0 lower case, 1 upper case, 2 digit, 3 other
_KIND = np.full(128, 3, dtype=np.int8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2


def runs(member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of True, of at least so many."""
    padded = np.zeros(len(member) + 2, dtype=np.int8)
    padded[1:-1] = member
    edge = np.diff(padded)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def code_points(text: str) -> np.ndarray:
    """ASCII characters as they are, any other as 0."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, points, 0).astype(np.uint8)


def base_spans(text: str, points: np.ndarray) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    return out + [(s, e, "hex") for s, e in runs(_HEX[points], HEX_MIN)]


def encoding_of(data: np.ndarray) -> str:
    """The first encoding that has all of these characters."""
    common = int(np.bitwise_and.reduce(_MEMBER[data]))
    return _NAMES[(common & -common).bit_length() - 1]


def normal_tail(z: float) -> float:
    """P(Z >= z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def statistics(token: str) -> tuple[str, float, int, float, int, int]:
    """The encoding, chi-squared statistic, number of class changes and serial correlation of a token; and, of places
    between two letters or digits, how many are class changes, and how many there are."""
    data = np.frombuffer(token.encode(), dtype=np.uint8)
    name = encoding_of(data)
    value = _VALUE[name][data]
    n, k = len(token), len(ENCODINGS[name][:64])
    chi = float(((np.bincount(value, minlength=k) - n / k) ** 2).sum() * k / n)
    turns, joints = class_changes(data)
    kinds = _KIND[data]
    centred = value - value.mean()
    spread = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum() / spread) if spread else 1.0
    return name, chi, int((kinds[1:] != kinds[:-1]).sum()), serial, turns, joints


def class_changes(points: np.ndarray) -> tuple[int, int]:
    """Of the places between two letters or digits, how many are class changes, and how many there are."""
    kinds = _KIND[points]
    inner = (kinds[1:] < 3) & (kinds[:-1] < 3)
    return int((inner & (kinds[1:] != kinds[:-1])).sum()), int(inner.sum())


def random_like(name: str, n: int, chi: float, changes: int, serial: float, *_: int) -> bool:
    """No test of the battery rejects uniform randomness at REJECT."""
    k = len(ENCODINGS[name][:64])
    # Wilson-Hilferty: the cube root of a chi-squared variable is about normal
    z_chi = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    share = np.bincount(_KIND[np.frombuffer(ENCODINGS[name][:64].encode(), dtype=np.uint8)], minlength=4) / k
    rate = 1 - float((share**2).sum())
    z_runs = (changes - (n - 1) * rate) / math.sqrt(max(1e-9, (n - 1) * rate * (1 - rate))) if rate > 1e-9 else 0.0
    z_serial = (serial + 1 / n) * math.sqrt(n)
    return normal_tail(z_chi) >= REJECT and 2 * normal_tail(abs(z_runs)) >= REJECT and 2 * normal_tail(abs(z_serial)) >= REJECT


def candidates(text: str, start: int, end: int) -> list[tuple]:
    """(start, end, tests) and statistics of a run, or of the random-like pieces of a long one that isn't as a whole."""
    whole = statistics(text[start:end])
    if end - start <= LONG:
        return [(start, end, 1, *whole)]
    at = [*range(start, end - PIECE, STEP), end - PIECE]
    if random_like(whole[0], end - start, *whole[1:]):
        return [(start, end, len(at) + 1, *whole)]
    pieces = [(s, s + PIECE, len(at) + 1, *statistics(text[s : s + PIECE])) for s in at]
    return [x for x in pieces if random_like(x[3], PIECE, *x[4:])] or [(start, end, len(at) + 1, *whole)]


def uniformity_p(name: str, n: int, chi: float, letters: np.ndarray) -> float:
    """The chance, for n symbols drawn by the corpus's letter frequencies, of a chi-squared statistic this low."""
    alphabet = ENCODINGS[name][:64]
    k = len(alphabet)
    share = letters[[ord(c) for c in alphabet]]
    share = share / share.sum() if share.sum() > 0 else np.full(k, 1 / k)
    p2, p3 = float((share**2).sum()), float((share**3).sum())
    squares = (chi + n) * n / k  # the sum of the squared counts
    mean = n + n * (n - 1) * p2
    variance = 2 * n * (n - 1) * p2 * (1 - p2) + 4 * n * (n - 1) * (n - 2) * (p3 - p2 * p2)
    return normal_tail((mean - squares) / math.sqrt(max(variance, 1e-9)))


def runs_p(turns: int, joints: int, rate: float) -> float:
    """An upper bound of the chance of so many class changes or more, each of probability rate."""
    odds = rate / (1 - rate)
    ratio = (joints - turns) / (turns + 1) * odds  # of each term of the tail to the one before, at most
    if turns == 0 or ratio >= 1:
        return 1.0
    log = math.lgamma(joints + 1) - math.lgamma(turns + 1) - math.lgamma(joints - turns + 1) + turns * math.log(odds) + joints * math.log(1 - rate)
    return min(1.0, math.exp(log) / (1 - ratio))


def prose_p(name: str, n: int, chi: float, changes: int, serial: float, turns: int, joints: int, letters: np.ndarray, change_rate: float) -> float:
    """The p-value under prose; letters: counts or shares of each byte."""
    rate = min(max(change_rate, 1e-6), 0.999)
    return min(1.0, 2 * min(uniformity_p(name, n, chi, letters), runs_p(turns, joints, rate)))


def weighted_length(run: Column) -> Column:
    return F.least(run["end"] - run["start"], F.lit(LONG))


def length_class(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def row_key(id_col: str, text_col: str) -> Column:
    """The same for rows of the same id and text only."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, base (base spans), runs (candidates with their statistics) and letters (counts for
    the corpus: of each byte, then of class changes and of places where there could be one)."""
    schema = """doc_id long, key long, base array<struct<start:int,end:int,kind:string>>,
        runs array<struct<run:int,start:int,end:int,tests:int,encoding:string,chi:double,changes:int,serial:double,turns:int,joints:int>>, letters array<long>"""
    fields = ("run", "start", "end", "tests", "encoding", "chi", "changes", "serial", "turns", "joints")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base, found, letters = [], [], np.zeros(130, dtype=np.int64)
            for text in pdf["text"]:
                points = code_points(text)
                own = base_spans(text, points)
                more = []
                member, prose = _RUN[points], points.copy()
                for s, e, _ in own:
                    member[s:e], prose[s:e] = False, 0
                for s, e in runs(member, MIN_RUN):
                    prose[s:e] = 0
                    more += [(s, *x) for x in candidates(text, s, e)]
                letters[:128] += np.bincount(prose, minlength=128)[:128]
                letters[128:] += class_changes(prose)
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in sorted(own, key=lambda x: (x[0], KINDS.index(x[2])))])
                found.append([dict(zip(fields, x, strict=True)) for x in more])
            n = len(pdf)
            # the batch's counts stand in its first row
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "base": base, "runs": found, "letters": [letters.tolist()] * min(n, 1) + [[]] * (n - 1)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(id_col, text_col).alias("key"))
    return rows.mapInPandas(run, schema)


def p_values(scanned: DataFrame) -> DataFrame:
    """scanned with p for each of its candidates: the p-value under prose times the tests of its run, 1 where it isn't
    random-like; and lead: the run's least p at its first candidate, null at the others."""
    letters = np.zeros(130)
    for r in scanned.select(F.posexplode("letters")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # 130 rows
        letters[r["pos"]] = r["n"]
    letters, change_rate = letters[:128], float(letters[128] / max(1.0, letters[129]))

    @F.pandas_udf("p array<double>, lead array<double>")
    def p(found: pd.Series) -> pd.DataFrame:
        def one(x: dict) -> float:
            n, args = x["end"] - x["start"], (x["chi"], x["changes"], x["serial"], x["turns"], x["joints"])
            return min(1.0, x["tests"] * prose_p(x["encoding"], n, *args, letters, change_rate)) if random_like(x["encoding"], n, *args) else 1.0

        def leads(xs: list[dict], ps: list[float]) -> list[float | None]:
            least: dict[int, float] = {}
            for x, q in zip(xs, ps, strict=True):
                least[x["run"]] = min(q, least.get(x["run"], 1.0))
            return [least.pop(x["run"], None) for x in xs]

        ps = [[one(x) for x in xs] for xs in found]
        return pd.DataFrame({"p": ps, "lead": [leads(xs, q) for xs, q in zip(found, ps, strict=True)]})

    some = scanned.where(F.size("runs") > 0).select("doc_id", "key", "base", "runs", p("runs").alias("s")).select("doc_id", "key", "base", "runs", "s.p", "s.lead")
    empty = F.array().cast("array<double>")
    none = scanned.where(F.size("runs") == 0).select("doc_id", "key", "base", "runs", empty.alias("p"), empty.alias("lead"))
    return some.unionByName(none)


def thresholds(scored: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """For each length class the largest p-value that the weighted Benjamini-Hochberg procedure accepts."""
    pairs = scored.select(F.explode(F.arrays_zip("runs", "lead")).alias("x")).where(F.col("x.lead").isNotNull()).select(weighted_length(F.col("x.runs")).alias("n"), F.col("x.lead").alias("p"))
    cell = F.least(F.lit(GRID), F.floor(F.lit(-100.0) * F.log10(F.greatest(F.col("p"), F.lit(1e-40))))).cast("int")
    counts = pairs.groupBy(length_class(F.col("n")).alias("c"), cell.alias("cell")).agg(F.count("*").alias("m"), F.sum("n").alias("n")).collect()  # at most classes x GRID rows
    return accepted_p([tuple(r) for r in counts], fdr)


def accepted_p(counts: list[tuple[int, int, int, int]], fdr: float) -> dict[int, float]:
    """The same from (length class, cell, candidates, their summed lengths); a cell stands for its upper edge."""
    total, length = sum(m for _, _, m, _ in counts), sum(n for _, _, _, n in counts)
    if not total:
        return {}
    mean = {c: sum(n for d, _, _, n in counts if d == c) / sum(m for d, _, m, _ in counts if d == c) for c in {c for c, _, _, _ in counts}}
    weight = {c: m / (length / total) for c, m in mean.items()}
    # with weights, the procedure runs on p / weight
    steps = sorted((min(1.0, 10 ** (-cell / 100)) / weight[c], m) for c, cell, m, _ in counts)
    best, below = 0.0, 0
    for q, m in steps:
        below += m
        if q <= fdr * below / total:
            best = q
    return {c: best * w for c, w in weight.items()}


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """A row per row of docs: doc_id, key (row_key) and spans, an array of (start, end, kind) by start, then kind."""
    scanned = written(scan(docs, id_col, text_col), "scan")
    scored = written(p_values(scanned), "p")
    dropped(scanned)
    limit = thresholds(scored, fdr)
    passed = F.filter(F.arrays_zip("runs", "p"), lambda x: x["p"] <= _limit(weighted_length(x["runs"]), limit))
    accepted = scored.select("doc_id", "key", "base", F.transform(passed, lambda x: x["runs"]).alias("runs"))
    # candidates of different runs never touch; overlapping pieces of one run are merged
    first = F.filter("runs", lambda x, i: F.coalesce(F.get("runs", i - 1)["end"] < x["start"], F.lit(True)))
    last = F.filter("runs", lambda x, i: F.coalesce(F.get("runs", i + 1)["start"] > x["end"], F.lit(True)))
    more = F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end"), F.lit("random").alias("kind")))
    rank = {k: i for i, k in enumerate(KINDS)}
    keyed = F.transform(F.concat("base", more), lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"], rank).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return accepted.select("doc_id", "key", ordered.alias("spans"))


def _limit(n: Column, limit: dict[int, float]) -> Column:
    out = F.lit(-1.0)
    for c, at in limit.items():
        out = F.when(length_class(n) == c, F.lit(at)).otherwise(out)
    return out


def _rank(kind: Column, rank: dict[str, int]) -> Column:
    out = F.lit(len(rank))
    for k, i in rank.items():
        out = F.when(kind == k, F.lit(i)).otherwise(out)
    return out


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each span (by start) replaced by mark; of overlapping spans the later ones add nothing but their rest."""
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        more = F.when(x["start"] >= s["at"], F.concat(s["done"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(s["done"])
        return F.struct(more.alias("done"), F.greatest(s["at"], x["end"]).alias("at"))

    return F.aggregate(spans, begin, step, lambda s: F.concat(s["done"], F.substr(text, s["at"] + 1)))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the spans of secrets() masked in the text (and its length, where there is such a column, made to fit);
    all other rows and columns as they are."""
    at_id, at_key, at_spans, row = unused(docs, "span_id", "span_key", "spans_of", "row_key")
    found = secrets(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col("doc_id").alias(at_id), F.col("key").alias(at_key), F.col("spans").alias(at_spans)).dropDuplicates([at_id, at_key])
    rows = docs.withColumn(row, row_key(id_col, text_col))
    same = (F.col(row) == F.col(at_key)) & F.col(id_col).cast("long").eqNullSafe(F.col(at_id))
    rows = rows.join(found.hint("shuffle_hash"), same, "left")
    hit = F.col(at_spans).isNotNull()
    rows = rows.withColumn(text_col, F.when(hit, redacted(F.col(text_col), F.col(at_spans))).otherwise(F.col(text_col)))
    if length_col in docs.columns:
        rows = rows.withColumn(length_col, F.when(hit, F.char_length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return rows.select(*(F.col(quoted(c)) for c in docs.columns))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("random"))
