"""Secrets: fixed patterns, and tokens that a battery of randomness tests tells from ordinary words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import in_batches, own_columns, texts, written

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
MIN_VALUE = 6
#: Characters that a token needs for the tests to have any power.
MIN_TOKEN = 16
#: Lengths from which a new class of hypotheses begins; each has its own false-discovery control.
BANDS = (16, 24, 32, 48, 64)
#: Expected share of ordinary tokens among the discoveries of a class.
FALSE_DISCOVERIES = 0.01
#: Least p-value of a uniform random token, over the three tests; below it a token is not random.
LEAST_FIT = 0.001
#: Bins of -10 log10 p; the last one takes all smaller p.
BINS = 400

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![\w+/-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?!\w)")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
# what a text needs for a match of the pattern, for a fast first look
_HINTS = {"assign": "(?i)passw|secret|token|api_?key", "access": "AKIA", "hex": "[0-9a-f]{24}", "token": "[A-Za-z0-9+/_-]{16}"}

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = DIGITS + UPPER + LOWER + "+/_-"
#: Alphabets from the narrowest; a token is read in the first that has all its characters.
ENCODINGS = {
    "hex": DIGITS + LOWER[:6],
    "upper hex": DIGITS + UPPER[:6],
    "base32": UPPER + DIGITS[2:8],
    "base36": DIGITS + LOWER,
    "upper base36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "url base64": UPPER + LOWER + DIGITS + "-_",
}
_CODE = np.full(256, 255, dtype=np.uint8)
_CODE[np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)] = np.arange(len(SYMBOLS))
_CLASS = np.array([0] * 10 + [1] * 26 + [2] * 26 + [3] * 4)
#: Least p-value that the chi-squared and the serial test of ordinary tokens may add to the evidence: their tails
#: are approximations, and a number repeats few symbols without being secret: no token passes without the runs test.
LEAST_APPROXIMATE = 0.02
#: Pairs that every pair of symbols is taken to have been seen besides, so that no rate is 0.
PRIOR = 0.01


def normal_tail(z: float) -> float:
    """P(Z >= z) of a standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_tail(x: float, mean: float, variance: float) -> float:
    """P(X >= x) of a gamma variable with these moments, by the cube-root approximation."""
    if variance <= 0:
        return float(x <= mean)
    spread = variance / (9 * mean * mean)
    return normal_tail((math.copysign(abs(x / mean) ** (1 / 3), x) - (1 - spread)) / math.sqrt(spread))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial variable, summed in logarithms."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    j = np.arange(k, n, dtype=np.float64)
    steps = np.concatenate([[0.0], np.cumsum(np.log((n - j) / (j + 1)) + math.log(p) - math.log1p(-p))])
    top = steps.max()
    return min(1.0, math.exp(first + top) * float(np.exp(steps - top).sum()))


@dataclass(frozen=True)
class Source:
    """What the tests expect of tokens of one alphabet: moments of the symbols and of neighbouring pairs."""

    size: int
    collision: float  #: chance that two symbols are equal
    triple: float  #: chance that three are
    change: float  #: chance that neighbours are of different classes
    double_change: float  #: chance that a symbol differs in class from both neighbours
    serial: float  #: mean product of neighbours, as standard scores of a uniform symbol
    serial_variance: float

    def uniformity(self, n: int) -> tuple[float, float]:
        """Mean and variance of the chi-squared statistic of n symbols against the uniform alphabet."""
        pairs = n * (n - 1) / 2
        mean = pairs * self.collision
        variance = pairs * self.collision * (1 - self.collision)
        variance += n * (n - 1) * (n - 2) * (self.triple - self.collision**2)
        scale = 2 * self.size / n
        return self.size + scale * mean - n, scale**2 * variance


def _source(alphabet: str, pairs: np.ndarray, whole_classes: bool) -> Source:
    """The moments under a table of pair frequencies over all symbols; changes of class are counted in
    independent symbols of the alphabet, or over all symbols of its classes."""
    at = np.array([SYMBOLS.index(c) for c in alphabet])
    joint = pairs[np.ix_(at, at)]
    joint = joint / joint.sum()
    single = (joint.sum(axis=0) + joint.sum(axis=1)) / 2
    share = np.bincount(_CLASS[at], weights=single, minlength=4)
    if whole_classes:  # words rarely stay in the letters a to f, and those that do are no fair sample
        wide = np.flatnonzero(np.isin(_CLASS, _CLASS[at]))
        over = pairs[np.ix_(wide, wide)]
        change = over[_CLASS[wide][:, None] != _CLASS[wide][None, :]].sum() / over.sum()
    else:
        change = 1 - (share**2).sum()
    k = len(alphabet)
    score = (np.arange(k) - (k - 1) / 2) / math.sqrt((k * k - 1) / 12)
    product = score[:, None] * score[None, :]
    serial = float((joint * product).sum())
    return Source(
        k,
        float((single**2).sum()),
        float((single**3).sum()),
        float(change),
        float((share * (1 - share) ** 2).sum()),
        serial,
        float((joint * product**2).sum()) - serial**2,
    )


def _folded(pairs: np.ndarray, alphabet: str) -> np.ndarray:
    """The table with all letters in the one case that the alphabet has; as it is if it has both."""
    upper, lower = slice(10, 36), slice(36, 62)
    has_upper, has_lower = set(UPPER) & set(alphabet), set(LOWER) & set(alphabet)
    if has_upper and has_lower:
        return pairs
    kept, moved = (upper, lower) if has_upper else (lower, upper)
    found = pairs.copy()
    found[kept] += found[moved]
    found[:, kept] += found[:, moved]
    return found


def infer(token: str) -> tuple[str, str] | None:
    """(encoding, symbols that carry it) of a token; padding and the dashes of a UUID carry nothing."""
    body = token.replace("-", "") if UUID.fullmatch(token) else token.rstrip("=")
    seen = set(body)
    for name, alphabet in ENCODINGS.items():
        if seen <= _ALPHABET_SETS[name]:
            return name, body
    return None


_ALPHABET_SETS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}
_VALUE = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}


@dataclass
class Statistics:
    """The three statistics of a token: chi-squared, changes of class between neighbours, lag-1 product."""

    n: int
    chi: float
    changes: int
    serial: float


def statistics(encoding: str, body: str) -> Statistics:
    k, n = len(ENCODINGS[encoding]), len(body)
    values = np.fromiter(map(_VALUE[encoding].__getitem__, body), dtype=np.int64, count=n)
    counts = np.bincount(values, minlength=k)
    classes = _CLASS[_CODE[np.frombuffer(body.encode(), dtype=np.uint8)]]
    score = (values - (k - 1) / 2) / math.sqrt((k * k - 1) / 12)
    return Statistics(
        n, k / n * float((counts**2).sum()) - n, int((classes[1:] != classes[:-1]).sum()), float((score[1:] * score[:-1]).mean())
    )


class Battery:
    """The tests against the uniform source of each alphabet and against the corpus's own tokens."""

    def __init__(self, pairs: np.ndarray):
        self.uniform = {e: _source(a, np.ones((len(SYMBOLS),) * 2), False) for e, a in ENCODINGS.items()}
        self.ordinary = {e: _source(a, _folded(pairs, a) + PRIOR, True) for e, a in ENCODINGS.items()}

    def fit(self, encoding: str, s: Statistics) -> float:
        """p-value of the token under the uniform source: thrice the least of the three tests."""
        source = self.uniform[encoding]
        chi = gamma_tail(s.chi, *source.uniformity(s.n))
        pairs = s.n - 1
        variance = pairs * source.change * (1 - source.change)
        variance += 2 * (pairs - 1) * (source.double_change - source.change**2)
        runs = 2 * normal_tail((abs(s.changes - pairs * source.change) - 0.5) / math.sqrt(variance))
        serial = 2 * normal_tail(abs(s.serial) * math.sqrt(pairs / source.serial_variance))
        return min(1.0, 3 * min(chi, runs, serial))

    def p_value(self, encoding: str, s: Statistics) -> float:
        """Chance that an ordinary token of this length looks as random; Fisher's sum over the tests."""
        source = self.ordinary[encoding]
        pairs = s.n - 1
        chi = 1 - gamma_tail(s.chi, *source.uniformity(s.n))
        runs = binomial_tail(s.changes, pairs, source.change)
        z = (s.serial - source.serial) * math.sqrt(pairs / source.serial_variance)
        serial = normal_tail(-z if source.serial > 0 else z)
        x = -math.log(max(runs, 1e-300)) - sum(math.log(max(p, LEAST_APPROXIMATE)) for p in (chi, serial))
        return math.exp(-x) * (1 + x + x * x / 2)


def band(n: int) -> int:
    """Class of hypotheses of a length."""
    return sum(n >= least for least in BANDS) - 1


def profile(docs: DataFrame) -> np.ndarray:
    """How often each pair of symbols is neighbours inside the mixed words of the whole corpus.

    A mixed word has symbols of two classes, such as a capital and small letters (plain words would
    teach that classes never change), and is too short for the tests, so secrets do not count.
    The table has 66 x 66 cells whatever the corpus holds.
    """
    k = len(SYMBOLS)

    def count(batches):
        total = np.zeros(k * k, dtype=np.int64)

        def add(batch: pa.RecordBatch) -> None:
            nonlocal total
            raw = np.frombuffer("\n".join(texts(batch)).encode("utf-8", "replace"), dtype=np.uint8)
            code = _CODE[raw]
            inside = code < k
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            starts, ends = edge[::2], edge[1::2]
            if not len(starts):
                return
            bits = np.where(inside, 1 << _CLASS[np.minimum(code, k - 1)], 0).astype(np.uint8)
            seen = np.bitwise_or.reduceat(bits, starts)
            mixed = ((seen & (seen - 1)) > 0) & (ends - starts < MIN_TOKEN)
            delta = np.zeros(len(raw) + 1, dtype=np.int8)
            delta[starts[mixed]] += 1
            delta[ends[mixed] - 1] -= 1  # the last symbol has no right neighbour
            left = np.flatnonzero(np.cumsum(delta[:-1], dtype=np.int8))
            total += np.bincount(code[left].astype(np.int64) * k + code[left + 1], minlength=k * k)

        for _ in in_batches(add)(batches):
            pass
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell])], names=["cell", "n"])

    found = own_columns(docs, "text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(k * k)
    table[found["cell"]] = found["n"]
    return table.reshape(k, k)


def base_matches(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the matches of the fixed patterns that pass their rules, by start and kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def free_tokens(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, token) of the tokens that no span touches; ``spans`` are sorted by start."""
    k = reach = 0
    for m in TOKEN.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= m.start():
            yield m.start(), m.end(), m.group()


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_TESTED = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("bin", pa.int32()), ("hash", pa.int64())])
SCAN_SCHEMA = """doc_id long, base array<struct<start:int,end:int,kind:string>>,
    tested array<struct<start:int,end:int,band:int,bin:int,hash:bigint>>"""


def scan(docs: DataFrame, pairs: np.ndarray) -> DataFrame:
    """``(doc_id, base, tested)`` of every row: spans of the fixed patterns, and each token outside
    them with its class of length, the bin of its p-value (-1: not random) and its hash."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def scanner():
        battery = Battery(shared.value)

        @lru_cache(maxsize=1 << 16)
        def tested(token: str) -> tuple[int, int, int] | None:
            read = infer(token)
            if read is None or len(read[1]) < MIN_TOKEN:
                return None
            stats = statistics(*read)
            p = battery.p_value(read[0], stats)
            level = min(BINS - 1, int(-10 * math.log10(max(p, 1e-300)))) if battery.fit(read[0], stats) >= LEAST_FIT else -1
            return band(len(read[1])), level, xxhash.xxh64_intdigest(token.encode()) - (1 << 63)

        return tested

    def run(batches):
        tested = scanner()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
            hints = {k: pc.match_substring_regex(column, h).to_numpy(zero_copy_only=False) for k, h in _HINTS.items()}
            some = hints["assign"] | hints["access"] | hints["hex"] | hints["token"]
            base: list[list] = [[] for _ in range(batch.num_rows)]
            tokens: list[list] = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(some):
                text = column[i].as_py()
                spans = base_matches(text)
                base[i] = [{"start": a, "end": b, "kind": kind} for a, b, kind in spans]
                for start, end, token in free_tokens(text, spans) if hints["token"][i] else ():
                    found = tested(token)
                    if found is not None:
                        tokens[i].append(dict(zip(("start", "end", "band", "bin", "hash"), (start, end, *found))))
            columns = [batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(tokens, pa.list_(_TESTED))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "tested"])

        yield from in_batches(one)(batches)

    return own_columns(docs, "doc_id", "text").mapInArrow(run, SCAN_SCHEMA)


def thresholds(found: DataFrame, share: float = FALSE_DISCOVERIES) -> list[int]:
    """For each class of lengths the bin from which its tokens are discoveries; ``BINS`` for none.

    Step-up control over all distinct tokens of the class, ordinary or not: the largest p at which
    hypotheses times p are at most ``share`` of the tokens that reach it. A bin counts as its largest p.
    """
    tokens = found.select(F.explode("tested").alias("t")).select("t.band", "t.bin", "t.hash").distinct()
    counts = np.zeros((len(BANDS), BINS + 1), dtype=np.int64)
    for row in tokens.groupBy("band", "bin").agg(F.count("*").alias("n")).collect():  # classes times bins at most
        counts[row["band"], row["bin"]] = row["n"]
    least = []
    for row in counts:  # bin -1 is the last cell
        reached = np.cumsum(row[:BINS][::-1])[::-1]
        good = np.flatnonzero((reached > 0) & (row.sum() * 10.0 ** (-np.arange(BINS) / 10) <= share * reached))
        least.append(int(good[0]) if len(good) else BINS)
    return least


def find_secrets(docs: DataFrame, share: float = FALSE_DISCOVERIES) -> DataFrame:
    """``(doc_id, spans)`` of every row of ``docs (doc_id, text)``: (start, end, kind) in code points.

    ``assign``, ``access`` and ``hex`` are the matches of the fixed patterns, a whole match each; kinds may
    overlap. ``random`` are other tokens of 16 characters or more, which touch none of them: the
    narrowest alphabet that fits is the token's encoding, a chi-squared, a runs and a
    serial-correlation test compare it with the uniform source of that alphabet and with what the
    corpus's own tokens of that length would give, and of those that pass as uniform the ones under
    the false-discovery threshold of their class of lengths are kept. Pair counts and hypotheses
    come from all documents. Spans are sorted by start, then kind as listed.

    Null and empty texts have none. Equal rows have equal results and count once as hypotheses; a
    null ``doc_id`` stays. An empty table gives no rows. Other columns are not read. Very long
    texts are searched in linear time.
    """
    found = written(scan(docs, profile(docs)))
    least = F.array(*[F.lit(t) for t in thresholds(found, share)])
    kept = F.filter("tested", lambda t: t["bin"] >= F.get(least, t["band"]))
    kept = F.transform(kept, lambda t: F.struct(t["start"], t["end"], F.lit("random").alias("kind")))
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(F.concat("base", kept), lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("_k"), s["end"], s["kind"]))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["end"], s["kind"]))
    return found.select("doc_id", spans.alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
