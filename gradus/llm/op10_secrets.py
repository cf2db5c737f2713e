"""Operator 10: secret scans with a battery of randomness tests.

Base kinds are exact patterns: ``assign``, ``access`` and ``hex``; a span is the
whole match. The battery adds spans of kind ``random``: unbroken strings of at
least ``LEAST`` letters, digits and the signs of common encodings, what base spans
leave of them. For each candidate

1. an encoding is inferred from its characters (hexadecimal, base 32, letters
   only, letters and digits, base 64) and gives the alphabet;
2. chi-squared uniformity over the alphabet, a runs test and a serial
   correlation test must each not reject randomness at ``ALPHA``;
3. a p-value says how likely an ordinary string of the same length would look as random. It combines,
   by Fisher's method, the same three questions asked of ordinary strings: how uniform its letters are
   against the frequencies of text, how often its kind of character changes against the runs of
   words, numbers and codes (``CHANGES``), and how seldom vowels and consonants take turns against syllables.

Discoveries are controlled by Benjamini-Hochberg at ``RATE`` over all candidates
of the corpus in each class of encoding and length. p-values are rounded up on
a logarithmic grid, so a count per class and grid point (a bounded table)
settles the thresholds for any number of documents.

Nulls, ties: a null text is the empty text, which has no spans; rows with null
or repeated doc_id are each scanned. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

LEAST = 20
ALPHA = 0.001
RATE = 0.01
#: Points of the p-value grid per power of ten, and its end.
GRID, END = 10, 30
#: Lower ends of the length classes.
LENGTHS = (20, 24, 32, 48, 96)

#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")

#: Relative frequencies of a to z in English text, in percent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
_SHARE = np.array(LETTERS) / sum(LETTERS)

#: Surprise of each letter under the frequencies of text, and its mean, deviation and skewness there.
_BITS = -np.log(_SHARE)
_MEAN = float((_SHARE * _BITS).sum())
_DEVIATION = float((_SHARE * (_BITS - _MEAN) ** 2).sum()) ** 0.5
_SKEW = float((_SHARE * (_BITS - _MEAN) ** 3).sum()) / _DEVIATION**3
#: How often one of two neighbours in an ordinary string is of another kind (small, capital, digit, sign): codes come in blocks,
#: names of several words in humps. And how often vowels and consonants take turns in syllables, at least.
CHANGES = {"hex": 0.1, "base32": 0.1, "letters": 0.1, "alnum": 0.25, "base64": 0.25}
TURNS = 0.5
#: Letters, and pairs of letters, from which they say something.
ENOUGH = 8
_ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    ("base32", re.compile(r"(?=.*[2-7])[A-Z2-7]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("letters", re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+"), "abcdefghijklmnopqrstuvwxyz"),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, each kind leftmost and non-overlapping."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    for start, word in long_words(text, 16):
        out += [(start + m.start(), start + m.end(), "hex") for m in HEX.finditer(word) if m.end() - m.start() >= 16]
    return out


def long_words(text: str, least: int) -> list[tuple[int, str]]:
    """Start and value of the words of at least that many characters between white space."""
    out, at = [], 0
    for word in text.split():
        if len(word) >= least:
            at = text.index(word, at)
            out.append((at, word))
            at += len(word)
    return out


def upper_tail(x: float, freedom: float) -> float:
    """Wilson-Hilferty tail of chi-squared."""
    z = ((max(x, 1e-9) / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return 0.5 * math.erfc(z / math.sqrt(2))


def lower_tail(k: int, n: int, q: float) -> float:
    """Chance of at most k of n, each at q."""
    if k < 0:
        return 0.0
    if n > 300:
        return 0.5 * math.erfc((n * q - k - 0.5) / math.sqrt(2 * n * q * (1 - q)))
    return min(1.0, sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))


def ordinary(value: str, name: str) -> float:
    """p of a string that looks as random as this under ordinary ones of its encoding, by the questions that it has enough letters for."""
    letters = np.array([ord(c) - 97 for c in value.lower() if "a" <= c <= "z"])
    n, p = len(letters), []
    if n >= ENOUGH and name != "hex":  # six letters are no text: codes of them may have any frequencies
        z = (float(_BITS[letters].sum()) - n * _MEAN) / (_DEVIATION * math.sqrt(n))
        freedom = 8 * n / _SKEW**2
        p.append(upper_tail(max(0.0, freedom + math.sqrt(2 * freedom) * z), freedom))
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "+" for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    p.append(lower_tail(len(value) - 1 - changes, len(value) - 1, 1 - CHANGES[name]))
    pairs = [(a in "aeiou", b in "aeiou") for a, b in zip(value.lower(), value.lower()[1:]) if a.isalpha() and b.isalpha()]
    if len(pairs) >= ENOUGH and name != "hex":
        p.append(lower_tail(sum(a != b for a, b in pairs), len(pairs), TURNS))
    x = -sum(math.log(max(q, 1e-300)) for q in p)
    return min(1.0, math.exp(-x) * sum(x**i / math.factorial(i) for i in range(len(p))))


def battery(value: str) -> tuple[str, float, float, float, float] | None:
    """Encoding, p of uniformity, runs and serial correlation under randomness, and p under ordinary text."""
    value = value.rstrip("=")
    n = len(value)
    if n < LEAST:
        return None
    found = next(((name, alphabet) for name, kind, alphabet in _ENCODINGS if kind.fullmatch(value)), None)
    if not found:
        return None
    name, alphabet = found
    shown, value = value, value.replace("-", "+").replace("_", "/") if name == "base64" else value if name not in ("hex", "letters") else value.lower()
    k = len(alphabet)
    place = np.array([alphabet.index(c) for c in value])
    counts = np.bincount(place, minlength=k).astype(float)
    squares = float((counts**2).sum())
    chi = squares * k / n - n
    # Sparse cells: chi-squared has mean k-1 and a variance smaller than 2(k-1).
    spread = 2 * (k - 1) * (n - 1) / n
    freedom = 2 * (k - 1) ** 2 / spread
    uniform = upper_tail(chi * freedom / (k - 1), freedom)
    high = place >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
    else:
        p_runs = 0.0
    centred = place - place.mean()
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    serial = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return name, uniform, p_runs, serial, ordinary(shown, name)


def left_over(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a stretch outside sorted, disjoint ones."""
    out, at = [], bisect.bisect_right(taken, (start, start)) - 1
    at = at if at >= 0 and taken[at][1] > start else at + 1
    while at < len(taken) and taken[at][0] < end:
        if taken[at][0] > start:
            out.append((start, taken[at][0]))
        start = max(start, taken[at][1])
        at += 1
    return [*out, (start, end)] if start < end else out


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int]]:
    """(start, end, class, grid point of p) of the strings that might be random; 0 (p = 1) where the battery rejects randomness."""
    base: list[tuple[int, int]] = []
    for s, e, _ in sorted(taken):
        if base and s <= base[-1][1]:
            base[-1] = (base[-1][0], max(e, base[-1][1]))
        else:
            base.append((s, e))
    out = []
    for start, word in long_words(text, LEAST):
        for m in _CANDIDATE.finditer(word):
            for s, e in left_over(start + m.start(), start + m.end(), base) if m.end() - m.start() >= LEAST else ():
                got = battery(text[s:e]) if e - s >= LEAST else None
                if got:
                    name, *tests, p = got
                    point = 0 if min(tests) < ALPHA else min(END * GRID, int(-math.log10(max(p, 1e-300)) * GRID))
                    out.append((s, e, f"{name}{max(x for x in LENGTHS if x <= max(LEAST, len(text[s:e].rstrip('='))))}", point))
    return out


def thresholds(counts: list[tuple[str, int, int]], rate: float = RATE) -> dict[str, int]:
    """Least grid point that counts as a discovery, by class (Benjamini-Hochberg)."""
    out = {}
    for kind in {c[0] for c in counts}:
        own = {p: n for k, p, n in counts if k == kind}
        total, above = sum(own.values()), 0
        for point in sorted(own, reverse=True):
            above += own[point]
            if point and 10 ** (-point / GRID) <= rate * above / total:
                out[kind] = point  # the last that holds is the step-up threshold
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


@common.tidy
def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every document."""
    common.tune(docs.sparkSession)
    raw = "doc_id long, base array<struct<s:long,e:long,k:string>>, more array<struct<s:long,e:long,k:string,p:int>>"
    span = [("s", pa.int64()), ("e", pa.int64()), ("k", pa.string())]
    kinds = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct(span))), ("more", pa.list_(pa.struct([*span, ("p", pa.int32())])))])

    def find(batches):
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "base": [], "more": []}
            for text in batch["text"].to_pylist():
                base = base_spans(text)
                out["base"].append([dict(zip("sek", x)) for x in base])
                out["more"].append([dict(zip("sekp", x)) for x in candidates(text, base)])
            yield pa.RecordBatch.from_pydict(out, kinds)

    rows = common.whole_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = common.written(rows.mapInArrow(tokens.released(find), raw), "spans")
    tally = found.select(F.explode("more").alias("m")).groupBy("m.k", "m.p").count()
    least = thresholds([tuple(r) for r in tally.collect()], rate)
    final = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"

    def settle(batches):
        for batch in batches:
            out = {c.split()[0]: [] for c in final.split(", ")}
            for doc, base, more in zip(*(c.to_pylist() for c in batch.columns)):
                base = [(x["s"], x["e"], x["k"]) for x in base]
                new = [(x["s"], x["e"], "random") for x in more if x["k"] in least and x["p"] >= least[x["k"]]]
                n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
                for c, v in zip(out, (doc, *n, len(new), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + new))):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in final.split(", ")]))

    return found.mapInArrow(tokens.released(settle), final)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return scan(common.table(spark, sf_dir, "documents"))
