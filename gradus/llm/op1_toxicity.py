"""Operator 1: toxicity by a weighted finite-state pattern grammar.

``Transducer`` objects have states, arcs (state, symbol) -> (symbol, next state) and
final states; ``composed`` feeds one's output to the next. A clause is a string of
symbols, and the composition of four transducers marks its insults and threats:

* the lexicon gives a word's symbol: INSULT (with a weight), THREAT, INTENT, TARGET,
  NEGATION, REPORT, BREAK (a comma) or OTHER. Insults are whole words and stems; an
  Aho-Corasick automaton finds them, and texts without insult or threat end here;
* ``negation``: an insult or threat among the ``NEGATED`` words after a NEGATION, with
  no BREAK between, is negated;
* ``report``: what follows a REPORT in its clause is reported;
* ``target``: guesses at the start whether the clause has a TARGET (a path whose guess
  is wrong reaches no final state) and marks insults aimed or plain;
* ``threat``: likewise, threats count in clauses with a TARGET and an INTENT.

Each clause has exactly one accepting path; it leaves marks plain, aimed, negated,
reported and threat with their weights. A document's score is the logistic
function of the marks' weights times the logarithms of their sums over all clauses.

The lexicon's weights and those of the marks are learned
from labelled rows whose crc32(doc_id) mod 5 is not 0: a sample of at most
``TOXIC`` and ``CLEAN`` rows in the order of a hash of doc_id, with one document
of each group of near copies. A stem needs several words of toxic documents that go on from it, none
of them most of its support, or the whole word is the insult. The marks' weights are drawn to
the grammar's own (``PRIOR``) where rows say little, and an insult that is negated or reported
weighs at most half of a plain one. Labels, lang, source and doc_id are no inputs of a
score. Without labels the grammar keeps the fixed lexicon.

Nulls, ties: null and empty texts get the score of a text without matches;
rows with null or repeated doc_id are each scored (a null doc_id is held out
iff crc32 of the empty text says so); labels that are null are ignored, and of
several labels of a document the largest counts. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

#: Bounds of the training sample.
TOXIC, CLEAN = 2000, 4000
#: Lexicon entries learned at most, and what an entry must reach.
ENTRIES, LEAST_DOCS, LEAST_SHARE, LEAST_ODDS, CLEAN_SHARE = 4000, 5, 0.008, 2.5, 0.06
#: Lengths of stems; the words that go on from one, and the most of its support that one word may have.
STEMS, ENDINGS, MAIN_SHARE = (4, 5, 6, 7, 8), 4, 0.5
NEGATED = 3
MARKS = ("plain", "aimed", "negated", "reported", "threat")
#: Intercept and the marks' weights without rows, and how strongly they are drawn there.
PRIOR, RIDGE = (-4.0, 3.0, 3.3, 0.3, 0.3, 3.5), 0.5

#: The grammar's words.
INSULTS = ("idiot", "moron", "stupid", "scum", "pathetic", "loser", "worthless", "trash", "disgusting", "clown")
THREATS = ("kill", "murder", "hurt", "strangle", "shoot", "stab", "destroy")
INTENTS = ("will", "gonna", "going", "shall", "must", "want", "should")
TARGETS = ("you", "your", "yours", "u", "ur", "he", "she", "they", "them", "him", "her", "du", "dich", "ihr", "tu", "te", "vous", "usted", "ellos")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "don't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "say", "wrote", "claimed", "called", "quoted", "reported", "sagte", "schrieb", "disait", "écrit", "dijo", "escribió")

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, BREAK = range(8)
SYMBOLS = tuple(range(8))
_SIGNS = {w: s for s, own in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INTENT, INTENTS)) for w in own} | {",": BREAK}

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|,")
_CLAUSE = re.compile(r"[.!?;\n()|]+")


class Transducer:
    """Finite-state transducer from state 0; ``arcs``: (state, symbol) -> [(symbol out, next state)]."""

    def __init__(self, arcs: dict, final: set):
        self.arcs, self.final = arcs, final

    def run(self, symbols) -> list[tuple]:
        """The outputs of all accepting paths."""
        paths = [((), 0)]
        for x in symbols:
            paths = [((*out, y), to) for out, state in paths for y, to in self.arcs.get((state, x), ())]
        return [out for out, state in paths if state in self.final]


def composed(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that gives ``second`` what ``first`` puts out, without states that are not reached or lead nowhere."""
    number, todo, arcs, final = {(0, 0): 0}, [(0, 0)], {}, set()
    inputs: dict = {}
    for (state, x), out in first.arcs.items():
        inputs.setdefault(state, []).append((x, out))
    while todo:
        a, b = pair = todo.pop()
        if a in first.final and b in second.final:
            final.add(number[pair])
        for x, out in inputs.get(a, ()):
            for y, to in out:
                for z, then in second.arcs.get((b, y), ()):
                    if (to, then) not in number:
                        number[(to, then)] = len(number)
                        todo.append((to, then))
                    arcs.setdefault((number[pair], x), []).append((z, number[(to, then)]))
    useful, before = set(final), -1
    while len(useful) != before:
        before = len(useful)
        useful |= {state for (state, _), out in arcs.items() if any(to in useful for _, to in out)}
    trimmed = {key: kept for key, out in arcs.items() if (kept := [(z, to) for z, to in out if to in useful])}
    return Transducer(trimmed, final)


def negation() -> Transducer:
    """State n: the next n words are negated."""
    arcs = {}
    for n in range(NEGATED + 1):
        for x in SYMBOLS:
            to = NEGATED if x == NEGATION else 0 if x == BREAK else max(0, n - 1)
            arcs[(n, x)] = [((x, "negated") if n and x in (INSULT, THREAT) else x, to)]
    return Transducer(arcs, set(range(NEGATED + 1)))


def report() -> Transducer:
    """State 1: the rest of the clause is reported; what is negated stays so."""
    arcs = {}
    for state in (0, 1):
        for x in (*SYMBOLS, (INSULT, "negated"), (THREAT, "negated")):
            arcs[(state, x)] = [((x, "reported") if state and x in (INSULT, THREAT) else x, 1 if x == REPORT else state)]
    return Transducer(arcs, {0, 1})


_SAID = tuple((x, how) for x in (INSULT, THREAT) for how in ("negated", "reported"))


def target() -> Transducer:
    """From the start to 1 (no target will come), 2 (one must come) or 3 (one has come)."""
    arcs = {}
    for state, guesses in ((0, (1, 2)), (1, (1,)), (2, (2,)), (3, (3,))):
        for x in (*SYMBOLS, *_SAID):
            for guess in guesses:
                if x == TARGET and guess == 1:
                    continue
                y = ("plain" if guess == 1 else "aimed") if x == INSULT else x[1] if x in _SAID and x[0] == INSULT else x
                arcs.setdefault((state, x), []).append((y, 3 if x == TARGET else guess))
    return Transducer(arcs, {0, 1, 3})


def threat() -> Transducer:
    """Guesses whether target and intent both come: states are the guess with what has come so far."""
    seen = [(live, t, i) for live in (False, True) for t in (0, 1) for i in (0, 1) if live or not (t and i)]
    number = {s: k + 1 for k, s in enumerate(seen)}
    arcs = {}
    for state, froms in ((0, ((False, 0, 0), (True, 0, 0))), *((number[s], (s,)) for s in seen)):
        for x in (OTHER, THREAT, INTENT, TARGET, NEGATION, REPORT, BREAK, *MARKS[:4], *(s for s in _SAID if s[0] == THREAT)):
            for live, t, i in froms:
                to = (live, t or int(x == TARGET), i or int(x == INTENT))
                if to not in number:
                    continue
                y = x if x in MARKS else ("threat" if x == THREAT else x[1]) if live and (x == THREAT or x in _SAID) else OTHER
                arcs.setdefault((state, x), []).append((y, number[to]))
    return Transducer(arcs, {0, *(k for s, k in number.items() if not s[0] or (s[1] and s[2]))})


@lru_cache(maxsize=1)
def grammar_machine() -> Transducer:
    """negation, report, target and threat, composed."""
    return composed(composed(composed(negation(), report()), target()), threat())


class Grammar:
    """The lexicon, the composed transducers and the weights of their marks."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: list[float] | None = None):
        self.words, self.stems = words, stems
        self.weights = weights or list(PRIOR)
        self.heaviest = max(words.values(), default=3.0)  # a threat weighs as much as the worst insult
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def _find(self):
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for x in {*self.words, *self.stems, *THREATS}:
                self.automaton.add_word(x, len(x))
            self.automaton.make_automaton()
        return self.automaton.iter

    def insult(self, word: str) -> float:
        weight = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                weight = max(weight, self.stems.get(word[:n], 0.0))
        return weight

    def sums(self, text: str) -> tuple[list[float], int]:
        """The marks' sums and the number of marked clauses."""
        low = text.lower()
        out, clauses = [0.0] * len(MARKS), 0
        hits = [end for end, n in self._find()(low) if end < n or not low[end - n].isalpha()]
        if not hits:
            return out, clauses
        at, hit = 0, 0
        for stop in [m.span() for m in _CLAUSE.finditer(low)] + [(len(low), len(low))]:
            if hit < len(hits) and hits[hit] < stop[0]:
                while hit < len(hits) and hits[hit] < stop[0]:
                    hit += 1
                clauses += self._clause(low[at : stop[0]], out)
            at = stop[1]
        return out, clauses

    def lexicon(self, clause: str) -> tuple[list[int], list[float]]:
        """The clause's symbols and their weights."""
        symbols, weights = [], []
        for word in _TOKEN.findall(clause):
            weight = self.insult(word)
            symbols.append(INSULT if weight else _SIGNS.get(word, OTHER))
            weights.append(weight or self.heaviest)
        return symbols, weights

    def _clause(self, clause: str, out: list[float]) -> bool:
        machine, symbols, weights = grammar_machine(), *self.lexicon(clause)
        # State -> its path's sums by mark. One path accepts, so paths never meet; a clause costs time in proportion to its words.
        paths = {0: (0.0,) * len(MARKS)}
        for x, w in zip(symbols, weights):
            step = {}
            for state, own in paths.items():
                for y, to in machine.arcs.get((state, x), ()):
                    if y == OTHER:
                        step[to] = own
                    else:
                        k = MARKS.index(y)
                        step[to] = (*own[:k], own[k] + w, *own[k + 1 :])
            paths = step
        found = next(own for state, own in paths.items() if state in machine.final)
        for k, w in enumerate(found):
            out[k] += w
        return any(found)

    def score(self, text: str) -> tuple[float, int]:
        sums, clauses = self.sums(text)
        z = self.weights[0] + sum(w * math.log1p(s) for w, s in zip(self.weights[1:], sums))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))), clauses


def held_out(doc_id):
    """The fold by crc32 of the id as text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """text and toxic of the bounded sample of labelled rows outside the held-out fold."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("label_doc"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(~held_out("label_doc")).groupBy("label_doc").agg(F.max("toxic").alias("toxic"))
    picked = [own.where(F.col("toxic") == t).orderBy(F.xxhash64("label_doc"), "label_doc").limit(n) for t, n in ((1, toxic), (0, clean))]
    # At most toxic + clean ids: a bounded broadcast.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = common.whole_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("label_doc"))
    mark = F.arrow_udf(_mark, "long")
    marked = rows.select("text", "toxic", mark("text").alias("mark"))
    return marked.groupBy("mark", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _mark(texts: pa.Array) -> pa.Array:
    """The least hash of a text's word triples: near copies mostly share it."""
    out = []
    for text in texts.to_pylist():
        w = text.lower().split()
        out.append(min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0))
    return pa.array(out, pa.int64())


@common.tidy
def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learn the lexicon and the states' weights."""
    common.tune(docs.sparkSession)
    rows = common.written(training_rows(docs, labels), "toxic")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    words, stems = {w: 3.0 for w in INSULTS}, {}
    if not toxic or not clean:
        return Grammar(words, stems)

    def entries(batches):
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                own = set(_WORD.findall(text.lower()))
                counts[label].update(own | {w[:n] + "*" for w in own for n in STEMS if len(w) > n})
        names = list({*counts[0], *counts[1]})
        for at in range(0, len(names), 10_000):
            part = names[at : at + 10_000]
            yield pa.RecordBatch.from_pydict({"entry": part, "pos": [counts[1][x] for x in part], "neg": [counts[0][x] for x in part]})

    odds = F.log((F.col("pos") + 0.5) / (toxic + 1.0)) - F.log((F.col("neg") + 0.5) / (clean + 1.0))
    found = rows.mapInArrow(tokens.released(entries), "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = common.written(found.where("pos > 0"), "entries")
    whole = ~F.col("entry").endswith("*")
    # The words that go on from a stem.
    stem = F.explode(F.array(*(F.when(F.length("entry") > n, F.concat(F.substring("entry", 1, n), F.lit("*"))) for n in STEMS))).alias("entry")
    ends = found.where(whole).select(stem, "pos").where("entry IS NOT NULL").groupBy("entry").agg(F.count("pos").alias("ends"), (F.max("pos") / F.sum("pos")).alias("main"))
    found = found.withColumn("odds", odds).where((F.col("pos") >= max(LEAST_DOCS, LEAST_SHARE * toxic)) & (F.col("odds") >= LEAST_ODDS) & (F.col("neg") * toxic <= CLEAN_SHARE * F.col("pos") * clean))
    found = found.join(ends, "entry", "left").where(whole | ((F.col("ends") >= ENDINGS) & (F.col("main") <= MAIN_SHARE)))
    support = {}
    for r in found.orderBy(F.desc("pos"), "entry").limit(ENTRIES).collect():
        (stems if r["entry"].endswith("*") else words)[r["entry"].rstrip("*")] = float(r["odds"])
        support[r["entry"]] = r["pos"]
    # Of stems that begin one another with much the same support, the longest.
    for x in sorted(stems, key=len):
        if any(len(y) > len(x) and y.startswith(x) and 10 * support[y + "*"] >= 9 * support[x + "*"] for y in stems):
            del stems[x]
    grammar = Grammar(words, stems)

    def measure(batches):
        for batch in batches:
            sums = [grammar.sums(t)[0] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.list_(pa.float64())), batch["toxic"]], names=["sums", "toxic"])

    got = rows.mapInArrow(tokens.released(measure), "sums array<double>, toxic int").collect()
    x = np.log1p(np.array([r["sums"] for r in got]))
    grammar.weights = logistic(x, np.array([r["toxic"] for r in got], float)).tolist()
    return grammar


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 200) -> np.ndarray:
    """Intercept and weights of a logistic regression drawn to ``PRIOR`` (Newton steps, projected).

    Insults never weigh less than nothing, aimed ones no less than plain ones and threats no
    less than those; negated and reported ones may, and weigh at most half of plain ones.
    """
    x = np.hstack([np.ones((len(x), 1)), x])
    w = prior = np.array(PRIOR)
    keep = np.full(len(w), ridge)
    keep[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        new = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - keep * (w - prior)), -0.5, 0.5)
        plain, aimed, negated, reported, threat = new[1:]
        plain = max(plain, 0.0)
        new[1:] = plain, max(aimed, plain), min(negated, plain / 2), min(reported, plain / 2), max(threat, aimed, plain)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def scored(docs: DataFrame, grammar: Grammar, column: str = "toxicity") -> DataFrame:
    """``docs`` with a struct of score and n_clauses of each whole text in ``column``."""
    common.tune(docs.sparkSession)

    @F.arrow_udf("score double, n_clauses long")
    def judge(texts: pa.Array) -> pa.Array:
        got = [grammar.score(t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=["score", "n_clauses"])

    return docs.withColumn(column, judge(F.coalesce(F.col("text"), F.lit(""))))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents``; labels are learned outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = fit(docs, common.table(spark, sf_dir, "labels"))
    score = F.col("toxicity.score")
    return scored(docs, grammar).select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("toxicity.n_clauses").alias("n_clauses"))
