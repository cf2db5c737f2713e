"""Operator 13: language identification of mixed-language texts.

1. Script ranges give a word's script; the languages that use that script in the training
   rows (at least ``SCRIPT_SHARE`` of their letters) are its candidates, the others score ``CLIP`` below the
   best. A word of a script that no language uses says nothing.
2. A word's score for a language is its log-likelihood under that language's
   character trigrams (Witten-Bell interpolated with bigrams and letters), at most ``CLIP`` below its best.
3. Viterbi over a text's words, where a change of language costs ``SWITCH``, labels
   spans. The prediction is the language with the most letters in its spans, and the score
   is its share of the letters times its posterior over its own words.

Most texts are of one language: if no stretch of words gains more than ``SWITCH`` for another than the best
single language, nor the best first and last stretches together, no path with changes can be better (each
change pays for one stretch within, and one for both ends), and the path is known without going word by word.

Texts are cut at all ASCII characters but letters, which no word goes beyond, and only runs between the cuts that a worker
does not remember are read for words.

Counts come from all training rows (non-null language outside the held-out fold); tasks
count characters over distinct words, and Spark adds the counts up, so what is shuffled is trigrams a
task and language. The model keeps the ``GRAMS`` most frequent trigrams and bigrams of each language: the rest
backs off.

Nulls, ties: a null text and a text without letter are ``und`` with score 0, and so is every
text if there are no training rows. Equal languages go to the smaller name. Rows with null or repeated doc_id each
give a row; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens
from .op1_toxicity import held_out

#: Nats that a change of language costs, and that one word may say at most.
SWITCH, CLIP = 15.0, 6.0
#: Trigrams, and bigrams, of a language that the model keeps.
GRAMS = 50_000
#: Share of a language's letters from which a script is one of its own.
SCRIPT_SHARE = 0.02
#: Words whose scores a worker remembers at most before the next texts, and the greatest length, in bytes, of the runs they stand in.
CACHE_WORDS, CACHED = 300_000, 64
#: Words of a text whose scores are plain numbers at a time.
STRETCH = 4096
#: Distinct trigrams that a task gathers before it passes them on.
HELD = 1 << 20
#: Letters of alphabets that were never seen share this part of a language's mass.
UNSEEN = 1e-4

#: First and last code points of scripts.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "ethiopic": ((0x1200, 0x139F),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
NAMES = [*SCRIPTS, "other"]

_RANGES = sorted((low, high, NAMES.index(name)) for name, ranges in SCRIPTS.items() for low, high in ranges)
_LOW, _HIGH, _SCRIPT = (np.array(x) for x in zip(*_RANGES))
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BLANKS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
#: Marks before and after a word, below every letter.
_START, _END = 2, 3
_BITS = 21


def scripts(codes: np.ndarray) -> np.ndarray:
    """Index of each code point's script in ``NAMES``."""
    k = np.searchsorted(_LOW, codes, "right") - 1
    return np.where((k >= 0) & (codes <= _HIGH[k]), _SCRIPT[k], len(NAMES) - 1)


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram keys of words with two marks before and one after, which word each belongs to, and the words' letters in one array."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ends = np.cumsum(size + 3)
    codes = np.full(int(ends[-1]) if len(words) else 0, _START, np.int64)
    codes[ends - 1] = _END
    inside = np.ones(len(codes), bool)
    inside[np.concatenate((ends - size - 3, ends - size - 2, ends - 1))] = False
    codes[inside] = letters
    last = np.ones(len(codes), bool)
    last[np.concatenate((ends - size - 3, ends - size - 2))] = False
    at = np.flatnonzero(last)
    return codes[at - 2] << 2 * _BITS | codes[at - 1] << _BITS | codes[at], np.repeat(np.arange(len(words)), size + 1), letters


class Model:
    """Languages, their scripts and their trigram log-probabilities, with back-off."""

    def __init__(self, counts: dict[str, tuple[dict[int, int], dict[int, int], dict[int, int]]], shares: dict[str, list[float]]):
        """``counts``: for each language its trigrams, bigrams and letters; ``shares``: of each script in its letters."""
        self.languages = sorted(counts)
        n = len(self.languages)
        self.scripts = np.array([[s >= SCRIPT_SHARE for s in shares[x]] for x in self.languages]).reshape(n, len(NAMES))
        self.keys, self.values, self.backs = [], [], []
        for order in (0, 1, 2):
            self.keys.append(np.array(sorted({k for x in self.languages for k in counts[x][order]}), np.int64))
        letters = self.keys[2]
        total = np.array([sum(counts[x][2].values()) for x in self.languages], float)
        one = np.array([[counts[x][2].get(int(k), 0) for x in self.languages] for k in letters], float).reshape(len(letters), n)
        floor = UNSEEN / (len(letters) + 1)
        uni = (1 - UNSEEN) * one / np.maximum(total, 1) + floor
        self.floor = float(np.log(floor))
        # Bigrams over letters, then trigrams over bigrams: seen + back-off * lower order.
        two, back2, whole2 = self._order(counts, 1, uni[self._at(letters, self.keys[1] & ((1 << _BITS) - 1))])
        lower = self._backed(self.keys[0] & ((1 << 2 * _BITS) - 1), self.keys[1], two, back2, whole2, letters, uni)
        three, back3, whole3 = self._order(counts, 0, lower)
        self.values = [np.log(x) for x in (three, two, uni)]
        self.backs = [(whole3, np.log(back3)), (whole2, np.log(back2))]

    def _order(self, counts, order: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the keys of an order, back-off weights of contexts and the contexts."""
        keys = self.keys[order]
        c = np.array([[counts[x][order].get(int(k), 0) for x in self.languages] for k in keys], float).reshape(len(keys), len(self.languages))
        context, place = np.unique(keys >> _BITS, return_inverse=True)
        sums, kinds = (np.zeros((len(context), c.shape[1])) for _ in "12")
        np.add.at(sums, place, c)
        np.add.at(kinds, place, c > 0)
        back = np.where(sums > 0, kinds / np.maximum(sums + kinds, 1), 1.0)
        return c / np.maximum(sums + kinds, 1)[place] + back[place] * lower, back, context

    @staticmethod
    def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key, -1 where it is missing."""
        if not len(keys):
            return np.full(len(wanted), -1)
        k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[k] == wanted, k, -1)

    def _backed(self, wanted, keys, values, backs, contexts, letters, uni) -> np.ndarray:
        """Probabilities of bigrams, also of those never seen."""
        k, c, u = self._at(keys, wanted), self._at(contexts, wanted >> _BITS), self._at(letters, wanted & ((1 << _BITS) - 1))
        last = np.where(u[:, None] >= 0, uni[u], np.exp(self.floor))
        return np.where(k[:, None] >= 0, values[k] if len(values) else last, np.where(c[:, None] >= 0, backs[c] if len(backs) else 1.0, 1.0) * last)

    def grams(self, wanted: np.ndarray) -> np.ndarray:
        """Log-probability of each trigram key for each language."""
        n = len(self.languages)
        out = np.zeros((len(wanted), n))
        todo = np.arange(len(wanted))
        for order in (0, 1, 2):
            keys, values = self.keys[order], self.values[order]
            k = self._at(keys, wanted[todo])
            hit = k >= 0
            out[todo[hit]] += values[k[hit]]
            todo = todo[~hit]
            if order < 2:
                contexts, back = self.backs[order]
                c = self._at(contexts, wanted[todo] >> _BITS)
                known = c >= 0
                out[todo[known]] += back[c[known]]
                wanted = wanted & ((1 << (2 - order) * _BITS) - 1)
        out[todo] += self.floor
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """A row a word: what it says for each language, 0 for the best and -CLIP at least."""
        if not words or not self.languages:
            return np.zeros((len(words), len(self.languages)))
        keys, owner, letters = spelled(words)
        total = np.add.reduceat(self.grams(keys), np.searchsorted(owner, np.arange(len(words))), axis=0)
        first = np.cumsum([0, *map(len, words[:-1])])
        fits = self.scripts[:, scripts(letters[first])].T
        none = ~fits.any(axis=1)
        best = np.where(fits, total, -np.inf).max(axis=1, keepdims=True)
        with np.errstate(invalid="ignore"):
            out = np.where(fits, np.maximum(total - best, -CLIP), -CLIP)
        out[none] = 0.0
        return out


def spans(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word: Viterbi with a price for changes; ties to the smaller index, and to staying."""
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    rise = np.vstack([np.zeros((1, k)), np.cumsum(scores - scores[:, best : best + 1], axis=0)])
    if (rise - np.minimum.accumulate(rise, axis=0)).max() <= switch and rise.max() + (rise[-1] - rise.min(axis=0)).max() <= switch:
        return np.full(n, best)
    # Few languages: plain numbers are faster than arrays. Before each word: all values, the best one's language, and what a change is worth.
    values, tops, changed = array("d"), array("q"), array("d")
    value = [0.0] * k
    for at in range(0, n, STRETCH):
        for row in scores[at : at + STRETCH].tolist():
            most = max(value)
            least = most - switch
            values.extend(value)
            tops.append(value.index(most))
            changed.append(least)
            value = [(least if least > v else v) + s for v, s in zip(value, row)]
    own = value.index(max(value))
    out = np.zeros(n, np.int64)
    out[-1] = own
    for i in range(n - 1, 0, -1):
        if changed[i] > values[i * k + own]:
            own = tops[i]
        out[i - 1] = own
    return out


def runs(text: str) -> list[bytes]:
    """The lower-cased text in UTF-8, cut at all ASCII characters but letters: no word goes beyond a run."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()


def words_of(run: bytes) -> list[str]:
    return _WORD.findall(run.decode("utf-8", "surrogatepass"))


class _Numbered(dict):
    """Numbers what it is asked for in turn; ``new`` has what was not known."""

    def __init__(self):
        self.new: list[bytes] = []
        self.next = 0

    def __missing__(self, key: bytes) -> int:
        self.new.append(key)
        self[key] = k = self.next
        self.next += 1
        return k


class Labeller:
    """Labels texts; a worker remembers the scores of the words of each run."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbered()
        self.table, self.sizes, self.ends = np.zeros((0, len(self.model.languages))), np.zeros(0), np.zeros(1, np.int64)

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """The rows of ``table`` and ``sizes`` of each text's words."""
        if max(len(self.table), self.known.next) > CACHE_WORDS:
            self._forget()
        known = self.known
        found = [np.fromiter(map(known.__getitem__, own), np.int64, len(own)) for own in map(runs, texts)]
        if known.new:
            each = [words_of(x) for x in known.new]
            words = [w for own in each for w in own]
            self.table = np.vstack([self.table, self.model.scores(words)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, words), np.float64, len(words))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))])
            for x in known.new:
                if len(x) > CACHED:
                    del known[x]
            known.new = []
        out = []
        for own in found:
            first = self.ends[own]
            size = self.ends[own + 1] - first
            stop = np.cumsum(size)
            out.append(np.repeat(first - stop + size, size) + np.arange(stop[-1] if len(stop) else 0))
        return out

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans (start, end, language in code points) of each text; spans tile the text."""
        names = self.model.languages
        out = []
        for text, own in zip(texts, self.rows([t if t and names else "" for t in texts])):
            if not len(own):
                out.append(("und", 0.0, []))
                continue
            s = self.table[own]
            path = spans(s)
            letters = np.bincount(path, self.sizes[own], len(names))
            k = int(letters.argmax())
            total = s[path == k].sum(axis=0)
            sure = 1.0 / np.exp(np.minimum(total - total[k], 700.0)).sum()
            out.append((names[k], float(letters[k] / letters.sum() * sure), self._tiles(text, path)))
        return out

    def _tiles(self, text: str, path: np.ndarray) -> list[tuple[int, int, str]]:
        cuts = (np.flatnonzero(path[1:] != path[:-1]) + 1).tolist()
        starts = [0]
        if cuts:
            # Lower-casing may lengthen a text but keeps its words.
            places = [m.start() for m in islice(_WORD.finditer(text), cuts[-1] + 1)]
            starts += [places[min(c, len(places) - 1)] for c in cuts]
        ends = [*starts[1:], len(text)]
        return [(a, b, self.model.languages[path[c]]) for a, b, c in zip(starts, ends, [0, *cuts])]


@common.tidy
def fit(rows: DataFrame, most: int = GRAMS) -> Model:
    """The model of ``rows`` (text, lang), all of them."""
    common.tune(rows.sparkSession)

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def packed():
            for lang, parts in held.items():
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(place, np.concatenate([c for _, c in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                found.setdefault(lang, Counter()).update(runs(text))
            for lang, seen in found.items():
                own: dict[str, int] = {}
                for run, n in seen.items():
                    for w in words_of(run):
                        own[w] = own.get(w, 0) + n
                if own:
                    keys, owner, _ = spelled(list(own))
                    keys, place = np.unique(keys, return_inverse=True)
                    held.setdefault(lang, []).append((keys, np.bincount(place, np.fromiter(own.values(), np.float64)[owner])))
                    size += len(keys)
            if size > HELD:
                yield from packed()
                size = 0
        yield from packed()

    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    grams = rows.mapInArrow(tokens.released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = common.written(grams, "grams")
    low = [F.col("gram"), F.col("gram").bitwiseAND(F.lit((1 << 2 * _BITS) - 1)), F.col("gram").bitwiseAND(F.lit((1 << _BITS) - 1))]
    counts, letters = {}, {}
    for order, key in enumerate(low):
        own = grams.groupBy("lang", key.alias("gram")).agg(F.sum("n").alias("n")) if order else grams
        # The most frequent of each language: at most ``most`` rows a language reach the driver.
        for lang, table in _most(own, most).items():
            counts.setdefault(lang, ({}, {}, {}))[order].update(table)
            if order == 2:
                codes = np.array([k for k in table if k > _END], np.int64)
                share = np.bincount(scripts(codes), [table[int(k)] for k in codes], len(NAMES)) if len(codes) else np.zeros(len(NAMES))
                letters[lang] = (share / max(share.sum(), 1)).tolist()
    return Model(counts, letters)


def _most(grams: DataFrame, most: int) -> dict[str, dict[int, int]]:
    sizes = {r["lang"]: r["count"] for r in grams.groupBy("lang").count().collect()}
    out = {}
    for lang, size in sorted(sizes.items()):
        own = grams.where(F.col("lang") == lang)
        own = own.orderBy(F.desc("n"), "gram").limit(most) if size > most else own
        got = own.select("gram", "n").toArrow()
        out[lang] = dict(zip(got["gram"].to_pylist(), got["n"].to_pylist()))
    return out


def labelled(docs: DataFrame, model: Model, column: str = "language") -> DataFrame:
    """``docs`` with a struct of lang, score and spans (start, end, lang) of each whole text in ``column``."""
    common.tune(docs.sparkSession)
    held: list[Labeller] = []  # a task's own
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    @F.arrow_udf("lang string, score double, spans array<struct<start:long,end:long,lang:string>>")
    def judge(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Labeller(model))
        got = held[0].label(texts.to_pylist())
        tiles = [[dict(zip(("start", "end", "lang"), t)) for t in g[2]] for g in got]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(tiles, pa.list_(span))], names=["lang", "score", "spans"])

    return docs.withColumn(column, judge("text"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id")))
    found = labelled(docs.select("doc_id", "text"), model)
    tiles = F.array_join(F.transform("language.spans", lambda s: F.concat_ws(":", s["lang"], s["start"], s["end"])), ",")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), tiles.alias("spans"))
