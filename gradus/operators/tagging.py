"""Parts of speech by a hidden Markov model whose emissions are closed-class words and suffixes.

Tags of closed-class words are known; all other words show themselves by their suffix alone. Transitions
and emissions start from a small table of pseudo-counts and are re-estimated in Spark rounds: every
task decodes its texts by Viterbi in Arrow batches and counts, Spark adds the counts up, and the table of a few hundred
numbers goes out again. Texts are never gathered.

Nulls, ties: a null text has no tags; equal paths go to the tag that comes first in ``TAGS``. Words are those
between single blanks, as in ``mutation.masked``, so tags and words have the same places.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship
from .mutation import once

TAGS = ("NOUN", "ADJ", "VERB", "ADV", "DET", "ADP", "PRON", "CONJ", "NUM", "OTHER")
#: Words whose tag is known.
CLOSED = {
    "DET": "the a an this that these those each every some any no all both".split(),
    "ADP": "of in on at by for with from to into over under about between through during as than".split(),
    "PRON": "i you he she it we they me him her us them who which what its their his your our my".split(),
    "CONJ": "and or but nor so yet if because while when where".split(),
    "VERB": "is are was were be been being am has have had do does did will would can could shall should may might must".split(),
    "ADV": "not very too also only just then there here now never always".split(),
}
#: Suffixes, the longest first, and what they speak for.
SUFFIXES = {"tion": "NOUN", "sion": "NOUN", "ment": "NOUN", "ness": "NOUN", "ance": "NOUN", "ence": "NOUN", "able": "ADJ", "ible": "ADJ", "less": "ADJ", "ity": "NOUN", "ism": "NOUN", "ist": "NOUN", "ous": "ADJ", "ful": "ADJ", "ive": "ADJ", "ish": "ADJ", "est": "ADJ", "ing": "VERB", "ize": "VERB", "ate": "VERB", "al": "ADJ", "ic": "ADJ", "er": "NOUN", "or": "NOUN", "ed": "VERB", "ly": "ADV", "es": "NOUN", "s": "NOUN"}
SHAPES = (*sorted({w for own in CLOSED.values() for w in own}), *SUFFIXES, "#", "?", "")
#: Pseudo-counts: of every pair, of what suffixes speak for, and of known words.
LEAST, SPOKEN, KNOWN = 0.5, 50.0, 1e6
ROUNDS = 3
#: Texts decoded together, places times texts at most, and characters of the words whose shapes a worker keeps.
TOGETHER, CELLS, SHORT = 256, 1 << 18, 32
#: Pairs of tags that follow one another often in the beginning.
FOLLOWS = {("DET", "NOUN"): 60, ("DET", "ADJ"): 30, ("ADJ", "NOUN"): 60, ("NOUN", "VERB"): 30, ("NOUN", "ADP"): 30, ("ADP", "DET"): 40, ("ADP", "NOUN"): 30, ("VERB", "DET"): 30, ("VERB", "ADV"): 15, ("PRON", "VERB"): 60, ("CONJ", "NOUN"): 20, ("NUM", "NOUN"): 40, ("ADV", "VERB"): 20}

_SHAPE = {s: i for i, s in enumerate(SHAPES)}
_SUFFIX = {s: _SHAPE[s] for s in SUFFIXES}
_LENGTHS = sorted({len(s) for s in SUFFIXES}, reverse=True)


def shape(word: str) -> int:
    """A word's emission: itself if its class is closed, else its suffix, a digit's or a sign's mark, or nothing."""
    w = word.lower().strip(".,;:!?\"'()[]")
    if w in _SHAPE and w:
        return _SHAPE[w]
    if not w:
        return _SHAPE["?"]
    if not w.isalpha() and any(c.isdigit() for c in w):
        return _SHAPE["#"]
    size = len(w) - 1
    for n in _LENGTHS:
        if size > n and (found := _SUFFIX.get(w[-n:])) is not None:
            return found
    return _SHAPE[""]


class Tagger:
    """Counts of pairs of tags (the first row: at the start) and of shapes by tag, and their logarithms."""

    def __init__(self, pairs: np.ndarray | None = None, shapes: np.ndarray | None = None):
        n = len(TAGS)
        pairs = np.zeros((n + 1, n)) if pairs is None else pairs
        shapes = np.zeros((n, len(SHAPES))) if shapes is None else shapes
        own, seen = pairs + LEAST, shapes + LEAST
        for (a, b), c in FOLLOWS.items():
            own[TAGS.index(a) + 1, TAGS.index(b)] += c
        for suffix, tag in SUFFIXES.items():
            seen[TAGS.index(tag), _SHAPE[suffix]] += SPOKEN
        seen[TAGS.index("NOUN"), _SHAPE[""]] += SPOKEN
        seen[TAGS.index("NUM"), _SHAPE["#"]] += KNOWN
        seen[TAGS.index("OTHER"), _SHAPE["?"]] += KNOWN
        for tag, words in CLOSED.items():
            for w in words:
                seen[TAGS.index(tag), _SHAPE[w]] += KNOWN
        self.pairs = np.log(own / own.sum(axis=1, keepdims=True))
        # Known words are told by their tag alone: each shape's share among the tags, by the tags' own sizes.
        self.shapes = np.log(seen / seen.sum(axis=0, keepdims=True))

    def path(self, shapes: np.ndarray) -> np.ndarray:
        """The best tags of a sequence of shapes."""
        if not len(shapes):
            return np.zeros(0, np.int64)
        value = self.pairs[0] + self.shapes[:, shapes[0]]
        come = np.zeros((len(shapes), len(TAGS)), np.int64)
        step = self.pairs[1:]
        for i in range(1, len(shapes)):
            each = value[:, None] + step
            come[i] = each.argmax(axis=0)
            value = each.max(axis=0) + self.shapes[:, shapes[i]]
        out = np.zeros(len(shapes), np.int64)
        out[-1] = value.argmax()
        for i in range(len(shapes) - 1, 0, -1):
            out[i - 1] = come[i, out[i]]
        return out

    def paths(self, sequences: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Number and ``path`` of each sequence that is not empty: those of about one length are decoded together, place by place."""
        order = sorted((k for k, s in enumerate(sequences) if len(s)), key=lambda k: -len(sequences[k]))
        at = 0
        while at < len(order):
            longest = len(sequences[order[at]])
            own = order[at : at + max(1, min(TOGETHER, CELLS // longest))]
            at += len(own)
            yield from zip(own, self._together([sequences[k] for k in own]))

    def _together(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Paths of sequences whose lengths fall. The same sums as in ``path``; where a value came from is looked up on the way back, for the best tag only."""
        lengths = np.array([len(s) for s in sequences])
        longest, step = int(lengths[0]), self.pairs[1:]
        shapes = np.zeros((longest, len(sequences)), np.int64)
        for k, s in enumerate(sequences):
            shapes[: len(s), k] = s
        # Sequences that go on at a place.
        going = np.searchsorted(-lengths, -np.arange(longest), side="left")
        values = [self.pairs[0][:, None] + self.shapes[:, shapes[0]]]
        for i in range(1, longest):
            n = going[i]
            values.append((values[-1][:, None, :n] + step[:, :, None]).max(axis=0) + self.shapes[:, shapes[i, :n]])
        out = np.zeros((longest, len(sequences)), np.int64)
        for i in range(longest - 1, -1, -1):
            on = going[i + 1] if i + 1 < longest else 0
            out[i, on : going[i]] = values[i][:, on:].argmax(axis=0)
            if on:
                out[i, :on] = (values[i][:, :on] + step[:, out[i + 1, :on]]).argmax(axis=0)
        return [out[: len(s), k] for k, s in enumerate(sequences)]

    def worth(self, shapes, path) -> float:
        """The logarithm of a path's weight."""
        return float(sum(self.pairs[0 if i == 0 else path[i - 1] + 1, t] + self.shapes[t, s] for i, (s, t) in enumerate(zip(shapes, path))))


_known_shape = lru_cache(maxsize=1 << 16)(shape)


def _shaped(text: str | None) -> np.ndarray:
    return np.array([_known_shape(w) if len(w) <= SHORT else shape(w) for w in text.split(" ")], np.int16) if text is not None else np.zeros(0, np.int16)


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """A batch's texts, a few at a time: a batch may be large."""
    for at in range(0, len(texts), TOGETHER):
        yield texts.slice(at, TOGETHER).to_pylist()


def fit(texts: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Tagger:
    """A tagger re-estimated ``rounds`` times on all texts."""
    ship(texts.sparkSession)
    tagger, n, m = Tagger(), len(TAGS), len(SHAPES)

    def shapes_of(batches):
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                # Their bytes: two for each word.
                yield pa.RecordBatch.from_arrays([pa.array([_shaped(value).tobytes() for value in piece], pa.binary())], names=["shapes"])

    # Every round reads the shapes, not the texts.
    shaped = texts.select(text).mapInArrow(shapes_of, "shapes binary").persist(StorageLevel.DISK_ONLY)
    for _ in range(rounds):

        def count(batches, tagger=tagger):
            pairs, shapes = np.zeros((n + 1) * n), np.zeros(n * m)
            for batch in batches:
                for piece in _pieces(batch.column(0)):
                    own = [np.frombuffer(value, np.int16) for value in piece]
                    for k, path in tagger.paths(own):
                        pairs += np.bincount(np.concatenate(([0], path[:-1] + 1)) * n + path, minlength=len(pairs))
                        shapes += np.bincount(path * m + own[k], minlength=len(shapes))
            whole = np.concatenate((pairs, shapes))
            at = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(whole[at])], names=["at", "n"])

        got = shaped.mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
        whole = np.zeros((n + 1) * n + n * m)
        for r in got:
            whole[r["at"]] = r["n"]
        tagger = Tagger(whole[: (n + 1) * n].reshape(n + 1, n), whole[(n + 1) * n :].reshape(n, m))
    shaped.unpersist()
    return tagger


def tags(tagger: Tagger, text: Column) -> Column:
    """The tag of each word of a text."""

    @F.arrow_udf("array<string>")
    def tag(texts: pa.Array) -> pa.Array:
        out = []
        for piece in _pieces(texts):
            found = dict(tagger.paths([_shaped(t) for t in piece]))
            out += [None if t is None else [TAGS[tag] for tag in found[k]] for k, t in enumerate(piece)]
        return pa.array(out, pa.list_(pa.string()))

    return tag(text)


def tagged(rows: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """``rows`` with tags and maskable: whether each word is a noun or an adjective of letters, as ``mutation.masked`` asks."""
    ship(rows.sparkSession)
    out = rows.select("*", once(tags(tagger, F.col(text))).alias("tags"))
    found = F.transform(F.split(text, " "), lambda w, i: F.get("tags", i).isin("NOUN", "ADJ") & w.rlike(r"^\p{L}+$"))
    return out.select("*", once(found).alias("maskable"))
