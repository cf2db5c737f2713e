"""Phrases of a text: constituents of its sentences' best trees under a small weighted grammar (CKY).

Words get their parts of speech from ``tagging``; a sentence is a run of words up to one that ends with
``.``, ``!`` or ``?``, and one of more than ``LONGEST`` words is parsed in stretches of at most that
many, because the chart grows with the cube of the length: every word is in a tree. A phrase is a lowest constituent of two words or
more, or a word that stands beside one, so a text's phrases are disjoint and all its words are in them.

Nulls, ties: a null text has no phrases, nor has one without words; of equal trees the one whose first cut comes
first is taken, then the rule that comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from . import tagging

LONGEST = 40
#: Rules of two parts and their weights (logarithms).
RULES = (
    ("S", "NP", "VP", 0.0), ("S", "S", "PP", -1.0), ("S", "S", "CS", -0.5), ("S", "S", "S", -3.0), ("CS", "CONJ", "S", 0.0),
    ("NP", "DET", "NB", 0.0), ("NP", "NUM", "NB", 0.0), ("NP", "NP", "PP", -0.7), ("NP", "NP", "CN", -0.7), ("CN", "CONJ", "NP", 0.0),
    ("NB", "ADJ", "NB", 0.0), ("NB", "NOUN", "NB", -0.5), ("PP", "ADP", "NP", 0.0),
    ("VP", "VERB", "NP", 0.0), ("VP", "VERB", "ADJ", -0.5), ("VP", "VERB", "VP", -0.7), ("VP", "VP", "PP", -0.5), ("VP", "ADV", "VP", -0.3), ("VP", "VP", "ADV", -0.3),
)
#: What else a word of a tag may be by itself.
LEXICAL = {"NOUN": {"NB": -0.1, "NP": -0.6}, "PRON": {"NP": 0.0, "DET": -1.0}, "NUM": {"NP": -1.0}, "VERB": {"VP": -0.5}, "ADJ": {"NP": -2.0}, "DET": {"NP": -2.0}}
#: What may stand for a sentence; any single word may, at ``WORD``.
WHOLE, WORD = {"NP": -4.0, "VP": -3.0, "PP": -4.0, "CS": -4.0}, -6.0

NAMES = sorted({x for r in RULES for x in r[:3]} | set(tagging.TAGS))
_AT = {x: i for i, x in enumerate(NAMES)}
_TO, _LEFT, _RIGHT = (np.array([_AT[r[i]] for r in RULES]) for i in range(3))
_WEIGHT = np.array([r[3] for r in RULES])
_S = _AT["S"]
_PARTS = np.array([_AT[x] for x in WHOLE])
_COST = np.array(list(WHOLE.values()))

Tree = tuple  # (name, start, end, parts)


def _closed(cell: np.ndarray) -> int:
    """Let the best whole part stand for a sentence; which one, -1 if none is better."""
    k = int((cell[_PARTS] + _COST).argmax())
    if cell[_PARTS[k]] + _COST[k] > cell[_S]:
        cell[_S] = cell[_PARTS[k]] + _COST[k]
        return int(_PARTS[k])
    return -1


def parse(tags: list[str]) -> tuple[float, Tree]:
    """Weight and tree of the best sentence over the tags."""
    n, k = len(tags), len(NAMES)
    chart = np.full((n, n + 1, k), -np.inf)
    whole = np.full((n, n + 1), -1)
    back: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for i, tag in enumerate(tags):
        cell = chart[i, i + 1]
        cell[_AT[tag]] = 0.0
        for name, w in LEXICAL.get(tag, {}).items():
            cell[_AT[name]] = w
        cell[_S] = WORD
        whole[i, i + 1] = _closed(cell)
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            j = i + size
            cuts = np.arange(i + 1, j)
            each = chart[i, cuts][:, _LEFT] + chart[cuts, j][:, _RIGHT] + _WEIGHT
            cut = each.argmax(axis=0)
            best = each[cut, np.arange(len(RULES))]
            cell, rule = chart[i, j], np.full(k, -1)
            for r in range(len(RULES)):
                if best[r] > cell[_TO[r]]:
                    cell[_TO[r]], rule[_TO[r]] = best[r], r
            back[i, j] = rule, cuts[cut]
            whole[i, j] = _closed(cell)

    def tree(i: int, j: int, name: int) -> Tree:
        if name == _S and whole[i, j] >= 0:
            return ("S", i, j, (tree(i, j, int(whole[i, j])),))
        if j == i + 1:
            return (NAMES[name], i, j, ())
        rules, cuts = back[i, j]
        r = int(rules[name])
        at = int(cuts[r])
        return (NAMES[name], i, j, (tree(i, at, int(_LEFT[r])), tree(at, j, int(_RIGHT[r]))))

    return float(chart[0, n, _S]), tree(0, n, _S)


def lowest(tree: Tree) -> list[tuple[int, int]]:
    """Stretches of the lowest constituents, and of the words beside them."""
    name, i, j, parts = tree
    if j - i == 1 or all(p[2] - p[1] == 1 for p in parts):
        return [(i, j)]
    return [x for p in parts for x in lowest(p)]


def _text_phrases(text: str | None, tagger: tagging.Tagger) -> list[str] | None:
    if text is None:
        return None
    words = text.split()
    out, first = [], 0
    for at, word in enumerate(words, 1):
        if at == len(words) or at - first == LONGEST or word[-1] in ".!?":
            own = words[first:at]
            tags = [tagging.TAGS[k] for k in tagger.path(np.array([tagging.shape(w) for w in own], np.int64))]
            out += [" ".join(own[i:j]) for i, j in lowest(parse(tags)[1])]
            first = at
    return out


def phrased(rows: DataFrame, tagger: tagging.Tagger, text: str = "text") -> DataFrame:
    """``rows`` with phrases, an array of disjoint stretches of the text in their order."""
    ship(rows.sparkSession)

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([_text_phrases(t, tagger) for t in texts.to_pylist()], pa.list_(pa.string()))

    return rows.withColumn("phrases", found(F.col(text)))
