"""Searches over prompts: driver loops whose scoring is one job for all candidates of a round."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Scores of candidates, in their order; one Spark job a call.
Scorer = Callable[[list[str]], list[float]]


def frame_scorer(spark: SparkSession, examples: DataFrame, score) -> Scorer:
    """A scorer that meets every candidate with every example and averages ``score`` (a column over prompt and example).

    Candidates are a round's few prompts: a bounded broadcast.
    """

    def run(prompts: list[str]) -> list[float]:
        grid = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "place int, prompt string")
        got = examples.crossJoin(F.broadcast(grid)).groupBy("place").agg(F.avg(score).alias("s")).collect()
        found = {r["place"]: r["s"] for r in got}
        return [found.get(i, 0.0) for i in range(len(prompts))]

    return run


def draw(*keys) -> float:
    """A number from 0 to 1 by md5."""
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:13], 16) / 16**13


def pick(items: list, *keys):
    return items[int(draw(*keys) * len(items))]


def phrases(text: str, level: str, chunker: Callable[[str], list[str]] | None = None) -> list[str]:
    """Words, sentences, spans of five words, or phrases: by ``chunker``, which a parser's user passes, else by function words and punctuation."""
    if level == "word":
        return text.split()
    if level == "sentence":
        return [s.strip() for s in text.replace("!", ".").replace("?", ".").split(".") if s.strip()]
    if level == "phrase":
        return (chunker or chunks)(text)
    words = text.split()
    return [" ".join(words[i : i + 5]) for i in range(0, len(words), 5)]


#: Words that begin a new phrase where no parser tells.
_BEGIN = frozenset("a an the this that these those and or but if when while that which who to of in on at by for with from into about as than is are was were be will would can could should must".split())


def chunks(text: str) -> list[str]:
    """Disjoint phrases in order: they end at punctuation and before a function word that follows another word."""
    out: list[list[str]] = [[]]
    for word in text.split():
        if out[-1] and word.lower().strip(".,;:!?") in _BEGIN and out[-1][-1].lower() not in _BEGIN:
            out.append([])
        out[-1].append(word.strip(".,;:!?"))
        if word[-1] in ".,;:!?":
            out.append([])
    return [" ".join(w for w in part if w) for part in out if any(part)]


def _found(text: str, cases: list[tuple[str, str]], last: tuple[str, str]) -> str:
    """As ``strings``' phrase edits: the first case found after the text's beginning changes everywhere, else the last."""
    for old, new in cases:
        if text.find(old) > 0:
            return text.replace(old, new)
    return text.replace(*last) if last[0] else text


def edited(kind: str, text: str, one: str, other: str = "") -> str:
    """delete ``one``; swap ``one`` and ``other``; add ``other`` after ``one`` (before all, where that is empty)."""
    if kind == "delete":
        return _found(text, [(f" {one}", " "), (f"{one} ", " ")], (one, ""))
    if kind == "add":
        return _found(text, [(f" {one}", f" {one} {other}"), (f"{one} ", f"{one} {other} ")], (one, one + other)) if one else f"{other} {text}"
    for phrase, mark in ((one, "<1>"), (other, "<2>")):
        spaced = f" {phrase} "
        text = text.replace(spaced, f" {mark} ") if spaced in text else text.replace(phrase, mark)
    return text.replace("<1>", other).replace("<2>", one)


def edit_search(base: str, scorer: Scorer, rounds: int = 10, candidates: int = 5, patience: int = 3, level: str = "word", seed: int = 0) -> tuple[str, list[float]]:
    """Delete, swap and (once something was deleted) add phrases; the best candidate replaces the base when it scores higher."""
    best = scorer([base])[0]
    deleted: list[str] = []
    waited, path = 0, [best]
    for turn in range(rounds):
        parts = phrases(base, level)
        if not parts:
            break
        kinds = ["delete", "swap"] + ["add"] * bool(deleted)
        made = []
        for c in range(candidates):
            kind, one, other = pick(kinds, seed, turn, c), pick(parts, seed, turn, c, "a"), pick(parts, seed, turn, c, "b")
            if kind == "add":  # also before all
                one, other = pick([*parts, ""], seed, turn, c, "a"), pick(deleted, seed, turn, c, "d")
            made.append((" ".join(edited(kind, base, one, other).split()), kind, one if kind == "delete" else other))
        got = scorer([m[0] for m in made])
        k = int(np.argmax(got))
        if got[k] > best:
            base, best, waited = made[k][0], got[k], 0
            if made[k][1] == "delete":
                deleted.append(made[k][2])
            elif made[k][1] == "add":
                deleted.remove(made[k][2])
        else:
            waited += 1
        path.append(best)
        if waited >= patience:
            break
    return base, path


def model_search(seeds: list[str], scorer: Scorer, complete: Callable[[list[str]], list[str]], rounds: int = 5) -> tuple[str, list[float]]:
    """Show the three best prompts with their scores, ask for a better one, score it, go on."""
    pool = list(zip(seeds, scorer(seeds)))
    path = [max(s for _, s in pool)]
    for _ in range(rounds):
        top = sorted(pool, key=lambda x: -x[1])[:3]
        ask = "Write a prompt better than these:\n" + "\n".join(f"{p} -> {s:.3f}" for p, s in top)
        new = complete([ask])[0]
        pool.append((new, scorer([new])[0]))
        path.append(max(path[-1], pool[-1][1]))
    return max(pool, key=lambda x: x[1])[0], path


def greedy(vocabulary: list[str], scorer: Scorer, length: int = 5) -> tuple[str, float]:
    """Append the token that scores best, ``length`` times; the first wins ties."""
    text, best = "", 0.0
    for _ in range(length):
        made = [f"{text} {t}".strip() for t in vocabulary]
        got = scorer(made)
        k = int(np.argmax(got))
        text, best = made[k], got[k]
    return text, best


def random_search(vocabulary: list[str], scorer: Scorer, tries: int = 64, length: int = 5, seed: int = 0) -> tuple[str, float]:
    made = [" ".join(pick(vocabulary, seed, t, i) for i in range(length)) for t in range(tries)]
    got = scorer(made)
    k = int(np.argmax(got))
    return made[k], got[k]


def genetic(vocabulary: list[str], scorer: Scorer, population: int = 128, mutants: int = 64, crossings: int = 64, rounds: int = 30, length: int = 5, keep: float = 0.1, chance: float = 0.1, patience: int = 10, seed: int = 0) -> tuple[str, list[float]]:
    """Token mutation, crossover by coin flips between parents, survival of the best share."""
    known: dict[str, float] = {}

    def scored(texts: list[str]) -> None:
        new = [t for t in dict.fromkeys(texts) if t not in known]
        if new:
            known.update(zip(new, scorer(new)))

    pool = [" ".join(pick(vocabulary, seed, "p", i, k) for k in range(length)) for i in range(population)]
    scored(pool)
    path, waited = [max(known.values())], 0
    for turn in range(rounds):
        elite = sorted(dict.fromkeys(pool), key=lambda t: -known[t])[: max(1, int(len(pool) * keep))]
        born = []
        for m in range(mutants):
            words = pick(elite, seed, turn, "m", m).split()
            born.append(" ".join(pick(vocabulary, seed, turn, m, i) if draw(seed, turn, "c", m, i) < chance else w for i, w in enumerate(words)))
        for c in range(crossings):
            one, other = pick(elite, seed, turn, "x", c).split(), pick(elite, seed, turn, "y", c).split()
            born.append(" ".join(a if draw(seed, turn, "z", c, i) < 0.5 else b for i, (a, b) in enumerate(zip(one, other))))
        pool = list(dict.fromkeys(elite + born))
        scored(pool)
        best = max(known[t] for t in pool)
        waited = 0 if best > path[-1] else waited + 1
        path.append(max(best, path[-1]))
        if waited >= patience:
            break
    return max(known, key=lambda t: known[t]), path


def swarm(vocabulary: list[str], scorer: Scorer, population: int = 128, rounds: int = 30, length: int = 5, seed: int = 0) -> tuple[str, list[float]]:
    """Particles of tokens whose places turn towards their own and the swarm's best, each place with a velocity of its own.

    A velocity gains by 3 where a place has the best one's token and loses by 3 where not, with an inertia that falls from .8 to .2;
    squashed, it is the chance that the place turns. The pull of the own best falls as the inertia does, that of the swarm's rises.
    """
    words = [[pick(vocabulary, seed, i, k) for k in range(length)] for i in range(population)]
    speed = [[6 * draw(seed, "v", i, k) - 3 for k in range(length)] for i in range(population)]
    own = [(list(w), s) for w, s in zip(words, scorer([" ".join(w) for w in words]))]
    best = max(own, key=lambda x: x[1])
    path = [best[1]]
    for turn in range(rounds):
        ease = turn / max(1, rounds)
        inertia, to_own, to_best = 0.8 - 0.6 * ease, 0.8 - 0.6 * ease, 0.2 + 0.6 * ease
        for i, w in enumerate(words):
            for k in range(length):
                same, near = (3 if w[k] == target[k] else -3 for target in (own[i][0], best[0]))
                speed[i][k] = inertia * speed[i][k] + (1 - inertia) * (same + near)
            turned = [1 / (1 + np.exp(-x)) for x in speed[i]]
            for target, pull, name in ((own[i][0], to_own, "o"), (best[0], to_best, "b")):
                if draw(seed, turn, name, i) < pull:
                    w = [b if draw(seed, turn, name, i, k) < turned[k] else a for k, (a, b) in enumerate(zip(w, target))]
            if draw(seed, turn, "m", i) < 0.5:  # a mutation in one place
                k = int(draw(seed, turn, "p", i) * length)
                w = [*w[:k], pick(vocabulary, seed, turn, "w", i), *w[k + 1 :]]
            words[i] = w
        for i, s in enumerate(scorer([" ".join(w) for w in words])):
            if s > own[i][1]:
                own[i] = (list(words[i]), s)
        best = max([best, *own], key=lambda x: x[1])
        path.append(best[1])
    return " ".join(best[0]), path
