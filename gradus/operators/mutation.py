"""Character mutations of task descriptions, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Characters and what they are mistaken for.
HOMOGLYPHS = {
    "-": "˗", "9": "৭", "8": "Ȣ", "7": "𝟕", "6": "б", "5": "Ƽ", "4": "Ꮞ", "3": "Ʒ", "2": "ᒿ", "1": "l", "0": "O", "'": "`",
    "a": "ɑ", "b": "Ь", "c": "ϲ", "d": "ԁ", "e": "е", "f": "𝚏", "g": "ɡ", "h": "հ", "i": "і", "j": "ϳ", "k": "𝒌", "l": "ⅼ",
    "m": "ｍ", "n": "ո", "o": "о", "p": "р", "q": "ԛ", "r": "ⲅ", "s": "ѕ", "t": "𝚝", "u": "ս", "v": "ѵ", "w": "ԝ", "x": "×",
    "y": "у", "z": "ᴢ",
}

SENTENCES, WORDS = 50, 3


def _pieces(word: Column, i: Column, skip: int) -> tuple[Column, Column]:
    """The word before place i (from 0) and from place i + skip."""
    return F.substring(word, F.lit(1), i), F.substring(word, i + 1 + skip, F.length(word))


def _places(word: Column, last: Column) -> Column:
    return F.when(F.length(word) > 1, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def neighbour_swaps(word: Column) -> Column:
    def swap(i):
        head, tail = _pieces(word, i, 2)
        return F.concat(head, F.substring(word, i + 2, F.lit(1)), F.substring(word, i + 1, F.lit(1)), tail)

    return F.transform(_places(word, F.length(word) - 2), swap)


def letter_inserts(word: Column, seed: Column) -> Column:
    """A letter drawn by md5 of seed, word and place before every character."""

    def insert(i):
        head, tail = _pieces(word, i, 0)
        drawn = F.conv(F.substring(F.md5(F.concat_ws("|", seed, word, i.cast("string"))), 1, 4), 16, 10).cast("int") % 52
        return F.concat(head, F.substring(F.lit(LETTERS), drawn + 1, F.lit(1)), tail)

    return F.transform(_places(word, F.length(word) - 1), insert)


def character_deletes(word: Column) -> Column:
    def delete(i):
        head, tail = _pieces(word, i, 1)
        return F.concat(head, tail)

    return F.transform(_places(word, F.length(word) - 1), delete)


def homoglyphs(word: Column) -> Column:
    """One character replaced, for every character that has a look-alike."""
    table = F.create_map(*(F.lit(x) for pair in HOMOGLYPHS.items() for x in pair))

    def replaced(i):
        head, tail = _pieces(word, i, 1)
        return F.concat(head, F.try_element_at(table, F.substring(word, i + 1, F.lit(1))), tail)

    places = F.when(F.length(word) > 0, F.sequence(F.lit(0), F.length(word) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(places, replaced), lambda w: w.isNotNull())


def mutants(word: Column, seed: Column) -> Column:
    return F.concat(neighbour_swaps(word), letter_inserts(word, seed), character_deletes(word), homoglyphs(word))


def once(value: Column) -> Column:
    """``value`` as a row's own generated column, which later expressions read and do not repeat."""
    return F.explode(F.array(value))


def mutated_word(word: Column, seed: Column) -> Column:
    """A mutant drawn by md5, or the word itself where it has none."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", seed, word)), 1, 7), 16, 10).cast("int")
    # The one-element transform binds the pool, which is long, to a name.
    return F.transform(F.array(mutants(word, seed)), lambda pool: F.coalesce(F.try_element_at(pool, drawn % F.greatest(F.size(pool), F.lit(1)) + 1), word))[0]


def alphabetic(word: Column) -> Column:
    return word.rlike(r"^\p{L}+$")


def mutated(rows: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """``rows`` (key, text, candidate) as key, candidate and mutated: up to ``words`` alphabetic words, chosen by md5 order, are mutated.

    Choice, mutants and text are generated one after the other, so each is computed once a row.
    """
    name = F.concat_ws("|", F.col(key).cast("string"), F.col("candidate").cast("string"))
    tokens = F.transform(F.split(text, " "), lambda w, i: F.struct(F.md5(F.concat_ws("|", F.col("__seed"), i.cast("string"))).alias("d"), i.alias("i"), w.alias("w")))
    picks = F.slice(F.array_sort(F.filter(tokens, lambda t: alphabetic(t["w"]))), 1, words)
    out = rows.select(key, text, "candidate", name.alias("__seed"))
    out = out.select(key, text, "candidate", "__seed", once(picks).alias("__picks"))
    changed = F.map_from_entries(F.transform("__picks", lambda t: F.struct(t["i"], mutated_word(t["w"], F.col("__seed")))))
    out = out.select(key, text, "candidate", once(changed).alias("__changed"))
    done = F.transform(F.split(text, " "), lambda w, i: F.coalesce(F.try_element_at(F.col("__changed"), i), w))
    return out.select(key, "candidate", F.array_join(done, " ").alias("mutated"))


def mutated_sentences(rows: DataFrame, key: str, text: str, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """key, candidate and mutated for ``sentences`` candidates of each row."""
    return mutated(rows.select(key, text, F.explode(F.sequence(F.lit(1), F.lit(sentences))).alias("candidate")), key, text, words)


def chosen_sentence(rows: DataFrame, key: str, text: str, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """key and mutated: the one of each row's candidates that comes first by md5 order. Which one does not depend on its words, so only it is mutated."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(sentences)), lambda c: F.struct(F.md5(F.concat_ws("|", F.lit("choice"), F.col(key).cast("string"), c.cast("string"))).alias("d"), c.alias("c")))
    return mutated(rows.select(key, text, F.array_min(draws)["c"].alias("candidate")), key, text, words).drop("candidate")


def masked(rows: DataFrame, key: str, text: str, candidates: int = 10, mark: str = "[MASK]", maskable: Column | None = None) -> DataFrame:
    """key, place and prompt: up to ``candidates`` words, not at either end, each masked in a text of its own, in md5 order.

    ``maskable`` is an array of booleans by word, such as a tagger's nouns and adjectives; without one, words of letters are.
    """
    words = F.split(text, " ")
    fits = (lambda w, i: alphabetic(w)) if maskable is None else (lambda w, i: F.coalesce(F.get(maskable, i), F.lit(False)))
    order = lambda i: F.md5(F.concat_ws("|", F.col(key).cast("string"), i.cast("string")))
    places = F.filter(F.transform(words, lambda w, i: F.when((i > 0) & (i < F.size(words) - 1) & fits(w, i), F.struct(order(i).alias("d"), i.alias("i")))), lambda x: x.isNotNull())
    out = rows.select(key, text, F.explode(F.slice(F.array_sort(places), 1, candidates)["i"]).alias("place"))
    return out.select(key, "place", F.array_join(F.transform(words, lambda w, i: F.when(i == F.col("place"), F.lit(mark)).otherwise(w)), " ").alias("prompt"))


def filled(prompts: DataFrame, fill, mark: str = "[MASK]") -> DataFrame:
    """``prompts`` with ``mutated``: the mark replaced by what ``fill`` (prompts to words, in the workers) answers."""

    def run(frames):
        for frame in frames:
            answers = fill(frame["prompt"].tolist())
            yield frame.assign(mutated=[p.replace(mark, a, 1) for p, a in zip(frame["prompt"], answers)])

    return prompts.mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in prompts.dtypes)}, mutated string")
