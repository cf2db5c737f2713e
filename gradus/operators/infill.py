"""Words at a mark: an interpolated Kneser-Ney model of what stands between two words.

For a word w between u and v, with D = ``DISCOUNT``:

    P(w | u, v) = max(c(u w v) - D, 0) / c(u . v) + D * kinds(u . v) / c(u . v) * (F(w | u) + B(w | v)) / 2

F (forward) and B (backward) are Kneser-Ney estimates of continuations: of the kinds of triples that begin with u
(end with v), those with w in the middle, discounted, and for the rest the share of all kinds of triples
that have w in the middle. A context that never occurred leaves all to the lower order. Over all words that occur, P sums to 1.

Everything is counts of triples and of their kinds, by aggregations that combine before their
shuffle; a model is four tables of distinct triples at most. ``scored`` joins places with the words that are asked for;
``best`` finds the best of all words exactly: those seen beside u or v, and of the others, whose order is
the same at every place, the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .mutation import once

DISCOUNT = 0.75
#: What stands before and after a text.
START, END = "<s>", "</s>"
#: Rows asked for up to which their words are sent to every task.
FEW = 500_000


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def triples(texts: DataFrame, text: str = "text") -> DataFrame:
    """u, w, v and c, how often w stands between u and v."""
    own = texts.where(F.col(text).isNotNull()).select(once(F.concat(F.array(F.lit(START)), words(F.col(text)), F.array(F.lit(END)))).alias("own"))
    # A triple is one string, since words hold no blanks: narrower rows than three columns make.
    each = F.when(F.size("own") > 2, F.transform(F.sequence(F.lit(1), F.size("own") - 2), lambda i: F.concat_ws(" ", F.get("own", i - 1), F.get("own", i), F.get("own", i + 1))))
    counted = own.select(F.explode(each).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    return counted.withColumn("t", F.split("t", " ")).select(*(F.get("t", F.lit(k)).alias(n) for k, n in enumerate("uwv")), "c")


def narrowed(counted: DataFrame, asked: DataFrame, few: int = FEW) -> DataFrame:
    """What a model needs to score the rows of ``asked`` (u, v, w): u, w, v, c and kinds, the triples that a row stands for.

    A neighbour that is not asked for is null, and so is a word that is neither asked for nor beside an asked
    neighbour; triples that are then alike become one row. All triples are still counted. Best on a written
    ``asked``, which is read four times.
    """
    out = counted
    for name in "uvw":
        own = asked.select(name).where(F.col(name).isNotNull()).distinct().withColumn(f"__{name}", F.lit(True))
        # Counted before: one narrow row a word that is asked for.
        out = out.join(F.broadcast(own) if asked.count() <= few else own, name, "left")
    near = F.coalesce(F.col("__u"), F.col("__v"))
    kept = [F.when(F.col("__u"), F.col("u")).alias("u"), F.when(F.coalesce(near, F.col("__w")), F.col("w")).alias("w"), F.when(F.col("__v"), F.col("v")).alias("v")]
    return out.select(*kept, "c").groupBy("u", "w", "v").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("kinds"))


@dataclass
class _Level:
    """Counts of words in a context, and each context's total and kinds."""

    words: DataFrame
    contexts: DataFrame


@dataclass
class Model:
    """Levels of a model: whole (context u, v), forward (u) and backward (v), and each word's share ``p`` (any)."""

    whole: _Level
    forward: _Level
    backward: _Level
    any: DataFrame


def fit(counted: DataFrame) -> Model:
    """``counted`` is what ``triples`` gives, best written first: four aggregations read it.

    Of what ``narrowed`` gives, the model is right for the neighbours and words that were asked for.
    """

    def level(context: list[str], count: Column) -> _Level:
        own = counted.dropna(subset=context).groupBy(*context, "w").agg(count.alias("n"))
        # Totals from the words' rows: one a word and context, so no word is told apart again.
        return _Level(own, own.groupBy(*context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")))

    one = F.sum("kinds") if "kinds" in counted.columns else F.count(F.lit(1))
    shares = counted.dropna(subset=["w"]).groupBy("w").agg(one.alias("n"))
    # One row: the number of kinds of triples.
    kinds = counted.agg(one.alias("all"))
    share = shares.crossJoin(F.broadcast(kinds)).select("w", (F.col("n") / F.col("all")).alias("p"))
    return Model(level(["u", "v"], F.sum("c")), level(["u"], one), level(["v"], one), share)


def _share(rows: DataFrame, level: _Level, on: list[str], name: str) -> DataFrame:
    """``rows`` with the discounted share of w in its context and what the context leaves to the lower order."""
    sums = level.contexts.select(*on, F.col("total").alias("__t"), F.col("kinds").alias("__k"))
    out = rows.join(sums, on, "left").join(level.words.select(*on, "w", F.col("n").alias("__n")), [*on, "w"], "left")
    seen = F.greatest(F.coalesce("__n", F.lit(0)) - F.lit(DISCOUNT), F.lit(0.0)) / F.col("__t")
    left = F.lit(DISCOUNT) * F.col("__k") / F.col("__t")
    return out.withColumns({name: F.coalesce(seen, F.lit(0.0)), f"{name}_left": F.coalesce(left, F.lit(1.0))}).drop("__n", "__t", "__k")


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (u, v, w and others) with ``p``; a word that never occurs has 0 beyond what its contexts say."""
    out = rows.join(model.any, "w", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    for level, on, name in ((model.whole, ["u", "v"], "__whole"), (model.forward, ["u"], "__f"), (model.backward, ["v"], "__b")):
        out = _share(out, level, on, name)
    lower = (F.col("__f") + F.col("__f_left") * F.col("p") + F.col("__b") + F.col("__b_left") * F.col("p")) / 2
    return out.withColumn("p", F.col("__whole") + F.col("__whole_left") * lower).drop(*(f"__{x}{y}" for x in ("whole", "f", "b") for y in ("", "_left")))


def marked(rows: DataFrame, prompt: str = "prompt", mark: str = "[MASK]") -> DataFrame:
    """``rows`` with u and v, the words beside the first mark; rows without a mark go."""
    own = F.concat(F.array(F.lit(START)), words(F.col(prompt)), F.array(F.lit(END)))
    at = F.array_position(own, mark.lower())
    return rows.where(at > 0).withColumns({"u": F.get(own, at.cast("int") - 2), "v": F.get(own, at.cast("int"))})


def best(rows: DataFrame, model: Model, k: int = 1) -> DataFrame:
    """u, v, w, p and rank of the k best words of every pair of neighbours in ``rows``; ties to the smaller word."""
    pairs = rows.select("u", "v").distinct()
    # Of words seen beside neither neighbour, the k most common are as good as any.
    common = model.any.orderBy(F.desc("p"), "w").limit(k).select("w")
    found = pairs.join(model.forward.words.select("u", "w"), "u").unionByName(pairs.join(model.backward.words.select("v", "w"), "v").select("u", "v", "w"))
    found = found.unionByName(pairs.crossJoin(F.broadcast(common))).distinct()
    place = F.row_number().over(Window.partitionBy("u", "v").orderBy(F.desc("p"), "w"))
    return scored(found, model).withColumn("rank", place).where(F.col("rank") <= k)


def filled(prompts: DataFrame, model: Model, prompt: str = "prompt", mark: str = "[MASK]") -> DataFrame:
    """``prompts`` with ``mutated``: the first mark replaced by the best word (none where the model is empty)."""
    placed = marked(prompts, prompt, mark)
    chosen = best(placed, model).select("u", "v", F.col("w").alias("__word"))
    parts = F.split(F.col(prompt), F.lit("\\Q" + mark + "\\E"), 2)
    out = placed.join(chosen, ["u", "v"], "left")
    return out.withColumn("mutated", F.concat(parts[0], F.coalesce("__word", F.lit("")), parts[1])).select(*prompts.columns, "mutated")
