"""Column functions on numbers and arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pass_at_k(n: Column, c: Column, k: int, strict: bool = False) -> Column:
    """Unbiased chance that one of k samples of n, c of them right, is right.

    1 where fewer than k samples are wrong, even if none is right; with
    ``strict`` null where there are fewer than k samples.
    """
    # sequence() counts down when its end is below its start, hence the case c = 0.
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    out = F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - miss)
    return F.when(n < k, F.lit(None)).otherwise(out) if strict else out


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / total(e))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def label_gap(p: Column, label: Column) -> Column:
    """p of the label less the largest other; entries equal to the label's count as -1."""
    own = F.element_at(p, label + 1)
    return own - F.array_max(F.transform(p, lambda x: F.when(x == own, -1.0).otherwise(x)))


def gap_reward(gap: Column, right: float = 200.0, wrong: float = 180.0) -> Column:
    return F.when(gap > 0, gap * right).otherwise(gap * wrong)


def cross_entropy_of_probabilities(p: Column, label: Column) -> Column:
    """Negated cross-entropy of a second softmax over probabilities."""
    return F.element_at(p, label + 1) - F.ln(total(F.transform(p, lambda x: F.exp(x))))


def kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: a * F.ln(a / b)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def brevity_penalty(reference: Column, hypothesis: Column) -> Column:
    return F.when(hypothesis > reference, 1.0).when(hypothesis == 0, 0.0).otherwise(F.exp(1 - reference / hypothesis))


def closest_length(lengths: Column, hypothesis: Column) -> Column:
    """The reference length nearest to the hypothesis'; the shorter of two equally near."""
    return F.array_min(F.transform(lengths, lambda n: F.struct(F.abs(n - hypothesis).alias("d"), n.alias("n"))))["n"]


def ngrams(tokens: Column, n: int) -> Column:
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice(tokens, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))


def padded(tokens: Column, n: int, left: str | None = None, right: str | None = None) -> Column:
    """Tokens with n - 1 pads on the sides that have a symbol."""
    sides = [F.array_repeat(F.lit(left), n - 1) if left is not None else None, tokens, F.array_repeat(F.lit(right), n - 1) if right is not None else None]
    return F.concat(*[s for s in sides if s is not None])


def geometric_mean(values: list[Column], weights: list[float]) -> Column:
    out = F.lit(0.0)
    for v, w in zip(values, weights):
        out = out + F.lit(w) * F.ln(v)
    return F.exp(out)


def standardised(values: Column, means: Column, variances: Column, demean_only: bool = False) -> Column:
    centred = F.zip_with(values, means, lambda x, m: x - m)
    return centred if demean_only else F.zip_with(centred, variances, lambda x, v: x / F.sqrt(v))
