"""Label words and prompt patterns of classification datasets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .strings import template

#: Label words by dataset, and those that masked models use instead.
LABEL_WORDS = {
    "xnli": ("yes", "maybe", "no"), "mnli": ("yes", "maybe", "no"), "snli": ("yes", "maybe", "no"), "anli": ("yes", "maybe", "no"),
    "sst2": ("negative", "positive"), "yelp_polarity": ("negative", "positive"), "rte": ("yes", "no"), "qnli": ("yes", "no"),
    "mrpc": ("no", "yes"), "qqp": ("no", "yes"), "boolq": ("no", "yes"), "ag_news": ("World", "Sports", "Business", "Technology"),
}
MASKED_LABEL_WORDS = {
    "SetFit/sst2": ("terrible", "great"), "yelp_polarity": ("terrible", "great"), "SetFit/CR": ("terrible", "great"), "rotten_tomatoes": ("terrible", "great"),
    "rl-cr": ("terrible", "great"), "rl-mr": ("terrible", "great"), "rl-sst-2": ("terrible", "great"), "rl-yelp-2": ("terrible", "great"),
    "ag_news": ("World", "Sports", "Business", "Tech"), "SetFit/sst5": ("terrible", "bad", "okay", "good", "great"), "yelp_review_full": ("terrible", "bad", "okay", "good", "great"),
}
MARKS = {"masked": "Ġ", "sequence": "▁"}

#: Endings of the prompt patterns by dataset.
ENDINGS = {
    "rte": " {prompt}. Sentence 1: {sentence_1}, Sentence 2: {sentence_2}, Textual Entailment: ",
    "sst2": " {prompt}. Sentence: {sentence_1}, Sentiment: ",
    "mrpc": " {prompt}. Sentence 1: {sentence_1}, Sentence 2: {sentence_2}, Semantically Equivalent: ",
    "qqp": " {prompt}. Sentence 1: {sentence_1}, Sentence 2: {sentence_2}, Semantically Equivalent: ",
    "qnli": " {prompt}. Question: {sentence_1}, Sentence: {sentence_2}, Entailment: ",
    "mnli": " {prompt} {sentence_1} {sentence_2} Entailment: ",
}

#: The columns that hold a dataset's one or two texts.
TEXT_COLUMNS = {
    "mnli": ("premise", "hypothesis"), "snli": ("premise", "hypothesis"), "xnli": ("premise", "hypothesis"), "sst2": ("sentence", "sentence"), "rte": ("sentence1", "sentence2"),
    "mrpc": ("sentence1", "sentence2"), "qnli": ("question", "sentence"), "qqp": ("question1", "question2"), "boolq": ("question", "passage"),
}


def label_words(dataset: str, masked: bool) -> list[str]:
    """A dataset's label words with the mark that stands for a blank before a token; an unknown dataset raises."""
    words = (MASKED_LABEL_WORDS.get(dataset) if masked else None) or LABEL_WORDS[dataset]
    return [MARKS["masked" if masked else "sequence"] + w for w in words]


def text_columns(dataset: str) -> tuple[str, str]:
    return TEXT_COLUMNS.get(dataset, ("text", "text"))


def prompt(dataset: str, text: Column, first: Column, second: Column | None = None) -> Column:
    slots = {"prompt": text, "sentence_1": first} | ({"sentence_2": second} if second is not None else {})
    return template(ENDINGS[dataset], slots)


#: What undoes Treebank tokens, in this order: (pattern, groups to keep). Patterns hold in Java's and in RE2's syntax.
TREEBANK = (
    (r"(?i)\b(can)\s(not)\b", r"\1\2"), (r"(?i)\b(gim)\s(me)\b", r"\1\2"), (r"(?i)\b(gon)\s(na)\b", r"\1\2"), (r"(?i)\b(got)\s(ta)\b", r"\1\2"), (r"(?i)\b(lem)\s(me)\b", r"\1\2"), (r"(?i)\b(wan)\s(na)\b", r"\1\2"),
    (r"([^' ])\s('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1\2 "), (r"([^' ])\s('[sS]|'[mM]|'[dD]|') ", r"\1\2 "), (r"(\S)\s('')", r"\1\2"), (r"''", '"'),
    (r" -- ", "--"), (r"([\[({<])\s", r"\1"), (r"\s([\])}>])", r"\1"),
    (r"([^'])\s'\s", r"\1' "), (r"\s([?!])", r"\1"), (r"([^.])\s(\.)([\])}>\"']*)\s*$", r"\1\2\3"), (r"([#$])\s", r"\1"), (r"\s([;%])", r"\1"), (r"\s\.\.\.\s", "..."), (r"\s([:,])", r"\1"),
    (r"([ (\[{<])\s``", r"\1``"), (r"(``)\s", r"\1"), (r"``", '"'),
)


def detokenised(words: Column) -> Column:
    """Words joined with blanks, then the Treebank rules undone."""
    out = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    for pattern, kept in TREEBANK:
        out = F.regexp_replace(out, pattern, kept.replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3"))
    return F.btrim(out)
