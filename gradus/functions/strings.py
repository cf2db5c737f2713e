"""Column functions on texts, prompts and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Python's str.split() has it.
SPACE = r"[\s\u001c-\u001f\u0085   -     　]+"
NAME_SEPARATOR = "::::"
ID_SEPARATOR = "____SPLIT____"

#: Where a generation ends, by kind of model and by language.
STOPS = {
    "chat": [],
    "completion": ["\n>>>", "\n$", "\nclass", "\ndef", "\n#", "\nprint", "\n@", "\nassert", "\nfor", "\nif __name__ == '__main__':", '\nif __name__ == "__main__":'],
    "python": ["\ndef", "\nclass", "\nif", "\n#", "\nprint"],
    "ts": ["\nexport", "\nimport", "\nexport default", "\nimport default", "\nconsole.log"],
}


def tags(text: Column, tag: str) -> Column:
    """Contents of every <tag>...</tag>."""
    return F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def first_fence(text: Column) -> Column:
    """Content of the first fenced block, or the empty text."""
    return F.regexp_extract(text, r"(?s)```(?:\w+)?\n(.*?)\n```", 1)


def language_blocks(text: Column, language: str) -> Column:
    """Fenced blocks of one language, joined by line feeds."""
    return F.array_join(F.regexp_extract_all(text, F.lit(rf"(?s)```{language}\n(.*?)(?=```)"), F.lit(1)), "\n")


def letters_at_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^[^a-zA-Z\s]+|[^a-zA-Z\s]+$", "")


def truncate_at(text: Column, stops: list[str]) -> Column:
    """The text up to the earliest stop sequence."""
    at = [F.nullif(F.instr(text, s), F.lit(0)) for s in stops]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def cleaned(text: Column, stops: list[str]) -> Column:
    """Without carriage returns, only the first Python fence's content if there is one, cut at the stops."""
    bare = F.replace(text, F.lit("\r"), F.lit(""))
    at = F.instr(bare, "```python")
    rest = F.btrim(F.replace(F.substring(bare, at, F.length(bare)), F.lit("```python"), F.lit("")), F.lit(" \n\t"))
    end = F.instr(rest, "```")
    inner = F.btrim(F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest), F.lit(" \n\t"))
    return truncate_at(F.when(at > 0, inner).otherwise(bare), stops)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def drop_last_line(text: Column) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n")


def template(pattern: str, slots: dict[str, Column]) -> Column:
    """The pattern with {name} replaced; names without a value stay as they are."""
    out = F.lit(pattern)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def sentence_bound(text: Column) -> Column:
    """One more than the number of full stops."""
    return F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) + 1


def composed(*parts: Column) -> Column:
    return F.concat_ws(NAME_SEPARATOR, *parts)


def parsed_name(name: Column) -> Column:
    """Struct of model, data and hyper from a result file's name of 4 or 6 parts; others raise."""
    parts = F.split(name, NAME_SEPARATOR)
    n = F.size(parts)
    model = F.element_at(F.split(F.array_join(F.slice(parts, F.lit(1), n - 3), NAME_SEPARATOR), "/"), -1)
    hyper = F.replace(F.array_join(F.slice(parts, -2, 2), NAME_SEPARATOR), F.lit(".json"), F.lit(""))
    found = F.struct(model.alias("model"), F.element_at(parts, -3).alias("data"), hyper.alias("hyper"))
    return F.when(n.isin(4, 6), found).otherwise(F.raise_error(F.concat(F.lit("not a result's name: "), name)).cast("struct<model:string,data:string,hyper:string>"))


def safe_id(text: Column, sign: str = "_") -> Column:
    return F.replace(text, F.lit("/"), F.lit(sign))


def program(imports: Column, code: Column, tests: Column, gaps: tuple[int, int] = (3, 3)) -> Column:
    return F.concat(imports, F.lit("\n" * gaps[0]), code, F.lit("\n" * gaps[1]), tests)


def messages(prompt: Column, demos: Column | None = None) -> Column:
    """Chat messages: demonstration pairs, then the prompt."""
    last = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    if demos is None:
        return last
    shown = F.flatten(F.transform(demos, lambda d: F.array(F.struct(F.lit("user").alias("role"), d["input"].alias("content")), F.struct(F.lit("assistant").alias("role"), d["output"].alias("content")))))
    return F.concat(shown, last)


def _edited(text: Column, cases: list[tuple[Column, Column]], last: tuple[Column, Column]) -> Column:
    """The first case whose pattern is found after the text's beginning decides; all occurrences change."""
    out = None
    for old, new in cases:
        at, changed = F.instr(text, old) > 1, F.replace(text, old, new)
        out = F.when(at, changed) if out is None else out.when(at, changed)
    return out.otherwise(F.replace(text, *last))


def delete_phrase(text: Column, phrase: Column) -> Column:
    blank = F.lit(" ")
    return _edited(text, [(F.concat(blank, phrase), blank), (F.concat(phrase, blank), blank)], (phrase, F.lit("")))


def add_phrase(text: Column, phrase: Column, after: Column) -> Column:
    blank = F.lit(" ")
    cases = [(F.concat(blank, after), F.concat(blank, after, blank, phrase)), (F.concat(after, blank), F.concat(after, blank, phrase, blank))]
    return F.when(after == "", F.concat(phrase, blank, text)).otherwise(_edited(text, cases, (after, F.concat(after, phrase))))


def swap_phrases(text: Column, one: Column, other: Column) -> Column:
    """Each phrase is first hidden behind a mark, with the blanks around it where it has both."""

    def hidden(where, phrase, mark):
        spaced = F.concat(F.lit(" "), phrase, F.lit(" "))
        return F.when(F.contains(where, spaced), F.replace(where, spaced, F.lit(f" {mark} "))).otherwise(F.replace(where, phrase, F.lit(mark)))

    both = hidden(hidden(text, one, "<1>"), other, "<2>")
    return F.replace(F.replace(both, F.lit("<1>"), other), F.lit("<2>"), one)


def split_tests(prompt: Column) -> Column:
    """Struct of entry (first line), comments and tests (at each '>>> ') of a Python prompt."""
    parts = F.split(prompt, ">>> ", -1)
    lines = F.split(F.element_at(parts, 1), "\n", -1)
    return F.struct(F.element_at(lines, 1).alias("entry"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n").alias("comments"), F.slice(parts, F.lit(2), F.size(parts)).alias("tests"))


def joined_tests(entry: Column, comments: Column, tests: Column) -> Column:
    return F.concat(entry, F.lit("\n"), comments, F.array_join(F.concat(F.array(F.lit("")), tests), ">>> "))


def split_tests_cs(prompt: Column) -> Column:
    """The same for C#: tests from '// >>>' on, comments from the first '//' before them."""
    at = F.instr(prompt, "// >>>")
    head = F.substring(prompt, F.lit(1), at - 1)
    note = F.instr(head, "//")
    return F.struct(F.substring(head, F.lit(1), note - 1).alias("entry"), F.substring(head, note, F.length(head)).alias("comments"), F.substring(prompt, at, F.length(prompt)).alias("tests"))
