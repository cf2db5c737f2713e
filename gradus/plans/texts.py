"""Queries on texts, prompts, joins and similarity, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import maths, strings
from ..operators import mutation, quantiles, similarity
from ..registry import Entry
from . import views as v
from .scores import _round

_DOCS = lambda s, d: v.table(s, d, "documents")
_NL = "chr(10)"


def _fenced(s, d):
    return _DOCS(s, d).select("doc_id", F.concat(F.lit("x\n```python\n"), "text", F.lit("\n```\nrest\r\n")).alias("answer"), "text")


def _names(s, d):
    o, n = v.table(s, d, "orders"), v.table(s, d, "nation")
    return o.select("o_orderkey", F.concat_ws("::::", F.concat(F.lit("org/"), "o_orderpriority"), F.col("o_orderstatus"), F.lit("0.8"), F.concat(F.col("o_custkey").cast("string"), F.lit(".json"))).alias("name"))


def _precisions_sql(method: int) -> list[str]:
    """SQL of the four smoothed precisions; 5 and 7 read num_5 and den_5 as well."""
    num, den = [f"num_{i}" for i in range(1, 6)], [f"den_{i}" for i in range(1, 6)]
    p = [f"{a} / CAST({b} AS DOUBLE)" for a, b in zip(num, den)]
    if method == 0:
        return [f"CASE WHEN {a} = 0 THEN 2.2250738585072014e-308 ELSE {x} END" for a, x in zip(num[:4], p)]
    if method == 1:
        return [f"CASE WHEN {a} = 0 THEN 0.1 / {b} ELSE {x} END" for a, b, x in zip(num[:4], den, p)]
    if method == 2:
        return [f"({a} + 1) / CAST({b} + 1 AS DOUBLE)" for a, b in zip(num[:4], den)]
    if method == 3:
        zero = [" + ".join(f"CAST({a} = 0 AS INT)" for a in num[: i + 1]) for i in range(4)]
        return [f"CASE WHEN {a} = 0 THEN 1 / (pow(2.0, {z}) * {b}) ELSE {x} END" for a, b, z, x in zip(num, den, zero, p)]
    if method in (4, 7):
        p[:4] = [f"CASE WHEN {a} <> 0 THEN {x} WHEN hyp_len > 1 THEN ({i} + 5.0 / ln(hyp_len)) / {b} WHEN hyp_len = 1 THEN NULL ELSE {x} END" for i, (a, b, x) in enumerate(zip(num[:4], den, p))]
    if method in (5, 7):
        out, before = [], f"(({p[0]}) + 1)"
        for i in range(4):
            before = f"(({before} + ({p[i]}) + ({p[i + 1]})) / 3)"
            out.append(before)
        return out
    if method == 6:
        third = f"((num_3 + 5 * CASE WHEN num_1 = 0 THEN 0.0 ELSE pow({p[1]}, 2) / ({p[0]}) END) / (greatest(0, hyp_len - 2) + 5.0))"
        fourth = f"((num_4 + 5 * CASE WHEN num_2 = 0 THEN 0.0 ELSE pow({third}, 2) / ({p[1]}) END) / (greatest(0, hyp_len - 3) + 5.0))"
        return [*p[:2], *(f"CASE WHEN num_3 = 0 THEN NULL ELSE {x} END" for x in (third, fourth))]
    return p[:4]


_BP = "CASE WHEN hyp_len > ref_len THEN 1.0 WHEN hyp_len = 0 THEN 0.0 ELSE exp(1 - ref_len / CAST(hyp_len AS DOUBLE)) END"


def _bleu_sql(method: int) -> str:
    return f"CASE WHEN num_1 = 0 THEN 0.0 ELSE {_BP} * exp({' + '.join(f'ln({x}) / 4' for x in _precisions_sql(method))}) END"


def reweighed_sql() -> str:
    """Smoothing 1 over as many orders as a hypothesis shorter than four words has."""
    p = _precisions_sql(1)
    cases = " ".join(f"WHEN hyp_len = {n} THEN {' + '.join(f'ln({x}) / {n}' for x in p[:n])}" for n in range(1, 4))
    return f"CASE WHEN num_1 = 0 THEN 0.0 ELSE {_BP} * exp(CASE {cases} ELSE {' + '.join(f'ln({x}) / 4' for x in p)} END) END"


def _grams_sql(side: str, orders: int = 4) -> str:
    parts = " UNION ALL ".join(f"SELECT pair_id, {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram FROM {side}w" for n in range(1, orders + 1))
    return f"{side}w AS (SELECT pair_id, list_filter(string_split_regex({'hypothesis' if side == 'h' else 'reference'}, '\\s+'), lambda x: x <> '') AS w FROM pairs), {side}g AS (SELECT pair_id, n, gram, count(*) AS k FROM ({parts}) GROUP BY ALL)"


def _matches_sql(orders: int = 4) -> str:
    each = ", ".join(f"coalesce((SELECT CAST(num AS BIGINT) FROM met m WHERE m.pair_id = hw.pair_id AND n = {n}), 0) AS num_{n}, greatest(1, CAST(len(hw.w) AS BIGINT) - {n - 1}) AS den_{n}" for n in range(1, orders + 1))
    return (
        f"WITH {v.PAIRS}, {_grams_sql('h', orders)}, {_grams_sql('r', orders)}, met AS (SELECT h.pair_id, h.n, sum(least(h.k, coalesce(r.k, 0))) AS num FROM hg h LEFT JOIN rg r USING (pair_id, n, gram) GROUP BY ALL), "
        f"matched AS (SELECT pair_id, CAST(len(hw.w) AS BIGINT) AS hyp_len, CAST(len(rw.w) AS BIGINT) AS ref_len, {each} FROM hw JOIN rw USING (pair_id)) "
    )


_MATCHES = _matches_sql()


def _matched(s, d, orders=4):
    return similarity.matches(v.pairs(s, d), orders)


#: Pairs whose second reference is the hypothesis without its first words.
_TWO = "two AS (SELECT pair_id, hypothesis, [reference, array_to_string(list_filter(string_split_regex(hypothesis, '\\s+'), lambda x: x <> '')[6:], ' ')] AS refs FROM pairs)"


def _two_references(s, d):
    rest = F.array_join(F.slice(strings.tokens(F.col("hypothesis")), F.lit(6), F.greatest(F.lit(0), F.size(strings.tokens(F.col("hypothesis"))))), " ")
    return v.pairs(s, d).select("pair_id", "hypothesis", F.array("reference", rest).alias("references"))



def _mutants_sql(source: str, seed: str | None) -> str:
    """CTEs that end in ``mutant``: ``source`` (w, and seed without a fixed one) with m, the mutant that md5 draws."""
    by = f"'{seed}'" if seed else "seed"
    longer = "length(w) > 1"
    look = ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in mutation.HOMOGLYPHS.items())
    pool = " || ".join(
        [
            f"CASE WHEN {longer} THEN list_transform(range(length(w) - 1), lambda i: substring(w, 1, i) || substring(w, i + 2, 1) || substring(w, i + 1, 1) || substring(w, i + 3)) ELSE [] END",
            f"CASE WHEN {longer} THEN list_transform(range(length(w)), lambda i: substring(w, 1, i) || substring('{mutation.LETTERS}', CAST(CAST('0x' || substring(md5({by} || '|' || w || '|' || i), 1, 4) AS BIGINT) % 52 AS INT) + 1, 1) || substring(w, i + 1)) ELSE [] END",
            f"CASE WHEN {longer} THEN list_transform(range(length(w)), lambda i: substring(w, 1, i) || substring(w, i + 2)) ELSE [] END",
            "list_filter(list_transform(range(length(w)), lambda i: substring(w, 1, i) || map_extract(looks, substring(w, i + 1, 1))[1] || substring(w, i + 2)), lambda x: x IS NOT NULL)",
        ]
    )
    return f"looks AS (SELECT map(list(a), list(b)) AS looks FROM (VALUES {look}) h(a, b)), pool AS (SELECT *, {pool} AS p FROM {source}, looks), mutant AS (SELECT * EXCLUDE (p, looks), coalesce(p[CAST('0x' || substring(md5({by} || '|' || w), 1, 7) AS BIGINT) % greatest(len(p), 1) + 1], w) AS m FROM pool)"


def entries() -> dict[str, Entry]:
    e: dict[str, Entry] = {}
    # Texts
    e["f01_tags"] = Entry(
        lambda s, d: v.table(s, d, "pages").select("page_id", strings.tags(F.col("html"), "p").alias("t")).select("page_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", "|")).alias("h")),
        "SELECT page_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, '|')) AS h FROM (SELECT page_id, regexp_extract_all(html, '<p>(.*?)</p>', 1, 's') AS t FROM pages)",
    )
    e["f02_first_fence"] = Entry(lambda s, d: _fenced(s, d).select("doc_id", F.md5(strings.first_fence(F.col("answer"))).alias("h")), "SELECT doc_id, md5(text) AS h FROM documents")
    e["f03_language_blocks"] = Entry(lambda s, d: _fenced(s, d).select("doc_id", F.md5(strings.language_blocks(F.col("answer"), "python")).alias("h")), f"SELECT doc_id, md5(text || {_NL}) AS h FROM documents")
    e["f04_letters_at_ends"] = Entry(lambda s, d: _DOCS(s, d).select("doc_id", F.md5(strings.letters_at_ends(F.col("text"))).alias("h")), r"SELECT doc_id, md5(regexp_replace(text, '^[^a-zA-Z\s]+|[^a-zA-Z\s]+$', '', 'g')) AS h FROM documents")
    tests = lambda: F.concat(F.lit("def f(x):\n"), "text", F.lit(">>> f(1)\n1\n>>> f(2)\n2"))
    e["f06_split_tests"] = Entry(
        lambda s, d: _DOCS(s, d).select("doc_id", strings.split_tests(tests()).alias("t")).select("doc_id", "t.entry", F.md5("t.comments").alias("comments"), F.array_join("t.tests", "|").alias("tests")),
        f"SELECT doc_id, 'def f(x):' AS entry, md5(text) AS comments, 'f(1)' || {_NL} || '1' || {_NL} || '|f(2)' || {_NL} || '2' AS tests FROM documents",
    )
    e["g15_split_and_joined"] = Entry(
        lambda s, d: _DOCS(s, d).select("doc_id", tests().alias("p"), strings.split_tests(tests()).alias("t")).select("doc_id", (strings.joined_tests(F.col("t.entry"), F.col("t.comments"), F.col("t.tests")) == F.col("p")).alias("same")),
        "SELECT doc_id, true AS same FROM documents",
    )
    e["f07_truncated"] = Entry(lambda s, d: _DOCS(s, d).select("doc_id", F.md5(strings.truncate_at(F.col("text"), ["\nThe", "\nA", " is "])).alias("h")), f"SELECT doc_id, md5(substring(text, 1, coalesce(least(nullif(instr(text, {_NL} || 'The'), 0), nullif(instr(text, {_NL} || 'A'), 0), nullif(instr(text, ' is '), 0)) - 1, length(text)))) AS h FROM documents")
    e["f09_cleaned"] = Entry(lambda s, d: _fenced(s, d).select("doc_id", F.md5(strings.cleaned(F.col("answer"), ["\nThe"])).alias("h")), f"SELECT doc_id, md5(substring(t, 1, coalesce(nullif(instr(t, {_NL} || 'The'), 0) - 1, length(t)))) AS h FROM (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9)) AS t FROM documents)")
    e["f12_last_line_dropped"] = Entry(lambda s, d: _DOCS(s, d).select("doc_id", F.md5(strings.drop_last_line(F.col("text"))).alias("h")), "SELECT doc_id, md5(array_to_string(l[1:len(l) - 1], chr(10))) AS h FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
    e["f13_template"] = Entry(lambda s, d: _DOCS(s, d).select("doc_id", F.md5(strings.template("Task in {lang} from {source}: {text} {other}", {"lang": F.col("lang"), "source": F.col("source"), "text": F.col("text")})).alias("h")), "SELECT doc_id, md5('Task in ' || lang || ' from ' || source || ': ' || text || ' {other}') AS h FROM documents")
    e["f15_sentence_bound"] = Entry(lambda s, d: _DOCS(s, d).select("doc_id", strings.sentence_bound(F.col("text")).cast("bigint").alias("low"), (strings.sentence_bound(F.col("text")) + 1).cast("bigint").alias("high")), "SELECT doc_id, CAST(length(text) - length(replace(text, '.', '')) + 1 AS BIGINT) AS low, CAST(length(text) - length(replace(text, '.', '')) + 2 AS BIGINT) AS high FROM documents")
    e["f16_parsed_names"] = Entry(lambda s, d: _names(s, d).select("o_orderkey", strings.parsed_name(F.col("name")).alias("p")).select("o_orderkey", "p.*"), "SELECT o_orderkey, o_orderpriority AS model, o_orderstatus AS data, '0.8::::' || o_custkey AS hyper FROM orders")
    e["f17_program"] = Entry(lambda s, d: _DOCS(s, d).select("doc_id", F.md5(strings.program(F.col("lang"), F.col("text"), F.col("source"))).alias("h")), "SELECT doc_id, md5(lang || repeat(chr(10), 3) || text || repeat(chr(10), 3) || source) AS h FROM documents")
    demos = lambda: F.array(F.struct(F.lit("in").alias("input"), F.col("source").alias("output")))
    e["f18_messages"] = Entry(lambda s, d: _DOCS(s, d).select("doc_id", F.posexplode(strings.messages(F.md5("text"), demos())).alias("place", "m")).select("doc_id", F.col("place").cast("bigint").alias("place"), "m.role", "m.content"), "SELECT doc_id, CAST(0 AS BIGINT) AS place, 'user' AS role, 'in' AS content FROM documents UNION ALL SELECT doc_id, 1, 'assistant', source FROM documents UNION ALL SELECT doc_id, 2, 'user', md5(text) FROM documents")
    e["f19_completion"] = Entry(lambda s, d: _DOCS(s, d).select("doc_id", F.md5(F.concat("source", "text")).alias("h")), "SELECT doc_id, md5(source || text) AS h FROM documents")
    edits = [("delete", lambda t: strings.delete_phrase(t, F.lit("the"))), ("add", lambda t: strings.add_phrase(t, F.lit("new"), F.lit("of"))), ("swap", lambda t: strings.swap_phrases(t, F.lit("the"), F.lit("and")))]
    e["f20_phrase_edits"] = Entry(
        lambda s, d: _DOCS(s, d).select("doc_id", *(F.md5(f(F.col("text"))).alias(n) for n, f in edits)),
        """WITH d AS (SELECT doc_id, text AS t FROM documents), s AS (SELECT doc_id, t, CASE WHEN contains(t, ' the ') THEN replace(t, ' the ', ' <1> ') ELSE replace(t, 'the', '<1>') END AS a FROM d),
        s2 AS (SELECT doc_id, t, CASE WHEN contains(a, ' and ') THEN replace(a, ' and ', ' <2> ') ELSE replace(a, 'and', '<2>') END AS b FROM s)
        SELECT doc_id, md5(CASE WHEN instr(t, ' the') > 1 THEN replace(t, ' the', ' ') WHEN instr(t, 'the ') > 1 THEN replace(t, 'the ', ' ') ELSE replace(t, 'the', '') END) AS "delete",
        md5(CASE WHEN instr(t, ' of') > 1 THEN replace(t, ' of', ' of new') WHEN instr(t, 'of ') > 1 THEN replace(t, 'of ', 'of new ') ELSE replace(t, 'of', 'ofnew') END) AS "add",
        md5(replace(replace(b, '<1>', 'and'), '<2>', 'the')) AS swap FROM s2""",
    )
    e["f21_tokens"] = Entry(lambda s, d: _DOCS(s, d).select("doc_id", strings.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("h")), r"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS h FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)")
    e["f25_safe_id"] = Entry(lambda s, d: v.table(s, d, "pages").select("page_id", strings.safe_id(F.col("url")).alias("id"), strings.safe_id(F.col("url"), "-").alias("dashed")), "SELECT page_id, replace(url, '/', '_') AS id, replace(url, '/', '-') AS dashed FROM pages")
    e["f27_column_pairs"] = Entry(lambda s, d: v.pairs(s, d).select("pair_id", F.md5("hypothesis").alias("first"), F.md5("reference").alias("second")), f"WITH {v.PAIRS} SELECT pair_id, md5(hypothesis) AS first, md5(reference) AS second FROM pairs")

    # Projections and filters
    e["p01_task_rows"] = Entry(
        lambda s, d: v.table(s, d, "pages").select(F.replace(F.col("url"), F.lit("/"), F.lit("_")).alias("data_id"), F.lit("text").alias("src_lang"), F.col("page_id").cast("string").alias("entry_func"), F.array_join(F.array(F.lit("import a"), F.lit("import b")), "\n").alias("import_str")),
        "SELECT replace(url, '/', '_') AS data_id, 'text' AS src_lang, CAST(page_id AS VARCHAR) AS entry_func, 'import a' || chr(10) || 'import b' AS import_str FROM pages",
    )
    e["p02_failed_rows_dropped"] = Entry(lambda s, d: v.table(s, d, "events").select("event_id", F.expr("try_cast(replace(event_type, 'view', '1') AS bigint)").alias("x")).where("x IS NOT NULL"), "SELECT event_id, TRY_CAST(replace(event_type, 'view', '1') AS BIGINT) AS x FROM events WHERE TRY_CAST(replace(event_type, 'view', '1') AS BIGINT) IS NOT NULL")
    e["p03_constant_column"] = Entry(lambda s, d: v.table(s, d, "benchmark").select("item_id", F.size(F.array().cast("array<string>")).cast("bigint").alias("demos")), "SELECT item_id, CAST(0 AS BIGINT) AS demos FROM benchmark")
    e["p05_infill_solution"] = Entry(lambda s, d: _DOCS(s, d).select("doc_id", F.md5(F.concat("lang", "text", "source")).alias("solution")), "SELECT doc_id, md5(lang || text || source) AS solution FROM documents")
    e["p06_security_ids"] = Entry(lambda s, d: v.table(s, d, "pages").select("page_id", F.element_at(F.split(F.concat("url", F.lit("____SPLIT____"), F.col("page_id").cast("string")), "____SPLIT____"), -1).alias("save_name")), "SELECT page_id, CAST(page_id AS VARCHAR) AS save_name FROM pages")
    e["p07_output_rows"] = Entry(lambda s, d: _DOCS(s, d).withColumn("random_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("bigint") - 1).withColumn("doc_string", F.md5("text")).drop("text", "n_chars", "lang"), "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS random_id, md5(text) AS doc_string FROM documents")
    e["p08_labelled"] = Entry(lambda s, d: v.table(s, d, "embeddings").where("label - 1 <> -1").select("vec_id"), "SELECT vec_id FROM embeddings WHERE label - 1 <> -1")
    e["p09_yes_answers"] = Entry(lambda s, d: v.table(s, d, "conversations").where(F.lower("text").startswith("th")).select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE starts_with(lower(text), 'th')")
    e["p10_first_extraction"] = Entry(lambda s, d: v.table(s, d, "pages").select("page_id", strings.tags(F.col("html"), "h1").alias("t")).where(F.size("t") > 0).select("page_id", F.md5(F.col("t")[0]).alias("h")), "SELECT page_id, md5(t[1]) AS h FROM (SELECT page_id, regexp_extract_all(html, '<h1>(.*?)</h1>', 1, 's') AS t FROM pages) WHERE len(t) > 0")
    e["p11_two_parts"] = Entry(lambda s, d: v.table(s, d, "pages").where(F.size(F.split("url", ":")) >= 2).select("page_id"), "SELECT page_id FROM pages WHERE len(string_split(url, ':')) >= 2")
    e["p13_vocabulary_filter"] = Entry(lambda s, d: v.vocabulary(s, d).where(F.contains("token", F.lit("th")) & ~F.col("token").isin("the", "with")).select("token", "score"), f"WITH {v.VOCAB} SELECT token, score FROM vocab WHERE contains(token, 'th') AND token NOT IN ('the', 'with')")
    e["p14_alphabetic"] = Entry(lambda s, d: v.vocabulary(s, d).where(mutation.alphabetic(F.col("token"))).select("token"), f"WITH {v.VOCAB} SELECT token FROM vocab WHERE regexp_full_match(token, '\\p{{L}}+')")
    e["p17_percentile_filter"] = Entry(lambda s, d: (lambda e_: e_.crossJoin(F.broadcast(quantiles.percentiles(e_, "value", [0.9], []).toDF("least"))).where("value > least").select("event_id"))(v.table(s, d, "events")), "SELECT event_id FROM events WHERE value > (SELECT quantile_cont(value, 0.9) FROM events)")

    # Joins
    e["j01_generated_and_seed"] = Entry(lambda s, d: v.table(s, d, "labels").join(_DOCS(s, d), "doc_id").select("doc_id", "quality", "lang"), "SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
    e["j02_fan_out"] = Entry(lambda s, d: v.table(s, d, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("sample_id")), "SELECT item_id, unnest(range(5)) AS sample_id FROM benchmark")
    e["j03_positional_pairs"] = Entry(
        lambda s, d: v.table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: F.md5(x["text"])).alias("u"), F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: F.md5(x["text"])).alias("a")).withColumn("k", F.least(F.size("u"), F.size("a"))).where("k > 0").select("conv_id", F.posexplode(F.arrays_zip(F.slice("u", F.lit(1), F.col("k")).alias("u"), F.slice("a", F.lit(1), F.col("k")).alias("a"))).alias("place", "z")).select("conv_id", F.col("place").cast("bigint").alias("place"), F.col("z.u").alias("question"), F.col("z.a").alias("answer")),
        "WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, md5(text) AS question FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, md5(text) AS answer FROM conversations WHERE role = 'assistant') SELECT conv_id, place, question, answer FROM u JOIN a USING (conv_id, place)",
    )
    e["j04_request_and_response"] = Entry(lambda s, d: (lambda c: c.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("bigint").alias("asked")).join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("bigint").alias("said")), ["conv_id", "turn"], "left").select("conv_id", "turn", "asked", F.coalesce("said", F.lit(0)).alias("said")))(v.table(s, d, "conversations")), "SELECT u.conv_id, u.turn, CAST(length(u.text) AS BIGINT) AS asked, coalesce(CAST(length(a.text) AS BIGINT), 0) AS said FROM conversations u LEFT JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
    e["j05_names_and_types"] = Entry(lambda s, d: v.table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split("p_type", " ").alias("b")).withColumn("k", F.least(F.size("a"), F.size("b"))).select("p_partkey", F.array_join(F.zip_with(F.slice("a", F.lit(1), F.col("k")), F.slice("b", F.lit(1), F.col("k")), lambda x, y: F.concat(x, F.lit(": "), y)), ", ").alias("typed")), "SELECT p_partkey, array_to_string(list_transform(range(1, 1 + least(len(a), len(b))), lambda i: a[i] || ': ' || b[i]), ', ') AS typed FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part)")
    e["j06_scores_and_vocabulary"] = Entry(lambda s, d: v.vocabulary(s, d).join(v.table(s, d, "benchmark").select(F.explode(F.split("text", "[ \n]")).alias("token")).where("token <> ''").distinct(), "token").where("score > 1").select("token", "score"), f"WITH {v.VOCAB} SELECT token, score FROM vocab WHERE score > 1 AND token IN (SELECT unnest(string_split_regex(text, '[ \\n]')) FROM benchmark)")
    e["j07_contained"] = Entry(lambda s, d: v.vocabulary(s, d).join(v.table(s, d, "conversations").select(F.explode(F.split("text", "[ \n]")).alias("token")), "token", "left_semi").agg(F.count(F.lit(1)).alias("n")), f"WITH {v.VOCAB} SELECT count(*) AS n FROM vocab WHERE token IN (SELECT unnest(string_split_regex(text, '[ \\n]')) FROM conversations)")
    e["j08_gram_matches"] = Entry(lambda s, d: similarity.grams(v.pairs(s, d), "hypothesis", 2).join(similarity.grams(v.pairs(s, d), "reference", 2).withColumnRenamed("k", "rk"), ["pair_id", "n", "gram"]).groupBy("pair_id", "n").agg(F.sum(F.least("k", "rk")).alias("hits")).select("pair_id", F.col("n").cast("bigint").alias("n"), "hits"), f"WITH {v.PAIRS}, {_grams_sql('h')}, {_grams_sql('r')} SELECT pair_id, CAST(n AS BIGINT) AS n, CAST(sum(least(h.k, r.k)) AS BIGINT) AS hits FROM hg h JOIN rg r USING (pair_id, n, gram) WHERE n <= 2 GROUP BY ALL")
    e["j09_prompt_grid"] = Entry(lambda s, d: v.logits(s, d).select("example").crossJoin(F.broadcast(v.table(s, d, "region").select("r_name"))).groupBy("r_name").agg(F.count(F.lit(1)).alias("n")), "SELECT r_name, count(*) AS n FROM embeddings CROSS JOIN region GROUP BY r_name")
    e["j10_with_fallback"] = Entry(lambda s, d: _DOCS(s, d).join(v.table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality")), "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
    e["j11_by_line"] = Entry(lambda s, d: v.pairs(s, d).select("pair_id", F.posexplode(F.split("hypothesis", "\n")).alias("line", "h")).join(v.pairs(s, d).select("pair_id", F.posexplode(F.split("reference", "\n")).alias("line", "r")), ["pair_id", "line"]).select("pair_id", F.col("line").cast("bigint").alias("line"), (F.col("h") == F.col("r")).alias("same")), f"WITH {v.PAIRS}, h AS (SELECT pair_id, unnest(range(len(l))) AS line, unnest(l) AS h FROM (SELECT pair_id, string_split(hypothesis, chr(10)) AS l FROM pairs)), r AS (SELECT pair_id, unnest(range(len(l))) AS line, unnest(l) AS r FROM (SELECT pair_id, string_split(reference, chr(10)) AS l FROM pairs)) SELECT pair_id, line, h = r AS same FROM h JOIN r USING (pair_id, line)")
    e["j12_dense_grid"] = Entry(lambda s, d: v.leaderboard_runs(s, d).groupBy("hyper", "model").pivot("data", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(-1), f"WITH {v.BOARD} SELECT hyper, model, coalesce(nullif(count(*) FILTER (WHERE data = 'F'), 0), -1) AS F, coalesce(nullif(count(*) FILTER (WHERE data = 'O'), 0), -1) AS O FROM board GROUP BY ALL")
    e["j13_verbalizers"] = Entry(lambda s, d: v.vocabulary(s, d).where(F.col("token").isin("the", "of", "and")).select("token", "id"), f"WITH {v.VOCAB} SELECT token, id FROM vocab WHERE token IN ('the', 'of', 'and')")

    # Similarity
    e["b03_modified_precision"] = Entry(lambda s, d: _matched(s, d), f"{_MATCHES} SELECT * FROM matched")
    for m in range(8):
        name, orders = "b01_sentence_bleu" if m == 0 else "b02_sentence_bleu" if m == 1 else f"b04_smoothing_{m}", 5 if m in (5, 7) else 4
        e[name] = Entry(lambda s, d, m=m, orders=orders: _round(_matched(s, d, orders).select("pair_id", similarity.bleu(m).alias("bleu"))), f"{_matches_sql(orders)} SELECT pair_id, round({_bleu_sql(m)}, 6) AS bleu FROM matched")
    two = (
        f"WITH {v.PAIRS}, {_TWO}, hw AS (SELECT pair_id, list_filter(string_split_regex(hypothesis, '\\s+'), lambda x: x <> '') AS w FROM two), rw AS (SELECT pair_id, k, list_filter(string_split_regex(r, '\\s+'), lambda x: x <> '') AS w FROM (SELECT pair_id, unnest(refs) AS r, unnest(range(2)) AS k FROM two)), "
        + "hg AS (SELECT pair_id, gram, count(*) AS k FROM (SELECT pair_id, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) AS gram FROM hw) GROUP BY ALL), rg AS (SELECT pair_id, gram, max(n) AS k FROM (SELECT pair_id, k, gram, count(*) AS n FROM (SELECT pair_id, k, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) AS gram FROM rw) GROUP BY ALL) GROUP BY pair_id, gram), "
        + "met AS (SELECT h.pair_id, CAST(sum(least(h.k, r.k)) AS BIGINT) AS num FROM hg h JOIN rg r USING (pair_id, gram) GROUP BY ALL), near AS (SELECT rw.pair_id, CAST(arg_min(len(rw.w), struct_pack(a := abs(CAST(len(rw.w) AS BIGINT) - CAST(len(hw.w) AS BIGINT)), b := len(rw.w))) AS BIGINT) AS ref_len FROM rw JOIN hw USING (pair_id) GROUP BY ALL) "
        + "SELECT pair_id, ref_len, coalesce(num, 0) AS num_2 FROM near LEFT JOIN met USING (pair_id)"
    )
    e["b03_two_references"] = Entry(lambda s, d: similarity.matches(_two_references(s, d)).select("pair_id", "ref_len", "num_2"), two)
    sums = ", ".join(f"sum({c}) AS {c}" for c in ["hyp_len", "ref_len", *(f"{a}_{n}" for a in ("num", "den") for n in range(1, 5))])
    e["a11_corpus_bleu"] = Entry(lambda s, d: _round(similarity.corpus(_matched(s, d)).select(similarity.bleu(1).alias("bleu"))), f"{_MATCHES}, total AS (SELECT {sums} FROM matched) SELECT round({_bleu_sql(1)}, 6) AS bleu FROM total")
    e["m08_brevity_penalty"] = Entry(lambda s, d: _round(_matched(s, d).select("pair_id", maths.brevity_penalty(F.col("ref_len"), F.col("hyp_len")).alias("bp"))), f"{_MATCHES} SELECT pair_id, round(CASE WHEN hyp_len > ref_len THEN 1.0 WHEN hyp_len = 0 THEN 0.0 ELSE exp(1 - ref_len / CAST(hyp_len AS DOUBLE)) END, 6) AS bp FROM matched")
    e["m09_closest_length"] = Entry(lambda s, d: v.table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text")).alias("l")).select("conv_id", maths.closest_length(F.col("l"), F.lit(60)).cast("bigint").alias("length")), "SELECT conv_id, CAST(arg_min(n, struct_pack(a := abs(n - 60), b := n)) AS BIGINT) AS length FROM (SELECT conv_id, length(text) AS n FROM conversations) GROUP BY conv_id")
    e["u04_clipped_matches"] = Entry(lambda s, d: _matched(s, d).agg(*(F.sum(f"num_{n}").alias(f"n{n}") for n in range(1, 5))), f"{_MATCHES} SELECT {', '.join(f'CAST(sum(num_{n}) AS BIGINT) AS n{n}' for n in range(1, 5))} FROM matched")
    keys = ["the", "of", "and", "to"]
    e["b06_weighted_recall"] = Entry(
        lambda s, d: _round(similarity.weighted_recall(v.pairs(s, d), keys).groupBy(F.col("n").cast("bigint").alias("n")).agg(F.sum("num").alias("num"), F.sum("den").alias("den")), 3),
        f"WITH {v.PAIRS}, {_grams_sql('h')}, {_grams_sql('r')}, w AS (SELECT r.pair_id, r.n, r.k, coalesce(h.k, 0) AS hk, CASE WHEN r.n > 1 OR gram IN ('the','of','and','to') THEN 1.0 ELSE 0.2 END AS w FROM rg r LEFT JOIN hg h USING (pair_id, n, gram)), p AS (SELECT e.pair_id, e.n, coalesce(sum(least(k, hk) * w), 0) AS num, greatest(1.0, coalesce(sum(k * w), 0)) AS den FROM (SELECT pair_id, unnest(range(1, 5)) AS n FROM pairs) e LEFT JOIN w ON w.pair_id = e.pair_id AND w.n = e.n GROUP BY ALL) SELECT CAST(n AS BIGINT) AS n, round(sum(num), 3) AS num, round(sum(den), 3) AS den FROM p GROUP BY n",
    )

    # Mutations
    token = lambda s, d: v.table(s, d, "benchmark").select(F.explode(F.split("text", "[ \n]")).alias("w")).where("w <> ''").distinct()
    toks = "t AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '[ \\n]')) AS w FROM benchmark) WHERE w <> '')"
    joined = lambda c: F.array_join(c, "|")
    e["g08_neighbour_swaps"] = Entry(lambda s, d: token(s, d).select("w", joined(mutation.neighbour_swaps(F.col("w"))).alias("m")), f"WITH {toks} SELECT w, array_to_string(CASE WHEN length(w) > 1 THEN list_transform(range(length(w) - 1), lambda i: substring(w, 1, i) || substring(w, i + 2, 1) || substring(w, i + 1, 1) || substring(w, i + 3)) ELSE [] END, '|') AS m FROM t")
    e["g09_letter_inserts"] = Entry(lambda s, d: token(s, d).select("w", joined(mutation.letter_inserts(F.col("w"), F.lit("7"))).alias("m")), f"WITH {toks} SELECT w, array_to_string(CASE WHEN length(w) > 1 THEN list_transform(range(length(w)), lambda i: substring(w, 1, i) || substring('{mutation.LETTERS}', CAST(CAST('0x' || substring(md5('7|' || w || '|' || i), 1, 4) AS BIGINT) % 52 AS INT) + 1, 1) || substring(w, i + 1)) ELSE [] END, '|') AS m FROM t")
    e["g10_character_deletes"] = Entry(lambda s, d: token(s, d).select("w", joined(mutation.character_deletes(F.col("w"))).alias("m")), f"WITH {toks} SELECT w, array_to_string(CASE WHEN length(w) > 1 THEN list_transform(range(length(w)), lambda i: substring(w, 1, i) || substring(w, i + 2)) ELSE [] END, '|') AS m FROM t")
    pairs_sql = ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in mutation.HOMOGLYPHS.items())
    e["g11_homoglyphs"] = Entry(lambda s, d: token(s, d).select("w", F.explode(mutation.homoglyphs(F.col("w"))).alias("m")), f"WITH {toks}, h(a, b) AS (VALUES {pairs_sql}), x AS (SELECT w, unnest(range(length(w))) AS i FROM t) SELECT w, substring(w, 1, i) || b || substring(w, i + 2) AS m FROM x JOIN h ON substring(w, i + 1, 1) = a")
    e["g12_mutated_words"] = Entry(lambda s, d: token(s, d).select("w", mutation.mutated_word(F.col("w"), F.lit("7")).alias("m")), f"WITH {toks}, {_mutants_sql('t', '7')} SELECT w, m FROM mutant")
    chosen = (
        "WITH c AS (SELECT item_id, text, list_sort(list_transform(range(1, 51), lambda c: struct_pack(d := md5('choice|' || item_id || '|' || c), c := c)))[1].c AS c FROM benchmark), x AS (SELECT item_id, item_id || '|' || c AS seed, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM c), "
        + "r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5(seed || '|' || i)) AS k FROM x WHERE regexp_full_match(w, '\\p{L}+')), t AS (SELECT item_id, i, w, seed FROM r WHERE k <= 3), "
        + _mutants_sql("t", None)
        + " SELECT item_id, string_agg(coalesce(m, w), ' ' ORDER BY i) AS mutated FROM (SELECT x.item_id, x.i, x.w, mutant.m FROM x LEFT JOIN mutant ON x.item_id = mutant.item_id AND x.i = mutant.i) GROUP BY item_id"
    )
    e["g13_mutated_sentences"] = Entry(lambda s, d: mutation.chosen_sentence(v.table(s, d, "benchmark"), "item_id", "text"), chosen)
    return e
