"""Queries of generation, masked words and fixed lists, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import classification, code, strings
from ..operators import generation, infill, mutation, phrases, tagging
from ..registry import Entry
from ..session import ship, spread
from ..sources import files
from . import views as v
from .programs import _scratch
from .scores import _round
from .sources import _DOC, _NL, _PROGRAM, programs
from .texts import _mutants_sql

#: Kneser-Ney from the definition: CTEs t (triples), a (shares) and the levels, over texts x(w), lists of words.
_INFILL = """g AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g FROM (SELECT ['<s>'] || w || ['</s>'] AS w FROM x)),
t AS (SELECT g[1] AS u, g[2] AS w, g[3] AS v, count(*) AS c FROM g GROUP BY ALL), a AS (SELECT w, count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY w),
wc AS (SELECT u, v, sum(c) AS total, count(*) AS kinds FROM t GROUP BY ALL), f AS (SELECT u, w, count(*) AS n FROM t GROUP BY ALL), fc AS (SELECT u, sum(n) AS total, count(*) AS kinds FROM f GROUP BY u),
b AS (SELECT v, w, count(*) AS n FROM t GROUP BY ALL), bc AS (SELECT v, sum(n) AS total, count(*) AS kinds FROM b GROUP BY v)"""
_P = (
    "coalesce(greatest(coalesce(t.c, 0) - 0.75, 0) / wc.total, 0) + coalesce(0.75 * wc.kinds / wc.total, 1) * (coalesce(greatest(coalesce(f.n, 0) - 0.75, 0) / fc.total, 0) + coalesce(0.75 * fc.kinds / fc.total, 1) * coalesce(a.p, 0) "
    "+ coalesce(greatest(coalesce(b.n, 0) - 0.75, 0) / bc.total, 0) + coalesce(0.75 * bc.kinds / bc.total, 1) * coalesce(a.p, 0)) / 2"
)
_LEVELS = "LEFT JOIN wc ON wc.u = q.u AND wc.v = q.v LEFT JOIN t ON t.u = q.u AND t.v = q.v AND t.w = q.w LEFT JOIN fc ON fc.u = q.u LEFT JOIN f ON f.u = q.u AND f.w = q.w LEFT JOIN bc ON bc.v = q.v LEFT JOIN b ON b.v = q.v AND b.w = q.w LEFT JOIN a ON a.w = q.w"


def _words_sql(table: str) -> str:
    return rf"x AS (SELECT list_filter(string_split_regex(lower(text), '\s+'), lambda y: y <> '') AS w FROM {table} WHERE text IS NOT NULL)"


def _places_sql(candidates: int) -> str:
    """CTE places: item_id, i, prompt and the words beside the mark."""
    return (
        "m AS (SELECT item_id, l, unnest(range(len(l))) AS i, unnest(l) AS w FROM (SELECT item_id, string_split(text, ' ') AS l FROM benchmark)), "
        f"k AS (SELECT item_id, l, i FROM m WHERE i > 0 AND i < len(l) - 1 AND regexp_full_match(w, '\\p{{L}}+') QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY md5(item_id || '|' || i)) <= {candidates}), "
        "n AS (SELECT item_id, i, array_to_string(list_transform(range(len(l)), lambda k: CASE WHEN k = i THEN '[MASK]' ELSE l[k + 1] END), ' ') AS prompt FROM k), "
        r"o AS (SELECT *, ['<s>'] || list_filter(string_split_regex(lower(prompt), '\s+'), lambda y: y <> '') || ['</s>'] AS o FROM n), "
        "places AS (SELECT item_id, i, prompt, o[list_position(o, '[mask]') - 1] AS u, o[list_position(o, '[mask]') + 1] AS v FROM o)"
    )


def _model(s: SparkSession, d: str, table: str, asked: DataFrame | None = None) -> infill.Model:
    ship(s)
    path = _scratch(s)
    counted = infill.triples(v.table(s, d, table))
    (counted if asked is None else infill.narrowed(counted, asked)).write.parquet(path)
    return infill.fit(s.read.parquet(path))


def _masked_scores(s, d):
    """What the documents' model says of three words at two places of every benchmark text."""
    asked = infill.marked(mutation.masked(v.table(s, d, "benchmark"), "item_id", "text", 2)).withColumn("w", F.explode(F.array(*map(F.lit, ("the", "of", "unheardof")))))
    path = _scratch(s)
    asked.select("item_id", "place", "u", "v", "w").write.parquet(path)
    asked = s.read.parquet(path)
    return _round(infill.scored(asked, _model(s, d, "documents", asked)).select("item_id", F.col("place").cast("bigint").alias("place"), "w", "p"), 9)


def _filled_tokens(s, d):
    """Up to ten places of every benchmark text, each filled with its best word."""
    prompts = mutation.masked(v.table(s, d, "benchmark"), "item_id", "text")
    return infill.filled(prompts, _model(s, d, "benchmark")).select("item_id", F.col("place").cast("bigint").alias("place"), F.md5("mutated").alias("h"))


def _tagged_tokens(s, d):
    """As g14_filled_tokens, at nouns and adjectives of a tagger fitted to the documents."""
    tagger = tagging.fit(v.table(s, d, "documents"))
    rows = tagging.tagged(spread(v.table(s, d, "benchmark")), tagger)
    prompts = mutation.masked(rows, "item_id", "text", maskable=F.col("maskable"))
    return infill.filled(prompts, _model(s, d, "benchmark")).select("item_id", "place", "mutated")


def _phrases(s, d):
    tagger = tagging.fit(v.table(s, d, "documents"))
    return phrases.phrased(spread(v.table(s, d, "benchmark")), tagger).select("item_id", F.posexplode("phrases").alias("n", "phrase"))


def _candidates(s, d):
    return mutation.mutated_sentences(v.table(s, d, "benchmark"), "item_id", "text").select("item_id", F.col("candidate").cast("int").alias("candidate"), F.md5("mutated").alias("h"))


_CANDIDATES = (
    "WITH c AS (SELECT item_id, text, unnest(range(1, 51)) AS c FROM benchmark), y AS (SELECT item_id, c, item_id || '|' || c AS seed, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM c), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY item_id, c ORDER BY md5(seed || '|' || i)) AS k FROM y WHERE regexp_full_match(w, '\\p{L}+')), t AS (SELECT item_id, c, i, w, seed FROM r WHERE k <= 3), "
    + _mutants_sql("t", None)
    + " SELECT item_id, CAST(c AS INT) AS candidate, md5(string_agg(coalesce(m, w), ' ' ORDER BY i)) AS h FROM (SELECT y.item_id, y.c, y.i, y.w, mutant.m FROM y LEFT JOIN mutant ON y.item_id = mutant.item_id AND y.c = mutant.c AND y.i = mutant.i) GROUP BY item_id, c"
)


class Flaky:
    """Fails for several prompts at once and answers one."""

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [None] * len(prompts) if len(prompts) > 1 else generation.StubCompleter("{digest}").complete(prompts)


def _prompts(s, d) -> DataFrame:
    ship(s)
    return v.table(s, d, "benchmark").select("item_id", F.col("text").alias("prompt"))


def _balanced(s, d):
    """Parts dealt to eight bins by their size: each part's bin holds at most 1.2 of the mean load."""
    ship(s)
    rows = generation.balanced(v.table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("cost")), "p_partkey", "cost", 8)
    path = _scratch(s)
    rows.write.parquet(path)
    held = s.read.parquet(path)
    loads = held.groupBy("bin").agg(F.sum("cost").alias("load")).withColumn("even", F.col("load") <= 1.2 * held.agg(F.sum("cost") / 8).first()[0])
    return held.join(F.broadcast(loads), "bin").select("p_partkey", "even")


# Generation: seeds are the nations, tasks the parts' programs.


def _seeds(s, d):
    return v.table(s, d, "nation").select(F.concat(F.lit("area"), F.col("n_regionkey").cast("string"), F.lit(":topic"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("text"))


def _tasks(s, d):
    rows = programs(s, d).select(F.col("p_partkey").alias("task_id"), F.col("entry").alias("entry_func"), F.concat(F.lit("def "), "entry", F.lit("(values, factor):")).alias("prefix"), F.col("source").alias("solution"), F.lit("").alias("demo_str"))
    path = _scratch(s)
    generation.described_tasks(rows).withColumn("instruction", F.col("docstring")).write.parquet(path)
    return s.read.parquet(path)


_SAID = generation.StubCompleter("<context>a {digest}</context><instruction>Do it.</instruction>")
_SCENARIOS = "SELECT 'area' || n_regionkey || ':topic' || n_nationkey AS name FROM nation"
#: Three scenarios a task: in the order of their md5, from the place that the task's gives.
_PICKED = f"sc AS (SELECT name AS scenario, row_number() OVER (ORDER BY md5('7|' || name), name) - 1 AS k, count(*) OVER () AS total FROM ({_SCENARIOS})), pick AS (SELECT p_partkey AS task_id, (CAST('0x' || substring(md5('7|' || p_partkey), 1, 13) AS BIGINT) + unnest(range(3))) % (SELECT any_value(total) FROM sc) AS k FROM part), chosen AS (SELECT task_id, scenario FROM pick JOIN sc USING (k))"


def _contexts(s, d, tasks: DataFrame | None = None):
    return generation.contexts(_tasks(s, d) if tasks is None else tasks, _seeds(s, d), _SAID, 3)


def _rewrites(s, d, tasks: DataFrame | None = None):
    return generation.rewritten(_contexts(s, d, tasks), _SAID)


def _new_tasks(s, d):
    doc = code.column(lambda x, n: code.docstring(x, n))
    tasks = _tasks(s, d)
    out = generation.new_tasks(tasks, generation.verified(_rewrites(s, d, tasks), generation.StubCompleter("Yes.")))
    return out.select("task_id", "entry_func", F.trim(doc(F.col("solution"), F.col("entry_func"))).alias("said"), F.length("doc_string").cast("bigint").alias("n"))


def _verified(s, d):
    """Rewrites of even tasks, which are said to agree, and none of odd ones."""
    rows = _rewrites(s, d, _tasks(s, d))
    parts = (generation.verified(rows.where(F.col("task_id") % 2 == k), generation.StubCompleter(answer)) for k, answer in enumerate(("Yes.", "No.")))
    return next(parts).unionByName(next(parts)).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))


def _scenarios(s, d):
    stub = generation.StubCompleter("<scenario>case {digest}</scenario>")
    return generation.proposed_scenarios(_seeds(s, d), stub, 30)


def _pipeline(s, d):
    """Scenarios, contexts, rewrites and verification one after the other: rewrites by task."""
    scenes = _scenarios(s, d)
    return generation.verified(generation.rewritten(generation.contexts(_tasks(s, d), scenes, _SAID, 3), _SAID), generation.StubCompleter("Yes.")).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))


# Fixed lists, applied to rows of tables.

_KINDS = list(strings.STOPS)


def _stops(s, d):
    """A nation's name before one of a kind's stops, and what is left of it."""
    ship(s)
    kinds = F.get(F.array(*map(F.lit, _KINDS)), F.col("n_nationkey") % len(_KINDS))
    rows = v.table(s, d, "nation").select("n_nationkey", "n_name", kinds.alias("kind"))
    out = []
    for kind, stops in strings.STOPS.items():
        own = rows.where(F.col("kind") == kind)
        stop = F.get(F.array(*map(F.lit, stops or ["\nx"])), F.col("n_nationkey") % max(1, len(stops)))
        text = F.concat("n_name", stop, F.lit("tail"))
        out.append(own.select("n_nationkey", "kind", F.lit(len(stops)).cast("bigint").alias("n"), (strings.truncate_at(text, stops) if stops else text).alias("kept")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_COMMENTED = {"java": 'int a; // {n}\n/* y */ String s = "//{n}";', "ruby": "# {n}", "python": 'a = "{n}"  # x\n\nb = 2\n'}
_BARE = {"java": 'int a;  \n  String s = "//{n}";', "ruby": "# {n}", "python": 'a = "{n}"  \nb = 2'}


def _by_key(values: list[str]):
    return F.get(F.array(*map(F.lit, values)), (F.col("n_nationkey") % len(values)).cast("int"))


def _case(values: list[str], by: str = "n_nationkey") -> str:
    quoted = ["'" + x.replace("'", "''").replace("\n", f"' || {_NL} || '") + "'" for x in values]
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(quoted)) + " END"


def _comments(s, d):
    ship(s)
    source = F.replace(_by_key(list(_COMMENTED.values())), F.lit("{n}"), F.col("n_name"))
    return v.table(s, d, "nation").select("n_nationkey", code.column(code.without_comments)(source, _by_key(list(_COMMENTED))).alias("got"))


_LABELLED = ("ag_news", "mrpc", "sst2", "rotten_tomatoes", "xnli")
_LABELS = {("ag_news", True): "ĠWorld|ĠSports|ĠBusiness|ĠTech", ("ag_news", False): "▁World|▁Sports|▁Business|▁Technology", ("mrpc", True): "Ġno|Ġyes", ("mrpc", False): "▁no|▁yes", ("sst2", True): "Ġnegative|Ġpositive", ("sst2", False): "▁negative|▁positive", ("rotten_tomatoes", True): "Ġterrible|Ġgreat", ("xnli", True): "Ġyes|Ġmaybe|Ġno", ("xnli", False): "▁yes|▁maybe|▁no"}


def _label_words(s, d):
    """The words of a dataset and kind of model a nation (by its key), masked kinds first."""
    shown = ["|".join(classification.label_words(x, masked)) for x, masked in _LABELS]
    return v.table(s, d, "nation").select("n_nationkey", _by_key(shown).alias("words"))


_ENDINGS = {
    "rte": "' Judge. Sentence 1: ' || text || ', Sentence 2: ' || item_id || ', Textual Entailment: '",
    "sst2": "' Judge. Sentence: ' || text || ', Sentiment: '",
    "mrpc": "' Judge. Sentence 1: ' || text || ', Sentence 2: ' || item_id || ', Semantically Equivalent: '",
    "qqp": "' Judge. Sentence 1: ' || text || ', Sentence 2: ' || item_id || ', Semantically Equivalent: '",
    "qnli": "' Judge. Question: ' || text || ', Sentence: ' || item_id || ', Entailment: '",
    "mnli": "' Judge ' || text || ' ' || item_id || ' Entailment: '",
}


def _patterns(s, d):
    rows, out = v.table(s, d, "benchmark"), F.lit(None).cast("string")
    for k, name in enumerate(_ENDINGS):
        out = F.when(F.col("item_id") % len(_ENDINGS) == k, classification.prompt(name, F.lit("Judge"), F.col("text"), F.col("item_id").cast("string"))).otherwise(out)
    return rows.select("item_id", F.md5(out).alias("h"))


def _bigcode(s, d):
    """Rows with a JSON structure of examples, of which those that call the entry are kept."""
    key = F.col("p_partkey").cast("string")
    examples = F.array(F.concat(F.lit(">>> task_func("), F.col("p_size").cast("string"), F.lit(")")), F.lit(">>> other(3)"), F.concat(F.lit(" >>> task_func('"), "p_brand", F.lit("')")))
    rows = v.table(s, d, "part").select(F.concat(F.lit("a/"), key).alias("task_id"), F.concat(F.lit("p"), key).alias("complete_prompt"), F.col("p_name").alias("canonical_solution"), F.to_json(F.struct(examples.alias("examples"))).alias("doc_struct"), F.lit("task_func").alias("entry_point"))
    shown = F.transform(F.from_json("doc_struct", "examples array<string>")["examples"], lambda x: F.btrim(F.replace(x, F.lit(">>>"), F.lit(""))))
    own = F.filter(shown, lambda x: F.contains(x, F.col("entry_point")))
    return rows.select(strings.safe_id(F.col("task_id")).alias("data_id"), F.concat("complete_prompt", "canonical_solution").alias("solution"), F.explode(own).alias("example"))


def _registered(s, d):
    """Regions as datasets, nations as their rows: the split that the registry names for one of them."""
    path = _scratch(s)
    nations = v.table(s, d, "nation").withColumn("split", F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd"))
    nations.write.partitionBy("split").parquet(f"{path}/nations")
    registry = v.table(s, d, "region").select(F.col("r_regionkey").cast("int").alias("data_id"), F.lit("nations").alias("source"), F.when(F.col("r_regionkey") % 2 == 0, "even").otherwise("odd").alias("split"), F.col("r_name").alias("name"))
    out = [files.loaded(registry, k, path).select("n_nationkey", "dataset") for k in (0, 1)]
    return out[0].unionByName(out[1])


def _keywords(s, d):
    """The documents' words by language, written as lists of one word a line and read back."""
    path = _scratch(s)
    words = v.table(s, d, "documents").where("lang IS NOT NULL").select("lang", F.explode(F.split("text", "[ \n]")).alias("word")).where("word <> ''").distinct()
    words.write.partitionBy("lang").text(path)
    return files.keywords(s, path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def _vocabulary(s, d):
    """The nations' names as one JSON object of ids."""
    path = _scratch(s)
    v.table(s, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("value")).write.text(path)
    return files.vocabulary(s, path)


def entries() -> dict[str, Entry]:
    e: dict[str, Entry] = {}
    e["e07_masked_scores"] = Entry(_masked_scores, f"WITH {_words_sql('documents')}, {_INFILL}, {_places_sql(2)}, q AS (SELECT *, unnest(['the', 'of', 'unheardof']) AS w FROM places) SELECT q.item_id, q.i AS place, q.w, round({_P}, 9) AS p FROM q {_LEVELS}")
    e["g14_filled_tokens"] = Entry(
        _filled_tokens,
        f"WITH {_words_sql('benchmark')}, {_INFILL}, {_places_sql(10)}, pairs AS (SELECT DISTINCT u, v FROM places), q AS (SELECT pairs.u, pairs.v, a.w FROM pairs, a), s AS (SELECT q.u, q.v, q.w, {_P} AS p FROM q {_LEVELS}), best AS (SELECT u, v, w FROM s QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY round(p, 12) DESC, w) = 1) "
        "SELECT item_id, i AS place, md5(replace(prompt, '[MASK]', w)) AS h FROM places JOIN best USING (u, v)",
    )
    e["g14_tagged_tokens"] = Entry(_tagged_tokens)
    e["f22_phrases"] = Entry(_phrases)
    e["g13_candidates"] = Entry(_candidates, _CANDIDATES)
    answers = "SELECT item_id, substring(md5(text), 1, 8) AS answer FROM benchmark"
    e["e02_retried"] = Entry(lambda s, d: generation.completed(_prompts(s, d), Flaky(), wait=0).select("item_id", "answer"), answers)
    e["e02_paced"] = Entry(lambda s, d: generation.paced(_prompts(s, d), generation.StubCompleter("{digest}"), minute=0.05).select("item_id", "answer"), answers)
    e["e05_balanced"] = Entry(_balanced, "SELECT p_partkey, true AS even FROM part")
    e["g01_scenarios"] = Entry(lambda s, d: _scenarios(s, d).where("text <> name").select("name", "text"), "SELECT 'area' || n_regionkey || ':topic' || n_nationkey AS name, n_name AS text FROM nation")
    context = "'a ' || substring(md5(replace(replace(replace('{}', '{{pb}}', {}), '{{var}}', 'values, factor'), '{{scenario}}', scenario)), 1, 8)"
    said = context.format(generation.CONTEXT_PROMPT.replace("'", "''").replace("\n", f"' || {_NL} || '"), _DOC)
    e["g02_contexts"] = Entry(lambda s, d: _contexts(s, d).select("task_id", "scenario", "context"), f"WITH {_PICKED} SELECT task_id, scenario, {said} AS context FROM chosen JOIN (SELECT p_partkey AS task_id, p_partkey AS k, p_size AS n, p_name AS name FROM part) USING (task_id)")
    e["g03_rewritten"] = Entry(lambda s, d: _rewrites(s, d).select("task_id", "scenario", "new_instruction"), f"WITH {_PICKED} SELECT task_id, scenario, 'Do it.' AS new_instruction FROM chosen")
    e["g04_new_tasks"] = Entry(_new_tasks, "SELECT p_partkey AS task_id, 'scale_' || p_partkey AS entry_func, 'Do it.' AS said, CAST(17 AS BIGINT) AS n FROM part, range(3)")
    e["g05_verified"] = Entry(_verified, "SELECT p_partkey AS task_id, CAST(3 AS BIGINT) AS n FROM part WHERE p_partkey % 2 = 0")
    e["g06_pipeline"] = Entry(_pipeline, "SELECT p_partkey AS task_id, CAST(3 AS BIGINT) AS n FROM part")
    kept = " ".join(f"WHEN '{k}' THEN {len(x)}" for k, x in strings.STOPS.items())
    e["f08_stops"] = Entry(_stops, f"SELECT n_nationkey, kind, CAST(CASE kind {kept} END AS BIGINT) AS n, n_name || CASE kind WHEN 'chat' THEN {_NL} || 'xtail' ELSE '' END AS kept FROM (SELECT *, {_KINDS}[n_nationkey % {len(_KINDS)} + 1] AS kind FROM nation)")
    e["f24_without_comments"] = Entry(_comments, f"SELECT n_nationkey, replace({_case(list(_BARE.values()))}, '{{n}}', n_name) AS got FROM nation")
    e["f26_label_words"] = Entry(_label_words, f"SELECT n_nationkey, {_case(list(_LABELS.values()))} AS words FROM nation")
    e["f28_patterns"] = Entry(_patterns, f"SELECT item_id, md5(CASE item_id % {len(_ENDINGS)} {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(_ENDINGS.values()))} END) AS h FROM benchmark")
    e["p04_bigcode_rows"] = Entry(_bigcode, "SELECT 'a_' || p_partkey AS data_id, 'p' || p_partkey || p_name AS solution, unnest(['task_func(' || p_size || ')', 'task_func(''' || p_brand || ''')']) AS example FROM part")
    e["s02_datasets"] = Entry(_registered, "SELECT n_nationkey, r_name AS dataset FROM nation JOIN region ON r_regionkey = n_nationkey % 2 AND r_regionkey IN (0, 1)")
    e["s12_keywords"] = Entry(_keywords, "SELECT lang, count(DISTINCT trim(w, ' ')) AS n FROM (SELECT lang, unnest(string_split_regex(text, '[ \\n]')) AS w FROM documents WHERE lang IS NOT NULL) WHERE w <> '' GROUP BY lang")
    e["s14_vocabulary"] = Entry(_vocabulary, "SELECT n_name AS token, CAST(n_nationkey AS BIGINT) AS id FROM nation")
    return e
