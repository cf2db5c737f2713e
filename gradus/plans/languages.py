"""Queries on programs in six languages, written from the rows of ``part``: syntax, data flow, table functions, program files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import code, flow, tables
from ..operators import codebleu, mutation
from ..registry import Entry
from ..session import ship, spread
from ..sources import files, store
from . import views as v
from .programs import _scratch
from .scores import _round
from .sources import _PROGRAM, programs
from .texts import _bleu_sql, _grams_sql, _matches_sql

_NL = "chr(10)"
LANGUAGES = ("java", "c_sharp", "javascript", "php", "go", "ruby")
#: A function by language: what comes first, a statement that is repeated, and the end. The slot is the part's size.
_REPEATED = {
    "java": ("int f(int a, int b) {\n  int c = {n};\n", "  a = a + b;\n", "  return a;\n}"),
    "c_sharp": ("int F(int a, int b) {\n  int c = {n};\n", "  a = a + b;\n", "  return a;\n}"),
    "javascript": ("function f(a, b) {\n  let c = {n};\n", "  a = a + b;\n", "  return a;\n}"),
    "php": ("function f($a, $b) {\n  $c = {n};\n", "  $a = $a + $b;\n", "  return $a;\n}"),
    "go": ("func f(a int, b int) int {\n  var c = {n}\n", "  a = a + b\n", "  return a\n}"),
    "ruby": ("def f(a, b)\n  c = {n}\n", "  a = a + b\n", "  return a\nend"),
}
#: By language, counted by hand: inner nodes of the function without the statement, of one statement, and
#: of those the ones around the statements, which ruby has no block for.
_NODES = {"java": (13, 3, 3), "c_sharp": (15, 3, 3), "javascript": (7, 3, 3), "php": (13, 6, 3), "go": (11, 5, 3), "ruby": (5, 2, 2)}
#: A function with a declaration, a loop with a header, one over elements, and a branch.
_FLOWING = {
    "java": "int f(int a, int[] b) { int c = {n}; for (int i = 0; i < a; i++) c += i; for (int d : b) c = d; if (a > c) { c = a; } else { c = b; } return c; }",
    "c_sharp": "int F(int a, int[] b) { int c = {n}; for (int i = 0; i < a; i++) c += i; foreach (int d in b) c = d; if (a > c) { c = a; } else { c = b; } return c; }",
    "javascript": "function f(a, b) { let c = {n}; for (var i = 0; i < a; i++) c += i; for (const d of b) c = d; if (a > c) { c += a; } else { c = b; } return c; }",
    "php": "<?php function f($a, $b) { $c = {n}; for ($i = 0; $i < $a; $i++) $c += $i; foreach ($b as $d) $c = $d; if ($a > $c) { $c = $a; } else { $c = $b; } return $c; }",
    "go": "func f(a int, b []int) int { var c = {n}; for i := 0; i < a; i++ { c += i }; for _, d := range b { c = d }; if a > c { c = a } else { c = b }; return c }",
    "ruby": "def f(a, b)\n c = {n}\n i = 0\n while i < a\n c += i\n end\n for d in b do\n c = d\n end\n if a > c\n c = a\n else\n c = b\n end\n return c\nend",
}
#: Its edges by hand, after the rules: a name, its place, < (comes from) or = (computed from) and the places of its sources.
_EDGES = {
    "java": "a4<|b9<|c13<15|{n}15<|i20<22|022<|i24<20,28|a26<4|i28=28|c31=33|i33<28|d38=40|b40<9|c42=44|d44<38|a48<4|c50<42|c53=55|a55<4|c60=62|b62<9|c66<53,60",
    "c_sharp": "a4<|b9<|c13<15|{n}15<|i20<22|022<|i24<20|a26<4|i28=28|c31=33|i33<28|d38=40|b40<9|c42=44|d44<38|a48<4|c50<42|c53=55|a55<4|c60=62|b62<9|c66<53,60",
    "javascript": "a3<|b5<|c9<11|{n}11<|i16<18|018<|i20<16,24|a22<3|i24=24|c27=29|i29<24|d34<|b36<5|c38<27|d40<34|a44<3|c46<27|c49=51|a51<3|c56<27|b58<5|c62<27,49",
    "php": "a4<|b7<|c11=13|{n}13<|i18=20|020<|i23<18,29|a26<4|i29=29|c33=36|i36<29|b41<7|d44=41|c47=50|d50<44|a55<4|c58<47|c62=65|a65<4|c71=74|b74<7|c79<47,62,71",
    "go": "a3<|b6<|c14<16|{n}16<|i19<|i23<19|a25<3|i27=27|c30=32|i32<27|d38<|b41<6|c43=45|d45<38|a49<3|c51<43|c53=55|a55<3|c59=61|b61<6|c65<43,53,59",
    "ruby": "a3<|b5<|c7=9|{n}9<|i10=12|012<|i14<10|a16<3|c17=19|i19<10|d22=24|b24<5|c26=28|d28<22|a31<3|c33<26|c34=36|a36<3|c38=40|b40<5|c43<34,38",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", f"' || {_NL} || '") + "'"


def _case(values: dict[str, str]) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in values.items()) + " END"


def _chosen(values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, x in values.items():
        out = F.when(F.col("language") == k, F.lit(x)).otherwise(out)
    return out


def spoken(s: SparkSession, d: str) -> DataFrame:
    """p_partkey, language (by the key), n (the size) and k (2 to 6 statements) of every part."""
    ship(s)
    language = F.get(F.array(*map(F.lit, LANGUAGES)), (F.col("p_partkey") % len(LANGUAGES)).cast("int"))
    rows = spread(v.table(s, d, "part").select("p_partkey", "p_size"))
    return rows.select("p_partkey", language.alias("language"), F.col("p_size").cast("string").alias("n"), (F.col("p_size") % 5 + 2).cast("int").alias("k"))


_SPOKEN = f"spoken AS (SELECT p_partkey, {list(LANGUAGES)}[CAST(p_partkey % {len(LANGUAGES)} AS INT) + 1] AS language, CAST(p_size AS VARCHAR) AS n, p_size % 5 + 2 AS k FROM part)"


def _filled(values: dict[str, str]) -> Column:
    return F.replace(_chosen(values), F.lit("{n}"), F.col("n"))


def repeated(s: SparkSession, d: str) -> DataFrame:
    """Pairs of a reference with k statements and a hypothesis with one less."""
    rows = spoken(s, d)
    head, one, last = (_filled({x: t[i] for x, t in _REPEATED.items()}) for i in range(3))
    return rows.select("*", F.concat(head, F.repeat(one, F.col("k")), last).alias("reference"), F.concat(head, F.repeat(one, F.col("k") - 1), last).alias("hypothesis"))


def _repeated_sql(less: int) -> str:
    head, one, last = (f"replace({_case({x: _quoted(t[i]) for x, t in _REPEATED.items()})}, '{{n}}', n)" for i in range(3))
    return f"{head} || repeat({one}, CAST(k - {less} AS INT)) || {last}"


def _shown(source: str, language: str) -> str:
    return "|".join(f"{n}{p}{'<' if how == 'comesFrom' else '='}{','.join(map(str, places))}" for n, p, how, _, places in flow.data_flow(source, language))


def _in_order(source: str, language: str) -> str:
    """Whether a source's edges stand in the order of their places, and the first place."""
    places = [p for _, p, *_ in flow.data_flow(source, language)]
    return f"{places == sorted(places)}{places[0]}"


def _flow_rows(s, d) -> DataFrame:
    return spoken(s, d).select("p_partkey", "language", "n", _filled(_FLOWING).alias("source"))


def _renamed(s, d):
    """The number of edges, and whether a copy with other names has the same normal form."""

    def both(source, language):
        import re

        other = re.sub(r"\b([abcdi])\b", r"\1\1", source)
        one, two = (code.normalised_flow(flow.data_flow(x, language)) for x in (source, other))
        return f"{len(one)}|{one == two}|{len({n for n, _, _ in one})}"

    return _flow_rows(s, d).select("p_partkey", code.column(both)(F.col("source"), F.col("language")).alias("got"))


def _syntax(s, d):
    count = code.column(lambda h, r, x: "|".join(map(str, flow.counters()[0](h, [r], x))))
    return repeated(s, d).select("p_partkey", count(F.col("hypothesis"), F.col("reference"), F.col("language")).alias("got"))


def _code_bleu(language: str):
    def run(s, d):
        pairs = repeated(s, d).where(F.col("language") == language).select(F.col("p_partkey").alias("pair_id"), "hypothesis", "reference")
        return _round(codebleu.code_bleu(pairs, language), 5)

    return run


def _code_bleu_sql(language: str) -> str:
    """n-gram and weighted parts from the texts, syntax and flow from the numbers of statements."""
    heavy = ", ".join(f"'{w}'" for w in files.KEYWORDS.get(language, [])) or "''"
    base, each, around = _NODES[language]
    # Two parameters, a declaration, its literal and the last read; three edges a statement.
    edges = 5
    pairs = f"{_SPOKEN}, pairs AS (SELECT p_partkey AS pair_id, k, {_repeated_sql(0)} AS reference, {_repeated_sql(1)} AS hypothesis FROM spoken WHERE language = '{language}')"
    sums = ", ".join(f"sum({c}) AS {c}" for c in ("hyp_len", "ref_len", *(f"{x}_{n}" for n in range(1, 5) for x in ("num", "den"))))
    return (
        f"{_matches_sql().replace(v.PAIRS, pairs)}, total AS (SELECT {sums} FROM matched), "
        f"w AS (SELECT r.pair_id, r.n, r.k, coalesce(h.k, 0) AS hk, CASE WHEN r.n > 1 OR gram IN ({heavy}) THEN 1.0 ELSE 0.2 END AS w FROM rg r LEFT JOIN hg h USING (pair_id, n, gram)), "
        "p AS (SELECT pair_id, n, sum(least(k, hk) * w) AS num, greatest(1.0, sum(k * w)) AS den FROM w GROUP BY ALL), c AS (SELECT n, CAST(sum(num) AS DOUBLE) AS num, CAST(sum(den) AS DOUBLE) AS den FROM p GROUP BY n), "
        f"parts AS (SELECT {_bleu_sql(1)} AS ngram, (CASE WHEN hyp_len > ref_len THEN 1.0 ELSE exp(1 - ref_len / CAST(hyp_len AS DOUBLE)) END) * (SELECT exp(avg(ln(num / den))) FROM c) AS weighted, "
        f"(SELECT sum({base} - {around} + {each} * k) / CAST(sum({base} + {each} * k) AS DOUBLE) FROM pairs) AS syntax, (SELECT sum({edges} - 3 + 3 * k) / CAST(sum({edges} + 3 * k) AS DOUBLE) FROM pairs) AS flow FROM total) "
        "SELECT round(ngram, 5) AS ngram, round(weighted, 5) AS weighted, round(syntax, 5) AS syntax, round(flow, 5) AS flow, round((ngram + weighted + syntax + flow) / 4, 5) AS code_bleu FROM parts"
    )


def _edge_rows(s, d):
    """Edges as rows of a table function, called laterally in SQL text."""
    tables.register(s)
    _flow_rows(s, d).createOrReplaceTempView("gradus_flowing")
    return s.sql("SELECT p_partkey, e.place, e.name || CASE e.relation WHEN 'comesFrom' THEN '<' ELSE '=' END || array_join(e.places, ',') AS edge FROM gradus_flowing f, LATERAL data_flow_edges(f.source, f.language) e")


_EDGE_ROWS = (
    f"WITH {_SPOKEN}, x AS (SELECT p_partkey, unnest(string_split(replace({_case({k: _quoted(t) for k, t in _EDGES.items()})}, '{{n}}', n || '@'), '|')) AS edge, n FROM spoken), "
    "y AS (SELECT p_partkey, CASE WHEN contains(edge, '@') THEN [n, regexp_extract(edge, '@([0-9]+)', 1), regexp_extract(edge, '@[0-9]+(.*)', 1)] "
    "WHEN regexp_matches(edge, '^0') THEN ['0', regexp_extract(edge, '^0([0-9]+)', 1), regexp_extract(edge, '^0[0-9]+(.*)', 1)] "
    "ELSE [regexp_extract(edge, '^([a-z]+)', 1), regexp_extract(edge, '^[a-z]+([0-9]+)', 1), regexp_extract(edge, '^[a-z]+[0-9]+(.*)', 1)] END AS t FROM x) "
    "SELECT p_partkey, CAST(t[2] AS INT) AS place, t[1] || t[3] AS edge FROM y"
)


def _mutant_rows(s, d):
    """All mutants of every distinct word of ``benchmark``, as rows of a table function in SQL text."""
    tables.register(s)
    v.table(s, d, "benchmark").createOrReplaceTempView("gradus_benchmark")
    return s.sql("WITH t AS (SELECT DISTINCT w FROM (SELECT explode(split(text, '[ \\n]')) AS w FROM gradus_benchmark) WHERE w <> '') SELECT w, m.kind, m.place, m.mutant FROM t, LATERAL word_mutants(w, '7') m")


_HOMOGLYPHS = ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in mutation.HOMOGLYPHS.items())
_MUTANT_ROWS = f"""WITH t AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '[ \\n]')) AS w FROM benchmark) WHERE w <> ''),
i AS (SELECT w, unnest(range(length(w))) AS i FROM t), h(a, b) AS (VALUES {_HOMOGLYPHS})
SELECT w, 'swap' AS kind, CAST(i AS INT) AS place, substring(w, 1, i) || substring(w, i + 2, 1) || substring(w, i + 1, 1) || substring(w, i + 3) AS mutant FROM i WHERE i < length(w) - 1
UNION ALL SELECT w, 'insert', CAST(i AS INT), substring(w, 1, i) || substring('{mutation.LETTERS}', CAST(CAST('0x' || substring(md5('7|' || w || '|' || i), 1, 4) AS BIGINT) % 52 AS INT) + 1, 1) || substring(w, i + 1) FROM i WHERE length(w) > 1
UNION ALL SELECT w, 'delete', CAST(i AS INT), substring(w, 1, i) || substring(w, i + 2) FROM i WHERE length(w) > 1
UNION ALL SELECT w, 'homoglyph', CAST(i AS INT), substring(w, 1, i) || b || substring(w, i + 2) FROM i JOIN h ON substring(w, i + 1, 1) = a"""


def _trajectories(s, d):
    """Every customer's orders in turn: the highest price so far, and how long it has stood."""
    tables.register(s)
    v.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").createOrReplaceTempView("gradus_orders")
    return s.sql("SELECT o_orderkey, round(best, 2) AS best, waited FROM trajectory(TABLE(gradus_orders) PARTITION BY (o_custkey) ORDER BY (o_orderkey), 'o_totalprice')")


_TRAJECTORIES = """WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER w AS best, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
f AS (SELECT *, max(CASE WHEN o_totalprice = best AND (earlier IS NULL OR o_totalprice > earlier) THEN r END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rose FROM (SELECT *, lag(best) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS earlier FROM b))
SELECT o_orderkey, round(best, 2) AS best, r - rose AS waited FROM f"""


def _program_files(s, d):
    """Every part's program as a file of its own, written and read by tasks."""
    store.register(s)
    path = _scratch(s)
    key = F.col("p_partkey").cast("string")
    rows = programs(s, d).select(F.concat(F.lit("task_"), (F.col("p_partkey") % 100).cast("string")).alias("task"), F.concat(F.lit("sample_"), F.col("p_size").cast("string")).alias("sample"), F.concat(F.lit("code_"), key, F.lit(".py")).alias("file"), F.col("source").alias("program"))
    rows.write.format("programs").mode("overwrite").save(path)
    return s.read.format("programs").load(path).select("task", "sample", "file", F.md5("program").alias("h"))


_PROGRAM_FILES = (
    "WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS n FROM part) SELECT 'task_' || CAST(p_partkey % 100 AS VARCHAR) AS task, 'sample_' || n AS sample, 'code_' || k || '.py' AS file, md5(replace(replace(replace('"
    + _PROGRAM.replace("'", "''")
    + "', '{k}', k), '{n}', n), '{name}', p_name)) AS h FROM p"
)


def _lines(s, d):
    """The lines of all documents, in the order of doc_id, as text files that are read in blocks of 64 KB."""
    path = _scratch(s)
    lines = v.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "value"))
    lines.orderBy("doc_id", "n").select("value").write.option("lineSep", "\n").text(path)
    size = s.conf.get("spark.sql.files.maxPartitionBytes")
    s.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        return files.lines(s, path).select("line_no", F.md5("line").alias("h"))
    finally:
        s.conf.set("spark.sql.files.maxPartitionBytes", size)


def entries() -> dict[str, Entry]:
    e: dict[str, Entry] = {}
    nodes = {k: f"'' || ({b} - {a} + {n} * k) || '|' || ({b} + {n} * k)" for k, (b, n, a) in _NODES.items()}
    e["b08_syntax_match"] = Entry(_syntax, f"WITH {_SPOKEN} SELECT p_partkey, {_case(nodes)} AS got FROM spoken")
    e["b09_data_flow"] = Entry(lambda s, d: _flow_rows(s, d).select("p_partkey", code.column(_shown)(F.col("source"), F.col("language")).alias("got")), f"WITH {_SPOKEN} SELECT p_partkey, replace({_case({k: _quoted(t) for k, t in _EDGES.items()})}, '{{n}}', n) AS got FROM spoken")
    # Names: a, b, c, d, i and two literals, one of which only go's short declaration drops.
    counts = {k: f"'{t.count('|') + 1}|True|{6 if k == 'go' else 7}'" for k, t in _EDGES.items()}
    e["b11_normalised_flow"] = Entry(_renamed, f"WITH {_SPOKEN} SELECT p_partkey, {_case(counts)} AS got FROM spoken")
    e["t07_edges_in_order"] = Entry(lambda s, d: _flow_rows(s, d).select("p_partkey", code.column(_in_order)(F.col("source"), F.col("language")).alias("got")), f"WITH {_SPOKEN} SELECT p_partkey, 'True' || {_case({k: t[1] and repr(t[1]) for k, t in _EDGES.items()})} AS got FROM spoken")
    for language in LANGUAGES:
        e[f"b13_code_bleu_{language}"] = Entry(_code_bleu(language), _code_bleu_sql(language))
    accepted = code.column(lambda x: flow.LANGUAGES.get(x, "none") + "|" + str(len(flow.subtrees("x = 1", x))) if x in flow.LANGUAGES else "none")
    names = [*flow.LANGUAGES, "cobol"]
    e["b14_languages"] = Entry(
        lambda s, d: v.table(s, d, "nation").select("n_nationkey", F.get(F.array(*map(F.lit, names)), (F.col("n_nationkey") % len(names)).cast("int")).alias("language")).select("n_nationkey", accepted("language").alias("got")),
        f"WITH l AS (SELECT n_nationkey, {names}[CAST(n_nationkey % {len(names)} AS INT) + 1] AS language FROM nation) SELECT n_nationkey, CASE language WHEN 'js' THEN 'javascript' WHEN 'cs' THEN 'c_sharp' WHEN 'cobol' THEN 'none' ELSE language END || CASE language WHEN 'cobol' THEN '' WHEN 'go' THEN '|5' WHEN 'ruby' THEN '|2' WHEN 'python' THEN '|2' WHEN 'php' THEN '|3' ELSE '|3' END AS got FROM l",
    )
    e["x02_edge_rows"] = Entry(_edge_rows, _EDGE_ROWS)
    e["x03_mutant_rows"] = Entry(_mutant_rows, _MUTANT_ROWS)
    e["x04_trajectories"] = Entry(_trajectories, _TRAJECTORIES)
    e["s09_s10_programs"] = Entry(_program_files, _PROGRAM_FILES)
    e["s11_lines"] = Entry(_lines, "SELECT row_number() OVER (ORDER BY doc_id, n) - 1 AS line_no, md5(trim(line, ' ')) AS h FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
    return e
