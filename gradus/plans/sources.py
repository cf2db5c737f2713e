"""Queries on source code that is written from the tables' rows, so that SQL can say what they give.

Every part has a program: imports, a helper, a documented function with an example, a loop, a late
import and an assertion under an if. Names and numbers are the part's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import code, strings
from ..operators import generation
from ..registry import Entry
from ..session import ship, spread
from ..sources import files
from . import views as v

_PROGRAM = """import math

def helper_{k}(x):
    return x * 2

def scale_{k}(values, factor={n}):
    \"\"\"Scale {name}.
    >>> scale_{k}([1], {n})
    {n}
    \"\"\"
    from os import path
    total = {n}
    for v in values:
        total += v * factor
    return total

if True:
    assert scale_{k}([], 1) == {n}
"""
_SQL = "p AS (SELECT p_partkey, p_partkey AS k, p_size AS n, p_name AS name, p_type FROM part)"


def programs(s: SparkSession, d: str) -> DataFrame:
    """p_partkey, entry, source, and the part's name, size and type."""
    ship(s)
    rows = spread(v.table(s, d, "part").select("p_partkey", "p_name", "p_size", "p_type"))
    slots = {"k": F.col("p_partkey").cast("string"), "n": F.col("p_size").cast("string"), "name": F.col("p_name")}
    return rows.select("p_partkey", "p_name", "p_size", "p_type", F.concat(F.lit("scale_"), F.col("p_partkey").cast("string")).alias("entry"), strings.template(_PROGRAM, slots).alias("source"))


def _got(function, kind: str = "string", *columns: str | Callable[[], Column]):
    """A query of one function over every part's program (and entry)."""

    def run(s, d):
        f = code.column(function, kind)
        return programs(s, d).select("p_partkey", f(*(F.col(c) if isinstance(c, str) else c() for c in columns or ("source", "entry"))).alias("got"))

    return run


def _sql(got: str) -> str:
    return f"WITH {_SQL} SELECT p_partkey, {got} AS got FROM p"


_NL = "chr(10)"
_DOC = f"'Scale ' || name || '.' || {_NL} || '>>> scale_' || k || '([1], ' || n || ')' || {_NL} || n"

#: A row's language and its function in it; the slot is the row's own number.
_FUNCTIONS = {
    "python": "def f(x):\n    y = {n}\n    while x:\n        y = y + x\n    return y",
    "java": "int f(int x) {\n  int y = {n};\n  while (x > 0) {\n    y = y + x;\n  }\n  return y;\n}",
    "cs": "int f(int x) {\n  int y = {n};\n  while (x > 0) {\n    y = y + x;\n  }\n  return y;\n}",
    "cpp": "int f(int x) {\n  int y = {n};\n  while (x > 0) {\n    y = y + x;\n  }\n  return y;\n}",
    "js": "function f(x) {\n  let y = {n};\n  while (x > 0) {\n    y = y + x;\n  }\n  return y;\n}",
    "ts": "function f(x) {\n  let y = {n};\n  while (x > 0) {\n    y = y + x;\n  }\n  return y;\n}",
    "php": "function f($x) {\n  $y = {n};\n  while ($x > 0) {\n    $y = $y + $x;\n  }\n  return $y;\n}",
    "sh": "f() {\n  y={n}\n  echo $y\n}",
    "go": "func f(x int) int {\n  y := {n}\n  for x > 0 {\n    y = y + x\n  }\n  return y\n}",
    "ruby": "def f(x)\n  y = {n}\n  while x > 0\n    y = y + x\n  end\n  y\nend",
}
_GENERATED = ("python", "java", "cs", "cpp", "js", "ts", "php", "sh")


def _case(by: str, values: dict, sql: bool):
    """The value of the language whose number is ``by`` modulo their count."""
    n = len(values)
    if sql:
        quoted = {k: "'" + x.replace("'", "''").replace("\n", f"' || {_NL} || '") + "'" for k, x in values.items()}
        return f"CASE {by} % {n} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(quoted.values())) + " END"
    out = F.lit(None).cast("string")
    for i, x in enumerate(values.values()):
        out = F.when(F.col(by) % n == i, F.lit(x)).otherwise(out)
    return out


def _spoken(s, d, languages):
    """nation rows with a language each and its function under their own number."""
    ship(s)
    rows = v.table(s, d, "nation")
    source = F.replace(_case("n_nationkey", {k: _FUNCTIONS[k] for k in languages}, False), F.lit("{n}"), F.col("n_nationkey").cast("string"))
    return rows.select("n_nationkey", _case("n_nationkey", {k: k for k in languages}, False).alias("language"), source.alias("source"))


def _spoken_sql(languages) -> str:
    return f"spoken AS (SELECT n_nationkey, {_case('n_nationkey', {k: k for k in languages}, True)} AS language, replace({_case('n_nationkey', {k: _FUNCTIONS[k] for k in languages}, True)}, '{{n}}', CAST(n_nationkey AS VARCHAR)) AS source FROM nation)"


def _generations(s, d):
    rows = _spoken(s, d, _GENERATED)
    said = F.concat(F.lit("Here it is:\n```"), "language", F.lit("\n"), "source", F.lit("\n\nf(1);\n```\nDone."))
    output = F.when(F.col("n_nationkey") % 5 == 4, F.lit("no code")).otherwise(said)
    f = code.column(lambda o, l: code.generation(o, "PROMPT\n", "f", l))
    return rows.select("n_nationkey", f(output, F.col("language")).alias("got"))


def _flow_hits(s, d):
    """A part's loop against a renamed copy (even sizes) or one without the loop."""
    ship(s)
    own = F.lit("t = n\nfor v in w:\n    t = t + v\nr = t\n")
    other = F.when(F.col("p_size") % 2 == 0, F.lit("a = b\nfor c in e:\n    a = a + c\ng = a\n")).otherwise(F.lit("t = n\nr = t\n"))
    return spread(v.table(s, d, "part").select("p_partkey", "p_size")).select("p_partkey", F.round(code.column(code.flow_match, "double")(own, other), 6).alias("got"))


def _executed(s, d):
    ship(s)
    rows = v.table(s, d, "region").select("r_regionkey", F.concat(F.lit("assert "), F.col("r_regionkey").cast("string"), F.lit(" < 3")).alias("program"))
    return generation.executed(rows).select("r_regionkey", "passed")


def _validated(s, d):
    ship(s)
    rows = v.table(s, d, "region").select("r_regionkey", F.concat(F.lit("assert "), F.col("r_regionkey").cast("string"), F.lit(" % 2 == 0")).alias("program"))
    return generation.validated(rows).select("r_regionkey")


def _small_flow(show):
    """A program of three assignments a nation, of which the second goes nowhere."""

    def run(s, d):
        ship(s)
        rows = v.table(s, d, "nation")
        n = F.col("n_nationkey").cast("string")
        return rows.select("n_nationkey", code.column(show)(F.concat(F.lit("x"), n, F.lit(" = 1\ny = 2\nz = x"), n, F.lit("\n"))).alias("got"))

    return run


def _json_sink(s, d):
    from .programs import _scratch

    path = _scratch(s)
    files.write_json(v.table(s, d, "nation"), path)
    return s.read.text(path).select(F.from_json("value", "n_nationkey int, n_name string").alias("r")).select("r.*")


def entries() -> dict[str, Entry]:
    e: dict[str, Entry] = {}
    e["b10_places"] = Entry(_small_flow(lambda x: "|".join(str(p) for _, p, *_ in code.data_flow(x))), "SELECT n_nationkey, '0|2|3' AS got FROM nation")
    e["b12_pruned"] = Entry(_small_flow(lambda x: "|".join(f"{n}:{how}" for n, _, how, _, _ in code.data_flow(x))), "SELECT n_nationkey, 'x' || n_nationkey || ':computedFrom|z:computedFrom|x' || n_nationkey || ':comesFrom' AS got FROM nation")
    e["s05_json_sink"] = Entry(_json_sink, "SELECT n_nationkey, n_name FROM nation")
    e["e05_parallel"] = Entry(lambda s, d: (ship(s), generation.executed(v.table(s, d, "nation").select("n_nationkey", F.concat(F.lit("assert "), F.col("n_nationkey").cast("string"), F.lit(" % 3 != 1")).alias("program")), partitions=4))[1].select("n_nationkey", "passed"), "SELECT n_nationkey, n_nationkey % 3 <> 1 AS passed FROM nation")
    broken = lambda: F.concat("source", F.when(F.col("p_size") % 2 == 1, "(").otherwise(""))
    literal = lambda: F.concat(F.when(F.col("p_size") % 2 == 0, "(").otherwise("["), F.col("p_size").cast("string"), F.lit(", [1.5, 'x']"), F.when(F.col("p_size") % 2 == 0, ")").otherwise("]"))
    pairs = [
        ("f30_docstring", _got(code.docstring), _DOC),
        ("f31_replaced_docstring", _got(lambda s, n: code.docstring(code.replaced_docstring(s, n, "New."), n)), "'New.'"),
        ("f32_updated_docstring", _got(lambda s, n: code.docstring(code.updated_docstring(s, "Sum up."), n)), f"'Sum up.' || {_NL} || '>>> scale_' || k || '([1], ' || n || ')'"),
        ("f33_docstring_names", _got(lambda s: ",".join(sorted(code.without_docstrings(s)[0])), "string", "source"), "'scale_' || k"),
        ("f34_hoisted_imports", _got(lambda s: "|".join(code.hoisted_imports(s).split("\n")[:2]), "string", "source"), "'import math|from os import path'"),
        ("f35_split_function", _got(lambda s, n: code.split_function(s, n)[0].rstrip("\n").split("\n")[-1]), "'def scale_' || k || '(values, factor=' || n || '):'"),
        ("f36_function_names", _got(lambda s: ",".join(sorted(code.function_names(s))), "string", "source"), "'helper_' || k || ',scale_' || k"),
        ("u07_without_builtins", _got(lambda s: ",".join(sorted(code.function_names(s + "\ndef sum(x):\n    return x\n"))), "string", "source"), "'helper_' || k || ',scale_' || k"),
        ("f37_parameters", _got(lambda s, n: ",".join(code.parameters(s, n))), "'values,factor'"),
        ("f38_call_arguments", _got(lambda s, n: "|".join(sorted(code.call_arguments(s, n)))), "'([], 1)'"),
        ("f39_tested_inputs", _got(lambda s, n: "|".join(code.tested_inputs(s, n) or [])), "'[]'"),
        ("f40_imports_and_asserts", _got(lambda s: "|".join(sum(code.imports_and_asserts(s), [])), "string", "source"), "'import math|from os import path|assert scale_' || k || '([], 1) == ' || n"),
        ("f11_first_function", _got(lambda s: code.first_function(s)[0], "string", "source"), "'scale_' || k"),
        ("f05_instruction_and_examples", _got(lambda s, n: "#".join(code.instruction_and_examples(code.docstring(s, n), n))), f"'Scale ' || name || '.#    >>>scale_' || k || '([1], ' || n || ')' || {_NL} || '    ' || n"),
        ("f41_checker", _got(lambda n, x: code.checker([f"({x}, 2)", x], [x, "'y'"], n, "check({input_list}, {output_list}, {func_entry})"), "string", "entry", lambda: F.col("p_size").cast("string")), "'check([(' || n || ', 2), (' || n || ',)], [' || n || ', ''y''], scale_' || k || ')'"),
        ("p16_parseable", _got(code.parseable, "boolean", broken), "n % 2 = 0"),
        ("p15_tuple_inputs", _got(code.is_tuple, "boolean", literal), "n % 2 = 0"),
        ("f14_types", _got(lambda t: "; ".join(code.described([t])[0]), "string", literal), "CASE WHEN n % 2 = 0 THEN 'int; list of float, str' ELSE 'list of int, list of float, str' END"),
    ]
    for name, run, sql in pairs:
        e[name] = Entry(run, _sql(sql))
    fenced = f"WITH {_spoken_sql(_GENERATED)} SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN 'PROMPT' || {_NL} || 'no code' ELSE source END AS got FROM spoken"
    e["f10_generations"] = Entry(_generations, fenced)
    e["a22_flow_match"] = Entry(_flow_hits, "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE round(3 / 9.0, 6) END AS got FROM part")
    e["e04_executed"] = Entry(_executed, "SELECT r_regionkey, r_regionkey < 3 AS passed FROM region")
    e["p12_validated"] = Entry(_validated, "SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0")
    return e
