"""Trees and data flow by language, table functions, program files and line numbers."""

import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gradus.functions import flow, syntax, tables
from gradus.plans import languages
from gradus.sources import files, store

from .test_operators import PROGRAMS

LANGUAGES = languages.LANGUAGES
SOURCES = {k: [PROGRAMS["js" if k == "javascript" else k], languages._FLOWING[k].replace("{n}", "7"), "".join(languages._REPEATED[k]).replace("{n}", "7")] for k in LANGUAGES}
MORE = {
    "java": "import java.util.List;\npublic class A<T> extends B { private final int[] xs = {1, 2}; public static <T> List<T> f(List<? extends T> a) throws E { try { switch (x) { case 1: y = (int) z; break; default: g(a -> a + 1); } } catch (E | F e) { throw new E(\"a\"); } finally { i--; } do { x = y > 0 ? 1 : new int[3][0]; } while (x < 3); return a.b().c[1]; } }",
    "c_sharp": "using System;\nnamespace N { }\nclass A { public async void F(string s = \"x\") { var t = await G(s); foreach (var q in t.Items) { q++; } int? n = t as B; for (;;) { break; } try { H(x => x.Y); } catch (E e) { throw; } finally { } } }",
    "javascript": "import a from 'b'\nexport default class A extends B { static async f(x, {y, z: [q]} = {}, ...r) { const g = async (a) => { await a }, h = x => x ** 2\n for (const k in r) if (k) continue; else break\n return {a: 1, ...x, y, m() { return `t${x}` }} } }\nswitch (a) { case 1: b(); default: c }\nlet [u, v = 2] = w ?? [];",
    "php": "<?php namespace A\\B; use C;\nclass D { private $x = 1; public function f(?int $a, &$b = [1, 'k' => 2]) : int { foreach ($a as $k => $v) { echo $k . $v; } if ($a) { } elseif ($b) { } else { } $this->x = fn($y) => $y * 2; $g = function ($z) use ($a) { return $z; }; return A::$s ?? $b['k']; } }",
    "go": "package p\nimport \"fmt\"\ntype T struct { a, b int; c []string }\nconst k = 1\nfunc (t *T) f(a, b int, c ...string) (int, error) {\n\tm := map[string]int{\"a\": 1}\n\tif v, ok := m[\"a\"]; ok && v > 0 { return v, nil }\n\tfor i := range c { defer g(func() { i++ }) }\n\tswitch x := t.a; x { case 1: fmt.Println(T{1, 2}) \n default: }\n\tvar p *T = &T{a: 1}\n\treturn <-ch, nil\n}",
    "ruby": "module M\n class A < B\n  def f(a, b = 1, *c, k: 2)\n   x, y = a, b\n   return 1 if x > y\n   z = @q.map { |v| v + 1 }\n   puts z, 'a' unless x\n   case a when 1 then 2 else 3 end\n   begin\n    raise E\n   rescue E => e\n    yield e\n   ensure\n    x += 1\n   end\n   until x do x -= 1 end\n   h = {a: 1, 'b' => [1, 2]}\n  end\n end\nend",
}


def edges(source, language):
    return [(n, p, how, list(q)) for n, p, how, _, q in flow.data_flow(source, language)]


@pytest.mark.parametrize("language", LANGUAGES)
def test_programs_have_trees_without_errors(language):
    for source in [*SOURCES[language], MORE[language]]:
        tree = syntax.parsed(source, language)
        if source != MORE[language]:
            assert "ERROR" not in syntax.shown(tree), syntax.shown(tree)
        assert [x.place for x in tree.leaves()] == list(range(len(syntax.tokens(source, language))))
        assert [x.text for x in tree.leaves()] == [t for _, t, _ in syntax.tokens(source, language)]
    assert syntax.shown(syntax.parsed(MORE[language], language)).count("ERROR") == 0


@pytest.mark.parametrize("language", LANGUAGES)
def test_any_text_has_a_tree_with_every_token(language):
    r, sources = np.random.default_rng(1), [*SOURCES[language], MORE[language]]
    done = 0
    for source in sources:
        parts = [t for _, t, _ in syntax.tokens(source, language)]
        for _ in range(420):
            kind = r.integers(4)
            if kind == 0:
                text = source[r.integers(len(source)) :][: r.integers(len(source))]
            elif kind == 1:
                text = " ".join(r.permutation(parts))
            elif kind == 2:
                text = " ".join(p for p in parts if r.random() > 0.1)
            else:
                at = r.integers(len(source))
                text = source[:at] + chr(r.integers(1, 0x2FFF)) * r.integers(1, 4) + source[at:]
            tree = syntax.parsed(text, language)
            assert [x.place for x in tree.leaves()] == list(range(len(syntax.tokens(text, language))))
            flow.data_flow(text, language)
            done += 1
    assert done * len(LANGUAGES) >= 10_000


def test_deep_and_long_texts():
    for language in LANGUAGES:
        for text in ("(" * 30_000, "x = " + "[" * 5000 + "]" * 5000, "{" * 20_000, "if (a) " * 3000, "a." * 20_000, "x = 1;\n" * 20_000):
            assert len(list(syntax.parsed(text, language).leaves())) == len(syntax.tokens(text, language))
    assert len(flow.data_flow("int f() { int a = 1; " + "a = a + 1; " * 3000 + "}", "java")) == 2 + 3 * 3000


def test_equal_shapes_have_equal_digests():
    for language in LANGUAGES:
        by_shape = {}

        def walk(node):
            yield node
            for c in node.children:
                if c.children:
                    yield from walk(c)

        for source in SOURCES[language]:
            for node in walk(syntax.parsed(source, language)):
                by_shape.setdefault(syntax.shown(node), set()).add(syntax.subtrees(node)[-1])
        digests = [d for found in by_shape.values() for d in found]
        assert all(len(found) == 1 for found in by_shape.values()) and len(set(digests)) == len(digests)


def test_branches_with_and_without_else():
    # a0 a4 a8: what a read after the branch may come from.
    texts = {
        "java": ("a = 1; if (b) { a = 2; } c = a;", "a = 1; if (b) { a = 2; } else { a = 3; } c = a;", 2, 2),
        "c_sharp": ("a = 1; if (b) { a = 2; } c = a;", "a = 1; if (b) { a = 2; } else { a = 3; } c = a;", 2, 2),
        "php": ("$a = 1; if ($b) { $a = 2; } $c = $a;", "$a = 1; if ($b) { $a = 2; } else { $a = 3; } $c = $a;", 2, 3),
        "go": ("a = 1\nif b { a = 2 }\nc = a", "a = 1\nif b { a = 2 } else { a = 3 }\nc = a", 2, 3),
        "javascript": ("a += 1; if (b) { a += 2; } c += a;", "a += 1; if (b) { a += 2; } else { a += 3; } c += a;", 2, 3),
        "ruby": ("a = 1\nif b\n a = 2\nend\nc = a", "a = 1\nif b\n a = 2\nelsif d\n a = 4\nelse\n a = 3\nend\nc = a", 2, 4),
    }
    for language, (one, other, n, m) in texts.items():
        for text, size in ((one, n), (other, m)):
            last = [e for e in edges(text, language) if e[0] == "a" and e[2] == "comesFrom"][-1]
            assert len(last[3]) == size, (language, text, last)


def test_rules_that_differ_by_language():
    # Plain assignments: all but javascript's compute.
    assert ("a", 0, "computedFrom", [2]) in edges("a = b;", "java") and edges("a = b;", "javascript") == []
    assert ("a", 0, "computedFrom", [2]) in edges("a = b", "go") and ("a", 0, "computedFrom", [2]) not in edges("a := b", "go")
    # Declarations come from their values, by field or by place.
    for text, language, place in (("int a = b;", "java", 1), ("int a = b;", "c_sharp", 1), ("let a = b;", "javascript", 1), ("var a = b", "go", 1)):
        assert ("a", place, "comesFrom", [place + 2]) in edges(text, language)
    assert ("a", 4, "comesFrom", [6]) in edges("function f($a = 1) { return $a; }", "php")
    assert ("a", 3, "comesFrom", [5]) in edges("def f(a: 1)\n a\nend", "ruby")
    # A header's declaration is followed again only where the rules name it.
    loop = "for (int i = 0; i < n; i++) { s += i; }"
    again = [e for e in edges(loop, "java") if e[:2] == ("i", 7)][0]
    assert again[3] == [3, 11] and [e for e in edges(loop, "c_sharp") if e[:2] == ("i", 7)][0][3] == [3]
    assert [e for e in edges(loop.replace("int", "var"), "javascript") if e[:2] == ("i", 7)][0][3] == [3, 11]
    assert [e for e in edges(loop.replace("int", "let"), "javascript") if e[:2] == ("i", 7)][0][3] == [3]
    # Ruby's parallel assignments pair targets with values, until loops run twice and while loops once.
    assert {("a", 0, "computedFrom", (4,)), ("b", 2, "computedFrom", (6,))} <= {(n, p, how, tuple(q)) for n, p, how, q in edges("a, b = b, a", "ruby")}
    assert [e for e in edges("x = 0\nuntil x > 3\n x = x + 1\nend", "ruby") if e[:2] == ("x", 4)][0][3] == [0, 7]
    assert [e for e in edges("x = 0\nwhile x > 3\n x = x + 1\nend", "ruby") if e[:2] == ("x", 4)][0][3] == [0]
    assert [e for e in edges("x = 0;\nwhile (x > 3) x = x + 1;", "java") if e[:2] == ("x", 6)][0][3] == [0, 10]
    # Loops over elements: php's source comes first.
    assert ("d", 6, "computedFrom", [3]) in edges("foreach ($b as $d) { echo $d; }", "php")


def test_table_functions_from_sql_text(spark):
    tables.register(spark)
    got = spark.sql("SELECT kind, place, mutant FROM word_mutants('ab', '1') WHERE kind <> 'insert'").collect()
    assert {tuple(r) for r in got} == {("swap", 0, "ba"), ("delete", 0, "b"), ("delete", 1, "a"), ("homoglyph", 0, "ɑb"), ("homoglyph", 1, "aЬ")}
    assert spark.sql("SELECT * FROM word_mutants('', '1')").count() == 0 == spark.sql("SELECT * FROM data_flow_edges(NULL, 'go')").count()
    nodes = spark.sql("SELECT kind, parent, depth, first, last FROM syntax_nodes('x = 1;', 'java')").collect()
    assert [tuple(r) for r in nodes] == [("program", -1, 0, 0, 3), ("expression_statement", 0, 1, 0, 3), ("assignment_expression", 1, 2, 0, 2)]
    rows = spark.createDataFrame([(1, "int f(int a) { int b = a; return b; }"), (2, None)], "k int, source string")
    edges = rows.lateralJoin(tables.data_flow_edges(F.col("source").outer(), F.lit("java"))).select("k", "name", "place", "places").collect()
    assert {(r["name"], r["place"], tuple(r["places"])) for r in edges} == {("a", 4, ()), ("b", 8, (10,)), ("a", 10, (4,)), ("b", 13, (8,))} and {r["k"] for r in edges} == {1}


def test_trajectory_keeps_the_tables_columns(spark):
    tables.register(spark)
    rows = [("a", 1, 2.0, "x"), ("a", 2, 1.0, None), ("a", 3, None, "y"), ("a", 4, 5.0, "z"), ("b", 1, None, "q"), ("b", 2, 3.0, "r")]
    spark.createDataFrame(rows, "g string, i int, score double, note string").createOrReplaceTempView("rounds")
    got = spark.sql("SELECT * FROM trajectory(TABLE(rounds) PARTITION BY (g) ORDER BY (i), 'score')")
    assert got.columns == ["g", "i", "score", "note", "best", "waited"]
    assert sorted((r["g"], r["i"], r["best"], r["waited"], r["note"]) for r in got.collect()) == [("a", 1, 2.0, 0, "x"), ("a", 2, 2.0, 1, None), ("a", 3, 2.0, 2, "y"), ("a", 4, 5.0, 0, "z"), ("b", 1, None, 1, "q"), ("b", 2, 3.0, 0, "r")]
    for wrong in ("'none'", "concat('sc', string(i))"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM rounds, LATERAL (SELECT * FROM trajectory(TABLE(SELECT 1 AS i), {wrong}))").collect()


def _programs(spark, n, bad=-1):
    i = F.col("id")
    return spark.range(n).select(F.concat(F.lit("t/"), (i % 7).cast("string")).alias("task"), F.lit("s").alias("sample"), F.when(i != bad, F.concat(F.lit("code_"), i.cast("string"), F.lit(".py"))).alias("file"), F.when(i % 5 != 0, F.concat(F.lit("é = "), i.cast("string"))).alias("program"))


def test_programs_are_files_of_their_own(spark, tmp_path):
    store.register(spark)
    path = f"file://{tmp_path}/out"
    _programs(spark, 60).repartition(5).write.format("programs").mode("overwrite").save(path)
    assert (tmp_path / "out/t_3/s/code_3.py").read_text() == "é = 3"
    back = spark.read.format("programs").option("folders", 2).load(path)
    assert back.rdd.getNumPartitions() == 4
    assert {tuple(r) for r in back.collect()} == {(f"t_{i % 7}", "s", f"code_{i}.py", f"é = {i}" if i % 5 else "") for i in range(60)}
    # Replaced as a whole, or refused; nothing else is left beside it.
    _programs(spark, 3).write.format("programs").mode("overwrite").save(path)
    assert spark.read.format("programs").load(path).count() == 3
    with pytest.raises(Exception, match="FileExistsError"):
        _programs(spark, 3).write.format("programs").mode("append").save(path)
    with pytest.raises(Exception, match="columns"):
        spark.range(2).write.format("programs").mode("overwrite").save(path)
    assert spark.read.format("programs").load(path).count() == 3


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    store.register(spark)
    with pytest.raises(Exception, match="no name for a file"):
        _programs(spark, 400, bad=399).repartition(4).write.format("programs").mode("overwrite").save(f"file://{tmp_path}/failed")
    left = [os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names]
    assert left == [] and not os.path.exists(tmp_path / "failed")


def test_lines_of_split_files_are_numbered_through(spark, tmp_path):
    r = np.random.default_rng(3)
    want = []
    for name in ("a.txt", "b.txt", "c.txt"):
        own = [f" {name} {i} " + "x" * int(r.integers(0, 90)) if r.random() > 0.1 else "" for i in range(4000)]
        own[-1] = "end"
        (tmp_path / name).write_text("\n".join(own) + ("\n" if name == "b.txt" else ""))
        want += own
    (tmp_path / "d.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = files.lines(spark, f"file://{tmp_path}/*.txt")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got.collect())) == [(i, x.strip()) for i, x in enumerate(want)]
    assert [tuple(x) for x in files.lines(spark, f"file://{tmp_path}/d.txt").collect()] == []


def test_lines_with_many_blocks_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BLOCKS", 0)
    (tmp_path / "a.txt").write_text("x\ny\n\nz")
    assert sorted(map(tuple, files.lines(spark, f"file://{tmp_path}/a.txt").collect())) == [(0, "x"), (1, "y"), (2, ""), (3, "z")]
