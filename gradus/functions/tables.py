"""Table functions: rows out of a row, or out of a table's partition, for DataFrames and for SQL text.

``register(spark)`` gives them their names in SQL:

* ``data_flow_edges(source, language)`` and ``syntax_nodes(source, language)``, called laterally;
* ``word_mutants(word, seed)``: every swap, insert, delete and look-alike of a word;
* ``trajectory(TABLE(t) PARTITION BY (...) ORDER BY (...), column)``: the table's columns (``analyze`` reads
  them) with the best value so far and how many rows ago it last rose. A partition is read row by row, so its size does not matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..session import ship


class DataFlowEdges:
    """Edges of a source in the order of their places; none for null."""

    def eval(self, source: str, language: str):
        from .flow import data_flow

        if source is None or language is None:
            return
        for name, place, how, names, places in data_flow(source, language):
            yield place, name, how, list(names), list(places)


class SyntaxNodes:
    """Inner nodes of a source's tree in the order of their first tokens: node, parent, depth, kind and first and last place."""

    def eval(self, source: str, language: str):
        from . import syntax
        from .flow import LANGUAGES

        if source is None or language is None:
            return
        tree, count = syntax.parsed(source, LANGUAGES[language]), 0
        stack = [(tree, -1, 0)]
        while stack:
            node, parent, depth = stack.pop()
            places = [x.place for x in node.leaves()]
            yield count, parent, depth, node.kind, min(places, default=None), max(places, default=None)
            stack.extend((c, count, depth + 1) for c in reversed(node.children) if c.text is None)
            count += 1


class WordMutants:
    """kind, place (from 0) and mutant; words of one letter have look-alikes only."""

    def eval(self, word: str, seed: str):
        from ..operators.mutation import HOMOGLYPHS, LETTERS

        if not word:
            return
        n = len(word)
        for i in range(n - 1):
            yield "swap", i, word[:i] + word[i + 1] + word[i] + word[i + 2 :]
        for i in range(n if n > 1 else 0):
            drawn = int(hashlib.md5(f"{seed}|{word}|{i}".encode()).hexdigest()[:4], 16) % len(LETTERS)
            yield "insert", i, word[:i] + LETTERS[drawn] + word[i:]
            yield "delete", i, word[:i] + word[i + 1 :]
        for i in range(n):
            if word[i] in HOMOGLYPHS:
                yield "homoglyph", i, word[:i] + HOMOGLYPHS[word[i]] + word[i + 1 :]


class Trajectory:
    """A partition's rows in their order, each with ``best`` (so far) and ``waited`` (rows since it last rose); nulls never rise."""

    def __init__(self):
        self.best, self.waited = None, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(rows.dataType, StructType):
            raise ValueError("the first argument is a table")
        if not column.isConstantExpression or column.value not in rows.dataType.fieldNames():
            raise ValueError(f"the second argument names a column of {rows.dataType.fieldNames()}")
        taken = {"best", "waited"} & set(rows.dataType.fieldNames())
        if taken:
            raise ValueError(f"the table has columns of its own named {sorted(taken)}")
        return AnalyzeResult(StructType([*rows.dataType.fields]).add("best", DoubleType()).add("waited", LongType()))

    def eval(self, row, column: str):
        value = row[column]
        if value is not None and (self.best is None or value > self.best):
            self.best, self.waited = float(value), 0
        else:
            self.waited += 1
        yield (*row, self.best, self.waited)


data_flow_edges = udtf(DataFlowEdges, returnType="place int, name string, relation string, names array<string>, places array<int>")
syntax_nodes = udtf(SyntaxNodes, returnType="node int, parent int, depth int, kind string, first int, last int")
word_mutants = udtf(WordMutants, returnType="kind string, place int, mutant string")
trajectory = udtf(Trajectory)


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL text."""
    ship(spark)
    for name, function in (("data_flow_edges", data_flow_edges), ("syntax_nodes", syntax_nodes), ("word_mutants", word_mutants), ("trajectory", trajectory)):
        spark.udtf.register(name, function)
