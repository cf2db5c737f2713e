"""Command line: ``python -m gradus list | run | evaluate | generate | code-bleu``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import registry
from .functions.flow import LANGUAGES
from .operators import codebleu, generation, metrics
from .session import ship
from .sources import files


def _saved(df: DataFrame, args: argparse.Namespace) -> None:
    """Written as asked for; what is there is kept unless told to override."""
    df.write.format(args.format).mode("overwrite" if args.override else "errorifexists").save(args.out)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    """A query of the library over the tables in a folder."""
    _saved(registry.queries()[args.query](spark, args.data), args)


def _generate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Samples for the tasks (data_id, prefix) of a JSON file, by the completer named as module:object."""
    ship(spark)
    completer = generation.StubCompleter() if args.completer is None else _named(args.completer)
    tasks = generation.samples(files.json_rows(spark, args.tasks, "data_id string, prefix string", whole=False), args.n, args.temperature)
    _saved(generation.completed(tasks, completer, prompt="prefix"), args)


def _named(path: str):
    """An object that the caller names as module:object."""
    import importlib

    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Execute all programs below a folder (task/sample.py) and give pass@k of each task."""
    ship(spark)
    ran = generation.executed(files.program_files(spark, args.programs).withColumnRenamed("folder", "task_id"), args.seconds, args.partitions)
    _saved(metrics.pass_table(ran, ["task_id"], tuple(args.k)), args)


def _code_bleu(spark: SparkSession, args: argparse.Namespace) -> None:
    """Line-aligned files of references and of hypotheses: the corpus' CodeBLEU and its parts."""
    hypotheses = files.lines(spark, args.hyp).withColumnRenamed("line", "hypothesis")
    references = [files.lines(spark, path).select("line_no", F.col("line").alias(f"r{k}")) for k, path in enumerate(args.refs)]
    pairs = hypotheses
    for other in references:
        pairs = pairs.join(other, "line_no")
    pairs = pairs.select(F.col("line_no").cast("long").alias("pair_id"), "hypothesis", F.array(*(f"r{k}" for k in range(len(references)))).alias("references"))
    weights = tuple(float(x) for x in args.params.split(","))
    codebleu.code_bleu(pairs, args.lang, weights).show(truncate=False)


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gradus")
    kinds = out.add_subparsers(dest="kind", required=True)
    kinds.add_parser("list", help="names of all queries")
    saved = argparse.ArgumentParser(add_help=False)
    saved.add_argument("--out", required=True)
    saved.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    saved.add_argument("--override", action="store_true")
    run = kinds.add_parser("run", parents=[saved], help=_run.__doc__)
    run.add_argument("query")
    run.add_argument("--data", required=True)
    make = kinds.add_parser("generate", parents=[saved], help=_generate.__doc__)
    make.add_argument("--tasks", required=True)
    make.add_argument("--n", type=int, default=1)
    make.add_argument("--temperature", type=float, default=0.0)
    make.add_argument("--completer")
    test = kinds.add_parser("evaluate", parents=[saved], help=_evaluate.__doc__)
    test.add_argument("--programs", required=True)
    test.add_argument("--seconds", type=float, default=3.0)
    test.add_argument("--partitions", type=int)
    test.add_argument("--k", type=int, nargs="+", default=list(metrics.KS))
    score = kinds.add_parser("code-bleu", help=_code_bleu.__doc__)
    score.add_argument("--refs", nargs="+", required=True)
    score.add_argument("--hyp", required=True)
    score.add_argument("--lang", required=True, choices=sorted(LANGUAGES))
    score.add_argument("--params", default="0.25,0.25,0.25,0.25")
    return out


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.kind == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    if args.kind == "run" and args.query not in registry.queries():
        print(f"no query {args.query}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("gradus").getOrCreate()
    {"run": _run, "generate": _generate, "evaluate": _evaluate, "code-bleu": _code_bleu}[args.kind](spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
