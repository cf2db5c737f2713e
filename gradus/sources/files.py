"""Readers and writers of the workload's files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.strings import ID_SEPARATOR
from ..session import shared_dir
from . import store

#: The keywords that weigh fully in weighted n-grams, by language; the other languages have none.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split(),
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split(),
    "c_sharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while add alias ascending async await by descending dynamic equals from get global group into join let nameof notnull on orderby partial remove select set unmanaged value var when where yield".split(),
}


#: A registry of datasets.
DATASET = "data_id int, source string, split string, name string"


def dataset(registry: DataFrame, data_id: int) -> dict:
    """The row of a registry (``DATASET``) as the caller keeps it; an unknown id raises."""
    found = registry.where(F.col("data_id") == data_id).first()
    if found is None:
        raise NotImplementedError(f"no dataset {data_id}")
    return found.asDict()


def loaded(registry: DataFrame, data_id: int, root: str) -> DataFrame:
    """The split of a registry's dataset, below ``root``/source, with its name."""
    row = dataset(registry, data_id)
    rows = registry.sparkSession.read.parquet(f"{root}/{row['source']}")
    return rows.where(F.col("split") == row["split"]).drop("split").withColumn("dataset", F.lit(row["name"]))


def models(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A model dimension: id, provider, name, kind and tensor parallelism, as the caller lists them."""
    return spark.createDataFrame(rows, "model_id int, provider string, name string, kind string, parallel int")


def lookup(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Join a dimension, whose keys are unique; a key without a row raises when the plan runs. Spark broadcasts it if it is small."""
    out = rows.join(dimension.withColumn("__found", F.lit(True)), key, "left")
    checked = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("unknown id "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return out.where(checked).drop("__found")


def json_rows(spark: SparkSession, path: str, schema: str | None = None, whole: bool = True) -> DataFrame:
    """Rows of JSON: each file one value (or array) if ``whole``, else each line."""
    reader = spark.read.option("multiLine", whole)
    return (reader.schema(schema) if schema else reader).json(path)


def few_shot_rows(spark: SparkSession, path: str) -> DataFrame:
    """text and label of a tab-separated file whose text column is called text or sentence."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col(next(c for c in ("text", "sentence") if c in rows.columns)).alias("text"), F.col("label").cast("int").alias("label"))


def program_files(spark: SparkSession, path: str) -> DataFrame:
    """file, folder (its sample's) and program of all *.py below ``path``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("folder"), F.col("content").cast("string").alias("program"))


def write_programs(rows: DataFrame, path: str) -> None:
    """A file for each row of folder (task/sample), file and program, below ``path`` (``store``)."""
    store.register(rows.sparkSession)
    parts = F.split("folder", "/", 2)
    named = rows.select(parts[0].alias("task"), F.coalesce(F.get(parts, 1), F.lit("sample_0")).alias("sample"), "file", "program")
    named.write.format("programs").mode("overwrite").save(path)


#: Blocks of files whose first lines' numbers a broadcast may hold.
BLOCKS = 200_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0) and trimmed line of text files, which are read as many tasks read them.

    Files follow one another in the order of their paths. Lines are written once with their
    block of bytes and their place in what its task read; sums over the blocks before give the number of a
    block's first line. Reading once keeps the blocks: a second scan may cut the files elsewhere.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    table = f"{shared_dir(spark)}/gradus-lines-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(table)
    held = spark.read.schema(rows.schema).parquet(table)
    counted = held.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # One row a block: a hundred bytes for what a task reads.
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counted.select("file", "block", "first", before.alias("before"))
    numbered = held.join(F.broadcast(blocks) if counted.count() <= BLOCKS else blocks, ["file", "block"])
    return numbered.select((F.col("before") + F.col("at") - F.col("first")).alias("line_no"), F.trim("value").alias("line"))


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of lists of one word a line, with the columns of the folders they lie in."""
    rows = spark.read.text(path)
    folders = [c for c in rows.columns if c != "value"]
    return rows.select(F.trim("value").alias("word"), *folders).where("word <> ''").distinct()


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token and id of a JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("token", "id"))


def variants(rows: DataFrame, name: str, values: str, first_only: bool = True) -> DataFrame:
    """One row per element of an array column (or its first alone), named by the row's id and the element's place."""
    each = rows.select("*", F.posexplode(values).alias("random_id", "variant"))
    each = each.where("random_id = 0") if first_only else each
    return each.withColumn("data_id", F.concat(F.col(name), F.lit(ID_SEPARATOR), F.col("random_id").cast("string")))


def latest(names: DataFrame, column: str = "name") -> DataFrame:
    """The last checkpoint by name, as strings compare; null without any."""
    return names.agg(F.max(column).alias("latest"))


def write_board(board: DataFrame, path: str) -> None:
    """The leaderboard as CSV with a header, a folder for each hyper-setting."""
    board.write.partitionBy("hyper").option("header", True).mode("overwrite").csv(path)


def write_once(rows: DataFrame, path: str, override: bool = False) -> None:
    """Keep what is there unless told to override."""
    rows.write.mode("overwrite" if override else "ignore").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def publish(rows: DataFrame, path: str) -> None:
    """A dataset of splits."""
    rows.write.partitionBy("split").mode("overwrite").parquet(path)
