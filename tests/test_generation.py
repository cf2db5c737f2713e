import hashlib

from pyspark.sql import functions as F

from gradus.operators import generation
from gradus.session import ship


def test_no_seed_is_lost(spark):
    """More seeds than any pool on the driver would hold by a fixed bound; they all come back."""
    ship(spark)
    seeds = spark.createDataFrame([(f"area{i:05d}:topic", f"text {i}") for i in range(1500)], "name string, text string")
    got = generation.proposed_scenarios(seeds, generation.StubCompleter(), 1510).collect()
    assert {r["name"] for r in got} > {f"area{i:05d}:topic" for i in range(1500)}
    assert 1510 < len(got) == len({r["name"] for r in got})


def test_enough_seeds_ask_for_nothing(spark):
    class Never:
        def complete(self, prompts):
            raise AssertionError

    seeds = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "name string, text string")
    assert sorted(map(tuple, generation.proposed_scenarios(seeds, Never(), 1).collect())) == [("a", "x"), ("b", "y")]
    assert generation.proposed_scenarios(seeds.limit(0), Never(), 5).count() == 0


def test_contexts_draw_distinct_scenarios(spark):
    ship(spark)
    tasks = spark.createDataFrame([(i, "do it", "a") for i in range(40)], "task_id long, instruction string, inputs string")
    scenes = spark.createDataFrame([(f"s{i}", "") for i in range(25)], "name string, text string")
    got = generation.contexts(tasks, scenes, generation.StubCompleter(), 4).collect()
    assert len(got) == 160 and len({(r["task_id"], r["scenario"]) for r in got}) == 160
    assert len({r["scenario"] for r in got}) > 15
    assert generation.contexts(tasks, scenes.limit(2), generation.StubCompleter(), 4).count() == 80
    assert generation.contexts(tasks, scenes.limit(0), generation.StubCompleter(), 4).count() == 0


def test_ranks_equal_a_window(spark):
    rows = spark.range(700).withColumn("d", F.md5(F.col("id").cast("string")))
    got = {r["id"]: r["place"] for r in generation.ranked(rows, "d", "id").collect()}
    order = sorted(range(700), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert got == {i: k for k, i in enumerate(order)}
