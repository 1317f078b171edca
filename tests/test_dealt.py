"""Tables dealt by a key: partitions grow with the rows, so that a task doesn't."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posora.operators import ordered
from posora.plans import corpus_cases


def test_partitions_grow_with_the_table(spark):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(few * 40).select((F.col("id") % 97).alias("k"), "id")
    assert ordered.dealt(rows, "k", a_task=40).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    own = ordered.dealt(rows, "k", a_task=10)
    assert own.rdd.getNumPartitions() == few * 4
    numbered = own.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("id")))
    assert numbered.rdd.getNumPartitions() == few * 4  # the window deals nothing anew
    assert numbered.count() == few * 40 and own.groupBy(F.spark_partition_id().alias("p"), "k").count().count() == rows.select("k").distinct().count()


def test_occurrence_slots_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    instances = spark.createDataFrame([(f"m{i % 50}", f"slot:{i}", None if i % 3 else f"0{i % 10}:00", "planned") for i in range(600)], "med string, slot string, clock string, state string")
    medications = spark.createDataFrame([(f"m{i}",) for i in range(50)], "med string").withColumn("start", F.lit("2024-01-01").cast("date"))
    want = sorted(map(tuple, corpus_cases.occurrence_slots(instances, medications).collect()))
    asked = []
    deal = ordered.dealt
    monkeypatch.setattr(corpus_cases, "dealt", lambda rows, *keys: asked.append(keys) or deal(rows, *keys, a_task=5))
    found = corpus_cases.occurrence_slots(instances, medications)
    assert asked == [("med",)] and found.rdd.getNumPartitions() == max(120, instances.rdd.getNumPartitions())
    assert sorted(map(tuple, found.collect())) == want and len(want) == 600
