"""Strict readers: every row is held against a contract, and each broken rule is named.

One pass gives, for each row, the names of the rules that it breaks. Rules that look across
rows (unique keys, one producer a document) are aggregates, with map-side partial sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """Keys that a JSON record must have, no others, with their types, and named rules over its fields."""

    keys: dict[str, str]
    rules: dict[str, Column] = field(default_factory=dict)


def broken_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``broken``: the names of rules that are false or null for the row, in order."""
    names = F.filter(F.array(*(F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items())), lambda n: n.isNotNull())
    return rows.withColumn("broken", names)


def strict_json(rows: DataFrame, text: str, contract: Contract) -> DataFrame:
    """``rows`` with ``record`` (the parsed fields) and ``broken``.

    A text that is no JSON object breaks ``object``; missing and further keys break ``keys``; a value that its type
    can't hold, or null, breaks ``type:<key>``; then come the contract's rules, over ``record``. Of a text that is no object only ``object`` is named.
    """
    schema = ", ".join(f"`{k}` {t}" for k, t in contract.keys.items())
    raw = ", ".join(f"`{k}` string" for k in contract.keys)
    parsed = rows.withColumns({"_keys": F.json_object_keys(text), "record": F.from_json(text, schema), "_raw": F.from_json(text, raw)})
    of = {"keys": F.array_sort("_keys") == F.array(*(F.lit(k) for k in sorted(contract.keys)))}
    of |= {f"type:{k}": F.col(f"record.`{k}`").isNotNull() for k in contract.keys}
    sound = F.col("_keys").isNotNull()
    named = broken_rules(parsed, {"object": sound, **{n: F.when(sound, r).otherwise(True) for n, r in {**of, **contract.rules}.items()}})
    return named.drop("_keys", "_raw")


def read_strict(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """(file, row, record, broken) of each line of JSONL files; blank lines are left out but counted, rows come from 1.

    A file is one partition's work, as its lines are numbered; many files are read side by side.
    """
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("_text"))
    lines = whole.select("file", F.posexplode(F.split("_text", "\n")).alias("_at", "_line")).filter(F.trim("_line") != "")
    return strict_json(lines.select("file", (F.col("_at") + 1).cast("long").alias("row"), "_line"), "_line", contract).drop("_line")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file; Spark's readers skip empty files, so these have no row."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n) of keys that stand in more than one row; nulls are a key of their own."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def mixed_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_values) of keys whose rows don't agree on ``value``; null is a value too."""
    seen = rows.groupBy(key).agg((F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("n_values"))
    return seen.filter("n_values > 1")
