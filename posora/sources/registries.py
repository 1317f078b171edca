"""Reviewed registries, snapshots with their metadata, archives and response envelopes as DataFrames.

Readers check what they read in the same plan: a file that isn't as described raises when it is used, and never
gives fewer rows in silence.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posora.functions.names import clean

ESCAPE = "@json:"


def read_registry(spark: SparkSession, path: str, columns: list[str], keys: list[str]) -> DataFrame:
    """A reviewed TSV registry: its header must be ``columns``, and no two rows may have the same ``keys``.

    Values that start with ``@json:`` are JSON strings; blank values are null. An empty registry gives no rows.
    """
    lines = spark.read.text(path)
    header = lines.limit(1).collect()
    if not header or header[0].value.lstrip("\ufeff").split("\t") != columns:
        raise ValueError(f"{path}: the header isn't {columns}")
    raw = spark.read.csv(path, sep="\t", header=True, quote="", schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=False)

    def value(c: str) -> Column:
        told = F.from_json(F.concat(F.lit('{"v":'), F.substring(F.col(c), F.lit(len(ESCAPE) + 1), F.length(c)), F.lit("}")), "v string")["v"]
        return F.when(F.col(c).startswith(ESCAPE), told).otherwise(clean(F.col(c))).alias(c)

    rows = raw.select(*map(value, columns))
    twice = F.count("*").over(W.partitionBy(*keys)) > 1
    checked = rows.withColumn("bad", F.when(twice, F.raise_error(F.concat(F.lit(f"{path}: repeated key "), F.to_json(F.struct(*keys))))))
    return checked.filter("bad IS NULL").drop("bad")


def snapshot_problems(spark: SparkSession, path: str, meta_path: str) -> DataFrame:
    """(check, wanted, found) of what a snapshot and its metadata file (row_count, sha256) don't agree on; no rows if all is well."""
    meta = spark.read.json(meta_path, multiLine=True).select(F.col("row_count").cast("string").alias("rows"), F.lower("sha256").alias("sha"))
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("found_sha"))
    rows = spark.read.text(path).filter(F.trim("value") != "").agg(F.count("*").cast("string").alias("found_rows"))
    both = meta.join(digest, F.lit(True)).join(rows, F.lit(True))
    checks = F.array(F.struct(F.lit("row_count").alias("check"), F.col("rows").alias("wanted"), F.col("found_rows").alias("found")), F.struct(F.lit("sha256").alias("check"), F.col("sha").alias("wanted"), F.col("found_sha").alias("found")))
    return both.select(F.explode(checks).alias("c")).select("c.*").filter("NOT wanted <=> found")


def read_zipped(spark: SparkSession, path: str, fields: dict[str, tuple[str, ...]], member: str = "") -> DataFrame:
    """(archive, row, *fields) of the JSON or TSV members of ZIP archives whose name ends in ``member``.

    ``fields`` has for each column the names that it may have in a header or object; the first that is there counts.
    Rows in which a column is blank or missing raise. One task reads an archive, row by row.
    """
    names = list(fields)

    def found(get, where: str) -> list[str]:
        out = []
        for name in names:
            value = next((v for alias in fields[name] if (v := get(alias)) is not None), None)
            if value is None or not str(value).strip():
                raise ValueError(f"{where}: no {name}")
            out.append(str(value).strip())
        return out

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in sorted(n for n in z.namelist() if n.endswith(member) and n.endswith((".json", ".tsv", ".txt"))):
                        if info.endswith(".json"):
                            told = json.loads(z.read(info))
                            items = told if isinstance(told, list) else told["results"]
                            rows += [found(item.get, f"{archive} {info}") for item in items]
                        else:
                            with io.TextIOWrapper(z.open(info), "utf-8-sig") as text:
                                header = text.readline().rstrip("\r\n").split("\t")
                                rows += [found(dict(zip(header, line.rstrip("\r\n").split("\t"), strict=False)).get, f"{archive} {info}") for line in text if line.strip()]
                out = pd.DataFrame(rows, columns=names, dtype=object)
                out.insert(0, "row", range(1, len(out) + 1))
                out.insert(0, "archive", archive)
                yield out

    schema = "archive string, row long, " + ", ".join(f"`{n}` string" for n in names)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, schema)


def envelope_items(response: Column, path: str = "$.body.items") -> Column:
    """array<string> of the items of a JSON response: a list, one object, or either under ``item``; each may itself be
    wrapped in ``item``. Null, no items and empty text give an empty array.
    """
    items = F.get_json_object(response, path)
    inner = F.coalesce(F.get_json_object(items, "$.item"), items)
    told = F.when(inner.startswith("["), F.from_json(inner, "array<string>")).when(inner.startswith("{"), F.array(inner))
    return F.coalesce(F.transform(told, lambda x: F.coalesce(F.get_json_object(x, "$.item"), x)), F.array().cast("array<string>"))
