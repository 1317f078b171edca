"""Registries, snapshots, archives and envelopes."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from posora.sources import registries


def test_registry(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text('category\tremark\tvalue\nage\t@json:"a\\tb"\t1\ndose\t x \t\n')
    rows = registries.read_registry(spark, str(path), ["category", "remark", "value"], ["category", "remark"]).collect()
    assert sorted(map(tuple, rows)) == [("age", "a\tb", "1"), ("dose", "x", None)]
    with pytest.raises(ValueError):
        registries.read_registry(spark, str(path), ["category"], ["category"])
    path.write_text("category\tvalue\nage\t1\nage\t2\n")
    with pytest.raises(Exception, match="repeated key"):
        registries.read_registry(spark, str(path), ["category", "value"], ["category"]).collect()


def test_snapshot(spark, tmp_path):
    path, meta = tmp_path / "s.jsonl", tmp_path / "s.meta.json"
    path.write_text('{"a":1}\n\n{"a":2}\n')
    meta.write_text(json.dumps({"row_count": 2, "sha256": hashlib.sha256(path.read_bytes()).hexdigest()}))
    assert registries.snapshot_problems(spark, str(path), str(meta)).count() == 0
    meta.write_text(json.dumps({"row_count": 3, "sha256": "0"}))
    assert {r.check for r in registries.snapshot_problems(spark, str(path), str(meta)).collect()} == {"row_count", "sha256"}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.json", json.dumps({"results": [{"substance_name": "Alpha", "unii": "U1"}]}))
        z.writestr("y.txt", "Name\tTYPE\tUNII\nBeta\tof\tU2\n")
    fields = {"name": ("substance_name", "Name"), "unii": ("unii", "UNII")}
    rows = registries.read_zipped(spark, str(tmp_path / "a.zip"), fields).collect()
    assert [(r.row, r.name, r.unii) for r in rows] == [(1, "Alpha", "U1"), (2, "Beta", "U2")]
    with pytest.raises(Exception, match="no kind"):
        registries.read_zipped(spark, str(tmp_path / "a.zip"), {"kind": ("TYPE",)}).collect()


def test_envelopes(spark):
    cases = [('[{"a":1},{"item":{"a":2}}]', 2), ('{"item":{"a":1}}', 1), ('{"item":[{"a":1},{"a":2}]}', 2), ('{"a":1}', 1), ('""', 0), ("[]", 0)]
    df = spark.createDataFrame([(i, '{"body":{"items":' + c + "}}") for i, (c, _) in enumerate(cases)] + [(9, None)], "k int, t string")
    got = {r.k: r.x for r in df.select("k", registries.envelope_items(F.col("t")).alias("x")).collect()}
    assert all(len(got[i]) == n for i, (_, n) in enumerate(cases)) and got[9] == []
    assert json.loads(got[0][1]) == {"a": 2}
