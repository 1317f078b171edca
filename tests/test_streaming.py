"""Streams over files."""

import json

from posora.streaming.requests import accepted, daily_counts

SCHEMA = "request string, med string, at timestamp"


def run(spark, folder, made, name):
    made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name).collect()


def test_requests_count_once_and_days_close(spark, tmp_path):
    rows = [("r1", "m1", "2024-01-01 10:00:00"), ("r1", "m1", "2024-01-01 10:01:00"), ("r2", "m1", "2024-01-01 11:00:00"), ("r3", "m2", None), (None, "m3", "2024-01-01 09:00:00"), (None, "m3", "2024-01-01 09:00:00"), ("r4", "m2", "2024-03-01 00:00:00")]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(dict(zip(("request", "med", "at"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema(SCHEMA).json(str(source))
    assert sorted(r.request or "" for r in run(spark, tmp_path, accepted(stream), "once")) == ["", "", "r1", "r2", "r4"]
    assert sorted((r.med, str(r.day), r.n) for r in run(spark, tmp_path, daily_counts(stream), "days")) == [("m1", "2024-01-01", 2), ("m3", "2024-01-01", 2)]
