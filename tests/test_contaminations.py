"""Shares of benchmark passages in documents, and how often the shingles are made for them."""

from pyspark.sql import functions as F

from posora.plans import corpus_shapes


def test_shares_and_one_making_of_the_shingles(spark, tmp_path, monkeypatch):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, "zero " + passage), (2, passage.replace("twelve", "x")), (3, passage.replace("six", "x")), (4, "One two"), (5, None), (6, passage + " " + passage)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage), (8, "one two"), (9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made, split = spark.sparkContext.accumulator(0), F.udf(lambda t: made.add(1) or t)
    monkeypatch.setattr(corpus_shapes, "shingles", lambda text, own=corpus_shapes.shingles: own(split(text)))
    found = {(r.doc_id, r.item_id): (round(r.coverage, 6), round(r.share, 6)) for r in corpus_shapes.contaminations(spark, str(tmp_path), 0.8).collect()}
    assert found == {(1, 7): (1.0, round(10 / 11, 6)), (2, 7): (0.9, 0.9), (6, 7): (1.0, round(10 / 12, 6))}
    # each document and item once, items again for their sizes, and the three documents that hold enough
    assert made.value <= 6 + 3 + 3 + 3
    won = {(r.doc_id, r.item_id) for r in corpus_shapes.passage_matching(spark, str(tmp_path)).collect()}
    assert won == {(1, 7)}
