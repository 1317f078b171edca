"""Tokens of prefixes are dealt once a round, and only those of several documents go on."""

from posora.llm import jaccard_join
from posora.llm.shared import Scratch


def test_tokens_are_dealt_once(spark):
    words = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(30)]
    texts = [*words, *(w.replace("x3 ", "y3 ", 1) for w in words[:5])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans, sizes = [], []

    class Noted(Scratch):
        def save(self, df):
            out = super().save(df)
            if "token" in df.columns:
                plans.append(df._jdf.queryExecution().executedPlan().toString())
                sizes.append((out.count(), out.groupBy("token").count().filter("count = 1").count()))
            return out

    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(docs, 3, 80, scratch=Noted(spark)).collect()}
    assert got == {i: i if i < 30 else i - 30 for i in range(35)}
    assert len(plans) == jaccard_join.ROUNDS + 1
    assert all(p.count("Exchange hashpartitioning(token") == 1 for p in plans)
    assert all(alone == 0 for _, alone in sizes) and sizes[1][0] == 0  # what one class has is dropped


def test_tokens_shared_with_other_lengths_alone_stay_behind(spark):
    """Neighbours by length are told apart exactly: what passes the length filter with any other document goes on."""
    long = [" ".join(f"v{i}x{k}" for k in range(200)) for i in range(4)]
    # the first words of a long text in a short one, and in one of like length
    texts = [*long, *(" ".join(w.split()[:40]) for w in long), *(w + f" more{i}" for i, w in enumerate(long[:2]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met = []

    class Noted(Scratch):
        def save(self, df):
            out = super().save(df)
            if "token" in df.columns:
                met.append({r.id for r in out.select("id").distinct().collect()})
            return out

    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(docs, 3, 90, scratch=Noted(spark)).collect()}
    assert got == {**{i: i for i in range(8)}, 8: 0, 9: 1}
    assert met[0] == {0, 1, 8, 9}
