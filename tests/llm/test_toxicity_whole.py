"""Toxicity is learnt from every labelled text, not from the sample that it starts from."""

import pickle
import random

import numpy as np

from posora.llm import toxicity


def test_words_outside_the_sample_are_learnt(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1600):
        words = ["".join(rng.choice("klmno") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 25))]
        if i % 2:
            words.insert(rng.randrange(len(words)), f"grumpel{i % 7}" if i % 10 else "zwackig")
        rows.append((i, " ".join(words), "aa", i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), sample=(20, 20))
    assert model.languages == ["aa"] and model.squares is None  # 20 texts of each kind are fewer than a language needs
    right = [(model.score(t) >= 0.5) == bool(y) for _, t, _, y in rows]
    assert np.mean(right) > 0.95


def test_long_texts_and_sums_of_counts():
    rng = np.random.default_rng(1)
    model = toxicity.train([(rng.integers(0, 99, (30, toxicity.PARTS), np.int32), bool(i % 2), None) for i in range(40)], 0.5)
    parts = rng.integers(0, toxicity.BUCKETS, (3 * toxicity.SPAN + 5, toxicity.PARTS), np.int32)
    whole = model.responses(model.vectors(parts))
    most, spot = model.strongest(parts)
    assert np.allclose(most, whole.max(0)) and (np.abs(whole[spot, np.arange(len(spot))] - most) < 1e-5).all()
    x, y, n = np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, True, False, True]), np.array([5, 1, 3, 9])
    assert toxicity.best_threshold(x, y, 0.4, n) == toxicity.best_threshold(np.repeat(x, n), np.repeat(y, n), 0.4)


def test_texts_without_a_label_are_left_out_before_texts_are_dealt(spark):
    for kind in ("long", "string"):
        rows = spark.range(20000).selectExpr(f"cast(id AS {kind}) AS _id", "'a b' AS _text").union(spark.createDataFrame([(None, "x")], f"_id {kind}, _text string"))
        kinds = spark.range(0, 40000, 7).selectExpr(f"cast(id AS {kind}) AS _id", "0 AS _toxic")
        found = [r[0] for r in toxicity.marked(rows, kinds).select("_id").collect()]
        wanted = {r[0] for r in rows.join(kinds, "_id").select("_id").collect()}
        assert wanted <= set(found) and len(found) <= len(wanted) + 40


def test_few_texts_deal_few_rows(spark):
    """Each of many tasks deals what its own texts changed, not all embeddings (8 MB and more a task before)."""
    rng = random.Random(4)
    texts = [(i, " ".join("".join(rng.choice("klmno") for _ in range(4)) for _ in range(8)), i % 2) for i in range(80)]
    parts = [np.concatenate(list(toxicity.word_parts(t))) for _, t, _ in texts]
    first = toxicity.train([(p, bool(y), "aa") for p, (_, _, y) in zip(parts, texts, strict=True)], 0.5)
    own = pickle.loads(pickle.dumps(first))
    toxicity.descend(own, parts[:8], np.arange(8) % 2 == 1, {True: 1.0, False: 1.0}, np.arange(8))
    said = np.zeros(toxicity.BUCKETS + 1, np.int32)
    np.add.at(said, np.concatenate([p[:, :2].ravel() for p in parts[:8]]), 1)
    rows = toxicity.changes(own, first, {"aa": said})
    known = np.unique(np.concatenate(parts[:8]))
    assert first.languages == ["aa"] and set(rows["at"][rows["at"] >= 0]) <= set(known[known >= 0])
    assert len(rows) <= len(known) + len(toxicity.flat(first)) and rows["l0"].sum() == said.sum()
    # one task gives its own model
    spread = spark.createDataFrame([(i, t, y, "aa") for i, (_, t, y) in enumerate(texts[:8])], "_at long, _text string, _toxic int, _lang string")
    order = sorted(range(8), key=lambda i: (i, texts[i][1]))
    again, alone = pickle.loads(pickle.dumps(first)), pickle.loads(pickle.dumps(first))
    weight = toxicity.balance(4, 4)
    toxicity.descend(alone, [parts[i] for i in order], np.array([texts[i][2] == 1 for i in order]), weight, np.arange(8))
    toxicity.gone_on(again, spread, 4, 4)
    assert np.abs(again.table[:-1] - alone.table[:-1]).max() < 1e-4 and np.abs(toxicity.flat(again) - toxicity.flat(alone)).max() < 1e-4
