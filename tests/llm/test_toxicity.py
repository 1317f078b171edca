"""The toxicity classifier: its parts against plain versions, and held-out labels."""

import random
import zlib

import numpy as np
import pytest
from conftest import DATA

from posora.llm import toxicity
from posora.llm.queries import QUERIES
from posora.llm.shared import mixed

SCHEMA = "doc_id long, text string, lang string, toxic int, score double, predicted int, _id int, parts string, at int"
REST = (0.0, 1, 2, "p", 3)


def plain_parts(text):
    """Buckets of each word's parts, byte by byte."""
    rows, word = [], b""
    for c in text.lower().encode() + b" ":
        if c >= 128 or 97 <= c <= 122:
            word += bytes([c])
        elif word:
            row = []
            for k, part in enumerate((word, *(word[:n] if len(word) >= n else None for n in toxicity.HEADS), word[-toxicity.TAIL :] if len(word) >= toxicity.TAIL else None)):
                h = sum(b * pow(int(toxicity._P), i, 1 << 64) for i, b in enumerate(part or b"")) + (k + 1) * int(toxicity._P)
                row.append(-1 if part is None else int(mixed(np.array([h % (1 << 64)], np.uint64))[0]) >> 46)
            rows.append(row)
            word = b""
    return rows


def test_parts_equal_plain_version(monkeypatch):
    text = "Ein löwe, it's A b-c 12x\nwortlang " + "ab" * 30 + " ende"
    assert np.concatenate(list(toxicity.word_parts(text))).tolist() == plain_parts(text)
    assert list(toxicity.word_parts(None)) == list(toxicity.word_parts("")) == list(toxicity.word_parts(" 12 ?!")) == []
    long = " ".join(random.Random(1).choice(["idiot", "haus", "öl", "a"]) for _ in range(20_000))
    assert np.concatenate(list(toxicity.word_parts(long))).tolist() == plain_parts(long)
    assert np.concatenate(list(toxicity.word_parts("x" * 200_000))).shape[1] == toxicity.PARTS


def made(rng, n):
    """Texts with an inflected bad word in half of them, in two languages."""
    out = []
    for i in range(n):
        lang, toxic = rng.choice(["aa", "bb"]), i % 2
        words = [lang + "".join(rng.choice("klmno") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(3, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), ("grumpel" if lang == "aa" else "zwackig") + rng.choice(["", "s", "en", "ung"]))
        out.append((" ".join(words), toxic, lang))
    return out


@pytest.fixture(scope="module")
def model():
    samples = [(np.concatenate(list(toxicity.word_parts(t))), bool(y), lang) for t, y, lang in made(random.Random(2), 600)]
    return toxicity.train(samples, 0.5)


def test_model_learns_words_by_language(model):
    held = made(random.Random(3), 300)
    right = [(model.score(t) >= 0.5) == bool(y) for t, y, _ in held]
    assert np.mean(right) > 0.97
    assert model.languages == ["aa", "bb"] and set(model.thresholds) == {"aa", "bb"}
    assert np.mean([model.judge(t)[1] == lang for t, _, lang in held]) > 0.97


def test_scores_equal_a_plain_version_at_every_slice_size(model, monkeypatch):
    text = " ".join(t for t, _, _ in made(random.Random(4), 40))
    parts = plain_parts(text)
    x = [sum(model.table[p].astype(float) for p in row) for row in parts] + [np.zeros(toxicity.SIZE)] * 2
    pooled = []
    for k, width in enumerate(toxicity.WIDTHS):
        each = [sum(x[i + j] @ model.filters[k][j].astype(float) for j in range(width)) for i in range(len(parts))]
        pooled += list(np.max(each, 0))
    logit = np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.last
    assert abs(model.judge(text)[0] - logit) < 1e-3
    whole = model.judge(text)
    for size in (64, 200, 1000):
        monkeypatch.setattr(toxicity, "SLICE", size)
        assert abs(model.judge(text)[0] - whole[0]) < 1e-3 and model.judge(text)[1] == whole[1]


def test_threshold_parts_the_kinds_with_least_error():
    rng = random.Random(5)
    for _ in range(50):
        x = np.array([rng.randint(0, 20) / 2 for _ in range(12)])
        y = np.array([rng.random() < 0.4 for _ in x])
        if 0 < y.sum() < len(y):
            cost = lambda t: 0.3 * (y & (x < t)).sum() / y.sum() + 0.7 * (~y & (x >= t)).sum() / (~y).sum()  # noqa: B023, E731
            t = toxicity.best_threshold(x, y, 0.3)
            assert t not in x
            assert cost(t) <= min(cost(v) for v in [*x, -1, 99]) + 1e-9


def test_query_on_held_out_labels(spark):
    sf = f"{DATA}/sf0.01"
    df = QUERIES["op13_toxicity"](spark, sf)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(rows[x.doc_id].predicted, x.toxic) for x in labels if x.doc_id in rows and rows[x.doc_id].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def test_odd_tables(spark):
    def run(rows, labels):
        docs = spark.createDataFrame([(*r, *REST) for r in rows], SCHEMA.replace("toxic int, ", ""))
        marks = spark.createDataFrame(labels, "doc_id long, toxic int")
        return [tuple(r) for r in toxicity.scored(docs, toxicity.fit(docs, marks)).collect()]

    assert run([], []) == []
    texts = [(1, None, "en"), (2, "", None), (3, "bad bad", "en"), (3, "bad bad", "en"), (None, "good " * 20_000, "en"), (5, "good", "en"), (6, "x" * 200_000, None)]
    assert run(texts, []) == [(r[0], 0.0, 0) for r in texts]
    assert run(texts, [(3, 1), (5, None), (5, 7), (None, 0)]) == [(r[0], 1.0, 1) for r in texts]
    out = run(texts, [(3, 1), (3, 0), (5, 0), (1, 0)])
    assert len(out) == len(texts) and all(0 <= r[1] <= 1 and r[2] == (r[1] >= 0.5) for r in out)
    assert out[0][1:] == out[1][1:] and out[2] == out[3]
