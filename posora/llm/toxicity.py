"""Toxicity by a convolutional text classifier.

A word's vector is the sum of hashed embeddings of the word, of its beginnings
and of its end, so that inflected and compound words meet. Filters over one, two
and three words, a maximum over the whole text for each and a logistic layer
give a text's logit. Training starts in numpy, in one task, from a bounded sample of
labelled texts (SAMPLE); then every labelled text is learnt from: each task goes on from
that start over its share of them, and what the tasks changed is averaged. A part of all
labelled texts is kept back to set the logit from which a text counts as toxic, for each
language by itself; the language is told from the text by its words, counted in all
texts that aren't kept back. Scores are such that every threshold lies at 0.5.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, mixed, slices

#: Embeddings, their length, words of a filter and filters of each width.
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 16
#: Lengths of a word's beginnings and of its end, in bytes; with the word itself the parts that a vector sums up.
HEADS, TAIL = (3, 4, 5, 6), 4
PARTS = len(HEADS) + 2
#: The bounded sample of the start: so many toxic and other texts, none of more than LONGEST words; what follows has no such bounds.
SAMPLE, LONGEST = (2000, 4000), 4096
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.05, 1e-5
#: One text of each kind in so many is kept back for thresholds; a language needs so many of them, of both kinds, for one of its own.
BACK, LEAST = 4, 40
#: Texts that a task goes on with; units of a change and of a logit, so that sums don't depend on their order.
SHARE, UNIT, GRID = 1 << 13, 1 << 18, 256
#: Bits of the marks by which texts without a label are left out before texts are dealt; 2^19 words of 64 bits at most.
MARKS = 25
#: Bytes and words of a text that are worked on at a time.
SLICE, SPAN = 1 << 16, 4096

_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_KINDS = np.arange(1, PARTS + 1, dtype=np.uint64) * _P
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * SLICE, _P, np.uint64)]))
_BACK = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * SLICE, np.uint64(pow(int(_P), -1, 1 << 64)), np.uint64)]))


def word_parts(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the parts of all words, a row of PARTS for each word (-1: the word is shorter), slice by slice."""
    if not text:
        return
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > SLICE:
            gap = raw.rfind(b" ", at, at + SLICE)
            end = gap + 1 if gap >= 0 else at + SLICE  # a word of more bytes is cut
        own = _parts(raw[at:end])
        if len(own):
            yield own
        at = end


def _parts(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    inner = np.concatenate([[False], b != 32, [False]])
    turn = np.flatnonzero(inner[1:] != inner[:-1])
    start, end = turn[::2], turn[1::2]
    # sums of b[i] * P^i: the difference over a stretch, moved back to its start, is the stretch's hash
    sums = np.concatenate([[np.uint64(0)], np.cumsum(b * _POWERS[: len(b)])])
    length = end - start
    out = np.full((len(start), PARTS), -1, np.int32)
    for k, n in enumerate((0, *HEADS, -TAIL)):
        has = length >= abs(n) if n else length > 0
        s, e = start[has], end[has]
        s, e = (s, e) if not n else (s, s + n) if n > 0 else (e + n, e)
        h = (sums[e] - sums[s]) * _BACK[s]
        out[has, k] = (mixed(h + _KINDS[k]) >> np.uint64(46)).astype(np.int32)
    return out


@dataclass
class TextModel:
    """Embeddings (the last row is that of a missing part), filters, the logistic layer, word scores of languages and thresholds."""

    table: np.ndarray
    filters: list[np.ndarray]  # for each width: width x SIZE x FILTERS
    bias: np.ndarray
    out: np.ndarray
    last: float
    languages: list[str] = field(default_factory=list)
    speech: np.ndarray | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    sure: float = 1.0
    constant: float | None = None
    squares: dict | None = None  # sums of squared gradients, while the model is fitted

    def vectors(self, parts: np.ndarray) -> np.ndarray:
        """A row for each word, and rows of zeros so that the widest filter fits everywhere."""
        x = np.zeros((len(parts) + max(WIDTHS) - 1, SIZE), np.float32)
        for k in range(PARTS):
            x[: len(parts)] += self.table[parts[:, k]]
        return x

    def responses(self, x: np.ndarray) -> np.ndarray:
        """What each filter gives at each word."""
        n = len(x) - max(WIDTHS) + 1
        return np.concatenate([sum(x[j : j + n] @ w[j] for j in range(len(w))) for w in self.filters], 1)

    def strongest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each filter gives at most and the word where it does first, slice by slice; zeros without words."""
        every = np.arange(len(self.bias))
        most, spot = np.zeros(len(every), np.float32), np.zeros(len(every), np.int64)
        for at in range(0, len(parts), SPAN):
            r = self.responses(self.vectors(parts[at : at + SPAN + max(WIDTHS) - 1]))[:SPAN]
            own = r.argmax(0)
            better = (r[own, every] > most) | (at == 0)
            most, spot = np.where(better, r[own, every], most), np.where(better, own + at, spot)
        return most, spot

    def pooled(self, most: np.ndarray) -> np.ndarray:
        return np.maximum(most + self.bias, 0)

    def judge(self, text: str | None) -> tuple[float, str | None]:
        """(logit, language) of a whole text; a long one goes by slices that overlap by what a filter spans."""
        most = np.zeros(len(self.bias), np.float32) - 1e9
        said, carry = np.zeros(len(self.languages)), np.empty((0, PARTS), np.int32)
        seen = False
        for parts in word_parts(text):
            seen = True
            if self.speech is not None:
                said += self.speech[parts[:, 0]].sum(0) + self.speech[parts[:, 1]].sum(0)
            # the last words wait for those after them: a filter must not see an end that is none
            parts, own = np.concatenate([carry, parts]), max(WIDTHS) - 1
            carry = parts[-own:]
            if len(parts) > own:
                most = np.maximum(most, self.responses(self.vectors(parts))[:-own].max(0))
        most = np.maximum(most, self.responses(self.vectors(carry)).max(0)) if seen else np.zeros_like(most)
        return float(self.pooled(most) @ self.out + self.last), self.languages[int(said.argmax())] if seen and self.languages else None

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        logit, lang = self.judge(text)
        return float(1 / (1 + np.exp(-np.clip(self.sure * (logit - self.thresholds.get(lang, self.threshold)), -30, 30))))


def best_threshold(logits: np.ndarray, toxic: np.ndarray, prior: float, counts: np.ndarray | None = None) -> float:
    """The logit in the middle of the gap that parts the kinds with the least error, toxic texts being a share ``prior``; ``counts`` says how many texts an entry stands for."""
    order = np.argsort(logits, kind="stable")
    n = np.ones(len(logits), np.int64) if counts is None else counts[order]
    x, bad, good = logits[order], np.where(toxic[order], n, 0), np.where(toxic[order], 0, n)
    missed = np.concatenate([[0], np.cumsum(bad)]) / max(1, bad.sum()) * prior
    false = (good.sum() - np.concatenate([[0], np.cumsum(good)])) / max(1, good.sum()) * (1 - prior)
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    width = np.concatenate([[1.0], x[1:] - x[:-1], [1.0]])
    cost = np.where(width > 0, missed + false, np.inf)  # equal logits stay together
    return float(edges[max(np.flatnonzero(cost <= cost.min() + 1e-12), key=lambda i: width[i])])


def train(samples: list[tuple[np.ndarray, bool, str | None]], prior: float, every: int = BACK) -> TextModel:
    """Fit a model to (parts of words, toxic, language), one in ``every`` kept back for thresholds (0: none); what the order of samples doesn't fix is seeded."""
    rng = np.random.default_rng(11)
    turn = [[i for i, s in enumerate(samples) if s[1] == kind] for kind in (False, True)]
    kept_back = {i for own in turn for i in (own[every - 1 :: every] if every else ())}
    back = [s for i, s in enumerate(samples) if i in kept_back]
    own = [s for i, s in enumerate(samples) if i not in kept_back]
    kinds = np.array([s[1] for s in own])
    f = FILTERS * len(WIDTHS)
    table = np.zeros((BUCKETS + 1, SIZE), np.float32)
    table[:BUCKETS] = rng.normal(0, 0.02, (BUCKETS, SIZE))
    # the first dimension starts from how much oftener a part stands in toxic texts
    seen = np.zeros((2, BUCKETS))
    for parts, toxic, _ in own:
        seen[int(toxic), np.unique(parts[parts >= 0])] += 1
    ratio = np.log((seen[1] + 1) / (kinds.sum() + 2)) - np.log((seen[0] + 1) / ((~kinds).sum() + 2))
    both = seen.sum(0)
    table[:BUCKETS, 0] = ratio * both / (both + 10) / 4
    filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, : FILTERS // 2] = np.abs(w[:, 0, : FILTERS // 2]) + 0.3
    model = TextModel(table, filters, np.zeros(f, np.float32), rng.normal(0, 0.1, f).astype(np.float32), 0.0)
    model.out[np.arange(f) % FILTERS < FILTERS // 2] += 0.2
    model.squares = {"table": np.zeros(BUCKETS + 1, np.float32), "filters": [np.zeros_like(w) for w in filters], "bias": np.zeros(f), "out": np.zeros(f), "last": 0.0}
    weight = balance(int(kinds.sum()), int((~kinds).sum()))
    for _ in range(EPOCHS):
        descend(model, [x[0] for x in own], kinds, weight, rng.permutation(len(own)))
    model.table[BUCKETS] = 0
    learn_languages(model, own)
    calibrate(model, back if len({s[1] for s in back}) == 2 else samples, prior)
    return model


def balance(toxic: int, others: int) -> dict[bool, float]:
    """Weights of the texts of each kind, so that both kinds count alike."""
    return {True: 0.5 / max(1, toxic) * (toxic + others), False: 0.5 / max(1, others) * (toxic + others)}


def descend(model: TextModel, texts: list[np.ndarray], kinds: np.ndarray, weight: dict[bool, float], order: np.ndarray) -> None:
    """One pass of the model over the texts, BATCH at a time in this order."""
    f, squares = len(model.bias), model.squares

    def step(value, grad, square):
        square += grad * grad
        value -= RATE * (grad / np.sqrt(square + 1e-6)).astype(np.float32) + RATE * DECAY * value

    for at in np.split(order, range(BATCH, len(order), BATCH)):
        most, spots = zip(*(model.strongest(texts[i]) for i in at), strict=True)
        raw = np.stack(most) + model.bias
        hidden = np.maximum(raw, 0)
        y = kinds[at]
        error = (1 / (1 + np.exp(-(hidden @ model.out + model.last))) - y) * np.where(y, weight[True], weight[False]) / len(at)
        back_to = (error[:, None] * model.out) * (raw > 0)
        grads = [np.zeros_like(w) for w in model.filters]
        rows, moves = [], []
        for i, g, spot in zip(at, back_to, spots, strict=True):
            parts = texts[i]
            if not len(parts):
                continue
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                live = np.flatnonzero(g[cols])
                for j in range(w):
                    place = spot[cols][live] + j
                    gl = g[cols][live]
                    inside = place < len(parts)
                    here = parts[place[inside]]
                    grads[k][j][:, live[inside]] += (model.vectors(here)[: len(here)] * gl[inside][:, None]).T
                    rows.append(here)
                    moves.append(model.filters[k][j][:, live[inside]].T * gl[inside][:, None])
        step(model.out, hidden.T @ error, squares["out"])
        step(model.bias, back_to.sum(0), squares["bias"])
        g = float(error.sum())
        squares["last"] += g * g
        model.last -= RATE * g / np.sqrt(squares["last"] + 1e-6)
        for k in range(len(WIDTHS)):
            step(model.filters[k], grads[k], squares["filters"][k])
        if rows:
            ids = np.concatenate(rows).ravel()
            move = np.repeat(np.concatenate(moves), PARTS, 0)[ids >= 0]
            ids, where = np.unique(ids[ids >= 0], return_inverse=True)
            total = np.zeros((len(ids), SIZE), np.float32)
            np.add.at(total, where, move)
            squares["table"][ids] += (total * total).mean(1)
            model.table[ids] -= RATE * total / np.sqrt(squares["table"][ids] + 1e-6)[:, None]


def flat(model: TextModel) -> np.ndarray:
    """All that tasks change but the embeddings, end to end."""
    return np.concatenate([*(w.ravel() for w in model.filters), model.bias, model.out, [model.last]])


def gone_on(model: TextModel, learnt: DataFrame, toxic: int, others: int) -> None:
    """Let ``model`` learn from every row of ``learnt`` (_at, _text, _toxic, _lang), SHARE texts a task, and average what the tasks change.

    An embedding is averaged over the tasks that met its part, all else over all tasks. Words of languages are counted on the way.
    """
    sc = learnt.sparkSession.sparkContext
    names = [r["_lang"] for r in learnt.filter("_lang IS NOT NULL").groupBy("_lang").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).collect()]
    model.languages = sorted(names)
    start, weight, tasks = sc.broadcast(model), balance(toxic, others), -(-(toxic + others) // SHARE)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = start.value
        own = pickle.loads(pickle.dumps(first))
        said = {lang: np.zeros(BUCKETS + 1, np.int32) for lang in own.languages}
        some = False
        for pdf in slices(batches):
            texts = [np.concatenate(p) if (p := list(word_parts(t))) else np.empty((0, PARTS), np.int32) for t in pdf["_text"]]
            descend(own, texts, pdf["_toxic"].to_numpy() == 1, weight, np.arange(len(texts)))
            for parts, lang in zip(texts, pdf["_lang"], strict=True):
                col = parts[:, :2].ravel()
                if lang in said:
                    np.add.at(said[lang], col[col >= 0], 1)
            some = some or len(texts) > 0
        if some:
            yield changes(own, first, said)

    told = [*(f"d{k}" for k in range(SIZE)), *(f"l{k}" for k in range(len(model.languages)))]
    made = learnt.repartition(tasks, "_at").sortWithinPartitions("_at", "_text").mapInPandas(learn, ", ".join(f"{c} int" for c in ("at", "met", *told)))
    # a row for each part that was met, BUCKETS at most, and one for each number of all else
    total = made.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("met", *told))).toArrow()
    start.unpersist()
    if not total.num_rows:
        return
    at, met, *sums = (total[c].to_numpy() for c in ("at", "met", *told))
    inside = at >= 0
    moved = np.stack(sums[:SIZE], 1)[inside]
    model.table[at[inside]] += moved / np.float32(UNIT) / np.maximum(met[inside], 1)[:, None].astype(np.float32)
    model.table[BUCKETS] = 0
    rest = flat(model)
    rest[-1 - at[~inside]] += sums[0][~inside] / UNIT / met[~inside]
    rest, place = rest.astype(np.float32), 0
    for w in (*model.filters, model.bias, model.out):
        w[...] = rest[place : place + w.size].reshape(w.shape)
        place += w.size
    model.last = float(rest[place])
    if model.languages:
        counts = np.zeros((BUCKETS + 1, len(model.languages)))
        counts[at[inside]] = np.stack(sums[SIZE:], 1)[inside]
        tell_apart(model, counts)


def changes(own: TextModel, first: TextModel, said: dict[str, np.ndarray]) -> pd.DataFrame:
    """What a task changed from ``first``: a row (at, met, d0.., l0..) for each part of words that its texts met, so
    that few texts give few rows, and a row for each number of all else, at -1 and below."""

    def change(after: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.rint(np.clip(after - before, -2, 2) * UNIT).astype(np.int32)

    met = own.squares["table"] != first.squares["table"]
    at = np.flatnonzero(np.any([met, *(said[lang] != 0 for lang in own.languages)], 0))
    moved, rest = change(own.table[at], first.table[at]), change(flat(own), flat(first))
    langs = [said[lang][at] for lang in own.languages]
    parts = pd.DataFrame({"at": at.astype(np.int32), "met": met[at].astype(np.int32), **{f"d{k}": moved[:, k] for k in range(SIZE)}, **{f"l{k}": x for k, x in enumerate(langs)}})
    others = pd.DataFrame(0, np.arange(len(rest)), parts.columns, np.int32).assign(at=-1 - np.arange(len(rest), dtype=np.int32), met=np.int32(1), d0=rest)
    return pd.concat([parts, others])


def learn_languages(model: TextModel, samples: list[tuple[np.ndarray, bool, str | None]]) -> None:
    """Word scores that tell languages apart, by log shares of words and of their beginnings."""
    names = [s[2] for s in samples if s[2] is not None and len(s[0])]
    model.languages = sorted(n for n in set(names) if names.count(n) >= LEAST)
    if not model.languages:
        return
    counts = np.zeros((BUCKETS + 1, len(model.languages)))
    for parts, _, lang in samples:
        if lang in model.languages and len(parts):
            col = parts[:, :2].ravel()
            counts[:, model.languages.index(lang)] += np.bincount(col[col >= 0], minlength=BUCKETS + 1)
    tell_apart(model, counts)


def tell_apart(model: TextModel, counts: np.ndarray) -> None:
    """Word scores from how often each language's texts hold a word; a column for each of the model's languages."""
    model.speech = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * BUCKETS)).astype(np.float32)
    model.speech -= model.speech.mean(1, keepdims=True)
    model.speech[BUCKETS] = 0


def calibrate(model: TextModel, samples: list[tuple[np.ndarray, bool, str | None]], prior: float) -> None:
    found = []
    for parts, toxic, _ in samples:
        most = model.responses(model.vectors(parts)).max(0) if len(parts) else np.zeros(len(model.bias), np.float32)
        lang = None
        if model.languages and len(parts):
            lang = model.languages[int((model.speech[parts[:, 0]].sum(0) + model.speech[parts[:, 1]].sum(0)).argmax())]
        found.append((float(model.pooled(most) @ model.out + model.last), toxic, lang))
    set_thresholds(model, np.array([x[0] for x in found]), np.array([x[1] for x in found]), [x[2] for x in found], np.ones(len(found), np.int64), prior)


def set_thresholds(model: TextModel, logits: np.ndarray, toxic: np.ndarray, langs: list[str | None], counts: np.ndarray, prior: float) -> None:
    """Thresholds of the model from logits, each of ``counts`` texts of a kind and a language."""
    model.threshold, model.thresholds = best_threshold(logits, toxic, prior, counts), {}
    for lang in model.languages:
        own = np.array([x == lang for x in langs])
        if counts[own].sum() >= LEAST and 0 < counts[own][toxic[own]].sum() < counts[own].sum():
            model.thresholds[lang] = best_threshold(logits[own], toxic[own], prior, counts[own])
    spread = np.abs(logits - np.array([model.thresholds.get(x, model.threshold) for x in langs]))
    order = np.argsort(spread, kind="stable")
    model.sure = float(3 / max(1e-3, spread[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)]))


def judged_whole(model: TextModel, back: DataFrame, prior: float) -> None:
    """Thresholds from every row of ``back``: its logits on a grid, counted by kind and language."""
    shared = back.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shared.value.judge(t) for t in pdf["_text"]]
            yield pd.DataFrame({"at": [int(np.rint(np.clip(x, -64, 64) * GRID)) for x, _ in found], "toxic": pdf["_toxic"].to_numpy() == 1, "lang": [lang for _, lang in found]})

    cells = back.select("_text", "_toxic").mapInPandas(judge, "at int, toxic boolean, lang string").groupBy("at", "toxic", "lang").agg(F.count("*").alias("n")).orderBy("at", "toxic", "lang").collect()
    set_thresholds(model, np.array([c["at"] / GRID for c in cells]), np.array([c["toxic"] for c in cells]), [c["lang"] for c in cells], np.array([c["n"] for c in cells]), prior)


def marked(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Those ``rows`` whose _id has the mark of one of ``kinds``: all that have a label and few others.

    Marks are of a bounded size whatever the number of labels, so only texts that have one are dealt when they meet it.
    """
    at = F.xxhash64("_id", F.lit(3)).bitwiseAND((1 << MARKS) - 1)
    bit = F.expr("shiftleft(1L, cast(_at & 63 AS int))")
    words = kinds.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    out = rows.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word")
    return out.filter(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", sample: tuple[int, int] = SAMPLE) -> TextModel:
    """Learn from all texts that have a label, starting from ``sample`` of them (toxic, others), chosen by the hash of their ids.

    Labels are 0 or 1, others and null ids are left out; an id with both is toxic.
    Texts of over LONGEST words are no part of the start. With labels of
    one kind, or none, every score is that kind.
    """
    spark = docs.sparkSession
    kinds = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic"))
    counts = {r["_toxic"]: r["n"] for r in kinds.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    blank = TextModel(np.zeros((1, SIZE), np.float32), [], np.zeros(0), np.zeros(0), 0.0, constant=float(1 in counts and 0 not in counts))
    if len(counts) < 2:
        return blank
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("_lang"))
    if docs.schema[id_col].dataType == labels.schema[id_col].dataType:
        rows = marked(rows, kinds)
    scratch = Scratch(spark)
    known = scratch.save(rows.hint("merge").join(kinds, "_id").select("_id", F.xxhash64("_id", F.lit(1)).alias("_at"), "_text", "_toxic", "_lang"))
    scratch.release()

    def numbers(df: DataFrame) -> dict[int, int]:
        return {r["_toxic"]: r["n"] for r in df.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}

    kept = F.pmod("_at", F.lit(BACK)) == BACK - 1
    learnt, back = known.filter(~kept), known.filter(kept)
    own = numbers(learnt)
    if len(own) < 2:
        learnt, own = known, numbers(known)
    if len(own) < 2:
        return blank
    if len(numbers(back)) < 2:
        back = known
    ids = learnt.select("_id", "_toxic").distinct()
    picked = [ids.filter(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample[1 - k]).select("_id") for k in (1, 0)]
    chosen = learnt.join(F.broadcast(picked[0].union(picked[1])), "_id", "left_semi")  # sum(sample) ids at most

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [list(word_parts(t)) for t in pdf["_text"]]
            whole = [np.concatenate(p) if p else np.empty((0, PARTS), np.int32) for p in found]
            keep = [len(p) <= LONGEST for p in whole]
            yield pd.DataFrame({"at": pdf["_at"][keep], "parts": [p.tobytes() for p, k in zip(whole, keep, strict=True) if k], "toxic": pdf["_toxic"][keep] == 1, "lang": pdf["_lang"][keep]})

    coded = chosen.mapInPandas(encode, "at long, parts binary, toxic boolean, lang string")
    prior = counts[1] / (counts[0] + counts[1])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        samples = [(np.frombuffer(p, np.int32).reshape(-1, PARTS), bool(t), lang) for pdf in batches for p, t, lang in zip(pdf["parts"], pdf["toxic"], pdf["lang"], strict=True)]
        if len({s[1] for s in samples}) == 2:
            yield pd.DataFrame({"model": [pickle.dumps(train(samples, prior, 0))]})

    # one task makes the start, whatever the input
    made = coded.repartition(1).sortWithinPartitions("at", "parts").mapInPandas(learn, "model binary").collect()
    if not made:
        return blank
    model = pickle.loads(made[0]["model"])
    gone_on(model, learnt, own[1], own[0])
    model.squares = None
    judged_whole(model, back, prior)
    scratch.drop(known)
    return model


def scored(docs: DataFrame, model: TextModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, score (0 to 1) and predicted of each row, from the text alone; null and empty texts get the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = pdf.drop(columns="_text")
            out["score"] = np.array([m.score(t) for t in pdf["_text"]], float)
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            yield out

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInPandas(score, schema + ", score double, predicted int")
