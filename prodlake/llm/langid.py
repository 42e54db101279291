"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word's features are the hashes of its letters' two- and three-grams and of the whole word.  A document is
the average of its features' embeddings; a linear layer and a softmax give the languages.  Both
layers are trained by stochastic gradient descent in numpy on a bounded sample of labelled
documents: at most ``SAMPLE`` of them, spread evenly over the languages, each a vector of at most
``BUCKETS`` counts, whatever the size of the corpus.  A fifth of the sample is not trained on: it sets the
softmax temperature and the score below which a prediction is rejected.

Prediction is linear in the words, so tasks look up each distinct word of a batch once.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is everything
when there is no labelled document; a null lang is never learned from; a null doc_id counts as
held out; repeated rows get equal predictions; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .worker import per_worker

UNDETERMINED = "und"
SAMPLE = 2000  # labelled documents to learn from
BUCKETS = 1 << 14
DIMENSIONS = 16
EPOCHS = 8
RATE = 0.5
REJECTED = 0.01  # share of right calibration predictions that the threshold may reject
SEED = 11
BATCH = 1 << 23  # characters scored at a time


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return per_worker("letters", lambda: np.array([chr(c).isalpha() for c in range(0x110000)]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def features(chunks: Sequence[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of every chunk's letters, ends marked, and of its whole word; and
    the chunk that each belongs to.  A chunk without a letter has none.

    ``chunks`` hold no line end: it marks both ends of a word here, so all grams come from one
    array of code points.
    """
    text = "\n" + "\n".join(chunks).lower() + "\n"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    points = points[_letters()[points] | (points == 10)]
    mark = points == 10
    owner = np.cumsum(mark) - 1
    p, step = points.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
    two, three = ~(mark[:-1] & mark[1:]), ~mark[1:-1]
    found = [_mix(p[:-1] * step + p[1:])[two], _mix((p[:-2] * step + p[1:-1]) * step + p[2:])[three]]
    of = [owner[:-1][two], owner[:-2][three]]
    letter = np.flatnonzero(~mark)
    if len(letter):
        own = owner[letter]
        place = letter - np.flatnonzero(mark)[own]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        found.append(_mix(np.add.reduceat(_mix(p[letter] + place.astype(np.uint64) * step), first)))
        of.append(own[first])
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64), np.concatenate(of)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            chunks = [c.decode() for c in (text.as_py() or "").encode().split()]
            rows.append(np.unique(features(chunks)[0].astype(np.int32), return_counts=True))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32())),
            ],
            names=["lang", "buckets", "counts"],
        )


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language: embedding and linear layer in one
    bias: np.ndarray
    temperature: float
    threshold: float


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = SEED) -> Model:
    """Fit and calibrate on ``(lang, buckets, counts)`` rows."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist())
    known = {rows[i][0] for i in range(len(rows)) if i not in held}
    languages = [x for x in languages if x in known]
    place = {x: i for i, x in enumerate(languages)}
    embed = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    linear, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    learn = [i for i in range(len(rows)) if i not in held]
    total, done = EPOCHS * max(1, len(learn)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            lang, buckets, counts = rows[i]
            share = (counts / counts.sum())[:, None]
            hidden = (embed[buckets] * share).sum(axis=0)
            error = _softmax(hidden @ linear + bias)
            error[place[lang]] -= 1
            rate = RATE * (1 - done / total)
            back = linear @ error
            linear -= rate * np.outer(hidden, error)
            bias -= rate * error
            embed[buckets] -= rate * share * len(buckets) ** 0.5 * back
            done += 1
    weights = embed @ linear
    logits, truth = [], []
    for i in sorted(held):
        lang, buckets, counts = rows[i]
        if lang in place:
            logits.append((weights[buckets] * (counts / counts.sum())[:, None]).sum(axis=0) + bias)
            truth.append(place[lang])
    temperature, threshold = 1.0, 0.0
    if logits:
        z, y = np.array(logits), np.array(truth)
        tried = np.geomspace(0.05, 5, 40)
        loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in tried]
        temperature = float(tried[int(np.argmin(loss))])
        scores = _softmax(z / temperature)
        right = scores.argmax(axis=1) == y
        if right.any():
            threshold = float(np.quantile(scores.max(axis=1)[right], REJECTED))
    return Model(languages, weights, bias, temperature, threshold)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model:
    """Train on a sample of the labelled documents that are not held out.

    Rows are drawn by a hash of doc_id, with a rate per language that makes the sample about
    even, so reruns draw the same rows.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    each = sample / max(1, len(sizes))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(rate)
    drawn = known.filter(draw < rate).select("lang", "text").mapInArrow(_counts, "lang string, buckets array<int>, counts array<float>")
    rows = drawn.limit(2 * sample).toArrow().to_pylist()
    rows = [(r["lang"], np.array(r["buckets"], np.int64), np.array(r["counts"], np.float32)) for r in rows]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tolist(), r[2].tolist()))
    return train(rows, seed)


def score(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Place of each text's language (-1: none) and its score.

    Every distinct word of the batch is looked up once; documents add up their words.
    """
    chunks = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
    bounds = chunks.offsets.to_numpy()
    coded = chunks.values.dictionary_encode()
    buckets, of = features(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    words, n = len(coded.dictionary), len(texts)
    held = np.bincount(of, minlength=words)
    place, doc = coded.indices.to_numpy(), np.repeat(np.arange(n), np.diff(bounds))
    total = np.bincount(doc, weights=held[place], minlength=n)
    best, scores = np.full(n, -1), np.zeros(n)
    known = total > 0
    if model.languages and known.any():
        sums = [np.bincount(of, weights=w[buckets], minlength=words) for w in model.weights.T]
        logits = np.stack([np.bincount(doc, weights=s[place], minlength=n) for s in sums], axis=1)
        chances = _softmax((logits[known] / total[known, None] + model.bias) / model.temperature)
        best[known], scores[known] = chances.argmax(axis=1), np.minimum(chances.max(axis=1), 1.0)
    return best, scores


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], object)  # -1 is the last one
        for batch in batches:
            held, size, parts = [], 0, []
            texts = batch.column(2).to_pylist()
            for i, text in enumerate(texts):
                held.append(text)
                size += len(text or "")
                if size >= BATCH or i == len(texts) - 1:
                    parts.append(score(model, held))
                    held, size = [], 0
            if not parts:
                continue
            best, scores = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(names[best], pa.string()),
                    pa.array(scores), pa.array((scores < model.threshold) | (scores == 0)),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every whole text."""
    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(
        _predict(model or learn(docs)), "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"
    )
