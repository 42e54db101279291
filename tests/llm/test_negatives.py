import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prodlake.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, positives=5, most=3):
    """Every anchor against every row."""
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for a, va, la in (r for r in kept if r[0] % 50 == 0):
        scored = [(-sum(x * y for x, y in zip(va, v, strict=False)), i, label) for i, v, label in kept if i != a]
        for p, i, _ in sorted((s for s in scored if s[2] == la))[:positives]:
            inside = sorted(s for s in scored if s[2] != la and 50 * -p <= 100 * -s[0] <= 95 * -p)[:most]
            out += [(a, i, rank, s[1], -p, -s[0]) for rank, s in enumerate(inside, 1)]
    return sorted(out)


def made(seed, n, dims, labels, grid=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice(grid)) if grid else (lambda: rng.gauss(0, 0.3))
    return [(i, [value() for _ in range(dims)], rng.choice(labels)) for i in range(n)]


EDGE = [
    (None, [1.0, 1.0], 1), (0, [1.0, 2.0], 1), (50, [1.0, None], 1), (100, None, 1), (150, [1.0, float("nan")], 1), (200, [float("inf"), 1.0], 1),
    (250, [1.0, 1.0], None), (300, [], 1), (350, [0.0, 0.0], 2), (1, [1.0], 1), (2, [1.0, 2.0, 3.0], 1), (3, [0.5, 1.5], 2), (3, [0.5, 1.5], 2),
    (4, [0.7, 1.3], 3), (5, [-1.0, -2.0], 1), (400, [-1.0, 0.5], 2), (0, [1.0, 2.0], 1), (6, [0.9, 1.5], 2),
]


@pytest.mark.parametrize(
    "rows",
    [
        made(1, 500, 16, range(10)),
        made(2, 300, 3, [1, 1, 1, 2], grid=[-0.5, 0.0, 0.25, 0.5]),  # ties everywhere, one label holds most
        made(3, 120, 2, [7]),  # no other label
        made(4, 130, 5, range(100)),  # few or no positives
        EDGE,
    ],
)
@pytest.mark.parametrize("block", [4096, 64])
def test_equals_brute_force(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS block", "1 AS score", "2 AS rank", "3 AS anchor_id")
    got = negatives.hard_negatives(df, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_nothing(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 300), st.sampled_from([0.2, 2.0, 3e3, 1e38]))
def test_a_walk_stops_with_the_best(seed, n, spread):
    rng = np.random.default_rng(seed)
    vectors = negatives.scaled(list(np.clip(rng.normal(0, spread, (n, 6)), -3e38, 3e38)))
    ids = rng.permutation(n).astype(np.int64)
    lists = np.argsort(vectors, axis=0, kind="stable").T.astype(np.uint16)
    block = negatives.Block(6, ids.tobytes(), (ids % 3).tobytes(), vectors.tobytes(), lists.tobytes())
    anchor = vectors[0] * (rng.random(6) < 0.7)
    scores = vectors.astype(object) @ anchor.astype(object)
    order = sorted(range(n), key=lambda i: (-scores[i], ids[i]))
    kind = negatives._kind(block, anchor)
    got = negatives.best(block.all(), -1, anchor, kind, 4)
    assert got[0].tolist() == [ids[i] for i in order[:4]] and got[1].tolist() == [scores[i] for i in order[:4]]
    windows = [negatives.window(int(abs(scores[i]))) for i in order[:2]]
    for (low, high), (found, _) in zip(windows, negatives.in_windows(block.all(), 1, anchor, kind, windows, 3), strict=True):
        assert found.tolist() == [ids[i] for i in order if low <= scores[i] <= high and ids[i] % 3 != 1][:3]


def test_a_walk_stops_early():
    """With one strong component the lists need not be read to their ends."""
    vectors = np.zeros((4000, 8), np.int32)
    vectors[:, 0] = np.arange(4000)
    ids = np.arange(4000)
    block = negatives.Block(8, ids.tobytes(), (ids % 2).tobytes(), vectors.tobytes(), np.argsort(vectors, axis=0, kind="stable").T.astype(np.uint16).tobytes())
    walk = iter(negatives.Walk(block.all(), vectors[10], np.float64))
    new, scores, threshold = next(walk)
    assert len(new) == 32 and threshold == 10 * 3968
    assert negatives.best(block.all(), -1, vectors[10], np.float64, 5)[0].tolist() == [3999, 3998, 3997, 3996, 3995]
