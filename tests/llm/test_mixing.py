import re

import numpy as np
import pytest

from prodlake.llm import mixing


def want_targets(sizes):
    """The contract in plain Python: reshare what lies over the limit until none does."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("name", ["small", "edge"])
def test_contract(name, request):
    docs = request.getfixturevalue(name)
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    target = want_targets(sizes)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"]) for r in mixed) == sorted((-1 if r.doc_id is None else r.doc_id, words(r.text)) for r in rows)
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, mixing.mix(docs).collect())) if name == "small" else True


def test_sources_come_near_their_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "a " * int(n), f"s{0 if i % 3 else i % 5}") for i, n in enumerate(rng.lognormal(3, 1, 3000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix(docs, block=256).toPandas()
    for _, of in mixed.groupby("source"):
        target = of["target"].iloc[0]
        assert abs(of["taken"].sum() - target) < 0.01 * target + 60


@pytest.mark.parametrize("n", [1, 2, 3, 10, 500])
def test_flight_keeps_both_totals(n):
    rng = np.random.default_rng(n)
    size, part = np.sort(rng.integers(1, 5000, n).astype(float))[::-1].copy(), np.full(n, 0.3)
    mixing.fly(part, size, rng)
    assert ((part > 0) & (part < 1)).sum() <= 2
    assert part.sum() == pytest.approx(0.3 * n) and part @ size == pytest.approx(0.3 * size.sum())
    mixing.land(part, rng)
    assert set(part) <= {0.0, 1.0} and abs(part.sum() - 0.3 * n) <= 1


def test_flight_keeps_expectations():
    size = np.array([900.0, 50, 40, 30, 20, 10, 10, 5])
    taken = np.zeros(8)
    for seed in range(2000):
        part, rng = np.full(8, 0.4), np.random.default_rng(seed)
        mixing.fly(part, size, rng)
        mixing.land(part, rng)
        taken += part
    assert np.abs(taken / 2000 - 0.4).max() < 0.05


def test_documents_repeat(small):
    mixed = {r.doc_id: r.copies for r in mixing.mix(small).collect()}
    out = mixing.mix_documents(small)
    assert out.columns == small.columns
    found = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert found == {d: c for d, c in mixed.items() if c}


def test_empty_and_clashing(none, clashing):
    assert mixing.mix(none).count() == 0 and mixing.mix_documents(none).count() == 0
    assert mixing.mix(clashing).count() == clashing.count()
    out = mixing.mix_documents(clashing)
    assert out.columns == clashing.columns
    assert out.count() == mixing.mix(clashing).agg({"copies": "sum"}).first()[0]
