import collections
import re

import numpy as np
import pytest

from prodlake.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
    )


def counted(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words


def test_statistics_equal_brute_force(small, edge):
    for docs in (small, edge):
        texts = {(r.doc_id, r.text) for r in docs.collect()}
        want = collections.Counter((d, statistics(t)) for d, t in texts)
        got = {(r.doc_id, counted(r)) for r in outliers.text_statistics(docs).collect()}
        assert got == set(want)


def test_repeats_overlap(spark):
    texts = ["a b c d e " * 3, "a a a a a a", "a b c d e f a b c d e g", "x\ny\nx\n\n \nx", "a b c d"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n bigint")
    got = {r.doc_id: counted(r) for r in outliers.text_statistics(docs).collect()}
    assert got == {i: statistics(t) for i, t in enumerate(texts)}


def test_base_rule(edge):
    for row in outliers.judge(edge).collect():
        assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words)
        assert not (row.base_failed and row.kept)
        if not row.base_failed:
            assert row.kept  # too few rows for an estimate reject nothing


def test_rejects_outliers_and_keeps_the_bulk(spark):
    rng = np.random.default_rng(3)
    words = ["stone", "river", "light", "on", "the", "of", "cloud", "a", "green", "walking"]
    rows = []
    for i in range(400):
        text = " ".join(f"{words[k]}{j % 89}" for j, k in enumerate(rng.integers(0, 10, rng.integers(30, 300))))
        if i % 10 == 0:
            text = " ".join(f"{w}$$$" for w in text.split())
        rows.append((i, text, "en" if i % 2 else None, "s" if i % 4 else None, 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n bigint")
    kept = {r.doc_id for r in outliers.judge(docs).filter("kept").collect()}
    assert kept == {i for i in range(400) if i % 10}
    again = {r.doc_id for r in outliers.keep_inliers(docs).collect()}
    assert again == kept


def test_determinant_beats_that_of_all_rows(spark):
    """A third of the rows far away: the estimate describes the others."""
    rng = np.random.default_rng(5)
    near, far = rng.normal(0, 100, (400, 5)), rng.normal(2000, 100, (200, 5))
    values = np.concatenate([near, far]).round().astype(int).tolist()
    vectors = spark.createDataFrame([(7, *v) for v in values], "gid bigint, " + ", ".join(f"{s} bigint" for s in outliers.STATS))
    (fit,) = outliers.estimates(vectors).collect()
    assert np.abs(np.array(fit.m)).max() < 0.05
    spread = np.array(fit.l)[[k for k, (i, j) in enumerate(outliers.PAIRS) if i == j]] * fit.scale**0.5
    assert (spread > 0.08).all() and (spread < 0.2).all()


def test_chi_square():
    assert outliers.chi_square(0.0, 5) == pytest.approx(4.351, rel=0.01)
    assert outliers.chi_square(1.96, 5) == pytest.approx(12.833, rel=0.01)
    assert outliers.chi_square(4.265, 5) == pytest.approx(30.856, rel=0.04)  # far out the approximation is a little wide


def test_empty_and_clashing(none, clashing):
    assert outliers.judge(none).count() == 0
    kept = outliers.keep_inliers(clashing)
    assert kept.columns == clashing.columns
    assert sorted(0 if r.doc_id is None else r.doc_id for r in kept.collect()) == [0, 5, 5, 6, 7]


def test_no_python(edge):
    plan = outliers.text_statistics(edge)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
