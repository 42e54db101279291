import random
import zlib

import pytest

from prodlake.llm import decontaminate, langid

BENCHMARK = "item_id bigint, text string"


def distance_in(item, text):
    """Smallest edit distance of ``item`` to any part of ``text``, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[-1] + 1))
    return min(row)


def test_myers_equals_the_table():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 200)))
        best, end = decontaminate.myers(decontaminate.masks(item), len(item), text)
        assert best == distance_in(item, text)
        assert distance_in(item, text[:end]) == best


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyz ")
        elif kind == 1:
            chars.insert(at, rng.choice("xyz "))
        else:
            del chars[at]
    return "".join(chars)


def test_finds_what_brute_force_finds():
    rng = random.Random(5)
    words = ["the", "cat", "sat", "on", "mat", "dog", "ran", "far"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 30)))) for i in range(15)]
    items += [(90, items[0][1].upper()), (91, "short one"), (92, None), (93, "")]
    matcher = decontaminate.Matcher([i for i in items if i[1] is not None])
    for _ in range(150):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 20)))]
        for _ in range(rng.randrange(0, 3)):
            parts += [edited(rng, rng.choice(items[:15])[1], rng.randrange(0, 9)), " ".join(rng.choice(words) for _ in range(9))]
        text = decontaminate.normalize(" ".join(parts))
        want = {}
        for i, item in items:
            plain = decontaminate.normalize(item)
            if len(plain) >= decontaminate.SHORTEST and (d := distance_in(plain, text)) <= len(plain) // decontaminate.PER_EDIT:
                want[i] = d
        got = matcher.find(text)
        assert {g[0]: g[1] for g in got} == want
        for i, d, start, end, n in got:
            assert 0 <= start < end <= len(text) and n >= 1
            assert distance_in(decontaminate.normalize(dict(items)[i]), text[start:end]) == d


def test_distance_is_the_smallest_of_repetitive_items():
    rng = random.Random(8)
    for _ in range(400):
        unit = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 6)))
        item = decontaminate.normalize((unit * 60)[: rng.randrange(30, 120)])
        if len(item) < decontaminate.SHORTEST:
            continue
        parts = [edited(rng, item, rng.randrange(0, 7)) for _ in range(rng.randrange(1, 4))]
        text = decontaminate.normalize("".join(parts) if rng.random() < 0.5 else " xyz ".join(parts))
        best = distance_in(item, text)
        got = decontaminate.Matcher([(1, item)]).find(text)
        assert [(g[0], g[1]) for g in got] == ([(1, best)] if best <= len(item) // decontaminate.PER_EDIT else [])
        for _, d, start, end, _ in got:
            assert distance_in(item, text[start:end]) == d


def test_items_without_an_id(spark, edge):
    item = "Rows that repeat are units  of their OWN, whatever is in them, and"
    benchmark = spark.createDataFrame([(None, item), (1, item), (None, item)], BENCHMARK)
    got = [(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(edge, benchmark).collect()]
    assert sorted(got, key=repr) == [(5, 1, 0)] * 2 + [(5, None, 0)] * 4
    assert decontaminate.drop_leaks(edge, benchmark).count() == 9


def test_given_leaks(spark, small):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, decontaminate.normalize(r.text)) for r in benchmark.collect()]
    want = {(r.doc_id, i) for r in small.collect() for i, t in items if t in decontaminate.normalize(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(small, benchmark).collect()}
    assert want and want <= got
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(small, benchmark, block=500).collect()} == got
    kept = decontaminate.drop_leaks(small, benchmark)
    assert kept.columns == small.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in small.collect()} - {d for d, _ in got}


def test_leaks_of_edge_rows(spark, edge, none, clashing):
    item = "Rows that repeat are units  of their OWN, whatever is in them, and"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item)], BENCHMARK)
    for docs in (edge, clashing):
        got = sorted(((r.doc_id, r.item_id or -1, r.distance) for r in decontaminate.leaks(docs, benchmark.fillna(7)).collect()), key=repr)
        assert got == [(5, 1, 0), (5, 1, 0), (5, 7, 0), (5, 7, 0)]
        assert decontaminate.drop_leaks(docs, benchmark.filter("item_id = 1")).count() == 9
    assert decontaminate.leaks(none, benchmark.fillna(7)).count() == 0
    assert decontaminate.leaks(edge, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(edge, benchmark.limit(0)).count() == edge.count()


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) < 0.05 * len(got)


def test_learns_from_no_held_out_row(spark):
    rows = [(i, "aaa bbb", "good" if zlib.crc32(str(i).encode()) % 5 else "bad") for i in range(200)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["good"]


def test_languages_of_edge_rows(edge, none, clashing):
    for docs in (edge, clashing):
        got = {(-1 if r.doc_id is None else r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs).collect()}
        for doc_id in (1, 2, 3, 8):
            assert (doc_id, "und", 0.0) in got
        assert {p for d, p, _ in got if d not in (1, 2, 3, 8)} <= {"en", "fr", "xx"}
    assert langid.identify(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_samples(n):
    import numpy as np

    rows = [("en", np.array([1, 2]), np.array([1.0, 2.0], np.float32))] * n
    model = langid.train(rows)
    assert model.languages == (["en"] if n else [])


def test_short_items_are_searched_exactly(spark):
    docs = spark.createDataFrame(
        [(1, "Well, who wrote Hamlet? Nobody asked."), (2, "who wrote hamlets"), (3, "WHO  WROTE\nHAMLET"), (4, "who wrote hamlat"), (5, "wwho wrote hamlet"), (6, "It is 3+4 = 7."), (7, "13+4"), (8, None)],
        "doc_id bigint, text string",
    )
    benchmark = spark.createDataFrame([(1, "Who wrote Hamlet"), (2, "3+4"), (3, "= 7."), (4, " "), (5, None)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.start, r.end) for r in decontaminate.leaks(docs, benchmark).collect())
    assert got == [(1, 1, 0, 6, 22), (3, 1, 0, 0, 16), (6, 2, 0, 6, 9), (6, 3, 0, 10, 14)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, benchmark).collect()) == [2, 4, 5, 7, 8]
