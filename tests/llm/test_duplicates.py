import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from prodlake.llm import components, passages, simhash


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(300, 700)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(260)]
    links += [(7, 7), (101, 100), (160, 100), (-5, 9), (9, 12)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == classes(nodes, [p for p in links if p[0] != p[1]])
    assert components.components(df.limit(0)).count() == 0


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("name", ["small", "edge", "clashing"])
def test_near_duplicates(name, request):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    prints = sorted({p for _, p in rows})
    near = classes(prints, [(p, q) for p, q in itertools.combinations(prints, 2) if (p ^ q).bit_count() <= 4])
    least = {}
    for doc_id, p in rows:
        if doc_id is not None:
            least[near[p]] = min(doc_id, least.get(near[p], doc_id))
    want = sorted((-1 if d is None else d, f"{p:016x}", -1 if least.get(near[p]) is None else least[near[p]]) for d, p in rows)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_every_close_pair_is_linked(spark):
    """Dense balls, pairs at the limit and beyond it, in runs of any size."""
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(1500)}
    for _ in range(5):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(150)}
    for p in list(prints)[:400]:
        prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 5, 6]))))
    prints = np.array(sorted(prints), np.uint64)
    links = [(i, int(j) + i + 1) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4)]
    want = Counter(Counter(classes(range(len(prints)), links).values()).values())
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print bigint")
    for run in (512, 16):
        found = components.components(simhash.print_links(df, run=run)).toPandas()
        sizes = Counter(Counter(found["root"]).values())
        sizes[1] += len(prints) - len(found)
        assert sizes == want


def test_views_see_every_link():
    masks = simhash.view_masks()
    assert len(masks) == 15
    for bits in itertools.islice(itertools.combinations(range(64), 4), 0, None, 97):
        dirty = sum(1 << b for b in bits)
        assert any(not dirty & m for m in masks)


def test_gray_rank():
    codes = np.arange(64, dtype=np.uint64)
    codes ^= codes >> np.uint64(1)
    assert simhash.gray_rank(codes).tolist() == list(range(64))


def test_keep_one(small, none, clashing):
    kept = simhash.keep_one(small)
    assert kept.columns == small.columns
    want = {r.component_id for r in simhash.near_duplicates(small).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(clashing).columns == clashing.columns


def shingle_list(text):
    words = (text or "").encode().lower().split()
    return [tuple(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 50 else []


def share_passage(a, b, width=46):
    """Whether windows of 50 words that lie on a diagonal of equal shingles are similar."""
    at = defaultdict(list)
    for j, x in enumerate(b):
        at[x].append(j)
    for shift in {j - i for i, x in enumerate(a) for j in at.get(x, ())}:
        for i in range(max(0, -shift), min(len(a), len(b) - shift) - width + 1):
            x, y = set(a[i : i + width]), set(b[i + shift : i + shift + width])
            common = len(x & y)
            if common >= 0.8 * (len(x) + len(y) - common):
                return True
    return False


def passage_classes(rows):
    parts = {d: shingle_list(t) for d, t in rows}
    holds = defaultdict(set)
    for d, s in parts.items():
        for x in s:
            holds[x].add(d)
    common = Counter(p for v in holds.values() for p in itertools.combinations(sorted(v), 2))
    links = [p for p, n in common.items() if n >= 38 and share_passage(parts[p[0]], parts[p[1]])]
    return classes({x for p in links for x in p}, links)


def any_similar_windows(a, b, width=46):
    """Whether any two windows of two documents are similar, whatever their places."""

    def candidates(one, other):
        held, sets = set(other), {frozenset(one[i : i + width]) for i in range(len(one) - width + 1)}
        return [w for w in sets if len(w & held) >= 0.8 * len(w)]

    mine = candidates(a, b)
    its = candidates(b, a) if mine else []
    return any((n := len(x & y)) >= 0.8 * (len(x) + len(y) - n) for x in mine for y in its)


def test_recall_against_every_pair_of_windows(small):
    """No window is left out here, nor any document compared by a diagonal."""
    parts = {r.doc_id: shingle_list(r.text) for r in small.collect()}
    holds = defaultdict(set)
    for d, s in parts.items():
        for x in s:
            holds[x].add(d)
    near = {p for v in holds.values() for p in itertools.combinations(sorted(v), 2)}
    links = [p for p in near if any_similar_windows(parts[p[0]], parts[p[1]])]
    want = classes(parts, links)
    got = {r.doc_id: r.class_id for r in passages.document_classes(small).collect()}
    assert len(links) > 20
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    assert all(want[a] == want[b] for a, b in got.items())  # nothing is linked that is not similar


def test_passages_equal_brute_force(small):
    want = passage_classes([(r.doc_id, r.text) for r in small.collect()])
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(small).collect()}
    assert want.keys() <= got.keys() and len(got) <= 1.05 * len(want) + 2
    for a, b in itertools.combinations(want, 2):
        if want[a] == want[b]:
            assert got[a] == got[b]


def test_planted_passages(spark):
    rng = random.Random(6)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    passage, line = prose(51), prose(30)
    rows = []
    for i in range(300):
        words = prose(rng.randrange(60, 200))
        at = rng.randrange(len(words))
        if i % 3 == 0:  # a passage that a third of all documents hold, some with an edit
            held = [w.upper() for w in passage] if i % 2 else list(passage)
            if i % 9 == 0:
                held = held + prose(1)
            words[at:at] = held
        else:  # a line too short to be one
            words[at:at] = line
        rows.append((i, " ".join(words)))
    rows += [(300, rows[1][1]), (301, rows[1][1]), (302, " ".join(passage[:49])), (None, rows[0][1]), (303, None), (304, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert set(got) == {i for i in range(300) if i % 3 == 0} | {1, 300, 301}
    assert {got[i].class_id for i in range(0, 300, 3)} == {0}
    assert {got[i].class_id for i in (1, 300, 301)} == {1}
    for i in range(0, 300, 3):
        spans = [tuple(map(int, s.split(":"))) for s in got[i].spans.split(",")]
        start = next(k for k, w in enumerate(rows[i][1].lower().split()) if w == passage[0])
        assert any(a <= start and start + 51 <= b for a, b in spans)
        assert got[i].n_repeated_words == sum(b - a for a, b in spans)


def test_runs_equal_plain_windows():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 40, 400).astype(np.uint64)  # ties in plenty
    owner = np.repeat([0, 1, 2], [150, 30, 220])
    key, start, band = passages.signature_runs(values, owner)
    want = set()
    for b in range(passages.BANDS):
        minima = [passages._hashed(values, 2 * b + f) for f in (0, 1)]
        before = None
        for i in range(len(values) - 45):
            if owner[i] != owner[i + 45]:
                before = None
                continue
            now = (owner[i], minima[0][i : i + 46].min(), minima[1][i : i + 46].min())
            if now != before:
                want.add((b, i))
            before = now
    assert set(zip(band.tolist(), start.tolist(), strict=True)) == want


def test_edge_passages(edge, none, clashing):
    # the two rows of doc_id 5 are one document
    assert passages.repeated_passages(edge).count() == 0
    assert passages.repeated_passages(none).count() == 0
    assert passages.repeated_passages(clashing).count() == 0


def every_pair(a, b, width=46):
    """Whether any two windows of 50 words are similar."""
    right = [set(b[j : j + width]) for j in range(len(b) - width + 1)]
    for i in range(len(a) - width + 1):
        x = set(a[i : i + width])
        for y in right:
            common = len(x & y)
            if common >= 0.8 * (len(x) + len(y) - common):
                return True
    return False


def test_whole_runs_are_compared():
    """A word inserted in the middle of a passage of 50 leaves few similar pairs, none on a diagonal."""
    rng = random.Random(11)
    found = 0
    for _ in range(60):
        words = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (50, 60, 60, 60, 60)]
        passage, a, b, c, d = words
        at = rng.randrange(20, 30)
        left, right = " ".join(a + passage + b), " ".join(c + passage[:at] + ["new"] + passage[at:] + d)
        assert every_pair(shingle_list(left), shingle_list(right))
        sides = [passages.Shingled(t) for t in (left, right)]
        assert not any(len(passages._diagonal(sides[0].values, sides[1].values, shift)) for shift in (0, 1))
        runs = []
        for side in sides:
            key, start, band = passages.signature_runs(side.values, np.zeros(len(side.values), np.int64))
            runs.append(dict(zip(key.tolist(), zip(start.tolist(), band.tolist(), strict=True), strict=True)))
        seeds = [(x, runs[1][k][0], band) for k, (x, band) in runs[0].items() if k in runs[1]]
        if seeds:
            mine, its, good = passages.compare(*sides, seeds)
            assert any(good) and mine and its
            found += 1
    assert found > 30


def test_similar_windows_equal_brute_force():
    rng = random.Random(12)
    for _ in range(20):
        base = [f"w{rng.randrange(rng.choice([6, 10**6]))}" for _ in range(95)]
        other = list(base)
        for _ in range(rng.randrange(4)):
            other.insert(rng.randrange(95), "new")
        left, right = (passages.Shingled(" ".join(w)) for w in (base, other))
        got = passages.similar_windows(left, 0, right, 0)
        for i, j in itertools.product(range(got.shape[0]), range(got.shape[1])):
            x, y = set(left.values[i : i + 46].tolist()), set(right.values[j : j + 46].tolist())
            common = len(x & y)
            assert got[i, j] == (5 * common >= 4 * (len(x) + len(y) - common))


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def swapped(words, at):
    return words[:at] + ["swapped"] + words[at + 1 :]


def test_similar_windows_under_a_common_line(spark):
    """Pairs with an edit in each window of 50 words, in groups that a line of 40 words brings together."""
    rng = random.Random(21)
    line = prose(rng, 40)
    rows = [prose(rng, 60) + line + prose(rng, 60) for _ in range(100)]
    for _ in range(25):
        passage = line + prose(rng, 12)
        rows += [prose(rng, 60) + p + prose(rng, 60) for p in (passage, swapped(passage, 46))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(docs).collect()}
    assert got == {i: i - i % 2 for i in range(100, 150)}


def test_chains_of_edits_are_one_class(spark):
    """A~B and B~C but not A~C: the leader A of three is like B only."""
    rng = random.Random(22)
    rows = []
    for _ in range(40):
        a = prose(rng, 50)
        chain = [a, swapped(a, 12), swapped(swapped(a, 12), 37)]
        parts = [shingle_list(" ".join(p)) for p in chain]
        assert every_pair(parts[0], parts[1]) and every_pair(parts[1], parts[2]) and not every_pair(parts[0], parts[2])
        rows += [prose(rng, 60) + p + prose(rng, 60) for p in chain]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(docs).collect()}
    met = passages.shingles  # pairs that share no band cannot be linked
    runs = [{int(k) for k in passages.signature_runs(met(" ".join(w)), np.zeros(len(w) - 4, np.int64))[0]} for w in rows]
    links = [(i, j) for t in range(0, 120, 3) for i, j in ((t, t + 1), (t + 1, t + 2)) if runs[i] & runs[j]]
    assert len(links) >= 76
    assert got == classes({x for p in links for x in p}, links)


def test_all_windows_of_a_leader_are_compared(spark):
    """A line stands twice in the leading text; only at its second place a passage follows."""
    rng = random.Random(23)
    rows = []
    for _ in range(40):
        line = prose(rng, 40)
        passage = line + prose(rng, 12)
        rows.append(prose(rng, 60) + line + prose(rng, 60) + passage + prose(rng, 60))
        rows.append(prose(rng, 60) + swapped(passage, 46) + prose(rng, 60))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(docs).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_bands_miss_few_similar_windows():
    """Of windows at a similarity just over 0.8, 0.36 to the power of the bands share no key."""
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(3000):
        values = rng.integers(0, 1 << 63, 51).astype(np.uint64)
        keys = [set(passages.signature_runs(values[part], np.zeros(46, np.int64))[0].tolist()) for part in (slice(0, 46), slice(5, 51))]
        missed += not keys[0] & keys[1]
    assert missed <= 0.025 * 3000


def test_every_document_has_a_class(spark):
    rng = random.Random(24)
    passage = prose(rng, 60)
    rows = [(3, " ".join(passage)), (4, " ".join(prose(rng, 9) + passage)), (5, "alone"), (5, "alone"), (6, None), (None, " ".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links, r.spans) for r in passages.document_classes(docs).collect())
    assert got == [(3, 3, 1, "0:60"), (4, 3, 1, "9:69"), (5, 5, 0, ""), (6, 6, 0, "")]


def test_windows_are_ordered_as_by_a_sort_of_all_three_columns():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 5000):
        key = r.integers(0, 2**63, n).astype(np.uint64)
        key[: n // 2] = key[r.integers(0, max(n // 20, 1), n // 2)]
        doc, place = r.integers(0, 40, n), r.permutation(n)
        assert passages._order(key, doc, place).tolist() == np.lexsort((place, doc, key)).tolist()


def test_windows_of_a_reach_count_a_shingle_once():
    width = passages._WINDOW
    words = [f"w{i}" for i in range(90)]
    for text in (words, words[:60] * 3, words[:12] + ["x"] * 60 + words):
        side = passages.Shingled(" ".join(text))
        for start in range(0, len(side.values) - width + 1, 7):
            values, held = side.reach(start)
            assert values.tolist() == side.values[start : start + 2 * width - 1].tolist()
            for k, row in enumerate(held):
                window = values[k : k + width]
                assert row.sum() == len(set(window.tolist())) and set(values[row > 0].tolist()) == set(window.tolist())
        starts = np.arange(0, len(side.values) - width + 1, 5)
        hashed = passages._hashed(side.values, 2)
        assert side.anchors(starts, 1).tolist() == [s + int(hashed[s : s + width].argmin()) for s in starts.tolist()]


def test_words_are_hashed_as_one_by_one():
    """All words of a text at once, of every length, beside the library's hash of each."""
    rng = random.Random(25)
    texts = [None, "", " \n", " ".join("x" * n for n in range(1, 80))]
    for _ in range(40):
        made = ["".join(rng.choice("aZé日9\x1c\x85") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(120))]
        texts.append(rng.choice(["", " ", "\n\n"]) + rng.choice(["\t", " ", "\x0b\x0c"]).join(made) + rng.choice(["", "\r\n"]))
    for text, got in zip(texts, passages.all_shingles(texts), strict=True):
        words = (text or "").encode().lower().split()
        of_word = np.array([xxh64_intdigest(w) for w in words], np.uint64)
        want = np.zeros(max(len(words) - 4, 0), np.uint64)
        for k in range(5):
            want = (want ^ of_word[k : k + len(want)]) * passages._M2 + np.uint64(k)
        want = passages._mix(want) if len(words) >= 50 else want[:0]
        assert got.tolist() == want.tolist() == passages.shingles(text).tolist()


def open_patterns(spark, sets, shared):
    """The patterns of sets of shingles, each a class of its own; all of them are in ``shared`` order."""
    place = {s: i for i, s in enumerate(shared)}
    rows = []
    for i, (held, alone) in enumerate(sets):
        n = len(held) + alone
        reach = n - -(-4 * n // 5) + 1 - alone
        if reach > 0:
            rows.append((i, i, n, sorted(held), sorted(held, key=place.get)[:reach], i, i, i, i))
    return spark.createDataFrame(rows, "p bigint, q bigint, n int, shared array<bigint>, firsts array<bigint>, low bigint, high bigint, class_low bigint, class_high bigint")


def test_patterns_of_near_copies_meet_seldom(spark):
    """Windows of 400 near copies, an edit in each, and some of other sizes: few pairs that are not similar are made."""
    rng = random.Random(26)
    base = list(range(140))
    sets = []
    for _ in range(400):
        start, cut = rng.randrange(95), rng.randrange(42)
        sets.append((base[start : start + cut] + base[start + cut + 5 : start + 46], 5))
    for _ in range(40):
        start = rng.randrange(95)
        sets.append((rng.sample(base[start : start + 46], rng.randrange(36, 47)), rng.randrange(4)))
    kinds = open_patterns(spark, sets, rng.sample(range(140), 140))
    listed = kinds.selectExpr("p", "explode(firsts) shingle")
    before = listed.alias("a").join(listed.alias("b"), "shingle").filter("a.p < b.p").count()
    want = set()
    for (i, (a, x)), (j, (b, y)) in itertools.combinations(enumerate(sets), 2):
        common, m, n = len(set(a) & set(b)), len(a) + x, len(b) + y
        if common and 5 * common >= 4 * (m + n - common):
            want.add((i, j))
    pairs = passages._pattern_pairs(kinds).collect()
    got = {tuple(sorted((r.p, r.low))) for r in pairs}
    assert got == want and len(want) > 30
    assert passages._met(kinds).count() < before / 4


def test_further_links_join_classes(spark):
    rng = random.Random(27)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    found, more = edges[:35], edges[35:] + [(200, 201), (202, 3)]
    made = [spark.createDataFrame(e, "doc bigint, leader bigint") for e in (found, more)]
    got = {r.node: r.root for r in passages._merged_classes(passages._classes(made[0]), made[1]).collect()}
    links = [p for p in found + more if p[0] != p[1]]
    want = classes({x for p in links for x in p}, links)
    assert {d: got.get(d, d) for d in want} == want


def test_copies_are_compared_at_once():
    words = [f"w{i}" for i in range(70)]
    side = passages.Shingled(" ".join(words))
    assert passages.compare(side, side, [(0, 0, 1), (5, 5, 2)]) == ([(0, 70)], [(0, 70)], [True, True])
    other = passages.Shingled(" ".join(words))
    for seeds in ([], [(0, 0, 1), (5, 5, 2)], [(0, 20, 1)]):
        assert passages.compare(side, side, seeds) == passages.compare(side, other, seeds)
