"""Near-duplicate passages by compact windows.

The tokens are shingles of five words.  For one hash function the node of a Cartesian tree over
the hashed shingles is a compact window: all subsequences that hold its minimum and stay
inside it share that min-hash.  Of these the ones of ``LENGTH`` words are a run of starts, and a
document has only about two runs per ``LENGTH`` words.  A sliding minimum lists the same runs
without building the tree.  Joining the runs of two hash functions by interval gives the windows that
share both; three such bands make signature groups of every passage.

Windows of equal signature meet by key.  The one of the smallest doc_id leads its group and the
others are compared with it first, so a group whose members are all like the leader costs as many
comparisons as it has members.  A group in which one fails (a text shorter than ``LENGTH`` brought
it together, or the leader is only like some) stays open with all its members, and so does one in
which the leading document has more windows than its first.  Open windows that hold the same
shingles of those that several classes share, among as many in all, are one pattern.  Patterns meet
again by a prefix filter that misses no similar pair: each is listed under the few of its shingles
that are rarest among the open ones, and two patterns that are listed under the same shingle are
compared there, once for all documents that hold them.  Windows of one key are combined in the map
tasks, so a passage that a third of all documents hold sends one window per batch.  A pair is
verified on its texts, or on whole patterns: the shingle sets of two windows of ``LENGTH`` words have a
Jaccard similarity of ``SIMILARITY`` or more.

Defined cases: null, empty and short texts hold no passage; ASCII letters compare in lower case;
repeats inside one document do not count; rows without a doc_id are not compared, rows with the
same doc_id are one document; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stored
from .components import components

SHINGLE = 5  # words
LENGTH = 50  # words of the shortest passage
SIMILARITY = 0.8
BANDS = 4  # pairs of hash functions
CHUNK = 1 << 19  # shingles hashed at a time
PAIRS = 16  # whose texts are cut into shingles together

_WINDOW = LENGTH - SHINGLE + 1  # shingles
_STEP = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# which of the places of a reach lie in each of its windows
_INSIDE = np.triu(np.ones((_WINDOW, 2 * _WINDOW - 1), np.float32)) * np.tril(np.ones((_WINDOW, 2 * _WINDOW - 1), np.float32), _WINDOW - 1)


def _hashed(shingles: np.ndarray, function: int) -> np.ndarray:
    return _mix(shingles + np.uint64(_STEP * (function + 1) % (1 << 64)))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
BYTES = 1 << 18  # of texts whose words are hashed at a time


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 of words given as stretches of ``raw``; all words of up to 31 bytes go step by step together."""
    from xxhash import xxh64_intdigest

    h = sizes.astype(np.uint64) + _P5

    def taken(which: np.ndarray, offset: np.ndarray | int, width: int) -> np.ndarray:
        at = (starts + offset)[which][:, None] + np.arange(width)
        return raw[at].view(f"<u{width}").ravel().astype(np.uint64)

    short = sizes < 32
    for k in range(3):
        which = np.flatnonzero(short & (sizes >= 8 * k + 8))
        part = _turned(taken(which, 8 * k, 8) * _P2, 31) * _P1
        h[which] = _turned(h[which] ^ part, 27) * _P1 + _P4
    which = np.flatnonzero(short & (sizes & 4 > 0))
    h[which] = _turned(h[which] ^ taken(which, sizes & ~7, 4) * _P1, 23) * _P2 + _P3
    for k in range(3):
        which = np.flatnonzero(short & (sizes & 3 > k))
        h[which] = _turned(h[which] ^ taken(which, (sizes & ~3) + k, 1) * _P5, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxh64_intdigest(raw[starts[i] : starts[i] + sizes[i]].tobytes())
    return h


def _shingles_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", np.uint8)
    blank = _BLANK[raw]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    of_word = _word_hashes(raw, starts, np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - starts)
    n = max(len(of_word) - SHINGLE + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ of_word[k : k + n]) * _M2 + np.uint64(k)
    out = _mix(out)
    last = np.searchsorted(starts, ends)
    for a, b in zip(np.concatenate([[0], last[:-1]]).tolist(), last.tolist(), strict=True):
        yield out[a : b - SHINGLE + 1] if b - a >= LENGTH else np.empty(0, np.uint64)


def all_shingles(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """A 64-bit hash of every five words in a row of each text; white space and letter case do not count."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= BYTES:
            yield from _shingles_of(held)
            held, size = [], 0
    if held:
        yield from _shingles_of(held)


def shingles(text: str | None) -> np.ndarray:
    return next(all_shingles([text]))


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, from those of half as many."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def signature_runs(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, start, band`` of each run of windows that share both minima of a band.

    ``owner`` names the document of each shingle; no window reaches over two of them.
    """
    n = len(values) - _WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    whole = owner[:n] == owner[_WINDOW - 1 :]
    fresh = np.concatenate([[True], (owner[1:n] != owner[: n - 1]) | ~whole[:-1]])
    keys, starts, bands = [], [], []
    for band in range(BANDS):
        first, second = (_sliding_minimum(_hashed(values, 2 * band + f), _WINDOW) for f in (0, 1))
        turn = fresh.copy()
        turn[1:] |= (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(turn & whole)
        keys.append(_signature(first[at], second[at], band))
        starts.append(at)
        bands.append(np.full(len(at), band, np.int64))
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(bands)


def _signature(first: np.ndarray, second: np.ndarray, band: int) -> np.ndarray:
    return _mix(_mix(first + np.uint64(band)) ^ second)


# a window is a document and a place: its first shingle * 8 + its band
WINDOWS = "key bigint, doc bigint, place bigint, leader bigint, leader_place bigint"
_NAMES = ["key", "doc", "place", "leader", "leader_place"]


def _rows(key, doc, place, leader=None, leader_place=None) -> pa.RecordBatch:
    none = pa.nulls(len(key), pa.int64())
    columns = [pa.array(np.asarray(c).view(np.int64)) if c is not None else none for c in (key, doc, place, leader, leader_place)]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _led(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by key and document: the first row of each row's key, which rows are of other
    documents than that row's, and which are linked to it: these, and in a key that has some, the
    further rows of its own document."""
    n = len(key)
    new = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.empty(0, bool)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.empty(0, np.int64)
    other = doc != doc[lead]
    met = np.zeros(n, bool)
    met[lead[other]] = True
    return lead, other, met[lead] & (lead != np.arange(n))


def _order(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The order by key, document and place; few keys repeat, and only these rows are compared further."""
    order = np.argsort(key)
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]]) if len(key) else np.empty(0, bool)
    at = np.flatnonzero(~new | np.concatenate([~new[1:], [False]])) if len(key) else np.empty(0, np.int64)
    tied = order[at]
    order[at] = tied[np.lexsort((place[tied], doc[tied], np.cumsum(new)[at]))]
    return order


def _combined(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Link windows of one key to the first of them; only its document goes on to meet others."""
    order = _order(key, doc, place)
    key, doc, place = key[order], doc[order], place[order]
    lead, other, linked = _led(key, doc, place)
    yield _rows(key[~other], doc[~other], place[~other])
    if linked.any():
        led = lead[linked]
        yield _rows(key[linked], doc[linked], place[linked], doc[led], place[led])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def signed(docs: list[int], bases: list[int], parts: list[np.ndarray]):
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        key, at, band = signature_runs(np.concatenate(parts), owner)
        own = owner[at]
        offset = np.cumsum([0, *[len(p) for p in parts]])[own]
        return key, np.array(docs, np.int64)[own], (at - offset + np.array(bases, np.int64)[own]) * 8 + band

    def pieces(batch: pa.RecordBatch):
        """Shingles of whole texts; a text longer than a chunk in overlapping parts."""
        docs, bases, parts, held = [], [], [], 0
        for doc, values in zip(batch.column(0).to_pylist(), all_shingles(x.as_py() for x in batch.column(1)), strict=True):
            for base in range(0, max(len(values) - _WINDOW + 1, 0), CHUNK):
                part = values[base : base + CHUNK + _WINDOW - 1]
                docs.append(doc), bases.append(base), parts.append(part)
                held += len(part)
                if held >= CHUNK:
                    yield docs, bases, parts
                    docs, bases, parts, held = [], [], [], 0
        if parts:
            yield docs, bases, parts

    for batch in batches:
        found = [signed(*p) for p in pieces(batch)]
        if not found:
            continue
        yield from _combined(*(np.concatenate(c) for c in zip(*found, strict=True)))


# the group is a hash of the key in fewer bytes; groups that share one are looked at together
LINKS = "group int, doc bigint, place bigint, leader bigint, leader_place bigint"


def _links(key, doc, place, leader, leader_place) -> pa.RecordBatch:
    columns = [key.view(np.uint64).astype(np.uint32).view(np.int32), doc, place, leader, leader_place]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["group", *_NAMES[1:]])


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link each window to the leader of its key; rows come sorted by key, document and place."""
    last: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        columns = [batch.column(c) for c in range(5)]
        linked = columns[3].is_valid().to_numpy(zero_copy_only=False)
        if linked.any():
            yield _links(*(c.filter(pa.array(linked)).to_numpy(zero_copy_only=False) for c in columns))
        key, doc, place = (c.to_numpy(zero_copy_only=False)[~linked] for c in columns[:3])
        if last is not None:  # the leading document of the last key may lead here too
            key, doc, place = (np.concatenate([x, y]) for x, y in zip(last, (key, doc, place), strict=True))
        if not len(key):
            continue
        lead, other, linked = _led(key, doc, place)
        ahead = (lead == lead[-1]) & ~other
        last = tuple(c[ahead] for c in (key, doc, place))
        if linked.any():
            led = lead[linked]
            yield _links(key[linked], doc[linked], place[linked], doc[led], place[led])


def _diagonal(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Starts of the windows of ``left`` that have enough shingles in common with the window of
    ``right`` that lies ``shift`` further on, shingle by shingle."""
    a, b = max(0, -shift), min(len(left), len(right) - shift)
    if b - a < _WINDOW:
        return np.empty(0, np.int64)
    same = np.concatenate([[0], np.cumsum(left[a:b] == right[a + shift : b + shift])])
    common = same[_WINDOW:] - same[:-_WINDOW]
    return a + np.flatnonzero(common >= SIMILARITY * (2 * _WINDOW - common))


def similar_windows(left: Shingled, x: int, right: Shingled, y: int) -> np.ndarray:
    """Whether the shingle sets of two windows are similar, for every window of ``left`` that starts
    in the ``_WINDOW`` places from ``x`` and every one of ``right`` from ``y``."""
    a, first = left.reach(x)
    b, its_first = right.reach(y)
    same = (a[:, None] == b).astype(np.float32)
    sizes, its_sizes = first.sum(axis=1), its_first.sum(axis=1)
    # windows with too few shingles anywhere in the other reach need no look at its windows
    if not (first @ same.max(axis=1) >= SIMILARITY * sizes).any() or not (its_first @ same.max(axis=0) >= SIMILARITY * its_sizes).any():
        return np.zeros((len(first), len(its_first)), bool)
    common = first @ same @ its_first.T  # each window holds a shingle once
    return common >= SIMILARITY * (sizes[:, None] + its_sizes - common) - 1e-4


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Shingled:
    """A document's shingles and, once asked for, the place of each band's first minimum."""

    def __init__(self, text: str | None, values: np.ndarray | None = None) -> None:
        self.values = shingles(text) if values is None else values
        self._hashed: dict[int, np.ndarray] = {}
        self._before: np.ndarray | None = None

    @property
    def before(self) -> np.ndarray:
        """The place where each shingle stood last, or -1."""
        if self._before is None:
            order = np.argsort(self.values, kind="stable")
            again = self.values[order[1:]] == self.values[order[:-1]]
            self._before = np.full(len(self.values), -1, np.int64)
            self._before[order[1:][again]] = order[:-1][again]
        return self._before

    def reach(self, start: int) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of the windows that start in the ``_WINDOW`` places from ``start``, and for
        each window (rows) which of them it holds, repeats counted once."""
        values = self.values[start : start + 2 * _WINDOW - 1]
        inside = _INSIDE[: len(values) - _WINDOW + 1, : len(values)]
        before = self.before[start : start + len(values)]
        if before.max() < start:
            return values, inside
        window = np.arange(len(inside))[:, None]
        return values, inside * (before < window + start)

    def anchors(self, starts: np.ndarray, band: int) -> np.ndarray:
        if band not in self._hashed:
            self._hashed[band] = _hashed(self.values, 2 * band)
        return starts + self._hashed[band][starts[:, None] + np.arange(_WINDOW)].argmin(axis=1)


def compare(left: Shingled, right: Shingled, seeds: list[tuple[int, int, int]]):
    """Verify seeds ``(place, right place, band)`` between two documents.

    Returns the words of ``left`` and of ``right`` in similar windows, and per seed whether it is
    in one.  Windows are compared along the diagonal of a seed's minimum; where that has none, as
    with words inserted or left out, every window of the one run with every window of the other.
    """
    spans: tuple[list, list] = ([], [])
    good_ones = np.zeros(len(seeds), bool)
    at, other, bands = np.array(seeds, np.int64).reshape(-1, 3).T
    if seeds and left is right and (at == other).all():  # copies
        whole = [(0, len(left.values) + SHINGLE - 1)]
        return whole, whole, [True] * len(seeds)
    i, j = np.empty_like(at), np.empty_like(at)
    for band in np.unique(bands).tolist():
        own = bands == band
        i[own], j[own] = left.anchors(at[own], band), right.anchors(other[own], band)
    for shift in np.unique(j - i).tolist():
        starts = _diagonal(left.values, right.values, shift)
        if len(starts):
            cut = np.flatnonzero(np.diff(starts) > 1)
            for x, y in zip(starts[[0, *(cut + 1)]].tolist(), starts[[*cut, -1]].tolist(), strict=True):
                spans[0].append((x, y + LENGTH))
                spans[1].append((x + shift, y + shift + LENGTH))
            own = np.flatnonzero(j - i == shift)
            near = starts.searchsorted(i[own] - _WINDOW, side="right")
            good_ones[own] = (near < len(starts)) & (starts[np.minimum(near, len(starts) - 1)] <= i[own])
    for seed in np.flatnonzero(~good_ones).tolist():
        x, y = seeds[seed][:2]
        alike = similar_windows(left, x, right, y)
        if alike.any():
            good_ones[seed] = True
            spans[0].extend((x + k, x + k + LENGTH) for k in np.flatnonzero(alike.any(axis=1)).tolist())
            spans[1].extend((y + k, y + k + LENGTH) for k in np.flatnonzero(alike.any(axis=0)).tolist())
    return merged(spans[0]), merged(spans[1]), good_ones.tolist()


_SPANS = "array<struct<start:bigint,end:bigint>>"
VERIFIED = f"doc bigint, leader bigint, spans {_SPANS}, leader_spans {_SPANS}, failed array<int>"


class _Cut:
    """The shingles of the texts met last."""

    def __init__(self) -> None:
        self._held: dict[str, Shingled] = {}

    def __call__(self, texts: list[str]) -> list[Shingled]:
        new = [t for t in dict.fromkeys(texts) if t not in self._held]
        if len(self._held) + len(new) > PAIRS * 4:
            self._held.clear()
            new = list(dict.fromkeys(texts))
        for text, values in zip(new, all_shingles(new), strict=True):
            self._held[text] = Shingled(text, values)
        return [self._held[t] for t in texts]


def _verified_batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    spans = [[[{"start": x, "end": y} for x, y in one] for one in c] for c in columns[2:4]]
    types = (pa.int64(), pa.int64(), span, span, pa.list_(pa.int32()))
    arrays = [pa.array(c, t) for c, t in zip((*columns[:2], *spans, columns[4]), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "leader", "spans", "leader_spans", "failed"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similar windows of a document and a leader, and the groups in which they have none."""
    cut = _Cut()
    for batch in batches:
        rows = []
        offsets = batch.column(4).offsets.to_numpy()
        groups, places, led = (batch.column(4).values.field(n).to_numpy(zero_copy_only=False) for n in ("group", "place", "leader_place"))
        for i, (doc, leader) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if i % PAIRS == 0:
                near = [batch.column(c)[i : i + PAIRS].to_pylist() for c in (2, 3)]
                near = [cut(near[0] + near[1])[k :: len(near[0])] for k in range(len(near[0]))]
            sides = near[i % PAIRS]
            own = slice(offsets[i], offsets[i + 1])
            # of rows with the same doc_id, only the ones that are long enough can hold the window
            fits = (places[own] // 8 + _WINDOW <= len(sides[0].values)) & (led[own] // 8 + _WINDOW <= len(sides[1].values))
            group, place, other = (x[own][fits].tolist() for x in (groups, places, led))
            mine, its, good = compare(*sides, [(p // 8, q // 8, p % 8) for p, q in zip(place, other, strict=True)])
            rows.append((doc, leader, mine, its, sorted({g for g, ok in zip(group, good, strict=True) if not ok})))
        yield _verified_batch(rows)


def _beside(pairs: DataFrame, docs: DataFrame, seeds: str) -> DataFrame:
    """Pairs of documents with both texts."""
    # the same names in both joins, so that the texts are shuffled by doc_id once
    text = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    whole = pairs.join(text, F.col("doc") == F.col("_id")).select("doc", "leader", seeds, F.col("_text").alias("text"))
    return whole.join(text, F.col("leader") == F.col("_id")).select("doc", "leader", "text", F.col("_text").alias("leader_text"), seeds)


def _reach(n: int, places: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` places lie in the ``width`` ones from one of ``places``."""
    turns = np.zeros(n + 1, np.int64)
    places = places[places < n]
    np.add.at(turns, places, 1)
    np.add.at(turns, np.minimum(places + width, n), -1)
    return np.cumsum(turns[:n]) > 0


def _places(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    offsets = batch.column(column).offsets.to_numpy()
    places = batch.column(column).values.to_numpy(zero_copy_only=False)
    return (places[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


HELD = "shingle bigint, doc bigint"


def _held_batch(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    owner = np.repeat(np.array([d for d, _ in found], np.int64), [len(x) for _, x in found])
    values = np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(owner)], names=["shingle", "doc"])


def _open_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of a document's open windows."""
    for batch in batches:
        found = []
        for doc, places, values in zip(batch.column(0).to_pylist(), _places(batch, 1), all_shingles(x.as_py() for x in batch.column(2)), strict=True):
            found.append((doc, np.unique(values[_reach(len(values), places, 2 * _WINDOW - 1)]).view(np.int64)))
        yield _held_batch(found)


PATTERNS = "p bigint, q bigint, doc bigint, class bigint, starts array<bigint>, n int, shared array<bigint>, firsts array<bigint>"


def patterns(side: Shingled, starts: np.ndarray, shared: np.ndarray, n_docs: np.ndarray, known: set[tuple[int, int]]):
    """What the windows at ``starts`` have in common with other classes: by the 128-bit name of a
    pattern its windows, its number of shingles, and unless it is ``known`` the shared ones and the
    first of these.

    A shingle that is not ``shared`` meets nothing, so all that matters of a window is which shared
    shingles it holds and how many shingles in all.  Of ``n`` shingles a similar window lacks at
    most a fifth.  In an order that holds for all documents, one of the first ``n - ceil(0.8 n) + 1``
    is therefore among the first of the other one too.  Those that are not shared come first; the
    shared ones follow, those of fewer documents first.  A window without a shared one among its
    first is similar to none.
    """
    order = np.lexsort((shared, n_docs))
    by_rank = shared[order]
    by_value = np.argsort(by_rank)
    values = side.values.view(np.int64)
    place = by_value[np.minimum(np.searchsorted(by_rank[by_value], values), len(by_rank) - 1)]
    rank = np.where(by_rank[place] == values, place + 1, 0)
    names = [_mix(side.values), _mix(side.values ^ _M1)]
    found: dict[tuple[int, int], list] = {}
    for part in np.array_split(starts, len(starts) // 4096 + 1):
        at = part[:, None] + np.arange(_WINDOW)
        once = side.before[at] < part[:, None]
        n = once.sum(axis=1)
        first = n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1
        held = once & (rank[at] > 0)
        reach = first - (n - held.sum(axis=1))
        some = np.flatnonzero(reach > 0)
        at, held, n, reach, part = at[some], held[some], n[some], reach[some], part[some]
        # the number of shingles is part of the name
        p, q = (np.where(held, name[at], np.uint64(0)).sum(axis=1, dtype=np.uint64).view(np.int64) for name in names)
        p = p ^ n
        order = np.lexsort((part, q, p))
        new = np.flatnonzero(np.concatenate([[True], (p[order[1:]] != p[order[:-1]]) | (q[order[1:]] != q[order[:-1]])])) if len(order) else order
        for group in np.split(order, new[1:]) if len(order) else ():
            i = group[0]
            name = int(p[i]), int(q[i])
            if name in found:
                found[name][0] = np.concatenate([found[name][0], part[group]])
            elif name in known:
                found[name] = [part[group], int(n[i]), None, None]
            else:
                own = at[i][held[i]]
                found[name] = [part[group], int(n[i]), np.sort(values[own]), by_rank[np.sort(rank[own])[: reach[i]] - 1]]
    return found


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    types = [pa.int64()] * 4 + [longs, pa.int32(), longs, longs]
    for batch in batches:
        rows, seen = [], set()
        offsets = batch.column(4).offsets.to_numpy()
        shared, n_docs = (batch.column(4).values.field(n).to_numpy(zero_copy_only=False) for n in ("shingle", "n"))
        texts = all_shingles(x.as_py() for x in batch.column(3))
        for i, (doc, own_class, places, values) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _places(batch, 2), texts, strict=True)):
            side, own = Shingled(None, values), slice(offsets[i], offsets[i + 1])
            starts = np.flatnonzero(_reach(max(len(side.values) - _WINDOW + 1, 0), places, _WINDOW))
            if not len(starts):
                continue
            # the shingles of a pattern go out once a batch
            named = patterns(side, starts, shared[own], n_docs[own], seen)
            rows += [(*name, doc, own_class, *entry) for name, entry in named.items()]
            seen.update(named)
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in PATTERNS.split(", ")])


def _similar(common: Column, n: Column, other: Column) -> Column:
    return common >= SIMILARITY * (n + other - common) - 1e-9


def _least(n: Column, other: Column) -> Column:
    """How many shingles similar sets of these sizes have in common at least."""
    return F.ceil((n + other) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)


def _met(kinds: DataFrame) -> DataFrame:
    """``p, q, in, p2, q2, in2``: patterns of different cells that are listed under the same shingle.

    Of two similar sets each lacks at most ``n - least`` of its shingles in the other, so the first
    one that both hold is among the first ``n - least + 1`` of each.  How many these are depends on
    both sizes: nearly all windows have the same, for which 6 will do where 10 serve every size.  So a
    list is named by its shingle and by the size of the smaller pattern; a pattern is on the lists of
    its own size, and on those of a smaller size that some pattern opened.
    """
    m, n = F.size("shared"), F.col("n")
    bits = F.expr("aggregate(shared, 0L, (bits, x) -> bits | shiftleft(1L, CAST(x & 63 AS INT)))")
    # patterns of one class are met together; one that several classes hold is on its own
    several = F.col("class_low") != F.col("class_high")
    cell = F.when(several, F.concat_ws(":", F.col("p").cast("string"), F.col("q").cast("string"))).otherwise(F.col("class_low").cast("string"))
    within = F.struct("low", "high", "n", m.alias("m"), bits.alias("bits"))
    kept = ["p", "q", "in", "cell"]
    base = kinds.select("p", "q", within.alias("in"), cell.alias("cell"), "n", m.alias("m"), "firsts")
    own = F.greatest(F.col("m") + 1 - _least(n, n), F.lit(0)).cast("int")
    own = base.select(*kept, F.explode(F.slice("firsts", F.lit(1), own)).alias("shingle"), F.col("n").alias("size"))
    opened = own.select("shingle", "size").distinct()
    every = base.select(*kept, "n", "m", F.posexplode("firsts").alias("at", "shingle")).join(opened, "shingle")
    smaller = (F.col("size") < n) & (F.col("size") >= SIMILARITY * n - 1e-9) & (F.col("at") < F.col("m") + 1 - _least(n, F.col("size")))
    listed = own.withColumn("home", F.lit(True)).union(every.filter(smaller).select(*kept, "shingle", "size", F.lit(False)))
    cells = listed.select("shingle", "size", "cell", "home").distinct()
    beside = cells.filter("home").drop("home").join(cells.toDF("shingle", "size", "cell2", "home2"), ["shingle", "size"])
    beside = beside.filter("IF(home2, cell < cell2, cell != cell2)")
    one = listed.filter("home").drop("home")
    other = listed.toDF("p2", "q2", "in2", "cell2", "shingle", "size", "home2")
    met = beside.join(one, ["shingle", "size", "cell"]).join(other, ["shingle", "size", "cell2", "home2"])
    return met.select("p", "q", "in", "p2", "q2", "in2")


def _pattern_pairs(kinds: DataFrame) -> DataFrame:
    """``p, q, low, high, of_low, of_high``: every pattern beside each one it is similar to, with the
    smallest and the largest document of that one and of its own.

    Patterns that only one class holds are linked by it already, with themselves and each other.
    A bit is set for every shared shingle: where too many bits differ, so do too many shingles, and
    the shingles themselves need not be fetched.
    """
    met = _met(kinds)
    least = _least(F.col("in.n"), F.col("in2.n"))
    differ = F.bit_count(F.col("in.bits").bitwiseXOR(F.col("in2.bits")))
    met = met.filter(differ <= F.col("in.m") + F.col("in2.m") - 2 * least).distinct()
    sides = kinds.select("p", "q", "shared")
    both = met.join(sides, ["p", "q"]).join(sides.toDF("p2", "q2", "shared2"), ["p2", "q2"])
    alike = both.filter(_similar(F.size(F.array_intersect("shared", "shared2")), F.col("in.n"), F.col("in2.n")))
    ends = [F.struct(f"{side}.low", f"{side}.high").alias(side) for side in ("in", "in2")]
    alike = stored(alike.select("p", "q", "p2", "q2", *ends), "alike")
    within = F.struct("low", "high")
    own = kinds.filter((F.col("class_low") != F.col("class_high")) & _similar(F.size("shared"), F.col("n"), F.col("n")))
    sides = [alike.select("p", "q", "in2", "in"), alike.select("p2", "q2", "in", "in2"), own.select("p", "q", within, within)]
    sides = [side.toDF("p", "q", "with", "of") for side in sides]
    return sides[0].union(sides[1]).union(sides[2]).select(
        "p", "q", "with.low", "with.high", F.col("of.low").alias("of_low"), F.col("of.high").alias("of_high")
    )


def _open_texts(docs: DataFrame, classes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, class, places`` of the documents with open windows, and these with their texts."""
    spots = members.groupBy("doc").agg(F.collect_set((F.col("place") / 8).cast("bigint")).alias("places"))
    spots = spots.join(classes, F.col("doc") == F.col("node"), "left").select("doc", "places", F.coalesce("root", "doc").alias("class"))
    spots = stored(spots, "open_places")
    return spots, stored(spots.join(docs, F.col("doc") == F.col("doc_id")).select("doc", "class", "places", "text"), "open_texts")


def _open_patterns(spots: DataFrame, texts: DataFrame) -> DataFrame:
    """The patterns of every document's open windows."""
    held = stored(texts.select("doc", "places", "text").mapInArrow(_open_shingles, HELD).distinct().join(spots.select("doc", "class"), "doc"), "open_shingles")
    # a shingle of one class alone links nothing
    shared = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b")
    known = held.join(shared.select("shingle", "n"), "shingle").groupBy("doc").agg(F.collect_list(F.struct("shingle", "n")).alias("shared"))
    return stored(texts.join(known, "doc").select("doc", "class", "places", "text", "shared").mapInArrow(_patterns, PATTERNS), "open_patterns")


def _left_open(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """The links between ``members`` (doc, place) whose documents are not in one of ``classes`` yet.

    Windows of one pattern are one from here on, however many documents hold them; every two
    patterns that are similar are met, by a shingle that is rare among the open windows.  A document
    of a pattern is linked to one of a similar pattern, and any two similar patterns by a pair of their
    documents, which joins the same documents as all of their pairs would.
    """
    spots, texts = _open_texts(docs, classes, members)
    release(docs.sparkSession)
    rows = _open_patterns(spots, texts)
    release(docs.sparkSession)
    kinds = rows.groupBy("p", "q").agg(
        F.any_value("n").alias("n"), F.any_value("shared", True).alias("shared"), F.any_value("firsts", True).alias("firsts"),
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("class").alias("class_low"), F.max("class").alias("class_high"),
    )
    pairs = stored(_pattern_pairs(stored(kinds, "patterns")), "pattern_pairs")
    release(docs.sparkSession)
    near = pairs.groupBy("p", "q").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    partner = F.when(F.col("low") != F.col("doc"), F.col("low")).otherwise(F.col("high"))
    spans = F.transform("starts", lambda s: F.struct(s.alias("start"), (s + LENGTH).alias("end")))
    nothing = F.array().cast(_SPANS)
    own = rows.join(near, ["p", "q"]).select("doc", partner.alias("leader"), spans.alias("spans"), nothing.alias("leader_spans"))
    # of two similar patterns, a document of each
    one = F.col("of_low")
    other = F.when(F.col("low") != one, F.col("low")).otherwise(F.col("high"))
    across = pairs.select(F.when(other != one, one).otherwise(F.col("of_high")).alias("doc"), other.alias("leader")).distinct()
    across = across.select("doc", "leader", nothing.alias("spans"), nothing.alias("leader_spans"))
    return stored(own.union(across).filter("doc != leader"), "open_links")


def _pairs(docs: DataFrame) -> DataFrame:
    """``doc, leader, seeds``: windows of one signature, each beside the leader of its group."""
    windows = docs.mapInArrow(_windows, WINDOWS)
    # links made in a map task need no meeting: they go to any task
    spread = F.when(F.col("leader").isNull(), F.col("key")).otherwise(F.xxhash64("doc", "place"))
    met = windows.withColumn("to", spread).repartition("to").drop("to").sortWithinPartitions("key", "doc", "place")
    pairs = met.mapInArrow(_lead, LINKS).groupBy("doc", "leader").agg(F.collect_list(F.struct("group", "place", "leader_place")).alias("seeds"))
    return stored(pairs, "pairs")


def _open_members(pairs: DataFrame, verified: DataFrame) -> DataFrame:
    """``doc, place`` of all windows of groups that stay open."""
    seeds = pairs.select("doc", "leader", F.explode("seeds").alias("s")).select("doc", "leader", "s.*")
    failed = verified.select(F.explode("failed").alias("group")).union(seeds.filter("doc = leader").select("group")).distinct()
    seeds = seeds.join(failed, "group", "left_semi")
    return seeds.select("doc", "place").union(seeds.select(F.col("leader").alias("doc"), F.col("leader_place").alias("place"))).distinct()


def _classes(links: DataFrame) -> DataFrame:
    return stored(components(links.select(F.col("doc").alias("a"), F.col("leader").alias("b"))), "classes")


def _merged_classes(classes: DataFrame, more: DataFrame) -> DataFrame:
    """``node, root`` after further links: these join whole classes, of which they are few."""
    for end in ("doc", "leader"):
        roots = classes.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        more = more.select("doc", "leader").join(roots, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_root", end))
    merged = _classes(more.select("doc", "leader").filter("doc != leader").distinct())
    moved = classes.join(merged.toDF("_root", "to"), F.col("root") == F.col("_root"), "left").select("node", F.coalesce("to", "root").alias("root"))
    # documents that only the further links name
    return moved.union(merged.join(classes, "node", "left_anti").select("node", "root"))


def passage_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, leader, spans, leader_spans`` for pairs of documents with a passage in common, and
    ``node, root``: the smallest document of the class of each.

    ``spans`` are those of ``doc`` in it, ``leader_spans`` those of ``leader`` unless its own rows
    name them.  Each step leaves a stored table and nothing else, so that the shuffles of the steps
    before can go.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    pairs = _pairs(docs)
    release(spark)
    # further windows of a leading document are compared with none here: their groups stay open
    verified = stored(_beside(pairs.filter("doc != leader"), docs, "seeds").mapInArrow(_verify, VERIFIED), "verified")
    release(spark)
    found = verified.filter(F.size("spans") > 0).drop("failed")
    classes = _classes(found)
    left = _left_open(docs, classes, _open_members(pairs, verified))
    return found.union(left), _merged_classes(classes, left)


def _joined(spans: Column) -> Column:
    """Sorted spans with overlapping ones made one."""
    empty = F.array().cast(_SPANS)

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        whole = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(whole))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(F.array_sort(spans), empty, add)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """A row per document that shares a passage of ``LENGTH`` words or more with another one.

    ``class_id`` is the smallest doc_id of the documents linked by such passages, ``n_links`` how
    many documents it was found to share one with (leaders of its passages, or all their members
    for a leader), ``n_repeated_words`` and ``spans`` which words they are, as ``start:end``.
    """
    links, classes = passage_links(docs)
    both = links.select("doc", F.col("leader").alias("other"), "spans").union(
        links.select(F.col("leader").alias("doc"), F.col("doc").alias("other"), F.col("leader_spans").alias("spans"))
    )
    partners = both.select("doc", "other").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_links"))
    single = both.select("doc", F.explode("spans").alias("span")).distinct()
    per = single.groupBy("doc").agg(_joined(F.collect_list("span")).alias("spans"))
    words = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    spelled = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return per.join(partners, "doc").join(classes, F.col("doc") == F.col("node")).select(
        F.col("doc").alias("doc_id"), F.col("root").alias("class_id"), "n_links", words.alias("n_repeated_words"), spelled.alias("spans")
    )


def document_classes(docs: DataFrame) -> DataFrame:
    """``repeated_passages`` with a row for every doc_id; one without a shared passage is a class of
    its own."""
    every = docs.select(F.col("doc_id").cast("bigint")).filter("doc_id IS NOT NULL").distinct()
    none = F.lit(0).cast("bigint")
    return every.join(repeated_passages(docs), "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", none).alias("n_links"),
        F.coalesce("n_repeated_words", none).alias("n_repeated_words"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
