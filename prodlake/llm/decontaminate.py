"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to ``length // PER_EDIT`` character edits.  Cut into one piece more
than that, at least one piece must occur unchanged.  One automaton finds all pieces of a
block of items in a text; Myers' bit-parallel algorithm reads the text around the hits once, those
that lie close together as one stretch, and gives every end of a match within the budget.  The
distance of an item is the smallest between it and any part of the text.

Texts and items are lower-cased and runs of white space become one blank; places are code points
of that form.  The items are the query set: they go out to the tasks in blocks of at most
``BLOCK`` characters, and each block reads the documents once.

Defined cases: null or empty texts hold nothing; a null doc_id or item_id is reported as it is; items shorter than ``SHORTEST`` characters occur
without an edit and as whole words only, they would be found inside others; items that are null or
blank are not searched; items with equal text are all reported; repeated rows are reported each;
empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .worker import per_worker

PER_EDIT = 20  # characters of an item for each edit it may have
SHORTEST = 24  # characters of an item that may have edits
BLOCK = 4_000_000  # characters of items searched at a time

RESULT = "doc_id bigint, item_id bigint, distance int, start bigint, end bigint, n_matches bigint"


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


def distances(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> list[int]:
    """Smallest edit distance of a pattern of ``m`` characters to a part of ``text`` that ends at
    each place, 0 first; an ``anchored`` part starts at the beginning of the text."""
    every, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = every, 0, m
    scores = [m]
    for c in text:
        equal = peq.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (every & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1 | anchored) & every, (down << 1) & every
        plus = down | (every & ~(vertical | up))
        minus = up & vertical
        scores.append(score)
    return scores


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of a pattern of ``m`` characters to any part of ``text``, and the
    first place where such a part ends."""
    scores = distances(peq, m, text)
    best = min(scores)
    return best, scores.index(best)


def best_ends(scores: list[int], budget: int) -> list[tuple[int, int]]:
    """``distance, end`` of the first best end of every run of ends within the budget."""
    out: list[tuple[int, int]] = []
    last = None
    for end, score in enumerate(scores):
        if score > budget:
            continue
        if last == end - 1:
            out[-1] = min(out[-1], (score, end))
        else:
            out.append((score, end))
        last = end
    return out


def _order(value: int | None) -> tuple[bool, int]:
    return value is not None, value or 0


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit goes on at either end of a part of ``text``."""
    before, after = (text[max(0, at - 1) : at + 1] for at in (start, end))
    return not (start > 0 and before.isalnum()) and not (end < len(text) and after.isalnum())


class Matcher:
    """Finds the items ``(item_id, text)`` of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], per_edit: int = PER_EDIT, shortest: int = SHORTEST) -> None:
        import ahocorasick

        same: dict[str, list[int]] = defaultdict(list)
        for item_id, text in items:
            if plain := normalize(text):
                same[plain].append(item_id)
        self._shortest = shortest
        budgets = {text: len(text) // per_edit if len(text) >= shortest else 0 for text in same}
        self._items = [(text, sorted(ids, key=_order), budgets[text], masks(text), masks(text[::-1])) for text, ids in sorted(same.items())]
        self._automaton = ahocorasick.Automaton()
        for n, (text, _, budget, _, _) in enumerate(self._items):
            edges = [round(i * len(text) / (budget + 1)) for i in range(budget + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                self._automaton.get(text[a:b], None) or self._automaton.add_word(text[a:b], [])
                self._automaton.get(text[a:b]).append((n, b))
        if self._items:
            self._automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """``item_id, distance, start, end, matches`` of every item that ``text`` holds."""
        plain = normalize(text)
        if not self._items or not plain:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for last, pieces in self._automaton.iter(plain):
            for n, b in pieces:
                starts[n].add(last + 1 - b)
        out = []
        for n, at in starts.items():
            item, ids, budget, peq, back = self._items[n]
            m, found = len(item), []
            if m < self._shortest:
                at = {s for s in at if whole_words(plain, s, s + m)}
            stretches: list[list[int]] = []
            for s in sorted(at):  # where the item would start without an edit before the piece
                if s >= 0 and plain.startswith(item, s):
                    found.append((0, s, s + m))
                elif budget:
                    a, b = max(0, s - budget), min(len(plain), s + m + budget)
                    if stretches and a <= stretches[-1][1]:
                        stretches[-1][1] = max(b, stretches[-1][1])
                    else:
                        stretches.append([a, b])
            for a, b in stretches:
                for distance, length in best_ends(distances(peq, m, plain[a:b]), budget):
                    end = a + length
                    # the shortest part that ends there with this distance
                    own = distances(back, m, plain[max(a, end - m - budget) : end][::-1], anchored=True)
                    found.append((distance, end - own.index(min(own)), end))
            if found:
                kept: list[tuple[int, int, int]] = []
                for match in sorted(found, key=lambda f: (f[1], f[2])):
                    if kept and match[1] < kept[-1][2]:
                        kept[-1] = min(kept[-1], match)
                    else:
                        kept.append(match)
                out += [(i, *min(kept), len(kept)) for i in ids]
        return sorted(out, key=lambda f: (_order(f[0]), f[1:]))


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """The query set on the driver, one block at a time."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("bigint"), "text").filter(F.col("text").isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= block:
            yield held
            held, size = [], 0
    if held:
        yield held


def _matcher(items: list[tuple[int, str]], per_edit: int):
    """The matcher of a block, made once per worker."""
    name = uuid.uuid4().hex
    return lambda: per_worker(("matcher", name), lambda: Matcher(items, per_edit))


def _search(items: list[tuple[int, str]], per_edit: int):
    kept = _matcher(items, per_edit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = kept()
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            rows = [(doc_id, *f) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for f in matcher.find(text.as_py())]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, per_edit: int = PER_EDIT, block: int = BLOCK) -> DataFrame:
    """A row per document and item it holds: the best match, and how many there are."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    found = None
    for items in _blocks(benchmark, block):
        part = rows.mapInArrow(_search(items, per_edit), RESULT)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], RESULT) if found is None else found


def _found(items: list[tuple[int, str]], per_edit: int):
    kept = _matcher(items, per_edit)

    @F.pandas_udf("boolean")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = kept()
        for batch in texts:
            yield pd.Series([bool(matcher.find(t)) for t in batch], dtype=bool)

    return found


def holds_item(benchmark: DataFrame, text: Column, per_edit: int = PER_EDIT, block: int = BLOCK) -> Column:
    """Whether a text holds any item; false for a null text."""
    held: Column = F.lit(False)
    for items in _blocks(benchmark, block):
        held = held | _found(items, per_edit)(text)
    return held


def drop_leaks(docs: DataFrame, benchmark: DataFrame, per_edit: int = PER_EDIT) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark."""
    return docs.filter(~holds_item(benchmark, F.col("text"), per_edit))
