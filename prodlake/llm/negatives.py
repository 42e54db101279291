"""Hard-negative mining by Fagin's threshold algorithm.

The rows are stored in blocks of at most ``BLOCK``; a block holds its vectors, scaled to whole
numbers, and a candidate list per dimension, sorted by that component.  The anchors of a block
are a query set: they go to all blocks.  In each block an anchor walks the lists by sorted
access, from the top of a dimension where its own component is positive and from the bottom
where it is negative, and scores every row that it meets for the first time by random access.
The threshold is the score of a row that stood at the reached place of every list; no row unseen
so far can have more.  An anchor stops when the threshold falls strictly below the kth score of
all it looks for, so that ties are met too.

Two passes: the first finds the positives of each anchor among the rows of its label, the second
the negatives of each positive's window of scores.  A window that lies above the threshold is
settled even if it holds fewer rows than asked for.  What the blocks find is merged by rank.

Scores are exact.  They are computed in the narrowest type that holds every possible sum: floats
up to 2^24, doubles up to 2^53, else 64-bit integers.

Defined cases: a row without label, vec_id or vector, or with a null or non-finite component,
takes no part; a shorter vector is filled up with zeros; scaled components are held between
-2^24 and 2^24; repeated rows take part as often as they occur, but a row with the anchor's vec_id
is no partner of it; an anchor without positives, or a positive without negatives, gives no row;
ties go to the smaller vec_id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 4096  # rows of a block
EVERY = 50  # anchors are the vec_ids divisible by this
POSITIVES = 5
NEGATIVES = 3
SCALE = 256
LIMIT = 1 << 24  # largest scaled component
_FIRST = 32  # places of a list read in the first round; each round reads four times as far

BLOCKS = "block bigint, n int, dims int, ids binary, labels binary, vectors binary, lists binary, anchors binary"
FOUND = "block bigint, anchor int, positive int, other_id bigint, score bigint, anchor_id bigint, positive_id bigint, positive_score bigint"
_WINDOWS = "array<struct<anchor:int,rank:int,other_id:bigint,score:bigint>>"
_FOUND = [c.split()[0] for c in FOUND.split(", ")]


def scaled(vectors: list[np.ndarray]) -> np.ndarray:
    """Whole components of some vectors, the shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int32)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = np.clip(np.floor(SCALE * vector), -LIMIT, LIMIT)
    return out


def _pack(tasks: int, size: int, every: int):
    """Blocks of the rows of a task, which take every ``tasks``-th number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        held: list[tuple[int, int, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal block
            ids, labels = (np.array([h[i] for h in held], np.int64) for i in range(2))
            vectors = scaled([h[2] for h in held])
            lists = np.argsort(vectors, axis=0, kind="stable").T.astype(np.uint16)
            anchors = np.flatnonzero(ids % every == 0).astype(np.int32)
            row = [block, len(ids), vectors.shape[1], *(x.tobytes() for x in (ids, labels, vectors, lists, anchors))]
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            block += tasks
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for vec_id, label, vector in zip(*(batch.column(c) for c in range(3)), strict=True):
                held.append((vec_id.as_py(), label.as_py(), vector.values.to_numpy(zero_copy_only=False)))
                if len(held) == size:
                    yield close()
        if held:
            yield close()

    return run


def build_blocks(embeddings: DataFrame, block: int = BLOCK, every: int = EVERY) -> DataFrame:
    """The stored blocks of ``embeddings`` (vec_id, embedding, label).

    Rows are dealt evenly, whatever their label; at most ``block`` (65,536) of them are in memory
    at a time.
    """
    vector = F.col("embedding").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull()
    fit &= F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.filter(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding")
    n = rows.count()
    tasks = max(1, min(-(-n // block), 4 * int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.select("vec_id", "label", vector.alias("vector")).repartition(tasks)
    return stored(rows.mapInArrow(_pack(tasks, block, every), BLOCKS), "blocks")


class Block:
    """The arrays of a block row."""

    def __init__(self, dims: int, ids: bytes, labels: bytes, vectors: bytes, lists: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.int32).reshape(len(self.ids), dims)
        self.lists = np.frombuffer(lists, np.uint16).reshape(dims, len(self.ids)) if dims else np.zeros((0, len(self.ids)), np.uint16)
        self.most = int(np.abs(self.vectors).max(initial=0))
        self._by_label: dict[int, Lists] = {}
        self._all: Lists | None = None

    def of(self, label: int) -> Lists:
        """The lists of one label's rows."""
        if label not in self._by_label:
            self._by_label[label] = Lists(self, np.flatnonzero(self.labels == label))
        return self._by_label[label]

    def all(self) -> Lists:
        self._all = self._all or Lists(self, None)
        return self._all


class Lists:
    """The sorted candidate lists of some rows of a block; ``rows`` are their places in it."""

    def __init__(self, block: Block, rows: np.ndarray | None) -> None:
        self.lists, self.rows = block.lists, np.arange(len(block.ids)) if rows is None else rows
        self.ids, self.labels = block.ids[self.rows], block.labels[self.rows]
        if rows is not None:
            place = np.full(len(block.ids), -1, np.int64)
            place[rows] = np.arange(len(rows))
            kept = place[block.lists]
            self.lists = kept[kept >= 0].reshape(len(block.lists), len(rows))
        whole = block.vectors[self.rows]
        self.sorted = np.take_along_axis(whole.T, self.lists.astype(np.int64), 1)
        self._whole, self._typed = whole, {}

    def typed(self, kind: type) -> np.ndarray:
        if kind not in self._typed:
            self._typed[kind] = self._whole.astype(kind)
        return self._typed[kind]


def _kind(a: Block, anchor: np.ndarray) -> type:
    """The narrowest type that holds every sum of products exactly."""
    most = a.most * int(np.abs(anchor).astype(np.int64).sum())
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Walk:
    """Sorted access for one anchor: rounds of rows met for the first time, and the threshold."""

    def __init__(self, lists: Lists, anchor: np.ndarray, kind: type) -> None:
        dims = min(len(anchor), len(lists.lists))
        self._lists, self._vectors = lists, lists.typed(kind)[:, :dims]
        self._anchor = anchor[:dims].astype(kind)
        self._up, self._down = np.flatnonzero(anchor[:dims] > 0), np.flatnonzero(anchor[:dims] < 0)
        self._exact = anchor[:dims].astype(np.int64)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Places and scores of the new rows, and the threshold; None after the last row."""
        n = len(self._lists.ids)
        seen = np.zeros(n, bool)
        lists, start, end = self._lists.lists, 0, min(_FIRST, n)
        while n and (len(self._up) or len(self._down)):
            met = np.zeros(n, bool)
            met[lists[self._up, n - end : n - start]] = True
            met[lists[self._down, start:end]] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            scores = (self._vectors[new] @ self._anchor).astype(np.int64)
            if end == n:
                yield new, scores, None
                return
            at = self._lists.sorted
            threshold = int(self._exact[self._up] @ at[self._up, n - end].astype(np.int64)) + int(self._exact[self._down] @ at[self._down, end - 1].astype(np.int64))
            yield new, scores, threshold
            start, end = end, min(4 * end, n)
        # without a component that counts every score is zero
        rest = np.flatnonzero(~seen)
        yield rest, np.zeros(len(rest), np.int64), None


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def best(lists: Lists, anchor_id: int, anchor: np.ndarray, kind: type, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of ``lists`` other than the anchor."""
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for new, found, threshold in Walk(lists, anchor, kind):
        other = lists.ids[new] != anchor_id
        ids, scores = np.concatenate([ids, lists.ids[new][other]]), np.concatenate([scores, found[other]])
        kept = first(ids, scores, k)
        ids, scores = ids[kept], scores[kept]
        if threshold is not None and len(ids) == k and threshold < scores[-1]:
            break
    return ids, scores


def in_windows(lists: Lists, label: int, anchor: np.ndarray, kind: type, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, ids and scores of the k best rows of other labels inside it."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    least = min(low for low, _ in windows)
    for new, found, threshold in Walk(lists, anchor, kind):
        fits = np.flatnonzero((found >= least) & (lists.labels[new] != label))
        ids, scores = lists.ids[new][fits], found[fits]
        settled = True
        for w, (low, high) in enumerate(windows):
            inside = (scores >= low) & (scores <= high)
            own = tuple(np.concatenate([x, y[inside]]) for x, y in zip(held[w], (ids, scores), strict=True))
            kept = first(*own, k)
            held[w] = tuple(x[kept] for x in own)
            bar = held[w][1][-1] if len(kept) == k else low
            settled = settled and threshold is not None and threshold < bar
        if settled:
            break
    return held


def window(positive_score: int) -> tuple[int, int]:
    """The whole scores s with 50 p <= 100 s <= 95 p."""
    return -(-positive_score // 2), 19 * positive_score // 20


_BLOCK_COLUMNS = ["dims", "ids", "labels", "vectors", "lists"]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, int, Iterator[tuple[int, int, int, np.ndarray]], list]]:
    """A block, and the anchors of a block that are to be looked up in it.  Rows come by block:
    the block itself, then the anchors sent to it."""
    number, held = None, None
    for batch in batches:
        names = batch.schema.names
        for row in range(batch.num_rows):
            cell = {name: batch.column(i)[row].as_py() for i, name in enumerate(names)}
            if cell["q_block"] is None:
                number, held = cell["block"], Block(*(cell[c] for c in _BLOCK_COLUMNS))
            elif cell["block"] == number:  # else there is no block of that number
                ids, labels = np.frombuffer(cell["ids"], np.int64), np.frombuffer(cell["labels"], np.int64)
                vectors = np.frombuffer(cell["vectors"], np.int32).reshape(len(ids), cell["dims"])
                at = np.frombuffer(cell["lists"], np.int32)
                yield held, cell["q_block"], ((int(at[i]), int(ids[i]), int(labels[i]), vectors[i]) for i in range(len(ids))), cell["windows"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_FOUND)


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, q_block, anchors, _ in _units(batches):
            rows = []
            for at, vec_id, label, vector in anchors:
                ids, scores = best(block.of(label), vec_id, vector, _kind(block, vector), k)
                rows += [(q_block, at, None, int(i), int(s), vec_id, None, None) for i, s in zip(ids, scores, strict=True)]
            yield _batch(rows)

    return run


def _negatives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, q_block, anchors, wanted in _units(batches):
            per_anchor: dict[int, list] = {}
            for w in wanted:
                per_anchor.setdefault(w["anchor"], []).append(w)
            rows = []
            for at, vec_id, label, vector in anchors:
                own = [w for w in per_anchor.get(at, []) if w["score"] >= 0]  # the window of a negative score is empty
                if not own:
                    continue
                found = in_windows(block.all(), label, vector, _kind(block, vector), [window(w["score"]) for w in own], k)
                for w, (ids, scores) in zip(own, found, strict=True):
                    rows += [(q_block, at, w["rank"], int(i), int(s), vec_id, w["other_id"], w["score"]) for i, s in zip(ids, scores, strict=True)]
            yield _batch(rows)

    return run


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each block alone; ``lists`` are their places in it."""
    for batch in batches:
        for row in range(batch.num_rows):
            block, dims, ids, labels, vectors, anchors = (batch.column(c)[row].as_py() for c in range(6))
            at = np.frombuffer(anchors, np.int32)
            own = [np.frombuffer(x, np.int64)[at].tobytes() for x in (ids, labels)]
            own.append(np.frombuffer(vectors, np.int32).reshape(-1, dims)[at].tobytes() if dims else b"")
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([block, dims, *own, anchors], types, strict=True)], names=["q_block", *_BLOCK_COLUMNS])


def _ranked(found: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, every: int = EVERY
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every
    anchor, each of its positives and each of the negatives of that positive."""
    blocks = build_blocks(embeddings, block, every)
    last = blocks.agg(F.max("block")).first()[0]
    tasks = 4 * int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queries = blocks.filter(F.length("anchors") > 0).select("block", "dims", "ids", "labels", "vectors", "anchors")
    queries = queries.mapInArrow(_query_blocks, "q_block bigint, dims int, ids binary, labels binary, vectors binary, lists binary")

    def in_all_blocks(anchors: DataFrame) -> DataFrame:
        """Every block and behind it the anchors of all blocks."""
        numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(last or 0).cast("bigint"))
        sent = anchors.select(F.explode(numbers).alias("block"), "q_block", *_BLOCK_COLUMNS, "windows")
        own = blocks.select("block", F.lit(None).cast("bigint").alias("q_block"), *_BLOCK_COLUMNS, F.lit(None).cast(_WINDOWS).alias("windows"))
        return own.union(sent).repartition(tasks, "block").sortWithinPartitions("block", F.col("q_block").asc_nulls_first())

    found = in_all_blocks(queries.withColumn("windows", F.lit(None).cast(_WINDOWS))).mapInArrow(_positives(positives), FOUND)
    top = stored(_ranked(found, ["block", "anchor"], positives).select("block", "anchor", "rank", "other_id", "score"), "positives")
    # at most ``positives`` for each anchor of a block
    windows = top.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("anchor", "rank", "other_id", "score")).alias("windows"))
    asked = queries.join(windows, F.col("q_block") == F.col("of"))
    found = in_all_blocks(asked).mapInArrow(_negatives(negatives), FOUND)
    return _ranked(found, ["block", "anchor", "positive"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
