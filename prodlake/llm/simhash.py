"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Fingerprints of 64 bits that differ in at most ``distance`` bits agree on whole bands of bits.
With ``distance + 2`` bands at least two are free of differences, so the 15 pairs of bands give
15 views in which every link is seen: an upper node of a view is a masked bit pattern that
its fingerprints share.  Inside a node they are sorted by Gray rank and cut into runs; a run
keeps the bits on which all of it agree.  Two runs whose agreed bits already differ too often are
pruned whole, the others are compared bit by bit.  Tasks report spanning links only, never all
pairs of a group, and a node of any size is spread over its runs.

Defined cases: a text of fewer words than a shingle is one shingle; an empty or null text has
fingerprint zero, linked like any other; repeated rows and copies share a fingerprint; a null
doc_id is no smallest id unless its class has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored
from .components import components

SHINGLE = 4  # words; fixed by the contract, as are the seed and the distance
SEED = 42
DISTANCE = 4
RUN = 512  # fingerprints of a run

_TOP = np.uint64(1 << 63)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit by bit the majority over the hashes of all shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes know the ASCII letters and blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    reach = min(shingle, len(words)) - 1
    spans = zip(starts[: len(words) - reach].tolist(), ends[reach:].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    major = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(major.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` of every whole text; the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_fingerprints, "doc_id bigint, print bigint")


def view_masks(distance: int = DISTANCE) -> list[int]:
    """A mask per pair of the ``distance + 2`` bands of 64 bits."""
    edges = np.linspace(0, 64, distance + 3).round().astype(int).tolist()
    bands = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [x | y for i, x in enumerate(bands) for y in bands[i + 1 :]]


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the Gray code: neighbours differ in one bit."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _views(masks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for view, mask in enumerate(masks):
                shared = prints & np.uint64(mask)
                rank = gray_rank(prints & ~np.uint64(mask)) ^ _TOP  # signed order of the unsigned rank
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(prints), view, np.int32)), *(pa.array(x.view(np.int64)) for x in (shared, rank, prints))],
                    names=["view", "node", "rank", "print"],
                )

    return run


def spanning_links(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the links: every member of one with its smallest."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            nearer = label[label]
            if (nearer == label).all():
                break
            label = nearer
        if (label == before).all():
            break
    members = np.flatnonzero(label != np.arange(n))
    return members, label[members]


def _close(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= distance)


_OUT = "kind int, a bigint, b bigint, view int, node bigint, run bigint, agreed bigint, bits bigint, prints array<bigint>"


def _runs(distance: int, size: int):
    """Links inside each run; runs that may have others of their node go out as well."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 9
        names = [x.split()[0] for x in _OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, serial = TaskContext.get().partitionId() << 32, 0
        views, nodes, prints = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)
        first, last_node = True, None

        def settle(done: bool):
            """Handle all nodes that are complete in the rows held; keep the rest."""
            nonlocal views, nodes, prints, first, last_node, serial
            n = len(prints)
            cut = np.flatnonzero((views[1:] != views[:-1]) | (nodes[1:] != nodes[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
            rows: list[tuple] = []
            keep = n
            sizes = ends - starts
            # single rows inside the partition have no partner; only its outer nodes may go on elsewhere
            wanted = set(np.flatnonzero(sizes > 1).tolist()) | {0, len(starts) - 1}
            for g in sorted(wanted):
                a, b = int(starts[g]), int(ends[g])
                node = (int(views[a]), int(nodes[a]))
                open_end = g == len(starts) - 1
                if open_end and not done:
                    whole = (b - a) // size * size  # the node may go on in the next batch
                    keep = a + whole
                    b = keep
                outer = first and g == 0 or open_end or node == last_node
                for at in range(a, b, size):
                    own = prints[at : min(at + size, b)]
                    if len(own) > 1:
                        left, right = _close(own, own, distance)
                        members, roots = spanning_links(len(own), left, right)
                        rows += [
                            (0, x, y, None, None, None, None, None, None)
                            for x, y in zip(own[members].view(np.int64).tolist(), own[roots].view(np.int64).tolist(), strict=True)
                        ]
                    if outer or b - a > size:
                        ones, zeros = np.bitwise_and.reduce(own), np.bitwise_and.reduce(~own)
                        agreed = np.array([ones | zeros, ones]).view(np.int64).tolist()
                        rows.append((1, None, None, *node, base + serial, *agreed, own.view(np.int64).tolist()))
                        serial += 1
                if open_end:
                    last_node = node
            first = first and keep == 0
            views, nodes, prints = views[keep:], nodes[keep:], prints[keep:]
            return batch_of(rows)

        for batch in batches:
            views = np.concatenate([views, batch.column(0).to_numpy(zero_copy_only=False)])
            nodes = np.concatenate([nodes, batch.column(1).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(prints) > size:
                yield settle(False)
        if len(prints):
            yield settle(True)

    return run


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                left, right = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
                i, j = _close(left, right, distance)
                both = np.concatenate([left, right])
                members, roots = spanning_links(len(both), i, j + len(left))
                out.append(np.stack([both[members], both[roots]]))
            found = np.concatenate(out, axis=1).view(np.int64) if out else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return run


def print_links(prints: DataFrame, distance: int = DISTANCE, run: int = RUN) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (print) that span the same components as all
    pairs within ``distance`` bits."""
    views = prints.select("print").mapInArrow(_views(view_masks(distance)), "view int, node bigint, rank bigint, print bigint")
    order = ["view", "node", "rank"]
    runs = stored(views.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs(distance, run), _OUT), "runs")
    inside = runs.filter("kind = 0").select("a", "b")
    held = runs.filter("kind = 1").select("view", "node", "run", "agreed", "bits", "prints")
    x, y = held.alias("x"), held.alias("y")
    apart = F.bit_count(F.expr("(x.bits ^ y.bits) & x.agreed & y.agreed"))
    same = (F.col("x.view") == F.col("y.view")) & (F.col("x.node") == F.col("y.node")) & (F.col("x.run") < F.col("y.run"))
    pairs = x.join(y, same & (apart <= distance)).select(F.col("x.prints").alias("p"), F.col("y.prints").alias("q"))
    return inside.union(pairs.mapInArrow(_compare(distance), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that can be reached over links of at most
    ``distance`` differing bits, the document itself included.
    """
    marked = stored(fingerprints(docs), "prints")
    distinct = stored(marked.groupBy("print").agg(F.min("doc_id").alias("smallest")), "distinct")
    roots = components(print_links(distinct, distance))
    classes = distinct.join(roots, F.col("print") == F.col("node"), "left").select("print", "smallest", F.coalesce("root", "print").alias("root"))
    least = classes.groupBy("root").agg(F.min("smallest").alias("component_id"))
    of_print = classes.join(least, "root").select("print", "component_id")
    return marked.join(of_print, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each class of near-duplicates: a row of its smallest doc_id.

    Rows that repeat the doc_id of a kept document collapse to one of them.  Rows without a
    doc_id cannot be told apart and all stay.
    """
    classes = near_duplicates(docs, distance)
    first = classes.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("first")).distinct()
    rows = packed(docs, doc_id=F.col("doc_id"))
    kept = rows.join(first, F.col("doc_id") == F.col("first"), "left_semi").dropDuplicates(["doc_id"])
    return kept.union(rows.filter("doc_id IS NULL")).select("row.*")
