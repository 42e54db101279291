"""Token alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cut the same bytes.  Where a token of either ends at the same place, the text can
be cut for both.  ``shared_cuts`` looks for such a place near the middle of an interval by
bisection in the other side's ends and goes on in both halves; an interval without a cut inside
is a leaf, one group of tokens that only belong together as a whole.  All open intervals take
their next step at once, so the work is a few array operations a level.  A token pair is linked
where its byte ranges overlap, always inside a group.

Neither tokenizer has a token that goes on from other characters into a blank, tab or line
feed, so a text is a row of stretches, a run of these and what follows it up to the next, whose
tokens and groups do not depend on their surroundings.  (Behind other white space a text is not
cut, a token may hold both.)  The distinct stretches of a batch of texts are encoded and aligned
once, as one long text, and the documents put together from them.

A batch of texts is stored as one row: the digests of its documents, its distinct id pairs, how
many of its documents hold each, and the pairs of each document, packed.  Pair counts are sums
over the pairs of batches, a pair that stands in every document has one row a batch.  Looked up
counts go back to their batch, where links are summed per document.

Defined cases: a text that is null or empty, or whose tokens do not join to its bytes, has no
tokens; repeated rows are documents of their own and count as such; a text longer than a batch
is a batch of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import ragged, tokenizer_path
from .worker import per_worker

BATCH = 8 << 20  # characters of texts that share a row

# white space that a token may join with what stands before it, white space beyond ASCII, and
# the character that B writes for a blank
_JOINED = r"\r\x0b\x0c\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2581\u3000\ufeff"
_STRETCH = re.compile(rf"[ \t\n]*[^ \t\n]+(?:(?<=[{_JOINED}])[ \t\n]+[^ \t\n]*)*|[ \t\n]+")

BATCHES = (
    "batch string, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "digests array<string>, pairs array<bigint>, holders array<int>, sizes array<int>, entries binary"
)
LINKED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
)


def shared_cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and in ``b`` of the ends both have, in order.

    ``a`` and ``b`` are ascending ends of tokens over the same bytes.
    """
    low, high = np.zeros(1, np.int64), np.full(1, len(a), np.int64)
    tries = np.zeros(1, np.int64)
    cuts = []
    open_ = high > low
    while open_.any():
        low, high, tries = low[open_], high[open_], tries[open_]
        # the middle, then its neighbours, ever further away on alternating sides
        away = (tries + 1) >> 1
        probe = ((low + high) >> 1) + np.where(tries & 1, -away, away)
        place = np.searchsorted(b, a[probe])
        found = place < len(b)
        found[found] = b[place[found]] == a[probe[found]]
        cuts.append(probe[found])
        # both halves of a cut interval start anew; the others look one place further
        low, high, tries = (
            np.concatenate([low[~found], low[found], probe[found] + 1]),
            np.concatenate([high[~found], probe[found], high[found]]),
            np.concatenate([tries[~found] + 1, np.zeros(2 * int(found.sum()), np.int64)]),
        )
        open_ = tries < high - low
    in_a = np.sort(np.concatenate(cuts)) if cuts else np.zeros(0, np.int64)
    return in_a, np.searchsorted(b, a[in_a])


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of ``a``, the first token of ``b`` whose bytes overlap it and how many do."""
    starts = np.concatenate([[0], a])[:-1]
    first = np.searchsorted(b, starts, "right")
    return first, np.searchsorted(b, a, "left") + 1 - first


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, ranks: str, pieces: str) -> None:
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_a = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_a[rank] = token
        self.bytes_b = [self._piece(i) for i in range(self._b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self._blank = self._b.piece_to_id("▁")

    def _piece(self, i: int) -> bytes:
        if self._b.is_byte(i):
            return bytes([int(self._b.id_to_piece(i)[3:-1], 16)])
        return self._b.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of stretches as they stand in a text, which starts with a blank."""
        in_a = [self._a.encode_ordinary(s) for s in stretches]
        # B puts a blank before everything: it takes the place of a leading one, or goes again
        in_b = self._b.encode([s[1:] if s[:1] == " " else s for s in stretches], num_threads=1)
        for i, s in enumerate(stretches):
            if s == " ":
                in_b[i] = [self._blank]
            elif s[:1] != " ":
                in_b[i] = in_b[i][1:]
        return in_a, in_b


def stretches(text: str) -> list[str]:
    """A text, which starts with a blank, as stretches that are encoded on their own."""
    return _STRETCH.findall(text)


class Aligned:
    """Some stretches: their tokens, groups and links."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str]) -> None:
        lists = tokenizers.encode(texts)
        raw = [t.encode() for t in texts]
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in lists)
        self.ids_a, self.ids_b = (np.fromiter((i for ids in x for i in ids), np.int64, int(n.sum())) for x, n in zip(lists, (self.n_a, self.n_b), strict=True))
        whole = b"".join(raw)
        spelled = [b"".join(map(table.__getitem__, ids.tolist())) for table, ids in ((tokenizers.bytes_a, self.ids_a), (tokenizers.bytes_b, self.ids_b))]
        self.good = np.ones(len(texts), bool)
        if spelled[0] != whole or spelled[1] != whole:
            for i, own in enumerate(raw):
                self.good[i] = all(b"".join([table[t] for t in ids[i]]) == own for table, ids in zip((tokenizers.bytes_a, tokenizers.bytes_b), lists, strict=True))
            # what does not join has no tokens
            keep_a, keep_b = np.repeat(self.good, self.n_a), np.repeat(self.good, self.n_b)
            self.ids_a, self.ids_b = self.ids_a[keep_a], self.ids_b[keep_b]
            self.n_a, self.n_b = self.n_a * self.good, self.n_b * self.good
        ends_a, ends_b = np.cumsum(tokenizers.sizes_a[self.ids_a]), np.cumsum(tokenizers.sizes_b[self.ids_b])
        cut_a, cut_b = shared_cuts(ends_a, ends_b)
        # every stretch ends with a cut
        self.n_groups = np.diff(np.searchsorted(cut_a, np.concatenate([[0], np.cumsum(self.n_a)])))
        self.spelled = self._spell(cut_a + 1, cut_b + 1)
        first, self._many = overlaps(ends_a, ends_b)
        links_a = np.repeat(self.ids_a, self._many)
        links_b = ragged(self.ids_b, first, self._many)
        self.links = links_a << 32 | links_b
        bounds = np.concatenate([[0], np.cumsum(self._many)])[np.concatenate([[0], np.cumsum(self.n_a)])]
        self.n_links, self.first_link = np.diff(bounds), bounds[:-1]

    def _spell(self, ends_a: np.ndarray, ends_b: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;...`` of each stretch."""
        names_a, names_b = (list(map(str, ids.tolist())) for ids in (self.ids_a, self.ids_b))
        groups, i, j = [], 0, 0
        for to_i, to_j in zip(ends_a.tolist(), ends_b.tolist(), strict=True):
            if to_i - i == 1 and to_j - j == 1:
                groups.append(f"{names_a[i]}|{names_b[j]}")
            else:
                groups.append(f"{','.join(names_a[i:to_i])}|{','.join(names_b[j:to_j])}")
            i, j = to_i, to_j
        ends = np.cumsum(self.n_groups).tolist()
        return [";".join(groups[end - n : end]).encode() for n, end in zip(self.n_groups.tolist(), ends, strict=True)]


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in groups of seven bits, lowest first, and all packed."""
    import zstandard

    out = np.zeros((len(numbers), 5), np.uint8)
    rest = numbers.astype(np.uint64)
    kept = np.ones((len(numbers), 5), bool)
    for level in range(5):
        out[:, level] = (rest & np.uint64(127)).astype(np.uint8)
        rest >>= np.uint64(7)
        out[:, level] |= np.where(rest > 0, 128, 0).astype(np.uint8)
        if level < 4:
            kept[:, level + 1] = rest > 0
    return zstandard.ZstdCompressor(level=1).compress(out[kept].tobytes())


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    last = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for level in range(5):
        on = starts + level <= last
        out[on] |= (data[starts[on] + level].astype(np.int64) & 127) << 7 * level
    return out


def align_batch(tokenizers: Tokenizers, doc_ids: list[int | None], texts: list[str | None]) -> tuple:
    """The row of a batch without its name."""
    cut = [stretches(" " + t) if t else [] for t in texts]
    n_stretches = np.fromiter(map(len, cut), np.int64, len(cut))
    coded = pa.array([s for own in cut for s in own], pa.large_string()).dictionary_encode()
    del cut
    place = coded.indices.to_numpy().astype(np.int64)
    a = Aligned(tokenizers, coded.dictionary.to_pylist())
    bounds = np.concatenate([[0], np.cumsum(n_stretches)])
    doc = np.repeat(np.arange(len(texts)), n_stretches)
    # a text with a stretch that does not join has no tokens at all
    good = np.bincount(doc, ~a.good[place], len(texts)) == 0
    use = good[doc]

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc[use], values[place[use]], len(texts)).astype(np.int64)

    digests = []
    names, spelled = place.tolist(), a.spelled
    for i, (start, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        digests.append(hashlib.sha256(b";".join([spelled[s] for s in names[start:end]])).hexdigest() if good[i] and end > start else "")
    # the pairs that a document holds, each once, with its number of links there
    pairs, code = np.unique(a.links, return_inverse=True)
    held = place[use]
    links = ragged(code, a.first_link[held], a.n_links[held])
    keys = np.sort(np.repeat(doc[use], a.n_links[held]) * len(pairs) + links)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([new, [len(keys)]]))
    held_doc, held_pair = np.divmod(keys[new], max(len(pairs), 1))
    sizes = np.bincount(held_doc, minlength=len(texts))
    step = np.diff(held_pair, prepend=0) if len(held_pair) else held_pair
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    step[firsts] = held_pair[firsts]
    entries = pack(np.concatenate([step, times]))
    holders = np.bincount(held_pair, minlength=len(pairs))
    return doc_ids, per_doc(a.n_a), per_doc(a.n_b), per_doc(a.n_groups), per_doc(a.n_links), digests, pairs, holders.astype(np.int32), sizes.astype(np.int32), entries


_LONGS = pa.list_(pa.int64())
_TYPES = [pa.string(), _LONGS, _LONGS, _LONGS, _LONGS, _LONGS, pa.list_(pa.string()), _LONGS, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]


def _align(ranks: str, pieces: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizers = per_worker(("aligned", ranks, pieces), lambda: Tokenizers(ranks, pieces))
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        texts: list[str | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            row = (f"{part}-{seq}", *align_batch(tokenizers, doc_ids, texts))
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=[c.split()[0] for c in BATCHES.split(", ")])
            seq, held = seq + 1, 0
            doc_ids.clear(), texts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                texts.append(text.as_py())
                doc_ids.append(doc_id.as_py())
                held += len(texts[-1] or "") + 1
                if held >= size:
                    yield close()
        if texts:
            yield close()

    return run


def _sums(rows: pa.Table, looked: pa.Table) -> pa.Table:
    """The documents of one batch with the sums over their links."""
    counts, best = np.zeros(looked.num_rows, np.int64), np.zeros(looked.num_rows, bool)
    at = looked.column("place").to_numpy()
    counts[at], best[at] = looked.column("holding").to_numpy(), looked.column("leads").to_numpy()
    cell = {name: rows.column(name).combine_chunks()[0] for name in rows.column_names}
    sizes = cell["sizes"].values.to_numpy().astype(np.int64)
    steps, times = np.split(unpack(cell["entries"].as_py()), 2)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    # a place is a step from the one before, in each document from 0 on
    total = np.concatenate([[0], np.cumsum(steps)])
    pair = total[1:] - np.repeat(total[bounds[:-1]], sizes)
    sums = [np.diff(np.concatenate([[0], np.cumsum(times * of[pair])])[bounds]) for of in (best, counts)]
    columns = [cell[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*columns, *map(pa.array, sums), cell["digests"].values], names=[c.split()[0] for c in LINKED.split(", ")])


def align(docs: DataFrame, ranks: str | None = None, pieces: str | None = None, batch: int = BATCH) -> DataFrame:
    """The stored batches of ``docs`` (doc_id, text), see ``BATCHES``."""
    run = _align(ranks or tokenizer_path("byte_bpe_50k.tiktoken"), pieces or tokenizer_path("piece_bpe_32k.model"), batch)
    return stored(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, BATCHES), "aligned")


def pair_counts(batches: DataFrame) -> DataFrame:
    """``pair, holding, leads``: the documents that hold an id pair (A << 32 | B) linked, and
    whether no pair of its A id is held by more."""
    each = batches.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
    counts = stored(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("holding")), "pairs")
    # a row per id of the vocabulary
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("holding").alias("most"))
    return counts.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "holding", (F.col("holding") == F.col("most")).alias("leads"))


def alignments(docs: DataFrame, **options) -> DataFrame:
    """Per document its tokens, groups, links and corpus-wide counts, see ``LINKED``."""
    batches = align(docs, **options)
    counts = pair_counts(batches)
    places = batches.select("batch", F.posexplode("pairs").alias("place", "pair"))
    looked = places.join(counts, "pair").select(F.col("batch").alias("of"), "place", "holding", "leads")
    rows = batches.select("batch", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "sizes", "entries")
    return rows.groupBy("batch").cogroup(looked.groupBy("of")).applyInArrow(_sums, LINKED)
