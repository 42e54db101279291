"""Token counts that follow edits.

A byte-level vocabulary merges inside pre-tokens only, so a document's count is the sum over its
pre-tokens.  A segment tree per document keeps, over leaves of ``LEAF`` pre-tokens, the
code points and tokens below each node.  An edit finds the leaves it touches by descending the
tree, goes back two leaves (a pre-token looks at most one character ahead, and a run of blanks
leaves its last one to the next word), cuts from there into pre-tokens again until it meets an
old leaf boundary behind the edit, counts these pre-tokens only, and updates the sums above.

Defined cases: a null text is empty and has an empty tree; an empty text has no tokens; places
outside a text are moved to its ends, and an edit that ends before it starts inserts only; nulls
in an edit are 0, its start, and the empty string; edits of a document are applied from the last
to the first, so all places are those of the stored text; overlapping ones apply to what the
later one left.  Repeated rows have the same tree; special tokens in a text are ordinary text; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import PIECES, byte_alphabet, tokenizer_path
from .worker import per_worker

LEAF = 32  # pre-tokens
GROWN = 8  # times LEAF: a leaf that is longer after an edit is cut up

# Fixed: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

TREE = "tree_key bigint, chars array<int>, tokens array<int>"
EDIT = "struct<start:bigint,end:bigint,insert:string>"


class PieceCounts(dict):
    """Tokens of a pre-token; the library counts each new one."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path).model
        self._cut = regex.compile(PATTERN).findall
        self._letters = byte_alphabet()

    def __missing__(self, piece: str) -> int:
        if len(self) >= PIECES:
            self.clear()
        n = len(self._model.tokenize("".join([self._letters[b] for b in piece.encode()])))
        self[piece] = n
        return n

    def cut(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points and tokens of each pre-token of ``text``."""
        pieces = self._cut(text)
        n = len(pieces)
        return np.fromiter(map(len, pieces), np.int32, n), np.fromiter(map(self.__getitem__, pieces), np.int32, n)


def _leaves(values: np.ndarray, size: int) -> np.ndarray:
    return np.add.reduceat(values, np.arange(0, len(values), size)).astype(np.int32) if len(values) else values


def _sums(leaves: np.ndarray) -> np.ndarray:
    """A complete binary tree: node 1 is the root, the leaves fill the last half."""
    width = 1 << max(0, int(len(leaves) - 1).bit_length())
    levels = [np.concatenate([leaves, np.zeros(width - len(leaves), np.int32)])]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1, dtype=np.int32))
    return np.concatenate([np.zeros(1, np.int32), *levels[::-1]])


class Tree:
    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.chars, self.tokens = chars, tokens

    @classmethod
    def build(cls, text: str, counts: PieceCounts) -> Tree:
        chars, tokens = counts.cut(text)
        return cls(_sums(_leaves(chars, LEAF)), _sums(_leaves(tokens, LEAF)))

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _locate(self, place: int) -> tuple[int, int]:
        """The leaf that holds the code point at ``place``, and the code points before it."""
        node, before, half = 1, 0, len(self.chars) // 2
        place = min(place, int(self.chars[1]) - 1)
        while node < half:
            node *= 2
            if place >= before + self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - half, before

    def _set(self, first: int, last: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        half = len(self.chars) // 2
        for sums, own in ((self.chars, chars), (self.tokens, tokens)):
            a, b = half + first, half + last
            sums[a : b + 1] = own
            while a > 1:
                a, b = a // 2, b // 2
                sums[a : b + 1] = sums[2 * a : 2 * b + 2].reshape(-1, 2).sum(axis=1)

    def edit(self, text: str, start: int, end: int, insert: str, counts: PieceCounts) -> tuple[str, int]:
        """Replace ``text[start:end]``; the new text and the code points that were cut again."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        new, shift = text[:start] + insert + text[end:], len(insert) - (end - start)
        if not text:
            fresh = Tree.build(new, counts)
            self.chars, self.tokens = fresh.chars, fresh.tokens
            return new, len(new)
        half = len(self.chars) // 2
        first, begin = self._locate(max(start - 1, 0))
        for _ in range(2):
            while first > 0:
                first -= 1
                begin -= int(self.chars[half + first])
                if self.chars[half + first]:
                    break
        last, before = self._locate(end)
        close = before + int(self.chars[half + last])
        while True:
            lens, tokens = counts.cut(new[begin : close + shift + 1])
            ends = np.cumsum(lens)
            met = int(np.searchsorted(ends, close + shift - begin))
            if close == len(text) or met < len(ends) and ends[met] == close + shift - begin:
                break
            last += 1
            close += int(self.chars[half + last])
        keep = len(lens) if close == len(text) else met + 1
        lens, tokens = lens[:keep], tokens[:keep]
        room = last - first + 1
        if len(lens) > room * GROWN * LEAF:
            # too much for these leaves: new ones take their place, nothing is counted again
            self.chars, self.tokens = (
                _sums(np.concatenate([old[half : half + first], _leaves(own, LEAF), old[half + last + 1 :]]))
                for old, own in ((self.chars, lens), (self.tokens, tokens))
            )
        else:
            parts = np.linspace(0, len(lens), room + 1).astype(int)
            held = [np.diff(np.concatenate([[0], np.cumsum(own)])[parts]) for own in (lens, tokens)]
            self._set(first, last, *held)
        return new, close + shift + 1 - begin


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = per_worker(("pieces", path), lambda: PieceCounts(path))
        for batch in batches:
            trees = [Tree.build(text.as_py() or "", counts) for text in batch.column(1)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.chars for t in trees], kind), pa.array([t.tokens for t in trees], kind)],
                names=["tree_key", "chars", "tokens"],
            )

    return run


def tree_key() -> Column:
    return F.xxhash64("doc_id", "text")


def build_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A tree per distinct row of ``docs`` (doc_id, text), to be stored by the caller."""
    run = _build(tokenizer or tokenizer_path("byte_bpe_50k.json"))
    return docs.select(tree_key().alias("tree_key"), "text").mapInArrow(run, TREE)


def _recount(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = per_worker(("pieces", path), lambda: PieceCounts(path))
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text, edits = batch.column(1)[i].as_py() or "", batch.column(2)[i].as_py() or []
                tree = Tree(*(np.array(batch.column(c)[i].values, np.int32) for c in (3, 4)))
                length, before, cut = len(text), tree.total, 0
                whole = [(e["start"] or 0, e["start"] or 0 if e["end"] is None else e["end"], e["insert"] or "") for e in edits if e]
                for start, end, insert in sorted(whole, reverse=True):
                    text, n = tree.edit(text, start, end, insert, counts)
                    cut += n
                rows.append((length, len(text), len(whole), cut, before, tree.total))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n_chars", "n_chars_edited", "n_edits", "n_chars_recut", "n_tokens", "n_tokens_edited"],
            )

    return run


def recount(docs: DataFrame, trees: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Counts of every row of ``docs`` (doc_id, text, edits) before and after its edits.

    ``edits`` is an array of (start, end, insert).  ``n_chars_recut`` is the text that was cut
    into pre-tokens again.
    """
    run = _recount(tokenizer or tokenizer_path("byte_bpe_50k.json"))
    one = trees.groupBy("tree_key").agg(F.any_value(F.struct("chars", "tokens")).alias("t"))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.col("edits").cast(f"array<{EDIT}>"), tree_key().alias("key"))
    joined = rows.join(one, F.col("key") == F.col("tree_key")).select("doc_id", "text", "edits", "t.chars", "t.tokens")
    return joined.mapInArrow(
        run, "doc_id bigint, n_chars bigint, n_chars_edited bigint, n_edits bigint, n_chars_recut bigint, n_tokens bigint, n_tokens_edited bigint"
    )


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Attach a table of edits (doc_id, start, end, insert) to the documents it names."""
    per = edits.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "end", "insert")).alias("edits"))
    return docs.select("doc_id", "text").join(per, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")


def revision(docs: DataFrame) -> DataFrame:
    """A revision of every document made from itself: its second quarter loses up to twelve
    characters, its middle gets the name of its source, its third quarter repeats its first words."""
    n = F.length(F.coalesce("text", F.lit("")))
    quarter = F.floor(n / 4).cast("bigint")

    def edit(start: Column, end: Column, insert: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), insert.alias("insert")).cast(EDIT)

    source = F.concat(F.lit(" "), F.coalesce("source", F.lit("")), F.lit(" "))
    edits = F.array(
        edit(quarter, quarter + F.least(quarter, F.lit(12)), F.lit("")),
        edit(2 * quarter, 2 * quarter, source),
        edit(3 * quarter, 3 * quarter, F.substring("text", 1, 20)),
    )
    return docs.select("doc_id", "text", edits.alias("edits"))


def count_revision(docs: DataFrame) -> DataFrame:
    """Build and store the trees of ``docs``, then count its revision through them."""
    return recount(revision(docs), stored(build_trees(docs), "trees"))
