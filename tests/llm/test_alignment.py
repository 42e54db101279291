import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prodlake.llm import alignment
from prodlake.llm.tokens import byte_alphabet, tokenizer_path

A = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
BYTE = {c: b for b, c in enumerate(byte_alphabet())}
NAMES = {i: bytes(BYTE[c] for c in t) if all(c in BYTE for c in t) else t.encode() for t, i in A.get_vocab().items()}

tokenizers = alignment.Tokenizers(tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))


def piece(i):
    spelled = B.id_to_piece(i)
    return bytes([int(spelled[3:5], 16)]) if B.is_byte(i) else spelled.replace("▁", " ").encode()


def tokens(text):
    """Both sides of a text as the libraries give them, or nothing."""
    if not text:
        return [], []
    a = [(i, NAMES[i]) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, piece(i)) for i in B.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(t for _, t in x) == whole for x in (a, b)) else ([], [])


def plain(text):
    """Groups of a text, and links by comparing every token of a group with every other."""
    sides = []
    for own in tokens(text):
        ends = np.cumsum([len(t) for _, t in own]).tolist()
        sides.append([(i, end - len(t), end) for (i, t), end in zip(own, ends, strict=True)])
    a, b = sides
    cuts = sorted({x[2] for x in a} & {x[2] for x in b})
    groups, links = [], []
    of_a, of_b = iter(a), iter(b)
    n_a, n_b = (Counter(cuts[bisect_left(cuts, e)] for _, _, e in x) for x in (a, b))
    for cut in cuts:
        one, other = ([next(x) for _ in range(n)] for x, n in ((of_a, n_a[cut]), (of_b, n_b[cut])))
        groups.append("|".join(",".join(str(i) for i, _, _ in x) for x in (one, other)))
        links += [(i, j) for i, s, e in one for j, s2, e2 in other if s < e2 and s2 < e]
    return len(a), len(b), groups, links


def brute(rows):
    found = [(doc_id, *plain(text)) for doc_id, text in rows]
    holding = Counter(pair for *_, links in found for pair in set(links))
    most = Counter()
    for (a, _), n in holding.items():
        most[a] = max(most[a], n)
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        best = sum(holding[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(holding[p] for p in links), digest))
    return sorted(out, key=repr)


characters = st.one_of(
    st.text(max_size=40), st.text(alphabet="aB .,'s!\n\t\x1c\x00é日1▁\xa0 　<|endoftxENDOFTX>0x41", max_size=60), st.text(alphabet="ab \n\t\r\x0b\x0c);,\xa0\u2003", max_size=25)
)


@settings(max_examples=600, deadline=None)
@given(characters)
@example(" ")
@example("  ")
@example("\n")
@example("a \n b  c\n\n")
@example("</s><s><unk> <|endoftext|> <0x0A>")
def test_stretches_equal_the_whole(text):
    if not text:
        return
    cut = alignment.stretches(" " + text)
    assert "".join(cut) == " " + text
    in_a, in_b = tokenizers.encode(cut)
    assert [i for ids in in_a for i in ids] == A.encode(" " + text, add_special_tokens=False).ids
    assert [i for ids in in_b for i in ids] == B.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 400)), st.sets(st.integers(1, 400)), st.integers(401, 500))
def test_cuts_are_the_shared_ends(a, b, end):
    a, b = (np.array(sorted([*x, end]), np.int64) for x in (a, b))
    in_a, in_b = alignment.shared_cuts(a, b)
    want = np.intersect1d(a, b)
    assert a[in_a].tolist() == want.tolist() == b[in_b].tolist()


def test_cutless_and_empty_intervals():
    odd, even = np.arange(1, 4001, 2), np.arange(2, 4002, 2)
    assert [x.tolist() for x in alignment.shared_cuts(np.append(odd, 5000), np.append(even, 5000))] == [[2000], [2000]]
    nothing = np.zeros(0, np.int64)
    assert [len(x) for x in alignment.shared_cuts(nothing, nothing)] == [0, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**34), max_size=300))
def test_numbers_come_back(numbers):
    assert alignment.unpack(alignment.pack(np.array(numbers, np.int64))).tolist() == numbers


@pytest.mark.parametrize("name", ["small", "edge", "clashing"])
def test_equals_brute_force(name, request):
    docs = request.getfixturevalue(name)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    for size in (alignment.BATCH, 500):
        got = alignment.alignments(docs, batch=size)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_a_pair_in_every_document(spark):
    """Repeated rows count as documents; the most frequent pair of an id leads."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("same words here")).otherwise(F.lit("same wordshere\n")).alias("text"))
    got = alignment.alignments(docs.repartition(7), batch=100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_nothing(none):
    assert alignment.alignments(none).count() == 0
