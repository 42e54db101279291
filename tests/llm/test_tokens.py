import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prodlake.llm import edit_counts, token_file
from prodlake.llm.tokens import WordEncoder, tokenizer_path
from prodlake.session import scratch_path

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
whole_words = Tokenizer.from_file(WORDS)
whole_bytes = Tokenizer.from_file(BYTES)
whole_bytes.encode_special_tokens = True
encoder, pieces = WordEncoder(WORDS), edit_counts.PieceCounts(BYTES)

texts = st.one_of(st.text(max_size=60), st.text(alphabet="aAiIJHẞßÀàÅåİŞǅé.,ñΣς \u0300\u0307\u0331\u030c", max_size=30), st.text(alphabet="aB .,'s!\n\t\x1cé日1<|endoftxENDOFTX>", max_size=60))


@settings(max_examples=300, deadline=None)
@given(texts)
def test_pieces_equal_the_whole(text):
    assert next(encoder.encode([text])).tolist() == whole_words.encode(text, add_special_tokens=False).ids
    assert int(pieces.cut(text)[1].sum()) == len(whole_bytes.encode(text, add_special_tokens=False).ids)


def test_letters_that_normalize_to_more_than_a_letter():
    """A letter and a mark behind it, for every letter whose normal form does not end with one."""
    normal = whole_words.normalizer.normalize_str
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha() and not normal(c)[-1:].isalpha()]
    assert "\u0130" in letters and "\u095c" in letters and len(letters) > 50
    texts = [f"a{c}{mark} b" for c in letters for mark in (".", ",", "!?")]
    got = [ids.tolist() for ids in encoder.encode(texts)]
    assert got == [e.ids for e in whole_words.encode_batch(texts, add_special_tokens=False)]
    assert pieces.cut("GELD\u0130.")[1].sum() == len(whole_bytes.encode("GELD\u0130.", add_special_tokens=False).ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 49407, 65535, 65536, 2**24, 2**32 - 1]), max_size=1500), st.data())
def test_code_gives_any_token(ids, data):
    code = token_file.Dac(token_file.dac_encode(np.array(ids, np.uint32)))
    assert len(code) == len(ids)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert code.read(a, b).tolist() == ids[a:b]
    for i in range(a, min(b, a + 20)):
        assert code[i] == ids[i]


def test_code_checks_its_input():
    with pytest.raises(ValueError):
        token_file.Dac(b"none at all")
    with pytest.raises(IndexError):
        token_file.Dac(token_file.dac_encode(np.array([], np.uint32)))[0]


@pytest.mark.parametrize("name", ["small", "edge", "clashing"])
def test_files_round_trip(name, request):
    docs = request.getfixturevalue(name)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for doc_id, text in rows:
        ids = np.array([*whole_words.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for options in ({}, {"segment": 100, "files": 3}):
        got = token_file.token_round_trip(docs, **options).orderBy("start").collect()
        assert [tuple(r) for r in got] == want


def test_random_access_to_files(spark, small):
    path = scratch_path(spark, "tokens")
    token_file.write_tokens(small, path, segment=500, files=2)
    first = small.orderBy("doc_id").limit(20).collect()
    ids = [i for r in first for i in [*whole_words.encode(r.text, add_special_tokens=False).ids, 2]]
    assert token_file.read_tokens(spark, path, 0, 0, 1500) == ids[:1500]
    assert token_file.read_tokens(spark, path, 0, 777, 1) == ids[777:778]


def test_empty_files(none):
    assert token_file.token_round_trip(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(texts, st.lists(st.tuples(st.integers(-3, 70), st.integers(-3, 70), texts), max_size=4))
def test_edits_equal_a_recount(text, edits):
    tree = edit_counts.Tree.build(text, pieces)
    for start, end, insert in edits:
        a = min(max(start, 0), len(text))
        want = text[:a] + insert + text[min(max(end, a), len(text)) :]
        text, _ = tree.edit(text, start, end, insert, pieces)
        assert text == want
        assert tree.total == len(whole_bytes.encode(text, add_special_tokens=False).ids)
        assert tree.chars[1] == len(text)


def test_a_small_edit_of_a_long_text_cuts_little():
    text = "some words and more of them. " * 5000
    tree = edit_counts.Tree.build(text, pieces)
    new, cut = tree.edit(text, 70_000, 70_003, "other", pieces)
    assert cut < 1000 and tree.total == len(whole_bytes.encode(new, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["small", "edge", "clashing"])
def test_revision_equals_a_recount(name, request):
    docs = request.getfixturevalue(name)

    def count(text):
        return len(whole_bytes.encode(text, add_special_tokens=False).ids)

    want = []
    for r in docs.collect():
        t = r.text or ""
        k = len(t) // 4
        new = t[:k] + t[k + min(k, 12) : 2 * k] + f" {r.source or ''} " + t[2 * k : 3 * k] + t[:20] + t[3 * k :]
        want.append((-1 if r.doc_id is None else r.doc_id, len(t), len(new), count(t), count(new)))
    got = edit_counts.count_revision(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.n_chars_edited, r.n_tokens, r.n_tokens_edited) for r in got) == sorted(want)


def test_edit_table_with_nulls(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "alone"), (None, "no id")], "doc_id bigint, text string")
    edits = spark.createDataFrame(
        [(1, 4, 7, "2"), (1, None, None, None), (1, 100, 3, "!"), (9, 0, 0, "lost")], "doc_id bigint, start bigint, end bigint, insert string"
    )
    trees = edit_counts.build_trees(docs)
    got = {r.doc_id: (r.n_edits, r.n_chars_edited) for r in edit_counts.recount(edit_counts.with_edits(docs, edits), trees).collect()}
    assert got == {1: (3, len("one 2 three!")), 2: (0, 5), None: (0, 5)}


def test_empty_edits(none):
    assert edit_counts.count_revision(none).count() == 0
