import zlib

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from prodlake.llm import decontaminate, mixing, outliers, simhash
from prodlake.llm.common import stored
from prodlake.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_equal_their_parts(spark):
    """Every stage against a plain form of what it decides; its input is its predecessor's output."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "benchmark_leaks", "mixing", "token_files"]

    good = stored(stages["quality"](spark, docs, SF), "t")
    kept = {r.doc_id for r in outliers.judge(docs).filter("kept").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == kept and good.count() == len(kept)

    single = stored(stages["near_duplicates"](spark, good, SF), "t")
    first = {r.component_id for r in simhash.near_duplicates(good).collect()}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == first and single.count() == len(first)

    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = stored(stages["benchmark_leaks"](spark, single, SF), "t")
    leaky = {r.doc_id for r in decontaminate.leaks(single, benchmark).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == first - leaky

    mixed = stored(stages["mixing"](spark, clean, SF), "t")
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    found = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == columns and found == copies

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    start, want = 0, []
    for doc_id, text in sorted((r.doc_id, r.text) for r in mixed.collect()):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in stages["token_files"](spark, mixed, SF).orderBy("start").collect()] == want
    assert [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()] == want


def test_stages_take_edge_rows(spark, edge, none):
    for docs in (edge, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, SF), "t")
            assert docs.columns == edge.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
