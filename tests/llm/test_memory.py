"""What tasks hold for each byte of text, by the allocations that numpy reports."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from alertloom.llm import bpe, decontaminate, runs, suffixes, tokens
import public_tokenizers


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def texts(n_bytes):
    rnd = random.Random(5)
    return [" ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) for _ in range(300)) for _ in range(n_bytes // 1950)]


def test_strings_of_a_run_are_held_narrow():
    column = pa.array(texts(3 << 20))
    run = suffixes.Run(pa.table({"run": pa.array([0] * len(column), pa.int32()), "doc_id": pa.array(range(len(column)), pa.int64()), "text": column}))
    everywhere = np.ones(len(run.anchor_hashes()), bool)
    run.study(everywhere)
    assert peak(lambda: run.study(everywhere)) < 60 * column.nbytes


def test_anchors_of_a_run_fill_all_buckets():
    column = pa.array(texts(1 << 20))
    run = suffixes.Run(pa.table({"run": pa.array([0] * len(column), pa.int32()), "doc_id": pa.array(range(len(column)), pa.int64()), "text": column}))
    hashes = run.anchor_hashes()
    assert (np.diff(hashes.astype(object)) > 0).all()
    in_bucket = np.diff(runs.by_bucket(hashes, 28))
    assert in_bucket.max() < 1.2 * len(hashes) / 28


def test_short_elements_are_hashed_in_steps():
    rnd = random.Random(6)
    elements = sorted((bytes(rnd.choices(b"abcd", k=100)), b"") for _ in range(20_000))
    blocks = [(suffixes.front_code(elements), len(elements))] * 2
    flags = []
    assert peak(lambda: flags.extend(suffixes.compare(blocks))) < 32 << 20
    assert [np.unpackbits(np.frombuffer(f, np.uint8))[:len(elements)].sum() for f in flags] == [0, len(elements)]


def test_words_of_a_run_are_held_narrow():
    column = pa.array(texts(3 << 20)).cast(pa.large_binary())
    cutter = bpe.Cutter(public_tokenizers.PATTERN)
    bpe._words(column, cutter)
    assert peak(lambda: bpe._words(column, cutter)) < 12 * column.nbytes


def test_distinct_words_of_a_run_are_found_piece_by_piece():
    column = pa.array(texts(3 << 20)).cast(pa.large_binary())
    cutter = bpe.Cutter(public_tokenizers.PATTERN)
    data, (starts, ends), hashes, back, first = bpe._words(column, cutter)
    assert (hashes[1:] > hashes[:-1]).all()
    assert (tokens.word_hashes(data, starts, ends) == hashes).all()
    words = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    for i in (0, 1, len(column) // 2, len(column) - 1):
        assert b"".join(words[k] for k in back[first[i]:first[i + 1]].tolist()) == column[i].as_py()
    few = pa.array(texts(1 << 17) * 24).cast(pa.large_binary())   # a run repeats most of its words
    assert peak(lambda: bpe._words(few, cutter)) < 5 * few.nbytes


def test_hits_of_one_block_need_one_python_task(spark, capsys):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "x y")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "A b c d e f g h i j k l m"), (8, "y")], "item_id bigint, text string")
    found = decontaminate.search(docs, items)
    found.explain()
    assert "EvalPython" not in capsys.readouterr().out
    assert sorted((r["doc_id"], r["n_hit"], r["items"]) for r in found.collect()) == [(1, 13, ["7"]), (2, 1, ["8"])]


def test_hits_are_the_same_in_several_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (None, "x y a"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "A b c d e f g h i j k l m"), (8, "y"), (8, "x"), (None, "n"), (9, None)], "item_id bigint, text string")

    def rows():
        return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], sorted(r["items"]), r["items_sha256"], r["contaminated"])
                      for r in decontaminate.search(docs, items).collect())

    once = rows()
    monkeypatch.setattr(decontaminate, "BLOCK", 1)
    assert rows() == once


def test_batches_of_the_pipeline_are_bounded_in_bytes(spark, monkeypatch):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    held = {n: spark.conf.get(n) for n in names}
    monkeypatch.setattr(corpus_pipeline, "read", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.quality, "keep", lambda docs, _: docs)
    docs = spark.range(0, 400, 1, 1).selectExpr("id doc_id", "repeat('some words of a text ', 5000) text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    try:
        seen = corpus_pipeline.quality_rules(spark, docs, "").mapInArrow(sizes, "rows bigint, size bigint").collect()
    finally:
        for n, v in held.items():
            spark.conf.set(n, v)
    assert sum(r["rows"] for r in seen) == 400
    assert max(r["size"] for r in seen) < corpus_pipeline.BATCH_BYTES + 300_000


def test_ranks_are_not_in_the_plan(spark, capsys):
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    bpe.encode(docs).explain(True)
    assert len(capsys.readouterr().out) < 100_000
