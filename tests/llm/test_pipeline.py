"""The pipeline against a plain version of each stage, on its own input."""

import brute
import corpus_pipeline
from alertloom.llm.tables import materialize, read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = materialize(stage(spark, docs, SF), "test")
        seen.append((name, before, docs))
        assert name == "encoding" or docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    failed = {r[0] for r in brute.op6(seen[0][1]) if r[6]}
    assert ids(seen[0][2]) <= {i for i, _ in seen[0][1]} - failed
    assert ids(seen[1][2]) == {c for _, _, c in brute.op8(seen[1][1])}
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    assert ids(seen[2][2]) == {r[0] for r in brute.op7(seen[2][1], items) if not r[5]}
    assert ids(seen[3][2]) == {i for i, _ in seen[3][1]}
    clean = [(r["doc_id"], r["text"]) for r in seen[3][2].collect()]
    assert all(n == (0, 0, 0) for _, *n, _ in [(r[0], tuple(r[1:4]), r[4]) for r in brute.op4(clean)] for n in n)
    assert ids(seen[4][2]) == {i for i, _ in clean}
    assert corpus_pipeline.run(spark, SF).count() == len(clean)
