"""Every language of the table is learned, however many there are."""

import random
import string

from alertloom.llm import language


def test_70_languages(spark):
    rnd, rows = random.Random(4), []
    for k in range(70):
        words = ["".join(rnd.choices(string.ascii_lowercase, k=5)) for _ in range(30)]
        rows += [(100 * k + i, f"l{k:02}", " ".join(rnd.choices(words, k=60))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    model = language.fit(docs)
    assert len(model.languages) == 70 and model.slots.shape == (2, 1 << language.SLOT_BITS)
    got = language.annotate(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred <> lang").count() == 0 and got.select("lang_pred").distinct().count() == 70
