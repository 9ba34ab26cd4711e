import random

import corpus_pipeline
from tests.llm.test_operators import prose


def test_near_copies_are_dropped_row_by_row(spark):
    """Rows with null or repeated ids are judged by their own text."""
    rng = random.Random(21)
    text = [prose(rng, 60) for _ in range(8)]
    near = text[3] + " tail"
    rows = [(3, text[3], "a"), (5, near, "b"), (5, text[0], "c"), (None, text[1], "d"), (None, text[2], "e"), (None, text[2] + " more", "f"), (None, near, "g"),
            (7, text[4], "h"), (7, text[4], "i"), (None, text[4], "j"), (8, text[5], "k"), (8, text[6], "l"), (9, "", "m"), (9, None, "n"), (None, "", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc_id_row string")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(r["doc_id_row"] for r in out.collect())
    assert len([x for x in kept if x in "ef"]) == len([x for x in kept if x in "hi"]) == 1
    assert [x for x in kept if x not in "efhi"] == list("acdklmno")
    assert sorted(r["doc_id_row"] for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(5), "").collect()) == kept
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0
