import re

import corpus_pipeline
from quirelake.llm import language
from quirelake.llm.piece_scan import Vocabulary, model_path
from tests.llm.helpers import DOCS
from tests.llm.test_private_data import brute as private
from tests.llm.test_simhash import brute_components, brute_print
from tests.llm.test_winnowing import brute as contamination

SF = "/root/testdata/sf0.001"


def test_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    model = language.trained(docs.where(language.fold(docs) != 1))
    lang, score = model.predict([r.text for r in rows])
    rows = [r for r, x, s in zip(rows, lang, score, strict=True) if x != "und" and s >= 0.5]
    roots = brute_components([brute_print(r.text) for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r, x in zip(rows, contamination([r.text for r in rows], items), strict=True) if not x[4]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == [r.doc_id for r in rows]
    v = Vocabulary(model_path())
    for r in rows:
        text = got[r.doc_id].text
        assert v.encode(text).tolist() == list(got[r.doc_id].ids)
        assert not any(private(text).values())
        if not any(private(r.text).values()) and not re.search("<[A-Z]+>", text):
            assert text == r.text


def test_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []
    rows = [(1, "the and of it " * 20, "en", "s", None), (1, "the and of it " * 20, "en", "s", None), (None, "the and of that " * 9, "en", None, 3), (2, None, "en", "s", 0), (3, "", None, "s", 0), (4, "la de le que " * 9, "fr", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as th", "2 as score", "'x' as lang_pred")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [*"doc_id text lang source n_chars th score lang_pred".split()]
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "4", "None"]
