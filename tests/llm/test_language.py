import zlib

import numpy as np
import pytest

from quirelake.llm.language import BITS, ORDERS, Model, _letters, features, fold, op10_ftrl_language, predicted, trained
from tests.llm.helpers import DOCS, table

SF = "/root/testdata/sf0.001"


def hashed(text):
    """n-gram hashes of one text, one by one."""
    chars, out = [int(_letters()[ord(c)]) for c in text], []
    for n in ORDERS:
        for i in range(len(chars) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x01000193 + (chars[i + k] + k + 1) * 0x9E3779B1) % (1 << 32)
            out.append(((h ^ (h >> 15)) * 0x85EBCA6B % (1 << 32)) >> (32 - BITS))
    return sorted(out)


def test_features():
    texts = ["Äb c", "", "x", "漢字 1!", "ab" * 20]
    for _, f, row, has in features(texts):
        assert [sorted(f[row == i].tolist()) for i in range(len(texts))] == [hashed(t) for t in texts]
        assert has.tolist() == [True, False, True, True, True]


def test_held_out_accuracy(spark):
    got = op10_ftrl_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert np.mean(held) >= 0.95


def test_edges(spark):
    docs = table(spark, ["aa bb", "aa bb", None, "", "12 !", "x" * 3000], [1, 1, 2, None, 4, 5], extra="'q' as score")
    model = trained(docs)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in predicted(docs, model).collect()}
    assert [got[k][0] for k in ((1, "aa bb"), (2, None), (None, ""), (4, "12 !"))] == ["en", "und", "und", "und"]
    assert got[4, "12 !"][1] == 0
    nothing = trained(spark.createDataFrame([], DOCS))
    assert nothing.langs == [] and {r.lang_pred for r in predicted(docs, nothing).collect()} == {"und"}
    assert predicted(spark.createDataFrame([], DOCS), model).collect() == []
    assert [r[0] for r in docs.select(fold(docs)).where("doc_id is null").collect()] == [0]


@pytest.mark.parametrize("texts", [["a"], ["é" * 10, ""]])
def test_scores_do_not_depend_on_the_batch(texts):
    rng = np.random.default_rng(1)
    model = Model(["a", "b"], np.ones(1 << BITS), rng.normal(size=(1 << BITS, 2)), np.zeros(2))
    alone = [model.predict([t]) for t in texts]
    both = model.predict(texts)
    assert [x[0][0] for x in alone] == both[0] and [x[1][0] for x in alone] == pytest.approx(both[1])
