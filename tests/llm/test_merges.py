import zlib

import numpy as np
import pytest
import sentencepiece as sp

import corpus_pipeline
from quirelake.llm import piece_scan
from quirelake.llm.piece_scan import Merges, encoded, model_path
from tests.llm.helpers import table
from tests.llm.test_piece_scan import TEXTS

LIBRARY = sp.SentencePieceProcessor(model_file=model_path())
LONG = [*TEXTS, "the " * 200, "ab" * 300, "é漢" * 200, "=" * 300, " " * 300, "thequickbrown" * 40, "▁ ▁x"]


def test_whole_texts_have_the_models_own_ids():
    v = Merges(model_path())
    assert [x.tolist() for x in v.encode_all(LONG)] == LIBRARY.encode(LONG)
    for t in LONG:
        cuts = v.cuts(t := piece_scan.MARK + t.replace(" ", piece_scan.MARK), 20)
        parts = [t[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert b"".join(map(v.joined, parts)) == v.joined(t)


@pytest.mark.parametrize("chunk", [20, 1 << 16])
def test_giant_texts_have_the_same_ids(spark, chunk):
    docs = table(spark, [*LONG, None])
    got = {r.doc_id: r for r in encoded(docs, model_path(), chunk, decode=True, merges=True).collect()}
    assert [list(got[i].ids) for i in range(len(LONG) + 1)] == [*LIBRARY.encode(LONG), []]
    assert [got[i].text for i in range(len(LONG))] == [t.replace(piece_scan.MARK, " ") for t in LONG]


def test_query_and_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: LIBRARY.encode(r.text or "") for r in docs.collect()}
    made = {r.doc_id: (r.n_pieces, r.ids_crc32) for r in piece_scan.op8_piece_scan(spark, sf).collect()}
    assert made == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.tokenise(spark, docs, sf).collect()} == want


def test_store_is_bounded_and_long_texts_agree(spark, monkeypatch):
    monkeypatch.setattr(piece_scan, "KEPT_BYTES", 5_000)
    v = Merges(model_path())
    texts = ["é漢" * 300, "one two three " * 50, "漢" * 700, "=" * 600] * 2
    for _ in range(3):
        assert [x.tolist() for x in v.encode_all(texts)] == LIBRARY.encode(texts)
        assert all(len(r) <= 256 or r in v.long for r in v.store)
    giant = "It is a long text of words. " * 8_000  # beyond two chunks of the real size
    rows = encoded(table(spark, [giant, giant]), model_path(), merges=True, decode=True).collect()
    assert [list(r.ids) for r in rows] == [LIBRARY.encode(giant)] * 2 and rows[0].text == giant
