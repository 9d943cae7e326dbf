import random
import zlib

import numpy as np
import pytest

from quirelake.llm.piece_scan import MARK, Vocabulary, decoded, digests, encoded, model_path, product, states
from tests.llm.helpers import copies, table

V = Vocabulary(model_path())
TEXTS = [t or "" for t in copies(6)] + ["  a   b ", " ", "\n\n x", "thlyouble" * 30, "é" * 90, "a" * 200, "x" + " " * 70 + "y", "\x00\U0001f600 z", "internationalisation of the " * 9]


def best(text):
    """Weight of the heaviest segmentation, by plain recursion over places."""
    t, top = MARK + text.replace(" ", MARK), {0: 0}
    for i in range(len(t)):
        for j, w, _ in V.steps(t, i):
            top[j] = max(top.get(j, -(1 << 60)), top[i] + w)
    return top[len(t)]


def weight(ids):
    by_id = {i: w for i, w in V.pieces.values()}
    total, at = 0, 0
    while at < len(ids):
        if ids[at] in by_id:
            total, at = total + by_id[ids[at]], at + 1
        else:
            first = V.raw[ids[at]][0]
            total, at = total + V.unknown, at + (1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4)
    return total


@pytest.mark.parametrize("text", TEXTS)
def test_whole_texts(text):
    ids = V.encode(text)
    assert V.decode(ids) == text
    if text:
        assert weight(ids.tolist()) == best(text)


@pytest.mark.parametrize("chunk", [3, 17, 40])
def test_chunks_give_the_heaviest_path(chunk):
    for text in TEXTS:
        if not text:
            continue
        t = MARK + text.replace(" ", MARK)
        cuts = V.cuts(t, chunk)
        own = [(t[a:b], t[b : b + V.longest]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ms = [V.transfer(*x) for x in own]
        s = states(ms)
        ids = [x for (c, a), i, j in zip(own, s[:-1], s[1:], strict=True) for x in V.trace(c, a, i, j)]
        assert V.decode(np.array(ids)) == text and weight(ids) == best(text)
        total = ms[0]
        for m in ms[1:]:
            total = product(total, m)
        assert total[0, 0] == best(text)


def test_product_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(-99, 0, (3, 5, 5))
    assert (product(product(a, b), c) == product(a, product(b, c))).all()


def test_library_agrees_on_runs():
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(model_path(), "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = V.pieces[p.piece][1]
    library = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = random.Random(2)
    words = {w for t in TEXTS for w in t.split() if len(w) < 40} | {"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))) for _ in range(2000)}
    words = [w for w in words if all(c in V.pieces for c in w)]
    assert [V.encode(w).tolist() for w in words] == library.encode(words)
    assert library.decode(V.encode("it is  a test").tolist()) == "it is  a test"


@pytest.mark.parametrize("chunk", [20, 1 << 16])
def test_tables(spark, chunk):
    texts = [*TEXTS, None, "x " * 60, "x " * 60]
    ids = [None, 7, 7, *range(10, 7 + len(texts))]
    docs = table(spark, texts, ids, extra="1 as uid")
    rows = encoded(docs, model_path(), chunk)
    got = decoded(rows, model_path()).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.text) for r in got], key=key) == sorted([(i, t or "") for i, t in zip(ids, texts, strict=True)], key=key)
    assert all(weight(list(r.ids)) == best(r.text) for r in got if r.text)
    made = {(r.doc_id, r.n_pieces, r.ids_crc32) for r in digests(rows, model_path()).collect()}
    assert made == {(r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_empty(spark):
    assert encoded(table(spark, []), model_path()).collect() == []
