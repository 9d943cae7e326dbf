"""The registered queries on the test tables, and the pipeline, against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import sentencepiece as sp
from tokenizers import Tokenizer

import corpus_pipeline
from quirelake.llm import language, private_data, simhash, substring_dedup, suffix_dedup, token_planes
from quirelake.llm.piece_scan import model_path
from tests.llm.test_private_data import RULES
from tests.llm.test_private_data import brute as private
from tests.llm.test_simhash import brute_components, brute_print
from tests.llm.test_substring_dedup import brute as later_words
from tests.llm.test_token_planes import PATH
from tests.llm.test_winnowing import brute as contamination

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def repeated_bytes(texts, length):
    """(bytes, removed, runs, digest of the rest) by a count of all windows."""
    raw, count = [(t or "").encode() for t in texts], {}
    for x in raw:
        for i in range(len(x) - length + 1):
            count[x[i : i + length]] = count.get(x[i : i + length], 0) + 1
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(x)] > 0
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(x), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_byte_repeats(spark):
    rows = documents(spark)
    got = suffix_dedup.op1_suffix_dedup(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == repeated_bytes([r.text for r in rows], 200)


def test_word_repeats(spark):
    rows = documents(spark)
    got = substring_dedup.op2_debruijn_dedup(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == later_words([r.text for r in rows], 20)


def test_token_files(spark):
    library, at = Tokenizer.from_file(PATH), 0
    for r, x in zip(token_planes.op4_token_planes(spark, SF).orderBy("doc_id").collect(), documents(spark), strict=True):
        ids = np.array([*library.encode(x.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (x.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_fingerprints(spark):
    rows = documents(spark)
    prints = [brute_print(r.text) for r in rows]
    roots = brute_components(prints)
    got = simhash.op7_simhash_gph(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(r.doc_id, f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, roots, strict=True)]


def test_personal_data(spark):
    for r, x in zip(private_data.op9_boosted_pii(spark, SF).orderBy("doc_id").collect(), documents(spark), strict=True):
        want = private(x.text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in RULES)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in RULES for a, b in want[k]).encode()).hexdigest()


def near_copies(texts, words=5, least=0.8):
    """Root of each text, by the similarity of all pairs of sets of shingles."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    split = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    sets = [frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset() for w in split]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if split[i] == split[j] or (a and b and len(a & b) >= least * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_pipeline(spark):
    """Stage by stage: language, near copies at 0.8 on five-word shingles, contamination, redaction, the model's own ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.trained(docs.where(language.fold(docs) != 1))
    rows = documents(spark)
    lang, score = model.predict([r.text for r in rows])
    rows = [r for r, x, s in zip(rows, lang, score, strict=True) if x != "und" and s >= 0.5]
    roots = near_copies([r.text for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r, x in zip(rows, contamination([r.text for r in rows], items), strict=True) if not x[4]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == [r.doc_id for r in rows]
    library = sp.SentencePieceProcessor(model_file=model_path())
    for r in rows:
        text = got[r.doc_id].text
        assert library.encode(text) == list(got[r.doc_id].ids)
        assert not any(private(text).values())
        if not any(private(r.text).values()) and not re.search("<[A-Z]+>", text):
            assert text == r.text
