import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirelake.llm.common import Scratch
from quirelake.llm.token_planes import Encoder, documents, planes, unplaned, write
from tests.llm.helpers import copies, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", " x", "x ", "it's a\n\n b\n c", "   a", "a  b", "漢 字 😀 x", "<|endoftext|> a", "a\t b \tc", "１ ٣ 4", "'s 're", "a ́b", "x　 y", "don't  stop", " ", "\n", "a\r\n b", "é à ß ÿ", "a \x00b", "a ​b", "a \x85b \x1cb"]


def test_pieces_give_the_library_ids():
    library, own = Tokenizer.from_file(PATH), Encoder(PATH, most=300)
    texts = [t or "" for t in copies(3)] + ODD
    for _ in range(2):
        assert [x.tolist() for x in own.batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1001, dtype=np.uint32)
    assert (unplaned(planes(ids, bits), 1001) == ids).all()


@pytest.mark.parametrize(("bits", "block"), [(False, 1 << 16), (True, 64), (False, 7)])
def test_against_library(spark, bits, block):
    texts = copies(4) + ODD
    ids = [None, *range(10, 9 + len(texts))]
    got = documents(write(table(spark, texts, ids, extra="1 as part").orderBy(F.rand(1)), Scratch(spark, "t"), PATH, block=block, bits=bits)).collect()
    got.sort(key=lambda r: -1 if r.doc_id is None else r.doc_id)
    library, at = Tokenizer.from_file(PATH), 0
    for r, i, t in zip(got, ids, texts, strict=True):
        x = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)


def test_empty_and_repeated_rows(spark):
    assert documents(write(table(spark, []), Scratch(spark, "t"), PATH)).collect() == []
    got = documents(write(table(spark, ["b", "a a", None], [1, 1, 1]), Scratch(spark, "t"), PATH)).orderBy("start").collect()
    assert [(r.start, r.n_tokens) for r in got] == [(0, 1), (1, 3), (4, 2)]


def test_random_texts_give_the_library_ids():
    rng, library, own = random.Random(5), Tokenizer.from_file(PATH), Encoder(PATH, most=20_000)
    abc = ["a", "the", "Z", "7", "42", "'", "'s", "'re", ".", "((", "-", " ", "  ", "\n", "\t", "\r\n", "\x0b", "é", "漢", "😀", " ", " ", "　", "᠎", "﻿", "​", "\x00", "\x1c", "\x7f", "\x85", "́", "²", "١", "<|endoftext|>"]
    for _ in range(40):
        texts = ["".join(rng.choices(abc, k=rng.randint(0, 40))) for _ in range(100)]
        assert [x.tolist() for x in own.batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_very_long_texts():
    library, own = Tokenizer.from_file(PATH), Encoder(PATH)
    texts = ["it is 4 o'clock. " * 60_000, "word" * 20_000, "漢字" * 20_000, "\n" * 9999]
    assert [x.tolist() for x in own.batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
