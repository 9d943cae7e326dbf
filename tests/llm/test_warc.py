import gzip
import hashlib
import io
import random

import pytest

from quirelake.llm.common import Scratch
from quirelake.llm.warc import chunk_table, chunked, parse, records, round_trip, write

PAGES = "page_id long, url string, html string"


def brute(rows):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, x in raw:
        if len(x) >= 1000:
            top[x] = max(top.get(x, i), i, key=lambda v: -1 if v is None else v)
    out = []
    for i, x in raw:
        again = len(x) >= 1000 and i != top[x]
        out.append((i, len(x), hashlib.sha1(x).hexdigest(), "revisit" if again else "response", top[x] if again else None))
    return sorted(out, key=str)


def pages():
    rng = random.Random(5)
    big = "é漢" * 3000
    rows = [(i, f"http://x/{i}\n", rng.choice([big, "a" * 999, "a" * 1000, "\r\n\r\n" * 400, "".join(rng.choice("<p>\r\n") for _ in range(rng.randint(0, 5000)))])) for i in range(60)]
    return rows + [(100, None, None), (101, "u", ""), (None, "n", big), (102, "u", "z" * 5000), (102, "u", "z" * 5000)]


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_round_trip(spark, chunk):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as n", "2 as sha").repartition(3)
    got = round_trip(df, chunk_bytes=chunk).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_chunks_and_files(spark):
    rows = pages()
    scratch = Scratch(spark, "t")
    manifest = write(chunked(records(spark.createDataFrame(rows, PAGES)), 500), scratch)
    table = chunk_table(manifest, chunk_bytes=500).where("page_id = 1").orderBy("chunk_no").collect()
    want = (rows[1][2]).encode()
    assert all(len(r.chunk) <= 500 for r in table)
    assert b"".join(r.chunk for r in table) in (want, b"")
    raw = b"".join(open(m.uri.removeprefix("file://"), "rb").read() for m in manifest.collect())
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") >= len(rows)
    assert sum(last for *_, last in parse(io.BytesIO(raw), 100)) == len(rows)


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], PAGES)).collect() == []
