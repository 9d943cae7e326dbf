"""Odd titles and lines whose results once differed from the SQL twins."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.plans import matching, pagetexts, references
from tests.compare import plain, spark_rows

LINES = ["Cillmi of the long road", "Vi and others", "4537960215852590 is no number", "", None, "XIV. The end", "12 men", "Im Anfang war es", "3. Rivers", "Chapter 4: Roads"]


def same(spark, folder, part, name, texts):
    rows = [(i, t, "b", "en", len(t or "")) for i, t in enumerate(texts)]
    path = str(folder / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int").write.parquet(path)
    columns, got = spark_rows(part.QUERIES[name](spark, str(folder)))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    out = con.execute(part.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert columns == sorted(names)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
    return got


@pytest.mark.parametrize("name", ["chapter_numbers", "chapters_by_number"])
def test_numbers_of_titles(spark, tmp_path, name):
    assert len(same(spark, tmp_path, matching, name, [t for x in LINES for t in (x, *["filling text"] * 9)] * 3)) == 30


def test_share_of_letters(spark, tmp_path):
    # 55 of 100 characters are letters: the share is reached, not missed by a rounding
    assert any(r[1] for r in same(spark, tmp_path, pagetexts, "block_headings", ["x"] * 11 + ["A" * 55 + "%" * 40]))


def test_capitals_one_for_one(spark, tmp_path):
    same(spark, tmp_path, references, "garbled_blocks", ["x"] * 4 + ["Aupfber%%% der&&& des&&& üß%%% der&&& tzö&&& au%%% des.", "ßßßßßßßßß%%%%%%%%%%%", "ﬁnﬂ ŉ ᾳ ǆ straße" * 3] * 40)
    assert not {c for c in map(chr, range(0x110000)) if len(c.upper()) > 1} - set(T.SPREAD_LETTERS)
    letters = [*T.SPREAD_LETTERS, "aß", "ßa", "Straße ﬁn", "ŉ", "", None, "plain ǆ"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in letters], "s string").select(T.upper_each(F.col("s"))).collect()]
    assert got == [duckdb.execute("select upper(?::varchar)", [x]).fetchone()[0] for x in letters]
