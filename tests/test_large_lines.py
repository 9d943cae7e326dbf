"""Documents of very many lines."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quirelake import catalogue
from tests.compare import TABLES, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


def folder(tmp_path, texts):
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    rows = {"doc_id": list(range(1, len(texts) + 1)), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": [len(x) for x in texts]}
    schema = pq.read_schema(f"{SF}/documents.parquet")
    pq.write_table(pa.table(rows).select(schema.names).cast(schema), tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["note_link_summary", "note_link_rows", "orphan_anchors"])
def test_more_than_100_000_lines(spark, tmp_path, name):
    sf = folder(tmp_path, ["a\n" * 230_000, "b\n" * 70_000, "c\nd\n" * 30])
    assert spark_rows(catalogue.QUERIES[name](spark, sf)) == duck_rows(catalogue.ORACLE_SQL[name], sf)


def test_many_paragraphs(spark):
    """4000 paragraphs that come as blocks, too: keys of all were made anew for each."""
    import time

    from quirelake.functions import pages as P

    text = "\n\n".join(f"Paragraph {i % 2500} of a long page of text" for i in range(4000))
    df = spark.createDataFrame([(text,), (None,)], "t string")
    blocks = F.transform(F.split("t", "\n\n"), lambda x: F.struct(F.lit("text").alias("label"), F.upper(x).alias("text")))
    began = time.perf_counter()
    got = [r.p for r in df.select(P.body_paragraphs(F.col("t"), blocks).alias("p")).collect()]
    assert time.perf_counter() - began < 20
    assert [x.text for x in got[0]] == [f"Paragraph {i} of a long page of text" for i in range(2500)] and {x.source for x in got[0]} == {"markdown"}
    assert got[1] == []
