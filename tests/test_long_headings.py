from quirelake import catalogue
from tests.compare import duck_rows, spark_rows
from tests.test_large_lines import folder


def test_headings_that_differ_after_a_million_characters(spark, tmp_path):
    heading = lambda end: "x" * 1_000_001 + end
    # lines with (doc_id + k) % 12 = 6 become headings: k = 5 and 17 of document 1
    sf = folder(tmp_path, ["\n".join(heading("a") if k == 5 else heading("b") if k == 17 else "y" for k in range(18))])
    got = spark_rows(catalogue.QUERIES["duplicate_headings"](spark, sf))
    assert got == duck_rows(catalogue.ORACLE_SQL["duplicate_headings"], sf)
