"""Queries on books and lines beyond the sizes of the smallest table."""

from quirelake import catalogue
from tests.compare import duck_rows, spark_rows


def test_greedy_note_pairs_past_page_214(spark):
    sf = "/root/testdata/sf0.1"
    assert spark_rows(catalogue.QUERIES["greedy_note_pairs"](spark, sf)) == duck_rows(catalogue.ORACLE_SQL["greedy_note_pairs"], sf)
