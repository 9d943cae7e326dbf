"""Book-shaped tables derived from the driver's tables by one deterministic rule, with the same rule as SQL.

A source is a book and its documents, in order, are the book's pages. Some lines get a note marker; notes follow by
fixed residues, so that orphans and distant notes occur. Every tenth page starts a chapter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.ordering import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, page_no, doc_id, text."""
    docs = table(spark, sf_dir, "documents")
    numbers = numbered(docs.select(F.col("source").alias("book"), "doc_id"), ["book"], "doc_id", "page_no")
    return numbers.join(docs.select("doc_id", "text"), "doc_id").select("book", "page_no", "doc_id", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, page_no, doc_id, k (place from 0), line; blank lines stay out."""
    p = pages(spark, sf_dir)
    return p.select("book", "page_no", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).where("line <> ''")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, page_no, k, marker: lines that carry a note marker, numbered through the book."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).where("line <> '' and (doc_id * 7 + k) % 5 = 0")
    numbers = numbered(docs.select("book", "doc_id", "k"), ["book"], "doc_id", "marker", block=1 << 10, then=("k",))
    page_of = numbered(table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id"), ["book"], "doc_id", "page_no")
    return numbers.join(page_of, ["book", "doc_id"]).select("book", "page_no", "k", "marker")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, marker, note_page: note definitions; each eleventh is missing, some stand one or two pages later."""
    a = anchors(spark, sf_dir).where("marker % 11 <> 0")
    shift = F.when(F.col("marker") % 13 == 0, 2).when(F.col("marker") % 13 == 1, 1).otherwise(0)
    return a.select("book", "marker", (F.col("page_no") + shift).alias("note_page"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, chapter_no, title, start_page, total_pages: every tenth page of a book starts a chapter."""
    p = pages(spark, sf_dir)
    total = p.groupBy("book").agg(F.max("page_no").alias("total_pages"))
    title = F.array_join(F.slice(F.filter(F.split(F.regexp_replace("text", "\n", " "), " "), lambda w: w != ""), 1, 6), " ")
    return p.where("page_no % 10 = 1").select("book", (F.floor(F.col("page_no") / 10) + 1).cast("int").alias("chapter_no"), title.alias("title"), F.col("page_no").alias("start_page")).join(total, "book")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contents() with the last page of each chapter."""
    return contents(spark, sf_dir).withColumn("end_page", F.least(F.col("start_page") + 9, F.col("total_pages")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, n, s: lines dressed as notes, references, headings and lists, by residue of doc_id + k."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).where("line <> ''")
    n = ((F.col("doc_id") * 3 + F.col("k")) % 120).cast("int")
    d = d.withColumn("n", n)
    line, num, r = F.col("line"), F.col("n").cast("string"), (F.col("doc_id") + F.col("k")) % 12
    c = F.concat
    forms = [
        c(line, F.lit(" [^"), num, F.lit("]")), c(line, F.lit(" $^{"), num, F.lit("}$")), c(line, F.lit("^{"), num, F.lit("}")), c(line, F.lit("<sup>"), num, F.lit("</sup>")),
        c(num, F.lit(". "), line), c(F.lit("["), num, F.lit("] "), line), c(F.lit("## "), line), c(F.lit("Chapter "), num, F.lit(": "), line),
        c(line, F.lit(" ²³")), F.lit("NOTES"), c(F.lit("* "), line), c(line, F.lit(" ["), num, F.lit("]")),
    ]
    s = forms[-1]
    for i in range(10, -1, -1):
        s = F.when(r == i, forms[i]).otherwise(s)
    return d.select("doc_id", "k", "n", s.alias("s"))


#: The same tables as DuckDB common table expressions; a query starts with `with` and the ones it needs.
SQL = {
    "pg": "pg as (select source as book, (row_number() over (partition by source order by doc_id))::int as page_no, doc_id, text from documents)",
    "ln": "ln as (select * from (select book, page_no, doc_id, unnest(range(len(string_split(text, chr(10))))) ::int as k, unnest(string_split(text, chr(10))) as line from pg) where line <> '')",
    "an": "an as (select book, page_no, k, (row_number() over (partition by book order by doc_id, k))::int as marker from ln where (doc_id * 7 + k) % 5 = 0)",
    "nt": "nt as (select book, marker, page_no + case when marker % 13 = 0 then 2 when marker % 13 = 1 then 1 else 0 end as note_page from an where marker % 11 <> 0)",
    "ct": "ct as (select book, (page_no // 10 + 1)::int as chapter_no, array_to_string(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '')[1:6], ' ') as title, page_no as start_page, total_pages from pg join (select book, max(page_no) as total_pages from pg group by book) using (book) where page_no % 10 = 1)",
    "ch": "ch as (select *, least(start_page + 9, total_pages) as end_page from ct)",
    "sm": """sm as (select doc_id, k, n, case (doc_id + k) % 12 when 0 then line || ' [^' || n || ']' when 1 then line || ' $^{' || n || '}$' when 2 then line || '^{' || n || '}'
      when 3 then line || '<sup>' || n || '</sup>' when 4 then n || '. ' || line when 5 then '[' || n || '] ' || line when 6 then '## ' || line when 7 then 'Chapter ' || n || ': ' || line
      when 8 then line || ' ²³' when 9 then 'NOTES' when 10 then '* ' || line else line || ' [' || n || ']' end as s
      from (select doc_id, k, line, ((doc_id * 3 + k) % 120)::int as n from (select doc_id, unnest(range(len(string_split(text, chr(10)))))::int as k, unnest(string_split(text, chr(10))) as line from documents) where line <> ''))""",
}
_NEEDS = {"pg": "", "ln": "pg", "an": "pg ln", "nt": "pg ln an", "ct": "pg", "ch": "pg ct", "sm": ""}


def sql(tables: str, body: str) -> str:
    """body after the named tables' expressions."""
    names: list[str] = []
    for t in tables.split():
        names += [x for x in [*_NEEDS[t].split(), t] if x not in names]
    order = [x for x in SQL if x in names]
    more = body.lstrip()
    head = "with " + ",\n".join(SQL[x] for x in order)
    return f"{head},\n{more[5:]}" if more.lower().startswith("with ") else f"{head}\n{more}"
