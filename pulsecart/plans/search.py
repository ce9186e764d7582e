"""Document-search queries over the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsecart.operators import search as S
from pulsecart.operators.sketches import merged_terms, term_sketches
from pulsecart.plans.settings import BRAND, KEYWORD
from pulsecart.sources import adapters
from pulsecart.sources.index import hits
from pulsecart.sources.postings import Postings
from pulsecart.sources.ranked_pages import RankedPages
from pulsecart.sources.tables import read_table
from pulsecart.workspace import materialise, run_folder

INDEX = "parts"
OR_WORDS = "ring Bolt"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.documents(read_table(spark, sf, "part"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return S.matching(_documents(spark, sf), terms={"brand": BRAND}, match={"name": KEYWORD})


def search_terms_max(spark, sf):
    return S.top_terms(_found(spark, sf), "kind", metric="size", size=10)


def search_top_sizes(spark, sf):
    return S.top_terms(_documents(spark, sf), "size", size=10)


def search_total(spark, sf):
    return S.total_hits(_found(spark, sf))


def search_hits_page(spark, sf):
    shown = S.slice_hits(_found(spark, sf), [F.col("_id").cast("bigint")], start=0, size=2)
    return hits(INDEX, shown).select("_index", "_type", "_id", "_source.*")


def search_match_any(spark, sf):
    return S.matching(_documents(spark, sf), match={"name": OR_WORDS}).select("_id", "name")


def search_match_postings(spark, sf):
    """The same from a stored inverted index, kept up over three batches: all parts with another part's name first,
    then odd ones and even ones with their own."""
    folder = run_folder(spark, "postings")
    postings, parts = Postings(spark, folder), _documents(spark, sf)
    odd = F.col("_id").cast("bigint") % 2 == 1
    for batch, rows in enumerate((parts.withColumn("name", F.reverse("name")), parts.where(odd), parts.where(~odd))):
        postings.upsert(rows, "name", "parts", batch)
    return postings.matching(parts, OR_WORDS).select("_id", "name")


def search_sizes_merged(spark, sf):
    """The top sizes from one stored summary for each brand, merged; exact, as there are few sizes."""
    sketches = materialise(term_sketches(_documents(spark, sf), ["brand"], "size"), "sketches")
    return merged_terms(sketches, size=10).select(F.col("item").alias("size"), "doc_count")


DEEP_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]
DEEP_PAGE, DEEP_SIZE, DEEP_RANGES = 1000, 5, 16


def search_deep_pages(spark, sf):
    """A deep page of all order lines from places in ranges, and the one after it from the last key of that page."""
    lines = read_table(spark, sf, "lineitem").select(*DEEP_ORDER, "l_partkey")
    pages = RankedPages(spark, f"{run_folder(spark, 'pages')}/lines").write(lines, DEEP_ORDER, DEEP_RANGES)
    shown = pages.page(DEEP_PAGE, DEEP_SIZE)
    rows = shown.collect()  # one page
    named = lambda rows, page: rows.select(F.lit(page).cast("int").alias("page"), *DEEP_ORDER[1:], "l_partkey")
    if not rows:
        return named(shown, DEEP_PAGE)
    following = S.after(lines, DEEP_ORDER, [rows[-1][c] for c in DEEP_ORDER], DEEP_SIZE)
    return named(shown, DEEP_PAGE).unionByName(named(following, DEEP_PAGE + 1))


QUERIES = {
    "search_sizes_merged": search_sizes_merged,
    "search_deep_pages": search_deep_pages,
    "search_terms_max": search_terms_max,
    "search_top_sizes": search_top_sizes,
    "search_total": search_total,
    "search_hits_page": search_hits_page,
    "search_match_any": search_match_any,
    "search_match_postings": search_match_postings,
}

_FOUND = f"""WITH found AS (
  SELECT * FROM part WHERE p_brand = '{BRAND}'
    AND list_contains(regexp_split_to_array(lower(p_name), '\\W+'), '{KEYWORD}'))"""

SQL = {
    "search_terms_max": f"""{_FOUND} SELECT p_type AS kind, count(*) AS doc_count, max(p_size) AS max_size
        FROM found GROUP BY p_type ORDER BY doc_count DESC, kind LIMIT 10""",
    "search_top_sizes": """SELECT p_size AS size, count(*) AS doc_count FROM part
        GROUP BY p_size ORDER BY doc_count DESC, size LIMIT 10""",
    "search_total": f"{_FOUND} SELECT count(*) AS total FROM found",
    "search_hits_page": f"""{_FOUND} SELECT '{INDEX}' AS _index, '_doc' AS _type,
        p_partkey::VARCHAR AS _id, p_brand AS brand, p_name AS name, p_type AS kind, p_size AS size
        FROM found ORDER BY p_partkey LIMIT 2""",
    "search_match_any": """SELECT p_partkey::VARCHAR AS _id, p_name AS name FROM part
        WHERE list_has_any(regexp_split_to_array(lower(p_name), '\\W+'), ['ring', 'bolt'])""",
}
SQL["search_sizes_merged"] = SQL["search_top_sizes"]
SQL["search_deep_pages"] = f"""SELECT ({DEEP_PAGE} + (n - 1) // {DEEP_SIZE})::INT AS page, l_orderkey, l_linenumber, l_partkey FROM (
    SELECT *, row_number() OVER () AS n FROM (SELECT * FROM lineitem ORDER BY {", ".join(DEEP_ORDER)}
    LIMIT {2 * DEEP_SIZE} OFFSET {(DEEP_PAGE - 1) * DEEP_SIZE}))"""
SQL["search_match_postings"] = SQL["search_match_any"]
