"""Sale-detail queries over orders, lineitem, part, customer and nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsecart.operators import sales as SD
from pulsecart.operators import search as S
from pulsecart.functions import gender_label, price, within_days
from pulsecart.plans.settings import AS_OF, SALE_DAY, SALE_WORD, TOLERANCE
from pulsecart.schemas import USER_INFO
from pulsecart.sources import adapters
from pulsecart.sources.snapshot import BucketedSnapshot
from pulsecart.sources.tables import read_table
from pulsecart.workspace import materialise, run_folder

PAGE_NUMBER, PAGE_SIZE = 2, 5


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.order_info(read_table(spark, sf, "orders"))


def _details(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.order_detail_keys(read_table(spark, sf, "lineitem"))


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.user_info(read_table(spark, sf, "customer"))


def with_product_fields(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """Product fields for the few pairs the interval join leaves, not for every detail."""
    named = adapters.with_product(pairs, part, "d_sku_id")
    return named.withColumnsRenamed({"sku_name": "d_sku_name", "order_price": "d_order_price"})


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return SD.pair_within(_orders(spark, sf), _details(spark, sf), TOLERANCE)


def _sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sale details without the user."""
    return SD.wide_rows(with_product_fields(_pairs(spark, sf), read_table(spark, sf, "part")))


def _unnamed(spark: SparkSession, sf: str) -> DataFrame:
    """Sale details without user and product, for results that need neither or only few of them."""
    none = F.lit(None).cast("string")
    return SD.wide_rows(_pairs(spark, sf).withColumns({"d_sku_name": none, "d_order_price": none}))


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return SD.with_user(_sales(spark, sf), _users(spark, sf), AS_OF)


def sale_detail_interval(spark, sf):
    return _sales(spark, sf)


def sale_detail_full_outer(spark, sf):
    pairs = SD.pairs_and_alone(_orders(spark, sf), _details(spark, sf), TOLERANCE)
    return pairs.select(
        F.col("o_id").alias("order_id"),
        F.col("d_id").alias("order_detail_id"),
        F.col("d_order_id").alias("detail_order_id"),
    )


def sale_detail_unmatched(spark, sf):
    return SD.unmatched(_orders(spark, sf), _details(spark, sf), TOLERANCE)


def sale_detail_enriched(spark, sf):
    return _enriched(spark, sf)


def sale_gender_split(spark, sf):
    split = SD.gender_split(SD.with_user(_unnamed(spark, sf), _users(spark, sf), AS_OF))
    return split.withColumn("label", gender_label("user_gender"))


def sale_age_bands(spark, sf):
    return SD.age_split(SD.with_user(_unnamed(spark, sf), _users(spark, sf), AS_OF))


def sale_by_keyword(spark, sf):
    """The day is a range on the raw times, so it reaches both scans: a detail of an order of the
    day lies within the tolerance of it."""
    orders = read_table(spark, sf, "orders").filter(within_days("o_orderdate", SALE_DAY, SALE_DAY))
    reach = F.expr(f"interval {TOLERANCE}")
    day = F.lit(SALE_DAY).cast("timestamp")
    near = F.col("l_shipdate").between(day - reach, day + F.expr("interval 1 day") + reach)
    lines = read_table(spark, sf, "lineitem").filter(near)
    pairs = SD.pair_within(adapters.order_info(orders), adapters.order_detail_keys(lines), TOLERANCE)
    sales = SD.wide_rows(with_product_fields(pairs, read_table(spark, sf, "part")))
    return S.sales_of(sales, SALE_DAY, SALE_WORD).select("order_detail_id", "sku_name", "dt")


def sale_page(spark, sf):
    """The page is taken first, as its order needs neither product nor user; then its rows get both."""
    found = S.page(_unnamed(spark, sf), ["dt", "order_detail_id"], PAGE_NUMBER, PAGE_SIZE)
    named = adapters.with_product(found.drop("sku_name", "sku_price"), read_table(spark, sf, "part"))
    return SD.with_user(named.withColumn("sku_price", price("order_price")), _users(spark, sf), AS_OF)


def sale_day_lookup(spark, sf):
    """Sale details of one day, with their buyers looked up in a snapshot in buckets."""
    snapshot = BucketedSnapshot(spark, run_folder(spark, "users"), USER_INFO, buckets=1024)
    snapshot.write(_users(spark, sf), "users", 0)
    sales = materialise(S.sales_of(_sales(spark, sf), SALE_DAY), "day")
    return SD.with_user(sales, snapshot.of_batch(sales, "user_id"), AS_OF)


def gmv_by_date(spark, sf):
    return SD.gross_value(_orders(spark, sf))


def gmv_by_hour(spark, sf):
    """Order dates carry no time of day here; the hour comes from the key."""
    hour = F.make_dt_interval(hours=F.pmod(F.col("o_orderkey"), F.lit(24)).cast("int"))
    orders = read_table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate") + hour)
    return SD.gross_value(adapters.order_info(orders), hourly=True)


def _by_province(spark, sf):
    buyers = read_table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.col("c_nationkey").cast("string").alias("province_id")
    )
    provinces = read_table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("province_id"), F.col("n_name").alias("province")
    )
    return SD.by_province_of_buyer(_orders(spark, sf), buyers, provinces)


def sales_by_province(spark, sf):
    return _by_province(spark, sf)


def sales_value_bands(spark, sf):
    """Provinces with the legend band of their order count. The widths follow from the largest province, so bands tell provinces apart at any size."""
    counts = _by_province(spark, sf).select("province", "orders")
    top = F.max("orders").over(Window.partitionBy())  # one row per province
    ranked = counts.withColumn("share", F.col("orders") / top * (SD.BANDS * SD.BAND_WIDTH))
    return SD.with_value_band(ranked, "share").drop("share")


QUERIES = {
    "sale_detail_interval": sale_detail_interval,
    "sale_detail_full_outer": sale_detail_full_outer,
    "sale_detail_unmatched": sale_detail_unmatched,
    "sale_detail_enriched": sale_detail_enriched,
    "sale_gender_split": sale_gender_split,
    "sale_age_bands": sale_age_bands,
    "sale_by_keyword": sale_by_keyword,
    "sale_page": sale_page,
    "sale_day_lookup": sale_day_lookup,
    "gmv_by_date": gmv_by_date,
    "gmv_by_hour": gmv_by_hour,
    "sales_by_province": sales_by_province,
    "sales_value_bands": sales_value_bands,
}

_NEAR = "l_shipdate BETWEEN o_orderdate - INTERVAL 30 DAY AND o_orderdate + INTERVAL 30 DAY"
DETAIL_ID = """concat_ws('-', l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'),
                 l_partkey, l_suppkey)"""
SALES = f"""
sales AS (
  SELECT {DETAIL_ID} AS order_detail_id, o_orderkey::VARCHAR AS order_id,
         o_orderstatus AS order_status, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS create_time,
         o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS sku_id, p_retailprice AS sku_price,
         p_name AS sku_name, strftime(o_orderdate, '%Y-%m-%d') AS dt
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND {_NEAR}
  LEFT JOIN part ON p_partkey = l_partkey),
users AS (
  SELECT c_custkey::VARCHAR AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS user_gender,
         c_mktsegment AS user_level,
         (datediff('day', DATE '1955-01-01' + (c_custkey * 37 % 20000)::INTEGER, DATE '2024-02-01') // 365)::INTEGER
           AS user_age
  FROM customer),
enriched AS (
  SELECT order_detail_id, order_id, order_status, create_time, s.user_id, sku_id, user_gender,
         coalesce(user_age, 0) AS user_age, user_level, sku_price, sku_name, dt
  FROM sales s LEFT JOIN users u ON u.user_id = s.user_id)"""
_PROVINCE = """
province AS (
  SELECT c_nationkey::VARCHAR AS province_id, n_name AS province,
         sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS sales, count(*) AS orders
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
  GROUP BY c_nationkey, n_name)"""

SQL = {
    "sale_detail_interval": f"WITH {SALES} SELECT * FROM sales",
    "sale_detail_full_outer": f"""
        SELECT o_orderkey::VARCHAR AS order_id,
               CASE WHEN l_orderkey IS NOT NULL THEN {DETAIL_ID} END AS order_detail_id,
               l_orderkey::VARCHAR AS detail_order_id
        FROM orders FULL OUTER JOIN lineitem ON l_orderkey = o_orderkey AND {_NEAR}""",
    "sale_detail_unmatched": f"""
        SELECT 'order' AS side, o_orderkey::VARCHAR AS order_id, NULL::VARCHAR AS order_detail_id
        FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {_NEAR})
        UNION ALL
        SELECT 'detail', l_orderkey::VARCHAR, {DETAIL_ID}
        FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey AND {_NEAR})""",
    "sale_detail_enriched": f"WITH {SALES} SELECT * FROM enriched",
    "sale_gender_split": f"""WITH {SALES} SELECT user_gender, count(*) AS ct,
        count(*) / (SELECT count(*) FROM enriched)::DOUBLE AS share,
        CASE user_gender WHEN 'M' THEN '男' WHEN 'F' THEN '女' ELSE user_gender END AS label
        FROM enriched GROUP BY user_gender""",
    "sale_age_bands": f"""WITH {SALES},
        banded AS (SELECT CASE WHEN user_age < 20 THEN '20岁以下' WHEN user_age < 30 THEN '20-30岁'
                               ELSE '30岁以上' END AS age_band FROM enriched)
        SELECT age_band, count(*) AS ct, count(*) / (SELECT count(*) FROM banded)::DOUBLE AS share
        FROM banded GROUP BY age_band""",
    "sale_by_keyword": f"""WITH {SALES} SELECT order_detail_id, sku_name, dt FROM sales
        WHERE dt = '{SALE_DAY}'
          AND list_contains(regexp_split_to_array(lower(sku_name), '\\W+'), '{SALE_WORD}')""",
    "sale_page": f"""WITH {SALES} SELECT * FROM enriched ORDER BY dt, order_detail_id
        LIMIT {PAGE_SIZE} OFFSET {(PAGE_NUMBER - 1) * PAGE_SIZE}""",
    "sale_day_lookup": f"WITH {SALES} SELECT * FROM enriched WHERE dt = '{SALE_DAY}'",
    "gmv_by_date": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS create_date,
        sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS gmv, count(*) AS orders FROM orders GROUP BY 1""",
    "gmv_by_hour": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS create_date,
        lpad((o_orderkey % 24)::VARCHAR, 2, '0') AS create_hour,
        sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS gmv, count(*) AS orders FROM orders GROUP BY 1, 2""",
    "sales_by_province": f"WITH {_PROVINCE} SELECT * FROM province",
    "sales_value_bands": f"""WITH {_PROVINCE} SELECT province, orders,
        least(floor((orders / max(orders) OVER () * 600) / 100), 5)::INTEGER AS band FROM province""",
}
