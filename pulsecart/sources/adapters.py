"""Entity records derived from the retail tables.

Each function takes table frames, batch or streaming, and returns the record layout plus the
typed time columns the operators use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsecart.functions import day_text, hour_text
from pulsecart.schemas import BROWSE_EVENT, COUPON_EVENT

ACCOUNTS_PER_DEVICE = 15
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _text(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def startup_log(events: DataFrame) -> DataFrame:
    """Startup records; ``event_id`` breaks ties."""
    user = F.col("user_id").cast("string")
    return events.select(
        user.alias("mid"),
        user.alias("uid"),
        _text("appid"), _text("area"), _text("os"), _text("ch"),
        F.col("event_type").alias("type"),
        _text("vs"),
        F.unix_millis("ts").alias("ts"),
        day_text("ts").alias("logdate"),
        hour_text("ts").alias("loghour"),
        F.col("ts").alias("event_time"),
        "event_id",
    )


def behaviour_log(events: DataFrame) -> DataFrame:
    """Startup records with the start and page fields of a behaviour record.

    A signup is a start. A view opens page ``$.k`` directly; a click opens it from the page whose
    number is one lower.
    """
    page = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("mid"),
        F.when(kind == "signup", F.col("value").cast("string")).alias("start"),
        F.when(kind.isin("view", "click"), page).alias("page"),
        F.when(kind == "click", (page.cast("int") - 1).cast("string")).alias("last_page_id"),
        F.unix_millis("ts").alias("ts"),
        F.col("ts").alias("event_time"),
    )


def event_log(events: DataFrame) -> DataFrame:
    """Behaviour events of devices that several accounts share."""
    kind = F.col("event_type")
    return events.select(
        F.expr(f"cast(user_id div {ACCOUNTS_PER_DEVICE} as string)").alias("mid"),
        F.col("user_id").cast("string").alias("uid"),
        F.when(kind == "purchase", COUPON_EVENT)
        .when(kind == "click", BROWSE_EVENT)
        .otherwise(kind)
        .alias("evid"),
        F.get_json_object("props", "$.k").alias("itemid"),
        F.unix_millis("ts").alias("ts"),
        F.col("ts").alias("event_time"),
    )


def order_info(orders: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Order records; with ``customers`` the province of the buyer is attached."""
    if customers is None:
        joined, province = orders, _text("province_id")
    else:
        joined = orders.join(
            customers.select("c_custkey", "c_nationkey"),
            orders.o_custkey == customers.c_custkey,
            "left",
        )
        province = F.col("c_nationkey").cast("string").alias("province_id")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("id"),
        province,
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_totalprice").alias("total_amount"),
        F.date_format("o_orderdate", TIME_FORMAT).alias("create_time"),
        F.col("o_orderdate").alias("ingest_time"),
    )


def order_detail_keys(lineitem: DataFrame) -> DataFrame:
    """Detail records without the product fields; see :func:`with_product`."""
    parts = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"]
    cells = [
        day_text(c) if c == "l_shipdate" else F.col(c).cast("string") for c in parts
    ]
    return lineitem.select(
        F.concat_ws("-", *cells).alias("id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("sku_id"),
        F.col("l_quantity").cast("string").alias("sku_num"),
        F.col("l_shipdate").alias("ingest_time"),
    )


def with_product(details: DataFrame, part: DataFrame, sku: str = "sku_id") -> DataFrame:
    """Attach product name and price, which the retail tables keep apart from the detail."""
    product = part.select(
        F.col("p_partkey").cast("string").alias(sku),
        F.col("p_name").alias("sku_name"),
        F.col("p_retailprice").cast("string").alias("order_price"),
    )
    return details.join(product, sku, "left")


def user_info(customers: DataFrame) -> DataFrame:
    """User records. Gender follows the key's parity; birthdays spread over 20,000 days."""
    key = F.col("c_custkey")
    birthday = F.date_add(F.to_date(F.lit("1955-01-01")), (key * 37 % 20000).cast("int"))
    return customers.select(
        key.cast("string").alias("id"),
        F.col("c_name").alias("login_name"),
        F.col("c_mktsegment").alias("user_level"),
        day_text(birthday).alias("birthday"),
        F.when(key % 2 == 0, "M").otherwise("F").alias("gender"),
    )


def user_changes(events: DataFrame) -> DataFrame:
    """Every event as a change of its user; ordered by ``event_time``, then ``event_id``."""
    return events.select(
        F.col("user_id").cast("string").alias("id"),
        F.col("event_type").alias("user_level"),
        F.col("ts").alias("event_time"),
        "event_id",
    )


def change_records(table: str, rows: DataFrame, key: Column, columns: dict[str, Column]) -> DataFrame:
    """Wrap rows as change records of ``table`` with one after image each.

    Keys divisible by 7 are deletes, else by 5 updates, else inserts; keys divisible by 11 carry a
    transaction end instead of row data.
    """
    cells = [
        F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in columns.items()
    ]
    return rows.select(
        F.lit(table).alias("table"),
        F.when(key % 11 == 0, "TRANSACTIONEND").otherwise("ROWDATA").alias("entry_type"),
        F.when(key % 7 == 0, "DELETE").when(key % 5 == 0, "UPDATE").otherwise("INSERT")
        .alias("event_type"),
        F.array(F.array(*cells)).alias("rows"),
    )


def order_changes(orders: DataFrame) -> DataFrame:
    columns = {
        "id": F.col("o_orderkey"),
        "order_status": F.col("o_orderstatus"),
        "user_id": F.col("o_custkey"),
        "total_amount": F.col("o_totalprice"),
        "create_time": F.date_format("o_orderdate", TIME_FORMAT),
    }
    return change_records("order_info", orders, F.col("o_orderkey"), columns)


def detail_changes(lineitem: DataFrame) -> DataFrame:
    columns = {
        "id": F.concat_ws(
            "-", "l_orderkey", "l_linenumber", day_text("l_shipdate"), "l_partkey", "l_suppkey"
        ),
        "order_id": F.col("l_orderkey"),
        "sku_id": F.col("l_partkey"),
        "sku_num": F.col("l_quantity"),
    }
    return change_records("order_detail", lineitem, F.col("l_orderkey"), columns)


def user_change_records(customers: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    columns = {"id": key, "login_name": F.col("c_name"), "user_level": F.col("c_mktsegment")}
    return change_records("user_info", customers, key, columns)


def documents(part: DataFrame) -> DataFrame:
    """Parts as searchable documents."""
    return part.select(
        F.col("p_partkey").cast("string").alias("_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("size"),
    )
