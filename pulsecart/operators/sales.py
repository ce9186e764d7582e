"""Sale details: late-tolerant join of orders and details, user enrichment, splits, sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsecart.functions import age_band, age_years, create_parts, price, seconds_in
from pulsecart.operators.keyed import last_by
from pulsecart.schemas import JOIN_TOLERANCE, SALE_DETAIL_COLUMNS

_ORDER_FIELDS = ["id", "order_status", "create_time", "user_id", "ingest_time"]


def _marked(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def within_tolerance(tolerance: str) -> Column:
    """Join condition on marked sides: same order, and arrivals no further apart than this."""
    reach = F.expr(f"interval {seconds_in(tolerance)} seconds")
    return (F.col("o_id") == F.col("d_order_id")) & F.col("d_ingest_time").between(
        F.col("o_ingest_time") - reach, F.col("o_ingest_time") + reach
    )


def pair_within(
    orders: DataFrame,
    details: DataFrame,
    tolerance: str = JOIN_TOLERANCE,
    how: str = "inner",
    salts: int = 1,
) -> DataFrame:
    """Order and detail pairs as ``o_`` and ``d_`` columns, whichever side came first.

    For batches and, with both sides watermarked, for streams. In a batch, an order with very many
    details is split by the adaptive skew join. A stream cannot do that: there ``salts`` spreads
    the details of every order over that many tasks, at the price of as many copies of the orders.

    Where both sides have a column ``held``, two held rows met in an earlier batch and are no pair.
    """
    held = "held" in orders.columns and "held" in details.columns
    if held and how != "inner":
        raise ValueError("held rows that met before would count as unmatched in an outer join")
    left = _marked(orders.select(*_ORDER_FIELDS, *["held"] * held), "o_")
    right = _marked(details, "d_")
    condition = within_tolerance(tolerance)
    if held:
        condition = condition & ~(F.col("o_held") & F.col("d_held"))
    if salts == 1:
        return left.join(right, condition, how)
    if how != "inner":
        raise ValueError("salted copies of an order would count as unmatched in an outer join")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = left.withColumn("o_salt", copies)
    right = right.withColumn("d_salt", F.pmod(F.xxhash64("d_id"), F.lit(salts)).cast("int"))
    paired = left.join(right, condition & (F.col("o_salt") == F.col("d_salt")))
    return paired.drop("o_salt", "d_salt")


def pairs_and_alone(
    orders: DataFrame, details: DataFrame, tolerance: str = JOIN_TOLERANCE
) -> DataFrame:
    """The full outer join of a batch: pairs, and rows of either side without a partner.

    Put together from joins that can be split on a hot order, which a full outer join cannot. One outer join on the
    details gives the pairs and the details alone, so whole details are shuffled once.
    """
    columns = [f"o_{c}" for c in _ORDER_FIELDS] + [f"d_{c}" for c in details.columns]
    left, right = _marked(details, "d_"), _marked(orders.select(*_ORDER_FIELDS), "o_")
    met = left.join(right, within_tolerance(tolerance), "left").select(*columns)
    alone = _marked(_orders_alone(orders, details, tolerance).select(*_ORDER_FIELDS), "o_")
    return met.unionByName(alone, allowMissingColumns=True)


def wide_rows(pairs: DataFrame) -> DataFrame:
    """Pairs as sale-detail rows, still without the user. A missing detail has price 0; a price
    that is not a number is null."""
    create_date, _ = create_parts("o_create_time")
    paid = F.when(F.col("d_id").isNull(), F.lit(0.0)).otherwise(price("d_order_price"))
    return pairs.select(
        F.col("d_id").alias("order_detail_id"),
        F.col("o_id").alias("order_id"),
        F.col("o_order_status").alias("order_status"),
        F.col("o_create_time").alias("create_time"),
        F.col("o_user_id").alias("user_id"),
        F.col("d_sku_id").alias("sku_id"),
        paid.alias("sku_price"),
        F.col("d_sku_name").alias("sku_name"),
        create_date.alias("dt"),
    )


def sale_details(orders: DataFrame, details: DataFrame, tolerance: str = JOIN_TOLERANCE) -> DataFrame:
    """Details joined to their order when both arrived within the tolerance."""
    return wide_rows(pair_within(orders, details, tolerance))


def one_per_detail(sales: DataFrame) -> DataFrame:
    """Each detail once, as repeated deliveries of an order pair it repeatedly."""
    order = [c for c in ("create_time", "order_status") if c in sales.columns]
    return last_by(sales, ["order_detail_id"], order)


def _orders_alone(orders: DataFrame, details: DataFrame, tolerance: str) -> DataFrame:
    """Order deliveries that no detail met.

    The inner join, which can be split on a hot order, is reduced to the orders it found; the
    anti join then meets each order once.
    """
    found = (
        pair_within(orders, details.select("order_id", "ingest_time"), tolerance)
        .select(F.col("o_id").alias("id"), F.col("o_ingest_time").alias("ingest_time"))
        .distinct()
    )
    return orders.join(found, ["id", "ingest_time"], "left_anti")


def _details_alone(orders: DataFrame, details: DataFrame, tolerance: str) -> DataFrame:
    """Details that no order delivery met, as ``d_`` columns."""
    left = _marked(details, "d_")
    right = _marked(orders.select("id", "ingest_time"), "o_")
    return left.join(right, within_tolerance(tolerance), "left_anti")


def unmatched_orders(
    orders: DataFrame, details: DataFrame, tolerance: str = JOIN_TOLERANCE
) -> DataFrame:
    """Orders that would expire without a detail."""
    return _orders_alone(orders, details, tolerance).select(
        F.lit("order").alias("side"),
        F.col("id").alias("order_id"),
        F.lit(None).cast("string").alias("order_detail_id"),
    )


def unmatched_details(
    orders: DataFrame, details: DataFrame, tolerance: str = JOIN_TOLERANCE
) -> DataFrame:
    """Details that would expire without their order."""
    narrow = details.select("id", "order_id", "ingest_time")
    return _details_alone(orders, narrow, tolerance).select(
        F.lit("detail").alias("side"),
        F.col("d_order_id").alias("order_id"),
        F.col("d_id").alias("order_detail_id"),
    )


def unmatched(orders: DataFrame, details: DataFrame, tolerance: str = JOIN_TOLERANCE) -> DataFrame:
    """Rows of both sides that would expire without a partner."""
    return unmatched_orders(orders, details, tolerance).unionByName(
        unmatched_details(orders, details, tolerance)
    )


def with_user(sales: DataFrame, users: DataFrame, as_of: str | Column) -> DataFrame:
    """Add gender, age and level of the buyer; ``users`` has one row per id.

    An unknown user leaves gender and level null and the age 0.
    """
    known = users.select(
        F.col("id").alias("user_id"),
        F.col("gender").alias("user_gender"),
        F.col("user_level"),
        age_years("birthday", as_of).alias("user_age"),
    )
    joined = sales.join(known, "user_id", "left")
    return joined.withColumn("user_age", F.coalesce("user_age", F.lit(0))).select(
        *SALE_DETAIL_COLUMNS
    )


def _split(sales: DataFrame, group: Column, name: str) -> DataFrame:
    """Counts per group with their share of all rows.

    The groups are few, so the total is taken over the counted rows, not over the sales again.
    """
    counts = sales.groupBy(group.alias(name)).agg(F.count("*").alias("ct"))
    gathered = counts.agg(
        F.sum("ct").alias("all"), F.collect_list(F.struct(name, "ct")).alias("groups")
    )
    return gathered.select("all", F.inline("groups")).select(
        name, "ct", (F.col("ct") / F.col("all")).alias("share")
    )


def gender_split(sales: DataFrame) -> DataFrame:
    """Sale details by gender of the buyer."""
    return _split(sales, F.col("user_gender"), "user_gender")


def age_split(sales: DataFrame) -> DataFrame:
    """Sale details by age band of the buyer."""
    return _split(sales, age_band("user_age"), "age_band")


def _money(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def gross_value(orders: DataFrame, hourly: bool = False) -> DataFrame:
    """Order value and count per day, or per day and hour. Sums are exact to the cent."""
    date, hour = create_parts("create_time")
    keys = [date.alias("create_date")] + ([hour.alias("create_hour")] if hourly else [])
    return orders.groupBy(*keys).agg(
        _money("total_amount").alias("gmv"), F.count("*").alias("orders")
    )


def by_province(orders: DataFrame, provinces: DataFrame) -> DataFrame:
    """Order value and count per province; ``provinces`` maps ``province_id`` to ``province``.

    Orders are summed by id before the names are joined.
    """
    sums = orders.groupBy("province_id").agg(
        _money("total_amount").alias("sales"), F.count("*").alias("orders")
    )
    return sums.join(provinces, "province_id", "left").select(
        "province_id", "province", "sales", "orders"
    )


def by_province_of_buyer(orders: DataFrame, buyers: DataFrame, provinces: DataFrame) -> DataFrame:
    """The same for orders without a province; ``buyers`` maps ``user_id`` to ``province_id``.

    Orders are summed by buyer before the join, so one row per buyer is shuffled, not all orders.
    """
    own = orders.groupBy("user_id").agg(
        F.sum(F.col("total_amount").cast("decimal(18,2)")).alias("sales"), F.count("*").alias("orders")
    )
    sums = own.join(buyers, "user_id", "left").groupBy("province_id").agg(
        F.sum("sales").cast("double").alias("sales"), F.sum("orders").alias("orders")
    )
    return sums.join(provinces, "province_id", "left").select("province_id", "province", "sales", "orders")


# The legend has six bands of this width, from 0 up.
BAND_WIDTH = 100
BANDS = 6


def with_value_band(df: DataFrame, value: str, width: float = BAND_WIDTH, bands: int = BANDS) -> DataFrame:
    """Legend band of a value: 0 for 0 to under ``width`` and so on; the last band is open above.
    Negative values and nulls have none."""
    v = F.col(value)
    band = F.when(v >= 0, F.least(F.floor(v / width), F.lit(bands - 1)))
    return df.withColumn("band", band.cast("int"))
