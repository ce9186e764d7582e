"""Record layouts as DDL, and the fixed values the records use."""

from __future__ import annotations

# Input records. Every field arrives as text except the two numeric ones.
STARTUP_LOG = (
    "mid string, uid string, appid string, area string, os string, ch string, type string, "
    "vs string, ts bigint"
)
EVENT_LOG = (
    "mid string, uid string, appid string, area string, os string, type string, evid string, "
    "pgid string, npgid string, itemid string, ts bigint"
)
ORDER_INFO = (
    "id string, province_id string, consignee string, order_comment string, "
    "consignee_tel string, order_status string, payment_way string, user_id string, "
    "img_url string, total_amount double, expire_time string, delivery_address string, "
    "create_time string, operate_time string, tracking_no string, parent_order_id string, "
    "out_trade_no string, trade_body string"
)
ORDER_DETAIL = (
    "id string, order_id string, sku_name string, sku_id string, order_price string, "
    "img_url string, sku_num string"
)
USER_INFO = "id string, login_name string, user_level string, birthday string, gender string"
CHANGE_RECORD = (
    "table string, entry_type string, event_type string, "
    "rows array<array<struct<name: string, value: string>>>"
)

# Output tables.
DAILY_ACTIVE_COLUMNS = [
    "mid", "uid", "appid", "area", "os", "ch", "type", "vs", "logdate", "loghour", "ts",
]
SALE_DETAIL_COLUMNS = [
    "order_detail_id", "order_id", "order_status", "create_time", "user_id", "sku_id",
    "user_gender", "user_age", "user_level", "sku_price", "sku_name", "dt",
]
ALERT_COLUMNS = ["alert_id", "mid", "uids", "itemIds", "events", "ts", "dt"]

# Event names with meaning for the coupon alert.
COUPON_EVENT = "coupon"
BROWSE_EVENT = "clickItem"

# Alert threshold, window and late-join tolerance.
ALERT_MIN_ACCOUNTS = 3
ALERT_WINDOW = "5 minutes"
JOIN_TOLERANCE = "100 seconds"

# Identifiers and display names of the daily indicators.
KPI_NEW_DEVICES = ("new_mid", "新增设备")
KPI_DAILY_ACTIVE = ("dau", "新增日活")

# Labels of the sale-detail splits.
AGE_BANDS = ["20岁以下", "20-30岁", "30岁以上"]
GENDER_LABELS = {"M": "男", "F": "女"}

# Page sizes the sale-detail grid offers, and its default day.
PAGE_SIZES = [5, 10, 20, 50, 100]
DEFAULT_SALE_DAY = "2019-03-04"
