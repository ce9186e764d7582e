"""Parameters that suit the retail tables; operators default to the live values."""

DAY, BEFORE = "2024-01-15", "2024-01-14"
FIRST_DAY, LAST_DAY = "2024-01-01", "2024-01-31"
AS_OF = "2024-02-01"
TIE = ["event_id"]

ALERT_WINDOW, ALERT_SLIDE, ALERT_BUCKET = "6 hours", "1 hour", "3 hours"
TOLERANCE = "30 days"
ARRIVAL_LIFE = "200 days"  # of a side in the join by arrival
SEEN_FOR = "24 hours"

SALE_DAY, SALE_WORD = "1996-05-12", "anvil"
KEYWORD = "ring"
BRAND = "Brand#19"
