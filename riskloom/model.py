"""Row shapes shared by every operator.

Amounts are ``DECIMAL(28,8)``: Spark decimals are bounded, so a payload whose amount does not fit exactly is
treated as malformed instead of being rounded.  Temporal logic works on epoch milliseconds (``ts_ms``).
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(28, 8)
MONEY_SUM = T.DecimalType(32, 8)  # up to 999 amounts plus one; wider types would lose scale when added
AVERAGE = T.DecimalType(28, 4)
TABLE_MONEY = T.DecimalType(19, 4)

# Codes, levels, limits and windows that outputs must carry exactly.
APPROVED = "APPROVED"
DECLINED = "DECLINED"
PAYMENT_STATUSES = (APPROVED, DECLINED)
STATUS_PROCESSED = "PROCESSED"
STATUS_LATE = "LATE"
LEVEL_LOW = "LOW"
LEVEL_MEDIUM = "MEDIUM"
LEVEL_HIGH = "HIGH"
MEDIUM_FROM = 40
HIGH_FROM = 70
MAX_SCORE = 100
SOURCE_DESERIALIZATION = "DESERIALIZATION"
SOURCE_VALIDATION = "VALIDATION"
MALFORMED_CODE = "MALFORMED_PAYLOAD"
MALFORMED_PREFIX = "MALFORMED_PAYLOAD: "
ALERT_ID_PREFIX = "high-risk-v1-"
MINUTE_MS = 60_000
FIVE_MINUTES_MS = 300_000
TEN_MINUTES_MS = 600_000
HISTORY_RETENTION_MS = 3_600_000
HISTORY_MAX_ENTRIES = 100

COORDINATES = ("topic", "partition", "offset")

RAW_SCHEMA = T.StructType(
    [
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

TRANSACTION_FIELDS = [
    T.StructField("transaction_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("currency", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("payment_status", T.StringType()),
]
TRANSACTION_SCHEMA = T.StructType(TRANSACTION_FIELDS)
TRANSACTION_COLUMNS = [f.name for f in TRANSACTION_FIELDS]

VIOLATIONS_TYPE = T.ArrayType(
    T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType())])
)

CONTEXT_FIELDS = [
    T.StructField("transactions_last_minute", T.LongType()),
    T.StructField("amount_last_ten_minutes", MONEY_SUM),
    T.StructField("previous_country", T.StringType()),
    T.StructField("recent_countries", T.ArrayType(T.StringType())),
    T.StructField("average_recent_amount", AVERAGE),
    T.StructField("recent_transaction_count", T.LongType()),
    T.StructField("time_since_previous_ms", T.LongType()),
    T.StructField("known_countries", T.ArrayType(T.StringType())),
    T.StructField("declined_last_five_minutes", T.LongType()),
]
CONTEXT_SCHEMA = T.StructType(CONTEXT_FIELDS)
CONTEXT_COLUMNS = [f.name for f in CONTEXT_FIELDS]

CONTRIBUTION_TYPE = T.StructType(
    [T.StructField("score", T.IntegerType()), T.StructField("reason", T.StringType())]
)

# Stored tables (relational column names and types).
TRANSACTIONS_TABLE = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("amount", TABLE_MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("payment_status", T.StringType()),
    ]
)
RISK_SCORES_TABLE = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("risk_score", T.ShortType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("reasons", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
FRAUD_ALERTS_TABLE = RISK_SCORES_TABLE
