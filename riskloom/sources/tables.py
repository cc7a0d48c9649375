"""Maps the ``events`` table to transactions, and to raw messages as a log source would deliver them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import model as m
from riskloom.functions.instants import format_instant

_ORIGIN_MS = 1_704_067_200_000  # 2024-01-01T00:00:00Z


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table, dealt over all cores.

    A file has as many reading tasks as row groups, perhaps one, and mapping and parsing an event costs a hundred times
    what moving it does.
    """
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{sf_dir}/events.parquet").repartition(tasks)


def events_as_transactions(events: DataFrame, *, compression: int = 1_000) -> DataFrame:
    """One transaction per event.

    Event times are compressed towards the start of 2024, because the gaps of a user would otherwise leave every
    short window empty.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    since_origin = F.expr("cast(cast(ts - timestamp_ntz'2024-01-01' as interval second) as decimal(18,6))")
    elapsed = F.floor(since_origin * 1000) / F.lit(compression).cast("decimal(9,0)")
    ts_ms = (F.floor(elapsed) + F.lit(_ORIGIN_MS)).cast("bigint")
    return events.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.lit("merchant-1").alias("merchant_id"),
        (F.col("value").cast(m.MONEY) * F.lit(4)).cast(m.MONEY).alias("amount"),
        F.lit("EUR").alias("currency"),
        F.when(k < 5, "US").otherwise("PT").alias("country"),
        F.timestamp_millis(ts_ms).alias("timestamp"),
        F.when(F.col("event_type") == "error", m.DECLINED).alias("payment_status"),
        ts_ms.alias("ts_ms"),
    )


def events_as_messages(events: DataFrame) -> DataFrame:
    """Every event as a raw JSON message, as a log source would deliver it.

    ``event_id % 40`` picks the defect a message carries, so that each kind of bad input grows with the table; most
    values stand for a sound message.  Messages of kind 16 repeat the id of the sound message three before them.
    """
    tx = events_as_transactions(events).withColumn("event_id", F.col("transaction_id").cast("bigint"))
    event_id, kind = F.col("event_id"), F.col("event_id") % 40

    def text(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    own_id = F.when(kind == 16, event_id - 3).otherwise(event_id).cast("string")
    amount = F.col("amount").cast("decimal(12,2)").cast("string")
    time = format_instant(F.col("timestamp"))
    status = F.when(kind == 7, "MAYBE").otherwise(F.col("payment_status"))
    document = F.concat(
        F.lit('{"transactionId":'),
        text(F.when(kind == 11, F.lit(" \\t ")).otherwise(own_id)),
        F.lit(',"customerId":'),
        text(F.col("customer_id")),
        F.lit(',"merchantId":"merchant-1","amount":'),
        F.when(kind == 4, F.lit('"abc"'))
        .when(kind == 8, F.concat(F.lit("-"), amount))
        .when(kind == 12, F.lit("0"))
        .when(kind == 16, F.lit("1.25"))
        .when(kind == 17, text(amount))
        .when(kind == 19, F.lit('"1,000"'))
        .otherwise(amount),
        F.lit(',"currency":'),
        text(F.when(kind == 9, "JPY").otherwise("EUR")),
        F.lit(',"country":'),
        F.when(kind == 15, F.lit('{"a":1}')).otherwise(text(F.col("country"))),
        F.lit(',"timestamp":'),
        text(
            F.when(kind == 5, F.lit("yesterday"))
            .when(kind == 18, F.regexp_replace(time, "Z$", ""))
            .otherwise(time)
        ),
        F.coalesce(F.concat(F.lit(',"paymentStatus":'), text(status)), F.lit("")),
        F.when(kind == 13, F.lit(',"somethingNew":true')).otherwise(F.lit("")),
        F.lit("}"),
    )
    payload = (
        F.when(kind == 0, F.lit("not json at all"))
        .when(kind == 1, F.lit('{"amount":'))
        .when(kind == 2, F.lit("[1,2,3]"))
        .when(kind == 3, F.lit('"text"'))
        .when(kind == 6, F.lit(""))
        .when(kind == 10, F.concat(F.lit('{"transactionId":'), text(own_id), F.lit("}")))
        .when(kind != 14, document)
    )
    return tx.select(
        payload.cast("binary").alias("value"),
        F.lit("transaction.events").alias("topic"),
        (event_id % 4).cast("int").alias("partition"),
        F.floor(event_id / F.lit(4).cast("decimal(1,0)")).cast("bigint").alias("offset"),
    )
