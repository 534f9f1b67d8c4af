"""Store events on Kafka topics (S10, S11). Spark's own source and sink need its Kafka package on the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.schemas import ENVELOPE


def read_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A stream of a topic's records as envelopes; options go to the source (startingOffsets, maxOffsetsPerTrigger)."""
    return envelopes(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load())


def envelopes(records: DataFrame) -> DataFrame:
    """Records (value, timestamp, partition, offset) as envelopes with event_time and arrival.

    event_time is the payload's own time, or the record's timestamp where that is missing or unreadable. arrival orders
    the records of a partition, which is all that a topic promises.
    """
    text = F.col("value").cast("string")
    names = [c.split()[0] for c in ENVELOPE.split(", ")]
    own = [F.get_json_object(text, f"$.{n}").alias(n) for n in names]
    return records.select(*own, F.coalesce(F.try_to_timestamp(F.get_json_object(text, "$.time")), F.col("timestamp")).alias("event_time"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("arrival"))


def records(events: DataFrame, key: Column) -> DataFrame:
    """Envelopes as records for a Kafka sink: events of one key keep their order (S11). data is JSON text."""
    head = [c for c in events.columns if c != "data"]
    whole = F.to_json(F.struct(*head))
    value = F.concat(F.expr("substr({0}, 1, length({0}) - 1)".format("_head")), F.lit(',"data":'), F.coalesce("data", F.lit("null")), F.lit("}")) if "data" in events.columns else F.col("_head")
    return events.withColumn("_head", whole).select(key.cast("string").alias("key"), value.alias("value"))
