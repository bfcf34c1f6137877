"""Subscription fan-out: which event goes to whom, with what signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.functions.hashing import key_pads, signed

ANY = "*"


def subscription_keys(subscriptions: DataFrame) -> DataFrame:
    """One row per (subscription, event it listens to) of the active ones."""
    active = subscriptions.filter(F.coalesce(F.col("active"), F.lit(True)))
    active = active.withColumn("pads", key_pads(F.coalesce("secret", F.lit("")))).drop("secret")
    return active.withColumn("event_key", F.explode(F.array_distinct("events"))).drop("events", "active")


def match_subscriptions(events: DataFrame, subscriptions: DataFrame, event_type: str = "event_type") -> DataFrame:
    """Event rows x subscriptions that list the event or '*': one equi-join, each pair once.

    An event asks for its own name and for '*'. Subscriptions that list both keep the '*' only.
    """
    keys = subscription_keys(
        subscriptions.withColumn(
            "events",
            F.when(F.array_contains("events", ANY), F.array(F.lit(ANY))).otherwise(F.col("events")),
        )
    )
    asked = events.withColumn("event_key", F.explode(F.array(F.col(event_type), F.lit(ANY))))
    # the registry of subscribers is the small side; its size is left to the runtime check
    return asked.join(keys, "event_key").drop("event_key")


def canonical_payload(event: Column, timestamp: Column, data: Column) -> Column:
    """JSON with its keys in sorted order: data, event, timestamp."""
    return F.to_json(F.struct(data.alias("data"), event.alias("event"), timestamp.alias("timestamp")))


def outbox(matched: DataFrame, body: Column) -> DataFrame:
    """Adds payload and signature; neither the secret nor its pads leave."""
    return (
        matched.withColumn("payload", body)
        .withColumn("signature", signed(F.col("payload"), F.col("pads")))
        .drop("pads")
    )


def latest(outbox_rows: DataFrame, limit: int = 50, time: str = "ts", id_column: str = "event_id") -> DataFrame:
    """Last deliveries, newest first."""
    return outbox_rows.orderBy(F.desc(time), F.desc(id_column), "subscription_id").limit(limit)
