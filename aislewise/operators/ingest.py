"""Validation, source policy, deduplication and typed projection of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.ids import payload_hash
from aislewise.schemas import EVENT_TYPES, PREFIX, REQUIRED, SUBJECTS, Field

FUTURE_MS, MAX_AGE_MS, MAX_BILLING_AGE_MS = 300_000, 86_400_000, 35 * 86_400_000
SIMULATOR = "urn:retail:sim"


def _data_fields(data: Column) -> Column:
    """The fields of the data object (JSON text) that are not null, as text: what get_json_object reads, for one parse a row."""
    fields = F.from_json(data, "map<string,string>", {"allowUnquotedControlChars": "true", "allowNonNumericNumbers": "false"})
    return F.map_filter(fields, lambda _, value: value.isNotNull())


def _field_errors(field: Field, fields: Column) -> list[Column]:
    """One message or null for each thing that can be wrong with a field of the data object."""
    value = fields[field.name]
    errors = [F.when(value.isNull(), f"data.{field.name} is missing")] if field.required else []
    if field.kind == "int":
        number = value.try_cast("long")
        errors.append(F.when(value.isNotNull() & (number.isNull() | ~value.rlike(r"^-?\d+$")), f"data.{field.name} is not an integer"))
        if field.least is not None:
            errors.append(F.when(number < field.least, f"data.{field.name} is under {field.least}"))
        if field.most is not None:
            errors.append(F.when(number > field.most, f"data.{field.name} is over {field.most}"))
    elif field.kind == "bool":
        errors.append(F.when(value.isNotNull() & ~value.isin("true", "false"), f"data.{field.name} is not a boolean"))
    if field.pattern:
        errors.append(F.when(value.isNotNull() & ~value.rlike(field.pattern), f"data.{field.name} has the wrong form"))
    if field.values:
        errors.append(F.when(value.isNotNull() & ~value.isin(*field.values), f"data.{field.name} is not one of its values"))
    return errors


def collected(*errors: Column) -> Column:
    """The messages that are not null, in order."""
    return F.array_compact(F.array(*errors))


def validate(events: DataFrame, now_ms: Column, prefix: str = PREFIX, simulator: str = SIMULATOR) -> DataFrame:
    """events (ENVELOPE) with t_ms, short_type and errors: every message that applies, empty for a valid event.

    prefix: what a deployment's event types begin with; simulator: what the sources of simulated events begin with.
    """
    short = F.when(F.col("type").startswith(prefix), F.substring("type", len(prefix) + 1, 200))
    e = events.withColumns({"short_type": short, "t_ms": F.unix_millis(F.try_to_timestamp("time")), "_fields": _data_fields(F.col("data"))})
    missing = [F.when(F.col(c).isNull(), f"{c} is missing") for c in REQUIRED]
    unknown = F.when(F.col("type").isNotNull() & (F.col("short_type").isNull() | ~F.col("short_type").isin(*EVENT_TYPES)), F.concat(F.lit("unknown type "), "type"))
    schema = F.when(F.col("dataschema").isNotNull() & ~F.col("dataschema").rlike(r"[/-]\d+\.\d+\.\d+(\.json|\.schema\.json)?$"), "dataschema has no version")
    by_type = []
    for name, fields in EVENT_TYPES.items():
        messages = [m for f in fields for m in _field_errors(f, F.col("_fields"))]
        subject = F.when(~F.col("subject").rlike(SUBJECTS[name]), "subject does not fit the type")
        by_type.append(F.when(F.col("short_type") == name, collected(subject, *messages)))
    simulated = F.col("source").startswith(simulator)
    most = F.when(F.col("short_type").rlike(r"^(pos|stock)\."), MAX_BILLING_AGE_MS).otherwise(MAX_AGE_MS)
    rest = [
        F.when(F.col("time").isNotNull() & F.col("t_ms").isNull(), "time is not a timestamp"),
        F.when(F.col("simrunid").isNotNull() & ~F.col("simrunid").rlike(r"^run-[0-9a-f]{12}$"), "simrunid has the wrong form"),
        F.when(simulated & F.col("simrunid").isNull(), "simulated event without simrunid"),
        F.when(~simulated & F.col("simrunid").isNotNull(), "simrunid on an event that is not simulated"),
        F.when(~simulated & (F.col("t_ms") > now_ms + FUTURE_MS), "time is in the future"),
        F.when(~simulated & (F.col("t_ms") < now_ms - most), "time is too old"),
        F.when(F.col("partitionkey") != F.col("storeid"), "partitionkey is not the store"),
        F.when(F.col("_fields")["storeId"] != F.col("storeid"), "data.storeId is not the store"),
    ]
    typed = F.coalesce(*by_type, F.array().cast("array<string>"))
    errors = F.concat(collected(*missing, unknown, schema), typed, collected(*rest))
    # exploded from an array of one, so that a filter on errors comes after them and doesn't have all checks counted again
    return e.select("*", F.explode(F.array(errors)).alias("errors")).drop("_fields")


def may_publish(client: Column, source: Column, allowed: dict[str, tuple[str, ...]]) -> Column:
    """Whether a client may send events of a source: one of its prefixes fits."""
    fits = [(client == c) & reduce(lambda a, b: a | b, [source.startswith(p) for p in prefixes], F.lit(False)) for c, prefixes in allowed.items()]
    return F.coalesce(reduce(lambda a, b: a | b, fits, F.lit(False)), F.lit(False))


def edge_names_store(source: Column, store: Column) -> Column:
    """An edge source urn:...:edge:<store>:... must name the event's own store."""
    return ~source.rlike(r"^urn:[^:]+:edge:") | (F.get(F.split(source, ":"), 3) == store)


def dedup(events: DataFrame) -> DataFrame:
    """events (source, id, arrival, payload_hash) with result: ACCEPTED, DUPLICATE or CONFLICT.

    The first arrival of each (source, id) is found by an aggregate, which combines before the shuffle, so an id that is
    sent again and again costs one row a task.
    """
    first = events.groupBy("source", "id").agg(F.min("arrival").alias("_first"), F.min_by("payload_hash", "arrival").alias("_hash"))
    out = events.join(first, ["source", "id"])
    result = F.when(F.col("arrival") == F.col("_first"), "ACCEPTED").when(F.col("payload_hash").eqNullSafe(F.col("_hash")), "DUPLICATE").otherwise("CONFLICT")
    return out.withColumn("result", result).drop("_first", "_hash")


def hashed(events: DataFrame) -> DataFrame:
    """events with payload_hash over the canonical form of the whole envelope (F1, F2)."""
    attributes = [c for c in events.columns if c in ("specversion", "id", "source", "type", "time", "subject", "dataschema", "datacontenttype", "storeid", "partitionkey", "simrunid", "sequence")]
    head = F.to_json(F.struct(*attributes))
    whole = F.concat(F.expr("left(" + "_head, length(_head) - 1)"), F.lit(',"data":'), F.coalesce("data", F.lit("null")), F.lit("}"))
    return events.withColumn("_head", head).withColumn("payload_hash", payload_hash(whole)).drop("_head")


def dead_letters(events: DataFrame, limit: int = 1024) -> DataFrame:
    """Invalid and conflicting events with reason and errors joined to at most `limit` characters."""
    reason = F.when(F.size("errors") > 0, "INVALID").when(F.col("result") == "CONFLICT", "CONFLICT")
    return events.withColumn("reason", reason).where("reason is not null").select("source", "id", "arrival", "reason", F.left(F.array_join("errors", "; "), F.lit(limit)).alias("errors"))


def typed_tables(valid: DataFrame) -> dict[str, DataFrame]:
    """The six stored tables of valid billing and stock events."""
    text = lambda f: F.get_json_object("data", f"$.{f}")
    number = lambda f: text(f).try_cast("long")
    base = [F.col("storeid").alias("store_id"), F.col("simrunid").alias("run_id"), "t_ms"]
    of = lambda t: valid.where(F.col("short_type") == t)
    n, s = lambda f, a: number(f).alias(a), lambda f, a: text(f).alias(a)
    return {
        "sale_lines": of("pos.sale.line").select(*base, s("tillId", "till_id"), s("billRef", "bill_ref"), n("revision", "revision"), n("lineNo", "line_no"), s("sku", "sku"), n("qtyMilli", "qty_milli"), s("unit", "unit"), n("amountMinor", "amount_minor"), n("taxMinor", "tax_minor"), s("currency", "currency")),
        "payments": of("pos.payment").select(*base, s("tillId", "till_id"), s("billRef", "bill_ref"), n("paymentNo", "payment_no"), s("tender", "tender"), s("direction", "direction"), n("amountMinor", "amount_minor"), s("currency", "currency")),
        "till_events": of("pos.till.event").select(*base, s("tillId", "till_id"), s("kind", "kind"), s("billRef", "bill_ref"), n("revision", "revision"), n("amountMinor", "amount_minor"), s("currency", "currency")),
        "stock_movements": of("stock.movement").select(*base, s("sku", "sku"), s("direction", "direction"), s("reason", "reason"), n("qtyMilli", "qty_milli"), s("unit", "unit")),
        "stock_levels": of("stock.level").select(*base, F.col("arrival").alias("seq"), s("sku", "sku"), n("qtyMilli", "qty_milli"), s("unit", "unit"), s("source", "source")),
        "day_totals": of("pos.day.total").select(*base, text("businessDate").try_cast("date").alias("business_date"), n("salesMinor", "sales_minor"), n("refundsMinor", "refunds_minor"), n("bills", "bills"), F.from_json(text("paymentsByTender"), "map<string,long>").alias("payments_by_tender"), s("currency", "currency"), s("source", "source")),
    }


def rule_events(events: DataFrame) -> DataFrame:
    """Valid store events as RULE_EVENT rows; other types are left out without being errors."""
    text = lambda f: F.get_json_object("data", f"$.{f}")
    own = events.where((F.size("errors") == 0) & F.col("short_type").startswith("store."))
    return own.select(F.col("storeid").alias("store_id"), F.col("simrunid").alias("run_id"), "arrival", "id", "type", "t_ms", "sequence", text("zoneId").alias("zone_id"), text("trackId").alias("track_id"), text("how").alias("how"), text("queueId").alias("queue_id"), text("length").try_cast("int").alias("length"))
