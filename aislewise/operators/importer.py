"""Billing import: profile mapping, bills with revisions, stock deltas and payments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aislewise.functions.buckets import instant_of, to_ms
from aislewise.functions.ids import reference
from aislewise.functions.money import to_minor


@dataclass(frozen=True)
class Profile:
    """How a source names the canonical fields: exact column, dotted path into JSON `record`, or `$.x` of the outer record."""

    fields: dict[str, str]
    values: dict[str, dict[str, str]] = field(default_factory=dict)
    zone: str = "Asia/Kolkata"
    currency: str = "INR"
    decimals: int = 2
    time_format: str = "iso8601"
    each: str | None = None


def extract(rows: DataFrame, profile: Profile) -> DataFrame:
    """rows with one column per canonical field (P7). rows: flat columns, or `record` (JSON text) with `each` to expand."""
    if "record" in rows.columns:
        rows = rows.withColumn("_outer", F.col("record"))
        if profile.each:
            items = F.from_json(F.get_json_object("record", f"$.{profile.each}"), "array<string>")
            rows = rows.withColumn("_item", F.explode(items))
        else:
            rows = rows.withColumn("_item", F.col("record"))
    out = {}
    for name, source in profile.fields.items():
        if source in rows.columns:
            out[name] = F.col(f"`{source}`")
        elif source.startswith("$."):
            out[name] = F.get_json_object("_outer", source)
        else:
            out[name] = F.get_json_object("_item", f"$.{source}")
    blank = {n: F.nullif(F.trim(c.cast("string")), F.lit("")) for n, c in out.items()}
    return rows.withColumns(blank).drop("_outer", "_item")


def mapped(profile: Profile, kind: str, value: Column) -> tuple[Column, Column]:
    """(mapped value, error) by the profile's value map: case and runs of spaces don't matter."""
    table = profile.values.get(kind, {})
    key = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    out = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) if table else F.lit(None).cast("string")
    return out, F.when(value.isNotNull() & out.isNull(), F.concat(F.lit(f"unknown {kind}: "), value))


def event_time(profile: Profile, date: Column, time: Column | None = None) -> Column:
    """Epoch ms of a source time (F8); a naive time is in the profile's zone, a missing one is the day's last second."""
    if profile.time_format == "epoch_ms":
        return date.try_cast("long")
    if profile.time_format == "epoch_s":
        return (date.try_cast("decimal(20,3)") * 1000).cast("long")
    text = date if time is None else F.concat_ws(" ", date, F.coalesce(time, F.lit("23:59:59")))
    if profile.time_format != "iso8601":
        naive = F.try_to_timestamp(text, F.lit(java_pattern(profile.time_format))).cast("timestamp_ntz")
        return to_ms(instant_of(naive, profile.zone))
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    day = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(text, F.lit(" 23:59:59"))).otherwise(text)
    naive = F.when(~zoned, day).try_cast("timestamp_ntz")
    return F.when(zoned, F.unix_millis(F.try_to_timestamp(text))).otherwise(to_ms(instant_of(naive, profile.zone)))


#: Strftime directives and Spark's pattern letters.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%b": "MMM", "%B": "MMMM", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%z": "Z"}


def java_pattern(strftime: str) -> str:
    return re.sub(r"%[A-Za-z]", lambda m: DIRECTIVES[m[0]], strftime)


def slug(value: Column) -> Column:
    """Lower case, anything but letters and digits to single dashes, 64 characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(F.trim(value)), r"[^a-z0-9]+", "-"), F.lit("-")), 1, 64)


def sku(value: Column) -> Column:
    """Spaces to dashes, other characters outside A-Z a-z 0-9 . _ - left out, 64 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(value), r"\s+", "-"), r"[^A-Za-z0-9._-]", ""), 1, 64)


def bill_lines(rows: DataFrame, profile: Profile, secret: bytes) -> DataFrame:
    """Canonical bill rows (bill_no, date, time, till, line_no, sku, qty, unit, amount, tax; text) as lines with error.

    _order keeps the source's order; a missing line number is the line's place in its bill.
    """
    qty, qty_error = to_minor(F.col("qty"), 3)
    amount, amount_error = to_minor(F.col("amount"), profile.decimals)
    tax, tax_error = to_minor(F.col("tax"), profile.decimals)
    unit, unit_error = mapped(profile, "unit", F.col("unit"))
    timed = rows.withColumn("_ms", event_time(profile, F.col("date"), F.col("time")))  # on its own, so that it is read once
    errors = [F.when(F.col("sku").isNull(), "no sku"), F.when(F.col("_ms").isNull(), "unreadable time"), qty_error, amount_error, F.when(F.col("tax").isNotNull(), tax_error), unit_error]
    # lines are dealt by their reference, by which bills are grouped afterwards, so they move once
    parsed = timed.select(
        F.when(F.col("bill_no").isNotNull(), reference("bill", F.col("bill_no"), secret)).alias("bill_ref"), F.col("_order"), F.col("_ms").alias("t_ms"), slug(F.coalesce("till", F.lit("till-1"))).alias("till_id"),
        F.col("line_no").alias("_line"), sku(F.col("sku")).alias("sku"), qty.alias("qty_milli"), F.coalesce(unit, F.lit("pcs")).alias("unit"), amount.alias("amount_minor"), F.when(F.col("tax").isNotNull(), tax).alias("tax_minor"),
        F.array_compact(F.array(*errors)).alias("_errors"),
    )
    place = F.row_number().over(W.partitionBy("bill_ref").orderBy("_order"))
    line = F.coalesce(F.col("_line").try_cast("int"), F.when(F.col("_line").isNull(), F.col("_place")))
    numbered = parsed.withColumn("_place", place).withColumn("line_no", line)
    first = F.array_compact(F.array(F.when(F.col("bill_ref").isNull(), "empty bill number"), F.when(F.col("line_no").isNull() | ~F.col("line_no").between(1, 10000), "line number out of range")))
    return numbered.select("bill_ref", "_order", "t_ms", "till_id", "line_no", "sku", "qty_milli", "unit", "amount_minor", "tax_minor", F.array_join(F.concat(first, "_errors"), "; ").alias("error"))


def imported_bills(lines: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bills with action, held-back bills) of one import (D7). known: bill_ref, revision, content, total, till_id.

    A bill with a bad line or repeated line numbers is held back whole. Of the others: `unchanged` content does nothing,
    `new` bills have revision 0, `revised` ones void the known revision and take the next.
    """
    content = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("line_no", "sku", "qty_milli", "unit", "amount_minor", F.coalesce("tax_minor", F.lit(-1)).alias("tax"), "till_id", "t_ms")))), 256)
    good = F.col("error") == ""
    bills = lines.where("bill_ref is not null").groupBy("bill_ref").agg(
        F.count_if(~good).alias("bad"), (F.count("line_no") - F.count_distinct("line_no")).alias("repeated"), content.alias("content"), F.sum("amount_minor").alias("total"), F.min("t_ms").alias("t_ms"), F.min_by("till_id", "_order").alias("till_id")
    )
    held = bills.where("bad > 0 or repeated > 0").select("bill_ref", F.when(F.col("bad") > 0, "a line is bad").otherwise("repeated line numbers").alias("reason"))
    k = known.select("bill_ref", F.col("revision").alias("_rev"), F.col("content").alias("_content"), F.col("total").alias("void_amount"), F.col("till_id").alias("void_till"))
    j = bills.where("bad = 0 and repeated = 0").drop("bad", "repeated").join(k, "bill_ref", "left")
    action = F.when(F.col("_rev").isNull(), "new").when(F.col("_content") == F.col("content"), "unchanged").otherwise("revised")
    revision = F.when(F.col("_rev").isNull(), 0).when(F.col("_content") == F.col("content"), F.col("_rev")).otherwise(F.col("_rev") + 1)
    return j.withColumns({"action": action, "revision": revision, "void_revision": F.col("_rev")}).drop("_rev", "_content"), held


def stock_deltas(lines: DataFrame, bills: DataFrame, before: DataFrame) -> DataFrame:
    """Movements that take a bill's stock from its known revision to the new one (D8). before: bill_ref, sku, unit, qty_milli."""
    changed = bills.where("action <> 'unchanged'").select("bill_ref", "revision")
    now = lines.join(changed, "bill_ref").groupBy("bill_ref", "revision", "sku", "unit").agg(F.sum("qty_milli").alias("now"))
    old = before.join(changed, "bill_ref").select("bill_ref", "revision", "sku", "unit", F.col("qty_milli").alias("old"))
    both = now.join(old, ["bill_ref", "revision", "sku", "unit"], "full_outer").withColumn("delta", F.coalesce("now", F.lit(0)) - F.coalesce("old", F.lit(0))).where("delta <> 0")
    back = F.when(F.col("revision") == 0, "customer_return").otherwise("adjustment")
    return both.select("bill_ref", "revision", "sku", "unit", F.when(F.col("delta") > 0, "out").otherwise("in").alias("direction"), F.when(F.col("delta") > 0, "sale").otherwise(back).alias("reason"), F.abs("delta").alias("qty_milli"))


def numbered_payments(payments: DataFrame) -> DataFrame:
    """payments with payment_no inside the bill and occurrence among identical ones."""
    by_bill = W.partitionBy("bill_ref").orderBy("_order")
    same = W.partitionBy("bill_ref", "tender", "direction", "amount_minor").orderBy("_order")
    return payments.withColumns({"payment_no": F.row_number().over(by_bill), "occurrence": F.row_number().over(same)})


#: Names under which sources know the canonical fields.
SYNONYMS = {
    "bill_no": ("billno", "invoiceno", "receiptno", "billnumber", "voucherno"), "date": ("date", "billdate", "invoicedate", "txndate"), "time": ("time", "billtime"), "till": ("counter", "till", "register", "pos"),
    "line_no": ("line", "lineno", "srno"), "sku": ("itemcode", "sku", "barcode", "productcode", "item"), "qty": ("qty", "quantity"), "unit": ("unit", "uom"), "amount": ("amount", "total", "linetotal", "netamount"), "tax": ("tax", "gst", "taxamount"),
    "tender": ("mode", "tender", "paymentmode"), "direction": ("type", "direction"), "provider_ref": ("txnref", "reference", "utr"),
}


def guessed_profile(columns: list[str]) -> dict[str, str]:
    """Canonical field to column by synonyms of normalised names; a column is used once."""
    plain = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in reversed(columns)}
    out: dict[str, str] = {}
    for name, words in SYNONYMS.items():
        found = next((plain[w] for w in words if w in plain and plain[w] not in out.values()), None)
        if found:
            out[name] = found
    return out


def breaking_changes(old: StructType, new: StructType, path: str = "") -> list[str]:
    """What a new row type takes away from readers of the old one."""
    after = {f.name: f for f in new.fields}
    out = []
    for f in old.fields:
        at = f"{path}{f.name}"
        if f.name not in after:
            out.append(f"{at}: removed")
        elif isinstance(f.dataType, StructType) and isinstance(after[f.name].dataType, StructType):
            out += breaking_changes(f.dataType, after[f.name].dataType, at + ".")
        elif f.dataType != after[f.name].dataType:
            out.append(f"{at}: {f.dataType.simpleString()} becomes {after[f.name].dataType.simpleString()}")
        elif f.nullable and not after[f.name].nullable:
            out.append(f"{at}: now required")
    return out + [f"{path}{f.name}: new and required" for f in new.fields if f.name not in {o.name for o in old.fields} and not f.nullable]
