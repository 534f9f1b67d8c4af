"""Row types of store events, stored tables and rule outputs, and the checks of each event type."""

from __future__ import annotations

from dataclasses import dataclass

#: Envelope of an event as read from JSON lines; data stays JSON text until its type is known.
ENVELOPE = (
    "specversion string, id string, source string, type string, time string, subject string, dataschema string, datacontenttype string, "
    "storeid string, partitionkey string, simrunid string, sequence string, traceparent string, tracestate string, data string"
)
REQUIRED = ("specversion", "id", "source", "type", "time", "subject", "dataschema", "storeid", "partitionkey", "data")

SALE_LINE = "store_id string, run_id string, t_ms long, till_id string, bill_ref string, revision int, line_no int, sku string, qty_milli long, unit string, amount_minor long, tax_minor long, currency string"
PAYMENT = "store_id string, run_id string, t_ms long, till_id string, bill_ref string, payment_no int, tender string, direction string, amount_minor long, currency string"
TILL_EVENT = "store_id string, run_id string, t_ms long, till_id string, kind string, bill_ref string, revision int, amount_minor long, currency string"
STOCK_MOVEMENT = "store_id string, run_id string, t_ms long, sku string, direction string, reason string, qty_milli long, unit string"
STOCK_LEVEL = "store_id string, run_id string, t_ms long, seq long, sku string, qty_milli long, unit string, source string"
DAY_TOTAL = "store_id string, run_id string, t_ms long, business_date date, sales_minor long, refunds_minor long, bills long, payments_by_tender map<string,long>, currency string, source string"
RULE_EVENT = "store_id string, run_id string, arrival long, id string, type string, t_ms long, sequence string, zone_id string, track_id string, how string, queue_id string, length int"
INCIDENT = (
    "incident_id string, rule_id string, rule_version string, mode string, kind string, store_id string, run_id string, key string, "
    "subject string, severity string, summary string, onset_ms long, detected_ms long, evidence array<string>, attrs map<string,string>"
)


@dataclass(frozen=True)
class Field:
    """A field of an event type's data: kind is text, int or bool; text may have a pattern or a set of values."""

    name: str
    kind: str = "text"
    required: bool = True
    pattern: str | None = None
    values: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None


_ID, _BILL, _CURRENCY = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$", r"^bill-[0-9a-f]{32}$", r"^[A-Z]{3}$"
#: What event types begin with, unless a deployment passes another prefix.
PREFIX = "com.retail."
#: Event types, the fields of each and their allowed values, as producers send them.
EVENT_TYPES: dict[str, tuple[Field, ...]] = {
    "store.zone.entered": (Field("zoneId", pattern=_ID), Field("trackId"), Field("how", required=False, values=("crossed", "appeared"))),
    "store.zone.exited": (Field("zoneId", pattern=_ID), Field("trackId"), Field("how", required=False, values=("crossed", "lost"))),
    "store.queue.joined": (Field("queueId", pattern=_ID), Field("trackId")),
    "store.queue.left": (Field("queueId", pattern=_ID), Field("trackId"), Field("served", "bool")),
    "store.queue.length": (Field("queueId", pattern=_ID), Field("length", "int", least=0, most=10000), Field("openRegisters", "int", least=0, most=1000)),
    "store.register.opened": (Field("registerId", pattern=_ID),),
    "store.register.closed": (Field("registerId", pattern=_ID),),
    "store.clock.tick": (Field("seq", "int", least=0),),
    "pos.sale.line": (
        Field("storeId"), Field("tillId"), Field("billRef", pattern=_BILL), Field("revision", "int", least=0), Field("lineNo", "int", least=1), Field("sku"),
        Field("qtyMilli", "int"), Field("unit"), Field("amountMinor", "int"), Field("taxMinor", "int", required=False), Field("currency", pattern=_CURRENCY),
    ),
    "pos.payment": (
        Field("storeId"), Field("tillId"), Field("billRef", required=False, pattern=_BILL), Field("paymentNo", "int", least=1), Field("tender"),
        Field("direction", values=("in", "out")), Field("amountMinor", "int", least=1), Field("currency", pattern=_CURRENCY),
    ),
    "pos.till.event": (Field("storeId"), Field("tillId"), Field("kind"), Field("billRef", required=False), Field("revision", "int", required=False), Field("amountMinor", "int", required=False), Field("currency", required=False)),
    "stock.movement": (Field("storeId"), Field("sku"), Field("direction", values=("in", "out")), Field("reason"), Field("qtyMilli", "int", least=1), Field("unit")),
    "stock.level": (Field("storeId"), Field("sku"), Field("qtyMilli", "int"), Field("unit"), Field("source")),
    "pos.day.total": (Field("storeId"), Field("businessDate"), Field("salesMinor", "int"), Field("refundsMinor", "int"), Field("bills", "int", least=0), Field("currency", pattern=_CURRENCY), Field("source")),
}
#: What an event's subject names, by type.
SUBJECTS = {
    "store.zone.entered": r"^zone:.+", "store.zone.exited": r"^zone:.+", "store.queue.joined": r"^queue:.+", "store.queue.left": r"^queue:.+", "store.queue.length": r"^queue:.+",
    "store.register.opened": r"^register:.+", "store.register.closed": r"^register:.+", "store.clock.tick": r"^store:.+", "pos.sale.line": r"^till:.+", "pos.payment": r"^till:.+",
    "pos.till.event": r"^till:.+", "stock.movement": r"^sku:.+", "stock.level": r"^sku:.+", "pos.day.total": r"^store:.+",
}
