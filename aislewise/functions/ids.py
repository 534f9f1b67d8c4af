"""Deterministic identifiers and references as columns."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(secret: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(secret).digest() if len(secret) > _BLOCK else secret).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 as lower-case hex, from sha2 alone: the pads depend on the secret only."""
    inner, outer = _pads(secret)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def reference(kind: str, number: Column, secret: bytes) -> Column:
    """`kind`- and 32 hex digits: a reference that doesn't show the number it stands for."""
    return F.concat(F.lit(f"{kind}-"), F.substring(hmac_sha256(number, secret), 1, 32))


def _uuid(hex32: Column, version: str) -> Column:
    variant = F.conv(F.substring(hex32, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8
    return F.concat_ws(
        "-",
        F.substring(hex32, 1, 8),
        F.substring(hex32, 9, 4),
        F.concat(F.lit(version), F.substring(hex32, 14, 3)),
        F.concat(F.lower(F.hex(variant.cast("long"))), F.substring(hex32, 18, 3)),
        F.substring(hex32, 21, 12),
    )


def name_uuid(name: Column) -> Column:
    """Version 3 UUID of a name without namespace: incident ids."""
    return _uuid(F.md5(F.encode(name, "utf-8")), "3")


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name in a namespace UUID."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    return _uuid(F.substring(F.sha1(F.concat(space, F.encode(name, "utf-8"))), 1, 32), "5")


def incident_id(rule_id: str, version: str | Column, store: Column, run: Column, key: Column, onset_ms: Column) -> Column:
    """Same rule, major version, store, run, key and onset give the same id; a null run is spelt `null`."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    major = F.lit(version.split(".")[0]) if isinstance(version, str) else F.substring_index(version, ".", 1)
    return name_uuid(F.concat_ws("|", F.lit(rule_id), major, text(store), text(run), text(key), text(onset_ms)))


def daily_pseudonym(secret: bytes, day: Column, local_id: Column) -> Column:
    """trk- and 16 hex digits that change every UTC day: HMAC under a key that is itself an HMAC of the day."""
    inner, outer = _pads(secret)
    day_key = F.unhex(F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(day, "utf-8")), 256))), 256))
    padded = F.concat(day_key, F.lit(bytes(_BLOCK - 32)))
    xor = lambda pad: F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(_BLOCK)), lambda i: F.lpad(F.hex(F.conv(F.hex(F.substring(padded, i, 1)), 16, 10).cast("long").bitwiseXOR(F.lit(pad).cast("long"))), 2, "0")), ""))
    mac = F.sha2(F.concat(xor(0x5C), F.unhex(F.sha2(F.concat(xor(0x36), F.encode(local_id, "utf-8")), 256))), 256)
    return F.concat(F.lit("trk-"), F.substring(mac, 1, 16))


def _canonical(text):
    def one(t):
        try:
            value = json.loads(t)
        except (TypeError, ValueError):
            return None
        if isinstance(value, dict):
            value = {k: v for k, v in value.items() if k not in ("traceparent", "tracestate")}
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return text.map(one)


def canonical_json(text: Column) -> Column:
    """Sorted keys, no spaces, non-ASCII as it is, trace context left out at the top level; null for invalid JSON (F1)."""
    return F.pandas_udf(_canonical, "string")(text)


def payload_hash(envelope_json: Column) -> Column:
    """SHA-256 of the canonical form (F2): equal for events that differ in key order or trace context only."""
    return F.sha2(canonical_json(envelope_json), 256)
