"""Checks of parameters and versions on the driver."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = re.compile(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")
_VERSION = re.compile(r"(\d+)\.(\d+)\.(\d+)")
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,63}")
SPANS = {"day": timedelta(days=35), "hour": timedelta(days=7), "15m": timedelta(days=2)}


def duration_ms(text: str) -> int:
    """Milliseconds of an ISO 8601 duration of days and smaller units."""
    m = _DURATION.fullmatch(text)
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {text!r}")
    d, h, mi, s = (float(x or 0) for x in m.groups())
    return round((d * 86400 + h * 3600 + mi * 60 + s) * 1000)


def version(text: str) -> tuple[int, int, int]:
    m = _VERSION.fullmatch(text)
    if not m:
        raise ValueError(f"not a version: {text!r}")
    return tuple(map(int, m.groups()))


def replaced_rules(old: dict[str, dict], new: dict[str, dict]) -> list[str]:
    """Why a new rules document (id to rule) may not replace the old one; empty if it may."""
    errors = [f"{rule}: removed" for rule in old if rule not in new]
    for rule, own in new.items():
        try:
            now = version(own["version"])
        except (KeyError, ValueError) as e:
            errors.append(f"{rule}: {e}")
            continue
        if rule in old:
            before = version(old[rule]["version"])
            changed = {k: v for k, v in own.items() if k not in ("version", "mode")} != {k: v for k, v in old[rule].items() if k not in ("version", "mode")}
            if now < before:
                errors.append(f"{rule}: version goes back from {old[rule]['version']} to {own['version']}")
            elif now == before and changed:
                errors.append(f"{rule}: parameters change without a new version")
    return errors


def checked_window(store_id: str, start: datetime, end: datetime, zone: str, bucket: str = "day") -> None:
    """Raises ValueError for what a read model refuses."""
    if not _ID.fullmatch(store_id or ""):
        raise ValueError("store id")
    ZoneInfo(zone)
    if bucket not in SPANS:
        raise ValueError(f"bucket is one of {', '.join(SPANS)}")
    if not start < end:
        raise ValueError("the window is empty")
    if end - start > SPANS[bucket]:
        raise ValueError(f"at most {SPANS[bucket].days} days by {bucket}")


def duration_ms_of(text: Column) -> Column:
    """duration_ms() of a column; null where a text is no duration."""
    form = f"^{_DURATION.pattern}$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, form, i), F.lit("")).cast("decimal(20,6)"), F.lit(0))
    known = text.rlike(form) & text.rlike(r"\d")
    return F.when(known, F.bround((part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)) * 1000, 0).cast("long"))


def version_of(text: Column) -> Column:
    """Major, minor and patch of a version as a struct, which orders as versions do; null where a text is none."""
    form = f"^{_VERSION.pattern}$"
    numbers = [F.regexp_extract(text, form, i).try_cast("long").alias(n) for i, n in enumerate(("major", "minor", "patch"), 1)]
    return F.when(text.rlike(form), F.struct(*numbers))


def limit_of(limit: Column, least: int = 1, most: int = 1000) -> Column:
    """checked_limit() of a column."""
    return F.greatest(F.lit(least), F.least(F.lit(most), limit)).cast("long")


def checked_limit(limit: int, least: int = 1, most: int = 1000) -> int:
    return max(least, min(most, limit))
