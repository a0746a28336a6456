"""Scalar functions: utility curves, exact quantisation, seeds, parsing."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UTILITIES = ("exponential", "linear_capped", "binary", "linear")


def utility(duration: Column, kind: str, saturation: float) -> Column:
    """exponential reaches 0.99 at the saturation; linear has no bound."""
    share = duration / F.lit(float(saturation))
    if kind == "exponential":
        return -F.expm1(F.lit(-math.log(100.0)) * share)
    if kind == "linear_capped":
        return F.least(share, F.lit(1.0))
    if kind == "binary":
        return (duration > 0).cast("double")
    if kind == "linear":
        return share
    raise ValueError(f"no utility named {kind!r}; there are {', '.join(UTILITIES)}")


def quantised(value: Column, places: int = 12) -> Column:
    """round_half_even(value / 10**-places) as decimal(38,0), from the shortest decimal text of a double below 1e12; no digit is lost before the one rounding."""
    return (F.bround(value.cast("string").cast("decimal(38,26)"), places) * F.lit(10**places).cast("decimal(13,0)")).cast("decimal(38,0)")


def canonical_json(value) -> bytes:
    """Sorted keys, no white space, finite numbers only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def stable_id(namespace: str, value) -> str:
    return f"{namespace}_{hashlib.sha256(canonical_json(value)).hexdigest()[:32]}"


def semantic_seed(labels: Column) -> Column:
    """The first 8 bytes of the text's SHA-256 as decimal(20,0): the same wherever a row is computed."""
    return F.conv(F.substring(F.sha2(labels.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def parsed_float(text: Column, nonnegative: bool = False) -> Column:
    """A finite double, else null."""
    x = F.trim(text).try_cast("double")
    good = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(good & (x >= 0) if nonnegative else good, x)


def parsed_identifier(text: Column) -> Column:
    """Text as it stands, leading zeros and all; blank is null."""
    return F.when(F.length(F.trim(text)) > 0, text)


def service_seconds(text: Column) -> Column:
    """HH:MM:SS with hours past 24, in seconds; null if malformed."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{1,3}):([0-5]\d):([0-5]\d)\s*$", i).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def osm_speed(text: Column) -> Column:
    """Metres a second of `50`, `50 km/h` or `30 mph` if in (0, 200] km/h, else null."""
    pattern = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*(mph|km/h|kph)?\s*$"
    kmh = F.regexp_extract(text, pattern, 1).try_cast("double") * F.when(F.lower(F.regexp_extract(text, pattern, 2)) == "mph", F.lit(1.609344)).otherwise(F.lit(1.0))
    return F.when((kmh > 0) & (kmh <= 200), kmh / 3.6)


def one_way(text: Column) -> Column:
    """True, false, or null where the text is neither."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes"), True).when(t.isin("0", "false", "no"), False)


def expected_overlap(start: Column, end: Column, first: Column, latest: Column, duration: Column) -> Column:
    """The mean overlap of [start, end) with a shift of a duration that begins anywhere between first and latest alike."""
    ramp = lambda x: F.greatest(x, F.lit(0.0)) * F.greatest(x, F.lit(0.0)) / 2
    area = lambda t: ramp(t - first) - ramp(t - latest)  # noqa: E731  integral of the share of shifts begun by t
    spread = (area(end) - area(start) - area(end - duration) + area(start - duration)) / (latest - first)
    fixed = F.greatest(F.least(end, first + duration) - F.greatest(start, first), F.lit(0.0))
    return F.when(latest > first, spread).otherwise(fixed)


def local_instant(local: Column, zone: str) -> Column:
    """The instant of a local time without offset; null where clocks skip it or show it twice."""
    utc = F.to_utc_timestamp(local, zone)
    skipped = F.from_utc_timestamp(utc, zone) != local
    twice = (F.from_utc_timestamp(utc + F.expr("interval 1 hour"), zone) == local) | (F.from_utc_timestamp(utc - F.expr("interval 1 hour"), zone) == local)
    return F.when(~(skipped | twice), utc)
