"""Deterministic ids: every write in the package is idempotent because of these."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed import ID_SEPARATOR


def domain_id(domain: str, *parts: Column) -> Column:
    """SHA-256 over the domain and its parts; a missing part counts as the empty string."""
    safe = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(ID_SEPARATOR, F.lit(domain), *safe), 256)


def stable_json(text: Column) -> Column:
    """JSON text with the keys of every object in sorted order (null when not JSON)."""
    return F.to_json(F.try_parse_json(text))


def estimate_tokens(text: Column) -> Column:
    """One token per three UTF-8 bytes, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(3.0)).cast("int"))


def epoch_timestamp(seconds: Column) -> Column:
    """Epoch seconds to a timestamp; values that are not finite or not in year 1..9999 give null."""
    value = seconds.cast("double")
    in_range = (value >= F.lit(-62135596800.0)) & (value < F.lit(253402300800.0))
    return F.when(in_range, F.timestamp_millis((value * 1000).cast("bigint")))


def iso(ts: Column) -> Column:
    """ISO-8601 text with milliseconds, always UTC sessions."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
