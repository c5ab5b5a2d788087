"""Lenient JSON getters over STRING or VARIANT columns: whatever cannot be had is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_KEYS = 6


def _path(keys: tuple[str | int, ...]) -> str:
    if not 1 <= len(keys) <= MAX_KEYS:
        raise ValueError(f"between 1 and {MAX_KEYS} keys are needed, not {len(keys)}")
    return "$" + "".join(f"[{k}]" if isinstance(k, int) or str(k).isdigit() else f"['{str(k)}']" for k in keys)


def as_variant(col: Column | str) -> Column:
    return F.try_parse_json(F.col(col) if isinstance(col, str) else col)


def get_json(value: Column, *keys: str | int) -> Column:
    """Any value as VARIANT, for chaining."""
    return F.try_variant_get(value, _path(keys), "variant")


def get_string(value: Column, *keys: str | int) -> Column:
    """Strings without quotes, other values as JSON text, JSON null as NULL."""
    return F.try_variant_get(value, _path(keys), "string")


def get_int(value: Column, *keys: str | int) -> Column:
    return F.try_variant_get(value, _path(keys), "bigint")


def get_float(value: Column, *keys: str | int) -> Column:
    return F.try_variant_get(value, _path(keys), "double")


def get_bool(value: Column, *keys: str | int) -> Column:
    return F.try_variant_get(value, _path(keys), "boolean")


def extract(value: Column, path: str) -> Column:
    """JSON text of whatever lies at ``path`` (``$.a.b``); a string keeps its quotes."""
    return F.to_json(F.try_variant_get(value, path, "variant"))


def array_contains(value: Column, key: str, wanted: str) -> Column:
    return F.array_contains(F.try_variant_get(value, _path((key,)), "array<string>"), wanted)


def array_length(value: Column, key: str) -> Column:
    items = F.try_variant_get(value, _path((key,)), "array<variant>")
    return F.when(items.isNotNull(), F.size(items))
