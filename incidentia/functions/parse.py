"""Fields of one raw report held as a VARIANT value.

A report is malformed when a step of its reading would meet a value of the wrong kind; such a
report is dropped as a whole. Missing keys are not malformed: they have defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentia.functions.text import strip
from incidentia.schema import DEFAULT_EVENT_TYPE


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def _is_array(value: Column) -> Column:
    return _kind(value).startswith("ARRAY")


def _field(record: Column, key: str) -> Column:
    return F.try_variant_get(record, f"$.{key}", "variant")


def _items(value: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>")
    )


def _string(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def scalar_text(record: Column, key: str) -> Column:
    """Text of a top-level field; empty when missing, null when given as null."""
    value = _field(record, key)
    return F.when(value.isNull(), F.lit("")).otherwise(_string(value))


def _objects(record: Column) -> Column:
    return F.filter(
        _items(_field(record, "mdr_text")), lambda item: _kind(item).startswith("OBJECT")
    )


def narrative(record: Column) -> Column:
    """Texts of the narrative items joined by one blank and stripped.

    An item without text adds an empty part, so its separator stays; other items are skipped.
    """
    parts = F.transform(_objects(record), lambda item: F.coalesce(_string(item, "$.text"), F.lit("")))
    return strip(F.array_join(parts, " "))


def narrative_malformed(record: Column) -> Column:
    return F.exists(
        _objects(record),
        lambda item: ~_kind(F.try_variant_get(item, "$.text", "variant")).isin("STRING", "MISSING"),
    ) | (_kind(_field(record, "mdr_text")) == "VOID")


def _first_device(record: Column) -> Column:
    return F.get(_items(_field(record, "device")), F.lit(0))


def _name_part(device: Column, key: str) -> Column:
    value = F.try_variant_get(device, f"$.{key}", "variant")
    return F.when(value.isNull(), F.lit("")).otherwise(_string(value))


def device_name(record: Column) -> Column:
    """Brand of the first device, else its generic name, else empty."""
    first = _first_device(record)
    brand = F.nullif(_name_part(first, "brand_name"), F.lit(""))
    return F.when(first.isNull(), F.lit("")).otherwise(
        F.coalesce(brand, _name_part(first, "generic_name"))
    )


def device_malformed(record: Column) -> Column:
    first = _first_device(record)
    return first.isNotNull() & ~_kind(first).startswith("OBJECT")


def event_type(record: Column, full_name: bool = False) -> Column:
    """First listed event type; a bare string gives its first character, unless ``full_name``.

    Missing, null and empty values give the default type.
    """
    value = _field(record, "event_type")
    text = _string(value)
    items = _items(value)
    bare = text if full_name else F.substring(text, 1, 1)
    return (
        F.when(_is_array(value) & (F.size(items) > 0), _string(F.get(items, F.lit(0))))
        .when((_kind(value) == "STRING") & (text != ""), bare)
        .otherwise(F.lit(DEFAULT_EVENT_TYPE))
    )


def event_type_malformed(record: Column) -> Column:
    """Truthy values that cannot be indexed, and listed entries that are no plain value."""
    value = _field(record, "event_type")
    kind = _kind(value)
    first = F.get(_items(value), F.lit(0))
    falsy = _string(value).isin("0", "false", "{}", "0.0")
    plain = _is_array(value) | kind.isin("STRING", "VOID", "MISSING")
    nested = _kind(first).startswith("ARRAY") | _kind(first).startswith("OBJECT")
    return (~plain & ~F.coalesce(falsy, F.lit(False))) | nested


def reject_reason(record: Column) -> Column:
    """Why a report yields no row; null for a good one."""
    return (
        F.when(~_kind(record).startswith("OBJECT"), F.lit("not_an_object"))
        .when(narrative_malformed(record), F.lit("malformed_narrative"))
        .when(narrative(record) == "", F.lit("no_narrative"))
        .when(device_malformed(record), F.lit("malformed_device"))
        .when(event_type_malformed(record), F.lit("malformed_event_type"))
    )
