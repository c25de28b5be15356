"""Severity labels: mapping, naming and integer codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentia.schema import EVENT_TYPE_SEVERITY, LABEL_NAMES, LABELS, UNKNOWN


def _map_literal(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(item) for pair in entries.items() for item in pair])


def _label_array() -> Column:
    return F.array(*[F.lit(label) for label in LABELS])


def severity_of(event_type: Column) -> Column:
    """Severity label of an event type; anything unlisted, null included, is UNKNOWN."""
    return F.coalesce(
        F.try_element_at(_map_literal(EVENT_TYPE_SEVERITY), event_type), F.lit(UNKNOWN)
    )


def label_name(label: Column, keep_unlisted: bool = False) -> Column:
    """Display name of a label; unlisted labels give null, or the label itself on request."""
    name = F.try_element_at(_map_literal(LABEL_NAMES), label)
    return F.coalesce(name, label) if keep_unlisted else name


def encode_label(label: Column) -> Column:
    """Position in the fixed label order; anything unlisted takes the UNKNOWN position."""
    position = F.nullif(F.array_position(_label_array(), label), F.lit(0)) - 1
    return F.coalesce(position, F.lit(LABELS.index(UNKNOWN))).cast("int")


def decode_label(index: Column) -> Column:
    return F.get(_label_array(), index.cast("int"))
