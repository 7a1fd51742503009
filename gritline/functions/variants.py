"""Loosely typed JSON fields: telling missing, null, text and number apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gritline.functions import severity as sv
from gritline.vocab import DEFAULT_CONFIDENCE

_NUMERIC = r"^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"


def field(item: Column, name: str) -> Column:
    """Field as a variant: SQL null when missing, a variant null when it is null."""
    return F.try_variant_get(item, f"$.{name}", "variant")


def fields(item: Column, *names: str) -> dict[str, Column]:
    """Columns ``v_<name>`` with the fields of an object.

    Each field is taken out once; the conversions below then work on columns.
    """
    return {f"v_{name}": field(item, name) for name in names}


def kind(value: Column) -> Column:
    """``OBJECT<..>``, ``ARRAY<..>``, ``STRING``, ``BIGINT``, ``VOID`` ..., null when missing."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    """Whether it is an object. Its fields are listed for that; :func:`kind` would go through all that is in them."""
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def is_array(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("ARRAY"), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def is_number(value: Column) -> Column:
    return F.coalesce(kind(value).rlike(_NUMERIC), F.lit(False))


def as_text(value: Column) -> Column:
    """Text of a value, null for missing and null."""
    return F.when(~F.is_variant_null(value), F.try_variant_get(value, "$", "string"))


def as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def truthy_text(value: Column) -> Column:
    """Text of a value that counts as given; null for empty, zero, false, null and missing."""
    text = as_text(value)
    empty = (
        (text == "")
        | (is_number(value) & (as_double(value) == 0))
        | ((kind(value) == "BOOLEAN") & (text == "false"))
        | text.isin("[]", "{}") & ~is_text(value)
    )
    return F.when(~F.coalesce(empty, F.lit(True)), text)


def as_whole(value: Column) -> Column:
    """Whole number of a line field: numbers are cut, text must be integral, else null."""
    number = F.when(is_number(value), as_double(value))
    boolean = F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
    text = F.when(is_text(value), sv.parse_integer(as_text(value)))
    return F.coalesce(number, boolean, text)


def bounded(number: Column, limit: float) -> Column:
    """A double within plus and minus ``limit``, null for not-a-number, so that it can be cast."""
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(-limit), F.least(number, F.lit(limit))))


def line_number(value: Column) -> Column:
    """Whole number of a line field as an int; numbers beyond are cut to the limits."""
    return bounded(as_whole(value), float((1 << 31) - 1)).cast("int")


def is_endless(value: Column) -> Column:
    """True for an infinite number."""
    return F.coalesce(F.abs(as_double(value)) == float("inf"), F.lit(False)) & is_number(value)


def confidence(value: Column) -> Column:
    """0.85 when missing; junk and explicit null give 0.5; the rest is clamped."""
    number = F.when(is_number(value), as_double(value))
    boolean = F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
    text = F.when(is_text(value), sv.parse_number(as_text(value)))
    given = sv.clamp_confidence(F.coalesce(number, boolean, text))
    return F.when(value.isNull(), F.lit(DEFAULT_CONFIDENCE)).otherwise(given)
