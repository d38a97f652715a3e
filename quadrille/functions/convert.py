"""Conversion of text cells and literals to declared kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.errors import BindError
from quadrille.types import SPARK, ColumnSpec

#: The spellings of truth in text cells; any other text that isn't blank is false.
TRUE_WORDS = ("true", "1", "yes", "verified")
DIGITS = 6

_POINT = r"^\s*(?i:point)?\s*\(?\s*([^,()\s]+)\s*,\s*([^,()\s]+)\s*\)?\s*$"


def fit_bytes(text: Column, size: int) -> Column:
    """The longest beginning of whole characters that takes at most ``size`` bytes."""
    fits = F.filter(F.sequence(F.lit(size // 4), F.lit(size)), lambda k: F.octet_length(F.left(text, k)) <= size)
    return F.when(F.octet_length(text) <= size, text).otherwise(F.left(text, F.array_max(fits)))


def parse_point(text: Column) -> Column:
    x, y = (F.regexp_extract(text, _POINT, k).try_cast("double") for k in (1, 2))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.round(x, DIGITS).alias("x"), F.round(y, DIGITS).alias("y")))


def parse_cell(text: Column, spec: ColumnSpec) -> Column:
    """The cell's value, or null if it isn't one.  Text is trimmed; numbers with a fraction are rounded to DIGITS places."""
    bare = F.trim(text)
    if spec.kind == "VARCHAR":
        return fit_bytes(bare, spec.size)
    if spec.kind == "BOOL":
        return F.when(bare != "", F.lower(bare).isin(*TRUE_WORDS))
    if spec.kind == "POINT":
        return parse_point(bare)
    value = bare.try_cast(SPARK[spec.kind])
    return F.round(value, DIGITS) if spec.kind == "FLOAT" else value


def literal(spec: ColumnSpec, kind: str, value: object) -> Column:
    """A literal of the dialect as a value of the column's kind; kinds that don't fit are an error."""
    wrong = BindError(f"column '{spec.name}' of type {spec.kind} can't be compared with or hold {kind} {value!r}")
    if spec.kind == "POINT":
        if kind == "POINT":
            x, y = value
        elif kind == "STRING" and len(parts := str(value).strip().removeprefix("POINT").strip(" ()").split(",")) == 2:
            x, y = _number(parts[0], wrong), _number(parts[1], wrong)
        else:
            raise wrong
        return F.struct(F.lit(round(float(x), DIGITS)).alias("x"), F.lit(round(float(y), DIGITS)).alias("y"))
    if kind == "POINT":
        raise wrong
    if spec.kind == "VARCHAR":
        if kind != "STRING":
            raise wrong
        cut = str(value).strip().encode()[: spec.size].decode(errors="ignore")
        return F.lit(cut)
    if spec.kind == "BOOL":
        if kind == "STRING":
            return F.lit(str(value).strip().lower() in TRUE_WORDS)
        if kind == "BOOL" or value in (0, 1):
            return F.lit(bool(value))
        raise wrong
    number = _number(value, wrong)
    if spec.kind == "INT":
        if number != int(number) or not -(2**31) <= number < 2**31:
            raise wrong
        return F.lit(int(number)).cast("int")
    return F.lit(round(float(number), DIGITS))


def _number(value: object, wrong: Exception) -> float | int:
    try:
        return value if isinstance(value, (int, float)) else (float(value) if "." in str(value) or "e" in str(value).lower() else int(str(value)))
    except ValueError:
        raise wrong from None
