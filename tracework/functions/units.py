"""Units, value formatting and cursor arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TIME = {"ps": 1e12, "ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}
VOLTAGE = {"V": 1.0, "mV": 1e3}
_BACK = {"ps": 1e-12, "ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "V": 1.0, "mV": 1e-3}
_PREFIXES = ((1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "k"), (1.0, ""), (1e-3, "m"), (1e-6, "u"), (1e-9, "n"), (1e-12, "p"))


def from_seconds(c: Column, unit: str) -> Column:
    return c * TIME[unit]


def to_seconds(c: Column, unit: str) -> Column:
    return c * F.lit(_BACK[unit]) if unit in TIME else _unknown(unit)


def from_volts(c: Column, unit: str) -> Column:
    return c * VOLTAGE[unit]


def to_volts(c: Column, unit: str) -> Column:
    return c * F.lit(_BACK[unit]) if unit in VOLTAGE else _unknown(unit)


def _unknown(unit: str) -> Column:
    raise ValueError(f"no unit {unit}")


def scientific(c: Column, digits: int) -> Column:
    """``1.5000e-7``: the exponent without padding or plus sign."""
    text = F.regexp_replace(F.format_string(f"%.{digits}e", c), r"e([+-])0*(\d)", "e$1$2")
    return F.regexp_replace(text, r"e\+", "e")


def format_si(c: Column, unit: str) -> Column:
    """Four decimals with an SI prefix from p to T; ``---`` for NaN and infinities, scientific below; null for null."""
    size = F.abs(c)
    text = F.when(F.isnan(c) | (size == float("inf")), F.lit("---")).when(size == 0, F.lit(f"0 {unit}"))
    for scale, prefix in _PREFIXES:
        text = text.when(size >= scale * 0.999, F.format_string(f"%.4f {prefix}{unit}", c / scale))
    return F.when(c.isNotNull(), text.otherwise(F.concat(scientific(c, 4), F.lit(f" {unit}"))))


def format_voltage(c: Column) -> Column:
    """Three decimals, in millivolts below one volt."""
    size = F.abs(c)
    return F.when(c.isNotNull(), F.when(size == 0, F.lit("0.000 V")).when(size < 1, F.format_string("%.3f mV", c * 1e3)).otherwise(F.format_string("%.3f V", c)))


def cursor_delta(a: Column, b: Column) -> tuple[Column, Column]:
    """The cursors' distance and one over it, null at 0."""
    delta = F.abs(b - a)
    return delta, 1 / F.nullif(delta, F.lit(0.0))


def cursor_places(low: float, high: float) -> tuple[float, float]:
    """Two cursors at 15 % of the span on either side of the middle."""
    middle, span = (low + high) / 2, high - low
    return middle - span * 0.15, middle + span * 0.15


def per_division(span: Column | float, divisions: int = 10) -> Column | float:
    """What one division of a screen spans: ten across, eight down."""
    return span / divisions
