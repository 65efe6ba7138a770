"""Math channels: arithmetic, derivative and integral of series."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import Column, DataFrame, functions as F

from ..frame import Series, join_on, lagged, running_sum

EPSILON = 2.220446049250313e-16


class Op(StrEnum):
    ADD = "add"
    SUBTRACT = "subtract"
    MULTIPLY = "multiply"
    INVERT = "invert"
    ABS = "abs"
    DERIVATIVE = "derivative"
    INTEGRAL = "integral"

    @property
    def binary(self) -> bool:
        return self in (Op.ADD, Op.SUBTRACT, Op.MULTIPLY)


_NAMES = {Op.ADD: "{a}+{b}", Op.SUBTRACT: "{a}-{b}", Op.MULTIPLY: "{a}*{b}", Op.INVERT: "-{a}", Op.ABS: "|{a}|", Op.DERIVATIVE: "d({a})/dt", Op.INTEGRAL: "int({a})"}


@dataclass(frozen=True)
class MathChannel:
    """A virtual channel: an operation on one or two channels of a wide table."""

    op: Op
    a: str
    b: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "op", Op(self.op))
        if self.op.binary and self.b is None:
            raise ValueError(f"{self.op} needs two channels")

    @property
    def name(self) -> str:
        return _NAMES[self.op].format(a=self.a, b=self.b)

    def column(self) -> Column:
        """The row-wise part of the operation."""
        a, b = F.col(f"`{self.a}`"), F.col(f"`{self.b}`") if self.b else None
        return {Op.ADD: lambda: a + b, Op.SUBTRACT: lambda: a - b, Op.MULTIPLY: lambda: a * b, Op.INVERT: lambda: -a, Op.ABS: lambda: F.abs(a)}.get(self.op, lambda: a)()

    def apply(self, df: DataFrame, s: Series) -> DataFrame:
        """The channel's points (.., row_id, t, v), row by row at full resolution."""
        points = df.select(*s.keys, s.row, s.t, self.column().alias(s.v))
        if self.op == Op.DERIVATIVE:
            return derivative(points, s)
        return integral(points, s) if self.op == Op.INTEGRAL else points


def derivative(df: DataFrame, s: Series) -> DataFrame:
    """(.., row_id, t, v): the slope between neighbours at the middle of their times; none where the times do not differ by more than ``EPSILON``."""
    df = lagged(df, s, "_p", s.t, s.v)
    dt = F.col(s.t) - F.col(f"_p.{s.t}")
    kept = df.where(F.abs(dt) > EPSILON)
    return kept.select(*s.keys, s.row, ((F.col(s.t) + F.col(f"_p.{s.t}")) / 2).alias(s.t), ((F.col(s.v) - F.col(f"_p.{s.v}")) / dt).alias(s.v))


def integral(df: DataFrame, s: Series) -> DataFrame:
    """(.., row_id, t, v): the trapezoid sum up to each row, 0 at the first."""
    df = lagged(df, s, "_p", s.t, s.v)
    area = (F.col(s.v) + F.col(f"_p.{s.v}")) / 2 * (F.col(s.t) - F.col(f"_p.{s.t}"))
    return running_sum(df, s, "_area", area).select(*s.keys, s.row, s.t, F.col("_area").alias(s.v))


class Registry:
    """Named math channels over a table; a channel may use the row-wise ones registered before it."""

    def __init__(self) -> None:
        self.channels: dict[str, MathChannel] = {}

    def add(self, channel: MathChannel, name: str | None = None) -> str:
        name = name or channel.name
        if name in self.channels:
            raise ValueError(f"there is a channel {name} already")
        self.channels[name] = channel
        return name

    def remove(self, name: str) -> None:
        del self.channels[name]

    def points(self, df: DataFrame, s: Series, name: str) -> DataFrame:
        channel = self.channels[name]
        for source in (channel.a, channel.b):
            if source in self.channels:
                df = self._with(df, s, source)
        return channel.apply(df, s)

    def _with(self, df: DataFrame, s: Series, name: str) -> DataFrame:
        """The table with a channel as a column; a derivative stands at its later row, and at none that has no row before it."""
        channel = self.channels[name]
        for source in (channel.a, channel.b):
            if source in self.channels and source not in df.columns:
                df = self._with(df, s, source)
        if channel.op in (Op.DERIVATIVE, Op.INTEGRAL):
            own = channel.apply(df, s).select(*s.keys, s.row, F.col(s.v).alias(name))
            return join_on(df, own, [*s.keys, s.row], "left")
        return df.withColumn(name, channel.column())
