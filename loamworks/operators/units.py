"""Quantities in different units: a graph of affine conversions and an equi-join.

A unit is a node. An edge says how a value in one unit becomes a value in another,
``y = scale * x + offset``. The shortest composition from every unit to each
canonical target is worked out once on the small graph, every further edge is
checked against it (a cycle must compose to the identity), and the data is then
converted by one equi-join on the source unit.
"""

from collections import deque
from collections.abc import Iterable
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import broadcast_if_small

FACTOR = T.DecimalType(24, 8)
AMOUNT = T.DecimalType(14, 3)

CONVERSIONS = T.StructType(
    [
        T.StructField("unit", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("scale", FACTOR, False),
        T.StructField("offset", FACTOR, False),
        T.StructField("steps", T.IntegerType(), False),
    ]
)


class UnitCycleError(ValueError):
    """Two ways between the same units give different conversions."""


def shortest_conversions(edges: Iterable[tuple], targets: Iterable[str], tolerance: Fraction = Fraction(1, 10**9)) -> list[tuple]:
    """``(unit, target, scale, offset, steps)`` for every unit that reaches a target.

    ``edges`` holds ``(source, destination, scale, offset)``; each is also walked
    backwards. Null or zero scales are refused. Raises ``UnitCycleError`` when an
    edge contradicts the composition found, beyond the relative ``tolerance``.
    """
    into: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
    for source, destination, scale, offset in edges:
        if source is None or destination is None or scale is None or offset is None:
            raise ValueError(f"an edge with a null: {(source, destination, scale, offset)}")
        a, b = Fraction(scale), Fraction(offset)
        if a == 0:
            raise ValueError(f"a conversion from {source} to {destination} with scale 0")
        into.setdefault(destination, []).append((source, a, b))
        into.setdefault(source, []).append((destination, 1 / a, -b / a))
    out = []
    for target in targets:
        found = {target: (Fraction(1), Fraction(0), 0)}
        queue = deque([target])
        while queue:
            at = queue.popleft()
            a0, b0, steps = found[at]
            for unit, a, b in into.get(at, []):
                way = (a0 * a, a0 * b + b0)
                if unit not in found:
                    found[unit] = (*way, steps + 1)
                    queue.append(unit)
                elif any(abs(x - y) > tolerance * max(abs(x), abs(y), 1) for x, y in zip(way, found[unit], strict=False)):
                    raise UnitCycleError(f"{unit} to {target} by {at}: {way} against {found[unit][:2]}")
        out += [(unit, target, a, b, n) for unit, (a, b, n) in found.items()]
    return out


def conversion_table(spark: SparkSession, edges: Iterable[tuple], targets: Iterable[str]) -> DataFrame:
    """The shortest conversions as a table; one row per unit and target."""
    as_decimal = lambda x: round(Decimal(x.numerator) / Decimal(x.denominator), 8)
    rows = [(u, t, as_decimal(a), as_decimal(b), n) for u, t, a, b, n in shortest_conversions(edges, targets)]
    return spark.createDataFrame(rows, CONVERSIONS)


def convert(df: DataFrame, conversions: DataFrame, unit: str, target: str, values: dict[str, str], n_conversions: int) -> DataFrame:
    """``df`` with, for each ``new: old`` of ``values``, the old column in unit ``target``, rounded half up to whole numbers.

    Rows whose unit is null or unknown keep a null result. Extra columns pass
    through untouched, whatever they are called. ``n_conversions`` is the number
    of conversions, by which the broadcast is decided.
    """
    ways = conversions.where(F.col("target") == target).select(
        F.col("unit").alias("__unit"), F.struct("scale", "offset").alias("__way")
    )
    joined = df.join(broadcast_if_small(ways, n_conversions, 64), df[unit] == F.col("__unit"), "left")
    in_target = lambda c: F.round(F.col(c).cast(AMOUNT) * F.col("__way.scale") + F.col("__way.offset"), 0).cast("long")
    return joined.withColumns({new: in_target(old) for new, old in values.items()}).drop("__unit", "__way")


def pay_edges(fx_rates: list[tuple[str, Decimal]], pay_periods: list[tuple[str, int]]) -> list[tuple]:
    """Edges between units ``CUR/period``: each period to the year, each currency's year to the Australian one."""
    edges = [(f"{cur}/{period}", f"{cur}/annual", n, 0) for cur, _ in fx_rates for period, n in pay_periods if period != "annual"]
    return edges + [(f"{cur}/annual", "AUD/annual", rate, 0) for cur, rate in fx_rates if cur != "AUD"]


def stated(column: Column) -> Column:
    """Whether a text holds a digit at all."""
    return column.rlike("[0-9]")
