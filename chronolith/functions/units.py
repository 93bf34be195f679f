"""Recorded units to canonical ones. An unlisted unit stops the run: a wrong factor is worse than no data."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Recorded unit, canonical unit, factor.
UNITS: dict[str, tuple[str, float]] = {
    "m": ("m", 1.0), "cm": ("m", 0.01), "in": ("m", 0.0254), "ft": ("m", 0.3048), "km": ("m", 1000.0), "mi": ("m", 1609.344),
    "m/s": ("m/s", 1.0), "ft/s": ("m/s", 0.3048), "km/hr": ("m/s", 1 / 3.6), "mi/hr": ("m/s", 0.44704),
    "s": ("s", 1.0), "ms": ("s", 0.001), "min": ("s", 60.0), "hr": ("s", 3600.0), "hours": ("s", 3600.0),
    "kg": ("kg", 1.0), "lb": ("kg", 0.45359237), "g": ("g", 1.0), "mg": ("mg", 1.0), "mL": ("mL", 1.0),
    "kcal": ("kcal", 1.0), "Cal": ("kcal", 1.0), "%": ("fraction", 1.0), "fraction": ("fraction", 1.0),
    "count": ("count", 1.0), "score": ("score", 1.0), "count/min": ("count/min", 1.0), "kcal/hr·kg": ("kcal/hr·kg", 1.0),
    "mL/min·kg": ("mL/min·kg", 1.0), "W": ("W", 1.0), "dBASPL": ("dBASPL", 1.0),
}


class UnknownUnitError(ValueError):
    """Units that have no conversion."""


def _map(which: int) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable((k, v[which]) for k, v in UNITS.items())])


def unknown_units(df: DataFrame) -> DataFrame:
    """Distinct recorded units without a conversion."""
    return df.select("unit").distinct().filter(F.col("unit").isNotNull() & ~F.col("unit").isin(*UNITS))


def converted(df: DataFrame) -> DataFrame:
    """``unit`` and ``value_num`` in canonical units; null units stay. No check of unknown units, see ``canonicalize``."""
    factor = F.coalesce(F.try_element_at(_map(1), F.col("unit")), F.lit(1.0))
    return df.withColumns({"value_num": F.col("value_num") * factor, "unit": F.try_element_at(_map(0), F.col("unit"))})


def canonicalize(df: DataFrame) -> DataFrame:
    """As ``converted``, after an error for unknown units: twenty are named, the others counted."""
    unknown = unknown_units(df)
    count = unknown.count()
    if count:
        some = [r.unit for r in unknown.orderBy("unit").limit(20).collect()]
        raise UnknownUnitError(f"no conversion for {some}" + (f" and {count - 20} more" if count > 20 else ""))
    return converted(df)
