"""Source names to a closed vocabulary. Raw names are classified over their distinct values and never kept."""

from __future__ import annotations

import re
import tomllib
import unicodedata
from collections.abc import Mapping
from itertools import chain
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exact product names by type, and parts of device names.
PRODUCTS: dict[str, tuple[str, ...]] = {
    "wearable": ("google health", "zepp"),
    "scale": ("withings", "renpho health"),
    "app": ("gymkit", "strava", "myfitnesspal", "waterminder", "headspace", "seven", "streaks", "snorelab", "sleep", "sleep++", "sleepwatch", "zombies, run!", "bevel", "spire", "clock"),
    "manual": ("health",),
    "derived": ("aggregated",),
}
DEVICES = (("apple watch", "wearable"), ("iphone", "phone"), ("ipad", "phone"))
UNKNOWN = "unknown"


def normalize(name: str) -> str:
    """A name folded for comparison: NFKC, no trailing ``(123)``, single spaces, case-folded."""
    text = unicodedata.normalize("NFKC", name)
    return " ".join(re.sub(r"\s*\(\d+\)\s*$", "", text).split()).casefold()


def classify(name: str | None, overrides: Mapping[str, str] | None = None) -> tuple[str, bool]:
    """(type, matched) of one name: override, device, product, else unknown and unmatched. Blank is unknown, matched."""
    if name is None or not name.strip():
        return UNKNOWN, True
    folded = normalize(name)
    own = {normalize(k): v for k, v in (overrides or {}).items()}
    if folded in own:
        return own[folded], True
    for part, kind in DEVICES:
        if part in folded:
            return kind, True
    for kind, names in PRODUCTS.items():
        if folded in names:
            return kind, True
    return UNKNOWN, False


def source_type(x: Column) -> Column:
    """The type of a name as a native expression, for names that ASCII folding normalizes (no NFKC in SQL)."""
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*\(\d+\)\s*$", ""), r"(?U)\s+", " ")))
    out = F.when(x.isNull() | (t == ""), UNKNOWN)
    for part, kind in DEVICES:
        out = out.when(t.contains(part), kind)
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable((n, k) for k, names in PRODUCTS.items() for n in names)])
    return out.otherwise(F.coalesce(F.try_element_at(table, t), F.lit(UNKNOWN)))


def classified(df: DataFrame, column: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with ``source_type`` in place of the names. Distinct names (a small set) pass through Python once."""
    own = dict(overrides or {})
    kind = F.udf(lambda n: classify(n, own)[0], "string")
    names = df.select(column).distinct().withColumn("source_type", kind(column))
    return df.join(names.withColumnRenamed(column, "__name"), F.col(column).eqNullSafe(F.col("__name")), "left").drop("__name", column)


def unmatched(df: DataFrame, column: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct names that no rule covers."""
    own = dict(overrides or {})
    known = F.udf(lambda n: classify(n, own)[1], "boolean")
    return df.select(column).distinct().filter(~known(column))


def load_table(path: str | Path, section: str) -> dict[str, str]:
    """One section of a TOML side table keyed by input path; empty where the file or section is missing."""
    file = Path(path)
    return dict(tomllib.loads(file.read_text()).get(section, {})) if file.exists() else {}


def load_subject_id(path: str | Path, key: str) -> str:
    found = load_table(path, "subjects").get(key)
    if not found:
        raise KeyError(f"no subject id for {key!r} in {path}")
    return found


def load_overrides(path: str | Path, key: str) -> dict[str, str]:
    file = Path(path)
    return dict(tomllib.loads(file.read_text()).get("sources", {}).get(key, {})) if file.exists() else {}
