"""From a path to its reader."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from chronolith.sources import flat_csv, nested_json, subject_dir, xml_export

READERS: dict[str, Callable[..., DataFrame]] = {"apple_xml": xml_export.read, "flat_csv": flat_csv.read, "nested_json": nested_json.read, "pmdata": subject_dir.read}
SOURCE_NAMES: dict[str, Callable[..., DataFrame]] = {"apple_xml": xml_export.source_names, "flat_csv": flat_csv.source_names, "nested_json": nested_json.source_names, "pmdata": subject_dir.source_names}
_SUFFIXES = {".xml": "apple_xml", ".csv": "flat_csv", ".json": "nested_json"}


def source_format(path: str | Path) -> str:
    p = Path(path)
    if p.is_dir():
        return "pmdata"
    if p.suffix.lower() not in _SUFFIXES:
        raise ValueError(f"no reader for {p.name}")
    return _SUFFIXES[p.suffix.lower()]


def find_inputs(root: str | Path) -> list[Path]:
    """Inputs under ``ours`` and ``other`` and participants' directories ``pmdata/pNN``, in a fixed order."""
    base = Path(root)
    files = [p for d in ("ours", "other") for p in sorted((base / d).glob("*")) if p.is_dir() or p.suffix.lower() in _SUFFIXES]
    return files + sorted(p for p in (base / "pmdata").glob("p[0-9][0-9]") if p.is_dir())
