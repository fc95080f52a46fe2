"""Report sink (S5): all results as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.plan import result_rows


def write_report(results: dict, path: str, mode: str = "overwrite") -> DataFrame | None:
    """Write every result as ``{"result": key, "row_json": ...}`` lines;
    returns the written frame (None when there is nothing to write)."""
    rows = result_rows(results)
    if rows is not None:
        rows.write.mode(mode).json(path)
    return rows
