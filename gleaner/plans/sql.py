"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

WS = r"[\s\x0B\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = "[^" + WS[1:]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def status_sql(x: str, a: float, b: float) -> str:
    return f"CASE WHEN {x} >= {a} THEN 'pass' WHEN {x} >= {b} THEN 'partial' ELSE 'fail' END"


def half_up_sql(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS INTEGER)"


def grade_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'A+' WHEN {x} >= 80 THEN 'A' WHEN {x} >= 70 THEN 'B' WHEN {x} >= 60 THEN 'C' WHEN {x} >= 50 THEN 'D' ELSE 'F' END"
