"""Coordinates and densities, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dms_to_decimal(d: Column, m: Column, s: Column, negative: Column) -> Column:
    """Signed degrees; parts count by their size; 0 if any isn't a number."""
    x = F.abs(d) + F.abs(m) / 60.0 + F.abs(s) / 3600.0
    return F.when(F.isnan(d) | F.isnan(m) | F.isnan(s), 0.0).otherwise(F.when(negative, -x).otherwise(x))


def dms_with_ref(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """With a reference letter: S and W are negative, whatever their case and the space around."""
    return dms_to_decimal(d, m, s, F.upper(F.regexp_replace(ref, r"(?U)^\s+|\s+$", "")).isin("S", "W"))


def ppu_to_dpi(ppu: Column) -> Column:
    """Pixels a metre as dots an inch."""
    return F.round(ppu * F.lit(0.0254))


def time_stamp(h: Column, m: Column, s: Column) -> Column:
    return F.format_string("%02d:%02d:%05.2fZ", h.cast("int"), m.cast("int"), s.cast("double"))
