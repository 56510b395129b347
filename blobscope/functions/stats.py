"""Byte statistics. One Arrow function counts the bytes; every statistic is an expression over the counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Critical value of chi-square with 255 degrees of freedom at 0.01.
CRITICAL_A01 = 310.457
LIBRARY_ENTROPY, DEFAULT_ENTROPY = 7.95, 7.92
LEAST_SCAN, LARGE_COMMENT, LARGE_APP = 256, 256, 32768


@F.arrow_udf(T.ArrayType(T.LongType()))  # a type, not a string: the module is imported before a session
def byte_histogram(content: pa.Array) -> pa.Array:
    """256 counts of each blob; null for null."""
    rows = [None if b is None else np.bincount(np.frombuffer(b, np.uint8), minlength=256) for b in (x.as_py() for x in content)]
    return pa.array(rows, pa.list_(pa.int64()))


def total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("long"), lambda s, c: s + c)


def entropy(hist: Column) -> Column:
    """Shannon entropy in bits a byte; 0 for no bytes. One pass over the counts: log2(n) - sum(c log2 c) / n."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
    step = lambda a, c: F.struct((a["n"] + c).alias("n"), (a["s"] + F.when(c > 0, c * F.log2(c)).otherwise(0.0)).alias("s"))
    return F.aggregate(hist, start, step, lambda a: F.when(a["n"] > 0, F.greatest(F.log2(a["n"]) - a["s"] / a["n"], F.lit(0.0))).otherwise(0.0))


def entropy_from_bytes(content: Column) -> Column:
    return entropy(byte_histogram(content))


def chi_square(hist: Column) -> Column:
    """Distance from the uniform distribution; an expected count is 1 at least. 0 for no bytes. One pass over the
    counts: with e expected, sum((c - e)^2) / e = sum(c^2) / e - 2 n + 256 e, and sum(c^2) is exact in integers."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("s"))
    step = lambda a, c: F.struct((a["n"] + c).alias("n"), (a["s"] + c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)").alias("s"))

    def finish(a: Column) -> Column:
        e = F.greatest(a["n"] / 256.0, F.lit(1.0))
        return F.when(a["n"] == 0, 0.0).otherwise(F.greatest(a["s"].cast("double") / e - 2.0 * a["n"] + 256.0 * e, F.lit(0.0)))

    return F.aggregate(hist, start, step, finish)


def normal_tail(z: Column) -> Column:
    """P(Z > z), by the rational approximation 7.1.26 of Abramowitz and Stegun for erfc."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    # fixed values: coefficients of the approximation
    poly = F.lit(1.061405429)
    for a in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + a
    y = poly * t * F.exp(-x * x)
    return F.when(z < -8, 1.0).when(z > 8, 0.0).otherwise(0.5 * F.when(x >= 0, y).otherwise(2.0 - y))


def chi_square_p(stat: Column, df: int | Column) -> Column:
    """Approximate p-value by the cube-root transformation of Wilson and Hilferty."""
    k = F.lit(df).cast("double") if isinstance(df, int) else df.cast("double")
    v = 2.0 / (9.0 * k)
    z = (F.pow(stat / k, F.lit(1 / 3)) - (1.0 - v)) / F.sqrt(v)
    return F.when((k == 0) | (stat <= 0), 1.0).otherwise(normal_tail(z))


def pairs_of_values(hist: Column) -> Column:
    """struct(stat, df) of the test for equal counts in pairs (2k, 2k + 1)."""
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.struct((F.get(hist, 2 * k) + F.get(hist, 2 * k + 1)).alias("s"), (F.get(hist, 2 * k) - F.get(hist, 2 * k + 1)).alias("d"))), lambda p: p["s"] > 0)
    stat = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["d"] * p["d"] / (2.0 * p["s"]))
    return F.struct(stat.alias("stat"), F.greatest(F.size(pairs) - 1, F.lit(0)).alias("df"))


def ascii_ratio(hist: Column) -> Column:
    """Share of graphic ASCII, space, tab and line ends."""
    n = total(hist)
    count = F.aggregate(F.slice(hist, 33, 95), F.lit(0).cast("long"), lambda s, c: s + c) + F.get(hist, F.lit(9)) + F.get(hist, F.lit(10)) + F.get(hist, F.lit(13))
    return F.when(n == 0, 0.0).otherwise(count / n)


def non_printable_ratio(hist: Column) -> Column:
    """Share of bytes outside 32 to 126 and 9 to 13."""
    n = total(hist)
    good = F.aggregate(F.slice(hist, 33, 95), F.lit(0).cast("long"), lambda s, c: s + c) + F.aggregate(F.slice(hist, 10, 5), F.lit(0).cast("long"), lambda s, c: s + c)
    return F.when(n == 0, 0.0).otherwise((n - good) / n)


def _finding(kind: str, severity: str, description: Column, metric: Column) -> Column:
    return F.struct(F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"), description.alias("description"), metric.cast("double").alias("metric_value"))


def _kept(*cases: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*(F.when(c, f) for c, f in cases)), lambda f: f.isNotNull())


def comment_findings(size: Column, non_printable: Column) -> Column:
    """Findings on a comment of so many bytes, of which this share isn't printable."""
    return _kept(
        (size > LARGE_COMMENT, _finding("SuspiciousComment", "Low", F.format_string("Unusually large comment payload detected (%d bytes > 256 threshold)", size), size)),
        ((size > 0) & (non_printable > 0.15), _finding("SuspiciousComment", "Medium", F.format_string("High proportion of non-printable bytes in COM segment (%.1f%% > 15.0%% threshold)", non_printable * 100), non_printable)),
    )


def app_findings(size: Column, marker: Column) -> Column:
    return _kept((size > LARGE_APP, _finding("SuspiciousAppSegment", "Low", F.format_string("Unusually large APP%d segment detected (%d bytes > 32768 threshold)", marker - 0xE0, size), size)))


def scan_report(hist: Column) -> Column:
    """Statistics and findings of entropy-coded data, from its counts; less than 256 bytes aren't tested."""
    n, pov = total(hist), pairs_of_values(hist)
    enough = n >= LEAST_SCAN
    stat = F.when(enough, chi_square(hist)).otherwise(0.0)
    p = F.when(enough, chi_square_p(stat, 255)).otherwise(1.0)
    ratio = ascii_ratio(hist)
    findings = _kept(
        (enough & ((stat > CRITICAL_A01) | (p < 0.01)), _finding("SuspiciousScanData", "Medium", F.format_string("Chi-Square test indicates significant statistical deviation from expected distribution (Stat=%.2f, p=%.4f < alpha=0.01)", stat, p), stat)),
        (enough & (pov["df"] > 64) & (pov["stat"] < pov["df"] * 0.2), _finding("AnomalousPoVDistribution", "High", F.format_string("Pairs-of-Values distribution is artificially equalized (PoV Stat=%.2f vs df=%d), indicative of LSB steganography", pov["stat"], pov["df"]), pov["stat"])),
        (enough & (ratio > 0.12), _finding("EmbeddedAsciiText", "High", F.format_string("Suspicious ASCII concentration detected in compressed scan stream (%.1f%% > 12.0%% threshold)", ratio * 100), ratio)),
    )
    return F.struct(n.alias("scan_data_bytes"), stat.alias("chi_square_stat"), F.lit(255).alias("degrees_of_freedom"), p.alias("p_value_approx"), F.when(enough, pov["stat"]).alias("pov_chi_square_stat"), ratio.alias("ascii_ratio"), findings.alias("findings"))


def is_suspicious(findings: Column) -> Column:
    return F.exists(findings, lambda f: f["severity"].isin("Medium", "High", "Critical"))


def overlay(logical: Column, physical: Column) -> Column:
    return F.struct((physical > logical).alias("has_overlay"), logical.alias("logical_size"), physical.alias("physical_size"), F.greatest(physical - logical, F.lit(0)).alias("overlay_size"))


def preview(data: Column) -> Column:
    """Hex pairs and printable characters of some bytes: `41 00 | A.`; empty for no bytes."""
    pairs = F.regexp_replace(F.hex(data), "(..)(?!$)", "$1 ")
    shown = F.regexp_replace(F.decode(data, "ISO-8859-1"), "[^\\x20-\\x7e]", ".")
    return F.when(F.length(data) == 0, "").otherwise(F.concat(pairs, F.lit(" | "), shown))
