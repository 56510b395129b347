"""PCM on ARRAY<FLOAT> columns of interleaved samples, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _indices(n: Column) -> Column:
    """0 to n - 1, empty for 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)


def frames(samples: Column, channels: int) -> Column:
    return F.floor(F.size(samples) / channels).cast("int")


def downmix(samples: Column, channels: int) -> Column:
    """Mean of each whole frame; one channel as it is."""
    if channels <= 1:
        return samples
    mean = lambda i: sum((F.get(samples, i * channels + c) for c in range(1, channels)), F.get(samples, i * channels)) / F.lit(channels).cast("float")
    return F.transform(_indices(frames(samples, channels)), lambda i: mean(i).cast("float"))


def upmix(samples: Column) -> Column:
    """Mono to stereo."""
    return F.flatten(F.transform(samples, lambda x: F.array(x, x)))


def remix(samples: Column, source: int, target: int) -> Column:
    """Channels beyond the target go; missing ones repeat the first."""
    if source == target:
        return samples
    if target == 1:
        return downmix(samples, source)
    if source == 1 and target == 2:
        return upmix(samples)
    frame = lambda i: F.array(*(F.get(samples, i * source + (c if c < source else 0)) for c in range(target)))
    return F.flatten(F.transform(_indices(frames(samples, source)), frame))


def resample(samples: Column, channels: int, rate: int, target: int) -> Column:
    """Linear interpolation of each channel; the length is rounded half up, the last frame repeats."""
    if rate == target or rate <= 0 or target <= 0 or channels <= 0:
        return samples
    n = frames(samples, channels)
    out = F.floor(n * F.lit(float(target)) / F.lit(float(rate)) + 0.5).cast("int")

    def frame(i: Column) -> Column:
        at = i.cast("double") * rate / target
        low = F.least(F.floor(at).cast("int"), n - 1)
        high = F.least(low + 1, n - 1)
        part = (at - F.floor(at)).cast("float")
        lerp = lambda c: F.get(samples, low * channels + c) + (F.get(samples, high * channels + c) - F.get(samples, low * channels + c)) * part
        return F.array(*(lerp(c).cast("float") for c in range(channels)))

    return F.when(n == 0, samples).otherwise(F.flatten(F.transform(_indices(out), frame)))


def gain(samples: Column, factor: Column | float) -> Column:
    """Samples times a factor, kept within -1 and 1; a factor of 1 changes nothing."""
    g = factor if isinstance(factor, Column) else F.lit(float(factor))
    g = g.cast("float")
    one = F.lit(1.0).cast("float")
    return F.when(F.abs(g - one) < 1e-6, samples).otherwise(F.transform(samples, lambda x: F.greatest(F.least((x * g).cast("float"), one), -one)))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x)))


def normalize(samples: Column, target: float = 0.98) -> Column:
    """Gain that brings the largest sample to the target; silence stays."""
    p = peak(samples)
    return F.when(p > 1e-6, gain(samples, F.lit(target).cast("float") / p)).otherwise(samples)
