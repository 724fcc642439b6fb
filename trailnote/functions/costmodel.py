"""A roofline cost model as column arithmetic on doubles. Nulls stay null; nothing divides by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def arithmetic_intensity(flops: Column, bytes_moved: Column) -> Column:
    """FLOPs per byte; null for no bytes."""
    return F.try_divide(flops.cast("double"), bytes_moved.cast("double"))


def critical_intensity(peak_flops: Column, bandwidth: Column) -> Column:
    """FLOPs per byte from which a machine is bound by computing."""
    return F.try_divide(peak_flops.cast("double"), bandwidth.cast("double"))


def bound_by(intensity: Column, critical: Column) -> Column:
    """'compute' above the critical intensity, else 'bandwidth' (at equality too); null if either is."""
    return F.when(intensity > critical, "compute").when(intensity <= critical, "bandwidth")


def matmul_flops(b: Column, d: Column, f: Column) -> Column:
    """FLOPs of (b, d) x (d, f)."""
    return 2.0 * b * d * f


def matmul_bytes(b: Column, d: Column, f: Column, width: int = 2) -> Column:
    """Bytes read and written once each, width bytes a number (2: bf16)."""
    return float(width) * (b * d + d * f + b * f)


def roofline_seconds(flops: Column, bytes_moved: Column, peak_flops: Column, bandwidth: Column) -> Column:
    """The larger of computing and moving time."""
    return F.greatest(F.try_divide(flops.cast("double"), peak_flops.cast("double")), F.try_divide(bytes_moved.cast("double"), bandwidth.cast("double")))


def local_batch(sequences: Column, tokens: Column, replicas: Column) -> Column:
    """Tokens that one replica sees in a step; null for no replicas."""
    return F.try_divide((sequences * tokens).cast("double"), replicas.cast("double"))
