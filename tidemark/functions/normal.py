"""Normal distribution function: a polynomial for the JVM, and math.erf in a pandas UDF where digits matter."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Abramowitz and Stegun, Handbook of Mathematical Functions, 26.2.17 (error below 7.5e-8).
P = 0.2316419
B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def cdf(x: Column) -> Column:
    """Phi(x) by polynomial, inside code generation."""
    t = 1 / (1 + P * F.abs(x))
    poly = t * (B[0] + t * (B[1] + t * (B[2] + t * (B[3] + t * B[4]))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


@F.pandas_udf(DoubleType())
def exact_cdf(x: pd.Series) -> pd.Series:
    """Phi(x) to double precision."""
    return x.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(-v / math.sqrt(2)))


def bucket_mass(mu: Column, sigma: Column, lower: Column, upper: Column, phi=cdf) -> Column:
    """Mass of whole degrees lower..upper (null: unbounded) under a normal law; null unless sigma is positive."""
    high = F.when(upper.isNull(), 1.0).otherwise(phi((upper + 0.5 - mu) / sigma))
    low = F.when(lower.isNull(), 0.0).otherwise(phi((lower - 0.5 - mu) / sigma))
    return F.when(sigma > 0, F.greatest(high - low, F.lit(0.0)))
