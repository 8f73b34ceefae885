"""Complex numbers as struct<re: double, im: double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complex_of(re, im=0.0) -> Column:
    c = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.struct(c(re).alias("re"), c(im).alias("im"))


def polar(r: Column, angle: Column) -> Column:
    return complex_of(r * F.cos(angle), r * F.sin(angle))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def conjugate(z: Column) -> Column:
    return complex_of(z["re"], -z["im"])


def add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def subtract(a: Column, b: Column) -> Column:
    return complex_of(a["re"] - b["re"], a["im"] - b["im"])


def multiply(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def divide(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_of((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n)


def modulus(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def phase(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def exp(z: Column) -> Column:
    return polar(F.exp(z["re"]), z["im"])


def mean(z: Column) -> Column:
    """Aggregate."""
    return F.struct(F.avg(z["re"]).alias("re"), F.avg(z["im"]).alias("im"))


def total(z: Column) -> Column:
    """Aggregate."""
    return F.struct(F.sum(z["re"]).alias("re"), F.sum(z["im"]).alias("im"))
