"""Decibels, filter responses and equaliser bells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def decibels(amplitude: Column, floor: float = 1e-12) -> Column:
    return 20 * F.log10(F.greatest(amplitude, F.lit(floor)))


def power_db(power: Column, floor: float = 1e-30) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(floor)))


def butterworth_db(frequency: Column, corner: Column, highpass: bool) -> Column:
    """The response of a second-order Butterworth filter at a frequency."""
    r = F.pow(frequency / corner if highpass else corner / frequency, F.lit(4.0))
    return 10 * F.log10(r / (1 + r))


def bell(frequency: Column, centre: Column, q: float = 1.4) -> Column:
    """How much of a band's gain reaches a frequency: 1 at the centre."""
    return 1 / (1 + F.pow(2 * q * F.log2(frequency / centre), F.lit(2.0)))
