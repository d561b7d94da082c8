"""Scalar column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b) -> Column:
    """Quotient rounded toward minus infinity, also for negative times."""
    return F.floor(a / F.lit(b))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def argmax(scores: Column) -> Column:
    """Index of the largest element, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda z: F.exp(z - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.transform(weights, lambda w: w / total)


def log_sum_exp(scores: Column) -> Column:
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, z: acc + F.exp(z - top))
    return top + F.log(total)


def bce_with_logits(x: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit in the overflow-free form."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def dictionary_code(value: Column, dictionary: list[str], strict: bool = True) -> Column:
    """Physical code of a closed-dictionary value; null stays null.

    An unknown value raises when ``strict``, else gives null.
    """
    position = F.array_position(F.lit(dictionary), value) - 1
    if strict:
        unknown = F.raise_error(F.concat(F.lit("value not in dictionary: "), value)).cast("int")
    else:
        unknown = F.lit(None).cast("int")
    return F.when(value.isNull(), F.lit(None).cast("int")).when(position >= 0, position.cast("int")).otherwise(unknown)


def stage_name(code: Column) -> Column:
    return F.when(code == 1, "Validation").when(code == 2, "Testing").otherwise("Training")


def md5_int(text: Column, digits: int = 8) -> Column:
    """Integer from the first hex digits of the md5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (days * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def epoch_seconds(day: Column) -> Column:
    """Whole seconds since 1970 of a date or a time without zone."""
    return F.floor(epoch_micros(day.cast("timestamp_ntz")) / 1_000_000)
