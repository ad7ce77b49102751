"""Listening times and how they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_PER_MINUTE = 160
WORDS_PER_SENTENCE = 18


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def speaking_seconds(words: Column, rate: Column) -> Column:
    return F.when((words <= 0) | (rate <= 0), F.lit(0.0)).otherwise(words / (F.lit(float(WORDS_PER_MINUTE)) * rate) * 60)


def format_clock(seconds: Column) -> Column:
    """m:ss, from an hour on h:mm:ss."""
    total = half_up(F.greatest(seconds, F.lit(0.0)))
    hours, minutes, rest = F.floor(total / 3600), F.floor(total / 60) % 60, F.lpad((total % 60).cast("string"), 2, "0")
    short = F.concat_ws(":", minutes.cast("string"), rest)
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), F.lpad(minutes.cast("string"), 2, "0"), rest)).otherwise(short)


def format_remaining(seconds: Column) -> Column:
    total = half_up(seconds)
    minutes = half_up(total / 60)
    return F.when(total <= 0, "finished").when(minutes < 1, "under a minute left").otherwise(F.concat(minutes.cast("string"), F.lit(" min left")))


def seek_index(n: Column, fraction: Column) -> Column:
    return F.greatest(F.lit(0), F.least(n - 1, F.floor(fraction * n).cast("int")))


def progress_bars(index: Column, n: Column, bars: int = 68) -> Column:
    return F.when(n <= 0, F.lit(0)).otherwise(half_up(index / n * bars).cast("int"))


def render_scale(width: Column, height: Column) -> Column:
    """The factor at which a page has 16 million pixels at most, and never over two."""
    return F.least(F.lit(2.0), F.sqrt(F.lit(16e6) / (width * height)))
