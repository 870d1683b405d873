"""Figures that a user sees while a job runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import duration_text

RECOGNISED_COST = 30


def in_stage(low: float, high: float, share: Column) -> Column:
    """Progress between a stage's ends, to a thousandth."""
    return F.bround(F.lit(low) + F.lit(high - low) * share, 3)


def recognition_share(local: Column, scanned: Column) -> Column:
    """The text layer's part of the work on a document."""
    return F.when(local + scanned == 0, F.lit(0.0)).otherwise(local / (local + RECOGNISED_COST * scanned))


def step_progress(done: Column, total: Column, chars: Column, expected: float) -> Column:
    return (done + F.least(F.lit(0.95), 1 - F.exp(-chars / expected))) / total


def time_left(seconds: Column, pages_done: Column, pages: Column) -> Column:
    """What the rest takes at the pace so far; null before the first page."""
    return F.when(pages_done > 0, duration_text(seconds / pages_done * (pages - pages_done)))
