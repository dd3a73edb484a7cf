"""Predicates over regions. They differ on purpose: each serves its own consumer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NON_SCORABLE
from .text import strip


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def _drawn(r: Column) -> Column:
    return _or(r["type"], "handwritten").isin(*NON_SCORABLE)


def _has_text(r: Column) -> Column:
    return strip(_or(r["text"], "")) != ""


def is_scorable(r: Column) -> Column:
    """For the metric: not drawn, not of another language, not illegible."""
    return ~_drawn(r) & (_or(r["language"], "uk") != "other") & (_or(r["legibility"], "legible") != "illegible")


def audit_scorable(r: Column) -> Column:
    return (_or(r["language"], "uk") == "uk") & (_or(r["legibility"], "legible") == "legible") & ~_drawn(r) & _has_text(r)


def train_usable(r: Column) -> Column:
    return _has_text(r) & (_or(r["language"], "uk") == "uk") & (
        _or(r["legibility"], "legible") != "illegible"
    ) & ~_drawn(r) & (F.size(F.coalesce(r["bbox"], F.array())) > 0)


def pseudo_usable(r: Column) -> Column:
    return (F.size(F.coalesce(r["bbox"], F.array())) > 0) & ~_drawn(r) & (_or(r["language"], "uk") == "uk")


def synth_text_usable(r: Column) -> Column:
    return F.length(strip(_or(r["text"], ""))).between(3, 120) & (_or(r["language"], "uk") == "uk") & ~_drawn(r)


def order_scorable(r: Column) -> Column:
    return ~_drawn(r)
