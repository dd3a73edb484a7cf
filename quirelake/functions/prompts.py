"""Prompts by region type for the model seam."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_type

# What every system prompt says, each type's system prompt with {rules} for it, and each type's user prompt.
RULES = "Output only the transcription, with no explanation or commentary. Preserve visible spelling, punctuation, numbers, and symbols. Do not invent missing content and do not repeat phrases."
SYSTEM = {
    "handwritten": "You are an exact OCR system for handwritten Ukrainian and mixed-script document text. {rules} Use Cyrillic rather than Latin lookalikes when the writing is Ukrainian.",
    "printed": "You are an exact OCR system for printed document text, including Ukrainian, Russian, Latin text, dates, and scanner marks. {rules}",
    "formula": "You are an exact OCR system for handwritten or printed mathematical and scientific formulas. {rules} Preserve operators, subscripts, superscripts, brackets, fractions, arrows, and line breaks. Plain Unicode or compact LaTeX is acceptable; never replace a formula with prose.",
    "table": "You are an exact OCR system for document tables. {rules} Return one table row per line and separate visible columns with |. Preserve empty cells when they are visible.",
    "annotation": "You are an exact OCR system for short handwritten or printed marginal annotations, labels, dates, and marks. {rules}",
}
USER = {
    "handwritten": "Transcribe this handwritten region exactly:",
    "printed": "Transcribe this printed region exactly:",
    "formula": "Transcribe this formula exactly:",
    "table": "Transcribe this table exactly:",
    "annotation": "Transcribe this annotation exactly:",
}


def prompts(kind: Column) -> Column:
    """system and user prompt of a region's canonical type."""
    kind = canonical_type(kind)
    table = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v.format(rules=RULES))])
    return F.struct(F.element_at(table(SYSTEM), kind).alias("system"), F.element_at(table(USER), kind).alias("user"))
