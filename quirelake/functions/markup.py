"""Arrow functions for what Spark's expressions lack: Unicode NFKC, sequence similarity, and formula and table markup with its fixed points."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markup commands and the characters they stand for.
SYMBOLS = {
    r"\alpha": "α", r"\beta": "β", r"\gamma": "γ", r"\delta": "δ", r"\epsilon": "ε", r"\varepsilon": "ε", r"\zeta": "ζ", r"\eta": "η", r"\theta": "θ",
    r"\vartheta": "ϑ", r"\iota": "ι", r"\kappa": "κ",
    r"\lambda": "λ", r"\mu": "μ", r"\nu": "ν", r"\xi": "ξ", r"\pi": "π", r"\rho": "ρ", r"\sigma": "σ", r"\tau": "τ", r"\upsilon": "υ",
    r"\phi": "φ", r"\varphi": "φ", r"\chi": "χ", r"\psi": "ψ", r"\omega": "ω",
    r"\Gamma": "Γ", r"\Delta": "Δ", r"\Theta": "Θ", r"\Lambda": "Λ", r"\Xi": "Ξ", r"\Pi": "Π", r"\Sigma": "Σ", r"\Phi": "Φ", r"\Psi": "Ψ",
    r"\Omega": "Ω",
    r"\cdot": "·", r"\times": "×", r"\div": "÷", r"\pm": "±", r"\mp": "∓", r"\circ": "∘", r"\bullet": "•", r"\star": "⋆",
    r"\leq": "≤", r"\le": "≤", r"\geq": "≥", r"\ge": "≥", r"\neq": "≠", r"\ne": "≠", r"\approx": "≈", r"\equiv": "≡", r"\sim": "∼",
    r"\propto": "∝",
    r"\rightarrow": "→", r"\to": "→", r"\leftarrow": "←", r"\leftrightarrow": "↔", r"\Rightarrow": "⇒", r"\Leftarrow": "⇐", r"\Leftrightarrow": "⇔", r"\implies": "⇒", r"\iff": "⇔",
    r"\cap": "∩", r"\cup": "∪", r"\subset": "⊂", r"\supset": "⊃", r"\subseteq": "⊆", r"\supseteq": "⊇", r"\in": "∈", r"\notin": "∉", r"\emptyset": "∅",
    r"\varnothing": "∅", r"\oplus": "⊕", r"\otimes": "⊗",
    r"\infty": "∞", r"\partial": "∂", r"\nabla": "∇", r"\forall": "∀", r"\exists": "∃", r"\neg": "¬", r"\sqrt": "√", r"\sum": "∑", r"\prod": "∏",
    r"\int": "∫", r"\ldots": "…", r"\dots": "…", r"\cdots": "⋯",
    r"\therefore": "∴", r"\because": "∵", r"\perp": "⊥", r"\angle": "∠", r"\parallel": "∥", r"\square": "□", r"\Box": "□", r"\triangle": "△",
    r"\uparrow": "↑", r"\downarrow": "↓", r"\Uparrow": "⇑", r"\Downarrow": "⇓", r"\vee": "∨", r"\wedge": "∧", r"\lor": "∨", r"\land": "∧", r"\setminus": "∖",
    r"\backslash": "\\",
    r"\mid": "|", r"\lvert": "|", r"\rvert": "|", r"\Vert": "‖", r"\lfloor": "⌊", r"\rfloor": "⌋", r"\lceil": "⌈", r"\rceil": "⌉", r"\male": "♂",
    r"\female": "♀",
}
FUNCTION_NAMES = "arcsin arccos arctan arcctg arccot arcsec arccsc sinh cosh tanh coth sin cos tan cot sec csc ctg liminf limsup log ln lg exp lim sup inf min max det dim gcd lcm mod arg deg hom ker".split()
ENVIRONMENTS = "array tabular matrix pmatrix bmatrix vmatrix Vmatrix smallmatrix aligned align alignat gathered cases split".split()
STYLES = "mathrm mathbf mathit mathbb mathcal mathfrak mathsf mathtt operatorname boldsymbol pmb".split()
RAISED, RAISED_AS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ", "0123456789+-=()n"
LOWERED, LOWERED_AS = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎", "0123456789+-=()"

_any_symbol = "|".join(re.escape(c) for c in sorted(SYMBOLS, key=len, reverse=True))
_env = "|".join(ENVIRONMENTS)
_arg = r"\s*\{([^{}]*)\}"
_gone = r"\s*\{[^{}]*\}"
_levels = {c: f"^{a}" for c, a in zip(RAISED, RAISED_AS, strict=True)} | {c: f"_{a}" for c, a in zip(LOWERED, LOWERED_AS, strict=True)}


def _rows(sep: str):
    return lambda m: "\n".join(part.strip() for part in m[1].split(sep))


def _cells(m: re.Match) -> str:
    return "\n".join(re.findall(r"\|\s*([^|\n]+?)\s*\|", m[0]))


#: Rewriting groups, in order. A group marked True is repeated until nothing changes.
REWRITES: list[tuple[bool, list]] = [
    (
        False,
        [
            (rf"\\begin\{{(?:{_env})\*?\}}(?:\{{[^}}]*\}})?\s*", ""),
            (rf"\s*\\end\{{(?:{_env})\*?\}}", ""),
            (r"\s*\\\\\s*", "\n"),
            (r"\s*&\s*", "|"),
            (rf"\\hline\b|\\cline{_gone}", ""),
            (rf"\\phantom{_gone}", ""),
            (rf"\\underline{_arg}", r"\1"),
            (r"\\text\{([^}]*)\}", r"\1"),
            (r"\\(?:left|right)\s*([()|\[\]{}.])", r"\1"),
            (r"\\(?:big|Big|bigg|Bigg)[lr]?\b", ""),
        ],
    ),
    (True, [(rf"\\(?:{'|'.join(STYLES)}){_arg}", r"\1")]),
    (False, [(rf"\\xrightarrow\s*(?:\[[^\]]*\])?{_gone}", "→"), (rf"\\xleftarrow\s*(?:\[[^\]]*\])?{_gone}", "←")]),
    (True, [(rf"\\cancel{_arg}", r"\1"), (rf"\\overset{_gone}{_arg}", r"\1"), (rf"\\underset{_gone}{_arg}", r"\1")]),
    (False, [(r"\\[,;:!]|\\quad|\\qquad|\\hspace\{[^}]*\}", " ")]),
    (True, [(rf"\\frac{_arg}{_arg}", r"\1/\2")]),
    (
        False,
        [
            (rf"\\(?:overrightarrow|vec){_arg}", r"→\1"),
            (rf"\\overleftarrow{_arg}", r"←\1"),
            (rf"\\(?:bar|hat|overline|widetilde|widehat|dot|ddot){_arg}", r"\1"),
            (rf"\\({'|'.join(FUNCTION_NAMES)})(?![A-Za-z])", r"\1 "),
            (_any_symbol, lambda m: SYMBOLS[m[0]]),
            (rf"√{_arg}", r"√\1"),
            ("[\u0300-\u036f\u20d0-\u20ff]", ""),
            ("[*∗⋅]", "·"),
            (f"[{RAISED}{LOWERED}]", lambda m: _levels[m[0]]),
            (r"([_^])\{([^}]+)\}", r"\1\2"),
            (r"\(([^();]+(?:\s*;\s*[^();]+)+)\)", _rows(";")),
            (r"\(([^()]*\\n[^()]*)\)", _rows("\\n")),
            (r"\|\s*([^|\n]+?)\s*\|(?:\s*\|\s*[^|\n]+?\s*\|)+", _cells),
        ],
    ),
]
_compiled = [(again, [(re.compile(p), to) for p, to in rules]) for again, rules in REWRITES]
_struck = [(re.compile(r"~~.*?~~\{(.*?)\}"), r"\1"), (re.compile(r"~~(.*?)~~"), r"\1")]


def _apply(text: str, rules: list) -> str:
    for pattern, to in rules:
        text = pattern.sub(to, text)
    return text


#: A character that any of the patterns needs: a text without one stays as it is.
_marked = re.compile(rf"[\\~&√*∗⋅_^;|\u0300-\u036f\u20d0-\u20ff{RAISED}{LOWERED}]")

_marked_in_arrow = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", _marked.pattern)


def rewrite(text: str) -> str:
    """Struck-through text and markup of formulas and tables in plain characters."""
    if not _marked.search(text):
        return text
    text = _apply(text, _struck)
    for again, rules in _compiled:
        before, text = text, _apply(text, rules)
        while again and text != before:
            before, text = text, _apply(text, rules)
    return text


@F.pandas_udf(T.StringType())
def rewrite_markup(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else rewrite(t))


@F.arrow_udf(T.ArrayType(T.StringType()))
def rewrite_markup_array(arrays: pa.Array) -> pa.Array:
    texts = arrays.flatten()
    marked = pc.fill_null(pc.match_substring_regex(texts, _marked_in_arrow), False)
    if not pc.any(marked, min_count=0).as_py():
        return arrays
    texts = pc.replace_with_mask(texts, marked, pa.array([rewrite(t) for t in texts.filter(marked).to_pylist()], texts.type))
    sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array([0, *sizes.cumsum().tolist()], pa.int32()), texts, mask=arrays.is_null())


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def ratio(a: str, b: str) -> float:
    """Similarity of two prepared texts: both empty 1, one empty 0."""
    if not a or not b:
        return float(not a and not b)
    return difflib.SequenceMatcher(None, a, b).ratio()
