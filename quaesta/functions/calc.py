"""Arithmetic expressions (V11, V12): a small operator-precedence reader, never `eval`.

Expressions of the same shape (equal but for their numbers) are read once and evaluated together on
arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NUMBER = re.compile(r"(?<![\w.])(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)")
_TOKEN = re.compile(r"\s*(?:(#)|(\*\*|//|[-+*/%^()×·])|([A-Za-z]\w*))")


def _only(f: Callable, ok: Callable) -> Callable:
    """f where its argument is allowed, elsewhere not a number."""
    return lambda x: np.where(ok(x), f(np.where(ok(x), x, 1.0)), np.nan)


def _power(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exponents beyond 1000, roots of negative numbers and negative powers of zero are refused."""
    ok = (np.abs(b) <= 1000) & ((a > 0) | ((a == 0) & (b >= 0)) | (b == np.floor(b)) & (a != 0))
    return np.where(ok, np.power(np.where(ok, a, 1.0), np.where(ok, b, 1.0)), np.nan)


def _divide(f: Callable) -> Callable:
    return lambda a, b: np.where(b == 0, np.nan, f(a, np.where(b == 0, 1.0, b)))


# Functions, constants, and binding strength of the operators.
FUNCTIONS = {"sqrt": _only(np.sqrt, lambda x: x >= 0), "sin": np.sin, "cos": np.cos, "tan": np.tan, "log": _only(np.log, lambda x: x > 0), "log10": _only(np.log10, lambda x: x > 0), "exp": np.exp, "abs": np.abs}
CONSTANTS = {"pi": np.pi, "e": np.e}
BINDING = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "//": 2, "**": 4}
OPERATORS = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": _divide(np.divide), "%": _divide(np.mod), "//": _divide(np.floor_divide), "**": _power}


def read(shape: str) -> Callable[[np.ndarray], np.ndarray] | None:
    """The function of its numbers (one column each) that an expression with # for each number stands for; None if it is no expression."""
    toks, i = [], 0
    shape = shape.rstrip()
    while i < len(shape):
        m = _TOKEN.match(shape, i)
        if not m:
            return None
        toks.append(m[1] or {"^": "**", "×": "*", "·": "*"}.get(m[2], m[2]) or m[3])
        i = m.end()
    at, used = 0, 0

    def first() -> Callable:
        nonlocal at, used
        t = toks[at]
        at += 1
        if t in ("+", "-"):
            v = climb(3)
            return v if t == "+" else lambda x: -v(x)
        if t == "(":
            v = climb(0)
            if toks[at] != ")":
                raise ValueError
            at += 1
            return v
        if t == "#":
            column, used = used, used + 1
            return lambda x: x[:, column]
        if t in FUNCTIONS and at < len(toks) and toks[at] == "(":
            v, f = first(), FUNCTIONS[t]
            return lambda x: f(v(x))
        c = CONSTANTS[t]
        return lambda x: np.full(len(x), c)

    def climb(least: int) -> Callable:
        nonlocal at
        left = first()
        while at < len(toks) and BINDING.get(toks[at], -1) > least:
            op = toks[at]
            at += 1
            right, f, a = climb(BINDING[op] - (op == "**")), OPERATORS[op], left
            left = lambda x, f=f, a=a, right=right: _finite(f(a(x), right(x)))
        return left

    try:
        f = climb(0)
        return f if at == len(toks) else None
    except (ValueError, IndexError, KeyError, RecursionError):
        return None


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, np.nan)


def evaluate_all(texts: list[str | None]) -> np.ndarray:
    """Values of expressions, not a number for null, for what is no expression, and where a step has no finite value."""
    out = np.full(len(texts), np.nan)
    shapes: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        if t:
            shapes.setdefault(_NUMBER.sub("#", t) if "#" not in t else "", []).append(i)
    with np.errstate(all="ignore"):
        for shape, rows in shapes.items():
            f = read(shape) if shape.strip() else None
            if f is None:
                continue
            numbers = np.array([_NUMBER.findall(texts[i]) for i in rows], dtype=object)
            x = numbers.astype(np.float64).reshape(len(rows), shape.count("#"))
            try:
                out[rows] = _finite(f(x))
            except RecursionError:
                pass
    return out


def evaluate(text: str | None) -> float | None:
    """Value of an expression, None on any error."""
    v = evaluate_all([text])[0]
    return None if np.isnan(v) else float(v)


@F.pandas_udf(DoubleType())
def calc(text: pd.Series) -> pd.Series:
    """V11 as a column."""
    v = evaluate_all([t if isinstance(t, str) else None for t in text])
    return pd.Series(v, dtype="float64").astype("Float64").mask(np.isnan(v))


def apply_tool(subject, answer, fol, calc_text, unit):
    """Answer after tools, and the tool used: the logic verdict if there is one, the recomputed value
    with the model's unit for physics, else the answer itself."""
    v = calc(calc_text)
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", v), r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    use_calc = (subject == "physics") & v.isNotNull()
    ans = F.when((subject == "logic") & fol.isNotNull(), fol).when(use_calc, F.trim(F.concat_ws(" ", shown, unit))).otherwise(answer)
    return F.struct(ans.alias("answer"), F.when((subject == "logic") & fol.isNotNull(), "fol").when(use_calc, "calc").otherwise("none").alias("tool"))
