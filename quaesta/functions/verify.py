"""Typed comparison of a predicted answer with the truth (V operators).

Whatever is used more than once is a column of its own, so that Spark evaluates each pattern once
per row; temporary columns start with two underscores and are dropped.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaesta.functions.text import WORD_EDGE, WS, WS_IN, bind, extract_answer, normalize, strip, strip_prefix

# Lower-case unit -> scale to its SI unit. Lower case merges mega with milli (see README).
UNITS = {
    "pj": 1e-12, "nj": 1e-9, "μj": 1e-6, "uj": 1e-6, "mj": 1e-3, "j": 1.0, "kj": 1e3,
    "pc": 1e-12, "nc": 1e-9, "μc": 1e-6, "uc": 1e-6, "mc": 1e-3, "c": 1.0,
    "pa": 1e-12, "na": 1e-9, "μa": 1e-6, "ua": 1e-6, "ma": 1e-3, "a": 1.0, "ka": 1e3,
    "μv": 1e-6, "uv": 1e-6, "mv": 1e-3, "v": 1.0, "kv": 1e3,
    "pf": 1e-12, "nf": 1e-9, "μf": 1e-6, "uf": 1e-6, "mf": 1e-3, "f": 1.0,
    "mω": 1e-3, "ω": 1.0, "kω": 1e3, "mohm": 1e-3, "ohm": 1.0, "kohm": 1e3,
    "nh": 1e-9, "μh": 1e-6, "uh": 1e-6, "mh": 1e-3, "h": 1.0,
    "hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9,
    "ps": 1e-12, "ns": 1e-9, "μs": 1e-6, "us": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0,
    "pm": 1e-12, "nm": 1e-9, "μm": 1e-6, "um": 1e-6, "mm": 1e-3, "cm": 1e-2, "dm": 1e-1, "m": 1.0, "km": 1e3,
    "mn": 1e-3, "n": 1.0, "kn": 1e3,
    "pw": 1e-12, "nw": 1e-9, "μw": 1e-6, "uw": 1e-6, "mw": 1e-3, "w": 1.0, "kw": 1e3,
    "μt": 1e-6, "ut": 1e-6, "mt": 1e-3, "t": 1.0,
    "v/m": 1.0, "kv/m": 1e3, "mv/m": 1e-3,
    "": 1.0, "%": 0.01, "rad": 1.0,
}
# Synonyms of the three verdicts, longest first.
VERDICTS = {
    "cannot be determined": "unknown", "indeterminate": "unknown", "affirmative": "yes", "incorrect": "no", "uncertain": "unknown", "negative": "no", "correct": "yes",
    "unknown": "unknown", "false": "no", "maybe": "unknown", "true": "yes", "yes": "yes", "no": "no",
}
# The two forms of a number with its unit; what they accept must be the same everywhere.
SCIENTIFIC = rf"(?s)([+-]?\d+(?:[.,]\d+)?){WS}*(?:[×xX*·]{WS}*10{WS}*[\^＾]?{WS}*(?:\(([+-]?\d+)\)|([+-]?\d+))|[eE]([+-]?\d+))(.*)$"
PLAIN = rf"(?s)^([+-]?\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?){WS}*([a-zA-ZμΩ\x{{2126}}°²³⁻/·{WS_IN}]*)"
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-")


def unit_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(UNITS.items())])


def unit_key(c: Column) -> Column:
    """Key of a unit in UNITS: ohm signs as ω, blanks dropped, lower case."""
    return F.lower(F.replace(F.translate(strip(c), "Ω\u2126", "ωω"), F.lit(" "), F.lit("")))


def parse(df: DataFrame, c: Column, name: str) -> DataFrame:
    """V1, V2: adds `name`_value (null if the text states no number) and `name`_unit ('' if none).

    A `name = ` is removed; then scientific notation anywhere, else a plain number at the beginning.
    A decimal comma is read as a point. Exponents beyond the range of a double give null.
    """
    t, s = f"__{name}_t", f"__{name}_s"
    df = df.withColumn(t, strip_prefix(strip_prefix(F.coalesce(c, F.lit("")))))
    df = df.withColumn(s, F.translate(t, *SUPERSCRIPTS))
    g = lambda i: F.regexp_extract(s, SCIENTIFIC, i)
    num = lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
    sci = F.struct(num(F.concat(g(1), F.lit("e"), g(2), g(3), g(4))).alias("v"), F.regexp_replace(strip(g(5)), r"^[.,;]+|[.,;]+$", "").alias("u"))
    plain = F.struct(num(F.regexp_extract(t, PLAIN, 1)).alias("v"), strip(F.regexp_extract(t, PLAIN, 2)).alias("u"))
    none = F.struct(F.lit(None).cast("double").alias("v"), F.lit("").alias("u"))
    df = df.withColumn(f"__{name}", F.when(F.col(s).rlike(SCIENTIFIC), sci).when(F.col(t).rlike(PLAIN), plain).otherwise(none))
    return df.withColumn(f"{name}_value", F.col(f"__{name}.v")).withColumn(f"{name}_unit", F.col(f"__{name}.u")).drop(t, s, f"__{name}")


def scale(unit: Column) -> Column:
    """Scale of a unit, null if unknown; a final 2 or 3 is dropped on the second try (V3)."""
    k = unit_key(unit)
    return F.coalesce(F.try_element_at(unit_map(), k), F.try_element_at(unit_map(), F.regexp_replace(k, "[23]$", "")))


def to_si(value: Column, unit: Column) -> Column:
    """V3: value in SI; unchanged if the unit is unknown."""
    return value * F.coalesce(scale(unit), F.lit(1.0))


def same_scale(pred_unit: Column, true_unit: Column) -> Column:
    """V5: both without unit, or equal scales; unknown units are compared by their keys. Dimensions do not count."""
    p, g = F.try_element_at(unit_map(), unit_key(pred_unit)), F.try_element_at(unit_map(), unit_key(true_unit))
    return F.when((pred_unit == "") & (true_unit == ""), True).when(p.isNull() | g.isNull(), unit_key(pred_unit) == unit_key(true_unit)).otherwise(p == g)


def mcq(pred: Column, truth: Column, lenient: bool = False) -> Column:
    """V6: first letters after a leading option, answer or choice. lenient: also unwraps tags and 'the answer is'."""
    if lenient:
        pred = F.regexp_replace(extract_answer(pred), r"(?i)^\s*(?:the\s+)?(?:correct\s+)?(?:answer|option|choice)(?:\s+is)?\s*:?\s*", "")
    first = lambda c: F.upper(F.substring(F.regexp_replace(normalize(c), r"^(?:option\s*|answer\s*|choice\s*)", ""), 1, 1))
    return first(pred) == first(truth)


def verdict(c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(VERDICTS.items())])
    return F.try_element_at(m, c)


def yes_no(pred: Column, truth: Column) -> Column:
    """V7: whole text a synonym, else the longest synonym found as a word, else equal text."""
    g = F.coalesce(verdict(normalize(truth)), normalize(truth))
    found = F.lit(None).cast("string")
    for w, v in reversed(VERDICTS.items()):
        found = F.when(F.lower(pred).rlike(f"{WORD_EDGE[0]}{w}{WORD_EDGE[1]}"), v).otherwise(found)
    return F.coalesce(verdict(normalize(strip_prefix(pred))), found, normalize(pred)) == g


def numeric(pred: Column, truth: Column, pv: Column, pu: Column, gv: Column, gu: Column, tolerance: float = 0.02) -> Column:
    """V8: equal in SI within a relative tolerance; truth 0 wants less than 1e-9; equal text if either is no number."""
    p, g = to_si(pv, pu), to_si(gv, gu)
    return F.when(pv.isNull() | gv.isNull(), normalize(pred) == normalize(truth)).when(g == 0, F.abs(p) < 1e-9).otherwise(F.abs(p - g) / F.abs(g) <= tolerance)


def verify(df: DataFrame, pred: str, truth: str, out: str = "ok", keep: bool = False) -> DataFrame:
    """V9: adds the verdict of the dispatch multiple choice, yes/no, numeric, text. Null texts count as ''.

    keep: also keeps pred_value, pred_unit, true_value, true_unit.
    """
    df = df.withColumn("__p0", F.coalesce(F.col(pred), F.lit(""))).withColumn("__g", F.coalesce(F.col(truth), F.lit("")))
    df = df.withColumn("__p", F.when(F.lower("__p0").contains("<answer>"), extract_answer(F.col("__p0"))).otherwise(F.col("__p0")))
    df = df.withColumn("__k", normalize(F.col("__g")))
    df = parse(parse(df, F.col("__p"), "__pred"), F.col("__g"), "__true")
    p, g = F.col("__p"), F.col("__g")
    parts = ["pred_value", "pred_unit", "true_value", "true_unit"]
    v = [F.col(f"__{x}") for x in parts]
    ok = (
        F.when(F.col("__k").isin("a", "b", "c", "d"), mcq(p, g))
        .when(F.col("__k").isin("yes", "no", "unknown", "true", "false", "uncertain"), yes_no(p, g))
        .when(v[0].isNotNull() & v[2].isNotNull(), numeric(p, g, *v))
        .otherwise(normalize(strip_prefix(p)) == normalize(strip_prefix(g)))
    )
    df = df.withColumn(out, ok)
    if keep:
        df = df.withColumns({x: F.col(f"__{x}") for x in parts})
    return df.drop("__p0", "__p", "__g", "__k", *[f"__{x}" for x in parts])


def relative_error(pv: Column, gv: Column) -> Column:
    """Without unit conversion; null if either is no number or the truth is 0."""
    return F.when((gv != 0) & pv.isNotNull(), F.abs(pv - gv) / F.abs(gv))


def has_number(c: Column) -> Column:
    return c.rlike(r"\d")


def has_unit(c: Column) -> Column:
    """Any known unit occurs in the text, blanks dropped (single letters make this nearly always true)."""
    units = F.array(*[F.lit(u) for u in UNITS if u])
    return bind(F.replace(F.lower(c), F.lit(" "), F.lit("")), lambda t: F.exists(units, lambda u: t.contains(u)))


def smoke_score(subject: Column, pred: Column, truth: Column) -> Column:
    """Logic equal or contained either way; physics first words as numbers within max(0.01, 2 %), else equal."""
    p, g = F.lower(strip(pred)), F.lower(strip(truth))
    n = lambda c: F.try_element_at(F.split(c, r"\s+"), F.lit(1)).try_cast("double")
    close = F.abs(n(p) - n(g)) <= F.greatest(F.lit(0.01), F.abs(n(g)) * 0.02)
    return F.when(subject == "logic", (p == g) | p.contains(g) | g.contains(p)).otherwise(F.coalesce(close, p == g))
