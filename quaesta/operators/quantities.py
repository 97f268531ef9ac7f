"""Quantities recorded in different units, brought to SI units.

The unit of a value is the one in its text, else in the unit column, else in its question. Where no
unit is stated, the kind of quantity is guessed: by its symbol, else by the unit of another value of
its row, else by the quantity its question asks for. The unit is then assigned by a mixture on the
logarithm of the number: all values of a kind share one distribution in SI, and a value written in a
unit is that distribution shifted by the unit's known factor. Components are fitted by EM on a
histogram over all rows (fixed bins, so its size is bounded). How far each source of guesses can be
trusted is measured where a unit is stated as well; the probability of an assigned unit is that trust
times its posterior, and below `sure` it is flagged as uncertain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaesta.functions import quantities as q

STATED = "src_table string, row_id string, field string, number double, unit string, unit_source string, si_unit string, factor double, shift double, kind string, guess string, guess_source string"
BIN = 0.1


def _guess(symbol: str, other: str | None, question: str | None) -> tuple[str, str]:
    """Kind of a value apart from its own unit, and where that was found; ('', '') if nowhere."""
    if symbol in q.SYMBOL_UNIT:
        return q.SYMBOL_UNIT[symbol], "symbol"
    question = question if isinstance(question, str) else None
    if q.asks_ratio(question):
        return "", ""
    got = q.read(other if isinstance(other, str) else None)
    u = q.scaled_unit(got[1]) if got and got[1] else None
    if u:
        return u[0], "other"
    kind = q.asked_kind(question)
    return (kind, "question") if kind else ("", "")


def stated_values(df: DataFrame) -> DataFrame:
    """Reads df(src_table, row_id, field, value, unit, question) into STATED columns, one row per number.

    unit and question may be null; a column other_value, if there is one, has another value of the
    row for the same quantity. Labels, ratios, prose and texts with several numbers give no row.
    unit_source is text, column, question, or '' where no unit is stated. guess is the kind by
    guess_source (symbol, other or question) whether or not a unit is stated.
    """
    if "other_value" not in df.columns:
        df = df.withColumn("other_value", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                got = q.read(r.value if isinstance(r.value, str) else None)
                if got is None:
                    continue
                v, text, symbol = got
                source, name = "text", text
                if not text:
                    source, name = "column", r.unit if isinstance(r.unit, str) and q.scaled_unit(r.unit) else ""
                    if not name:
                        source, name = "question", q.asked_unit(r.question if isinstance(r.question, str) else None)
                u = q.scaled_unit(name) if name else None
                guess, by = _guess(symbol, r.other_value, r.question)
                out.append((r.src_table, r.row_id, r.field, v, name.strip() if u else "", source if u else "", u[0] if u else "", u[1] if u else None, u[2] if u else None, u[0] if u else guess, guess, by))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATED.split(", ")])

    return df.mapInPandas(run, STATED).dropDuplicates(["src_table", "row_id", "field"])


def trust(stated: DataFrame) -> dict[str, float]:
    """Per source of guesses: share of right ones among all rows with a stated unit (one more of each counted)."""
    t = stated.filter("si_unit != '' and guess != ''").groupBy("guess_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("guess") == F.col("si_unit")).alias("right"))
    got = {r["guess_source"]: (r["right"] + 1) / (r["n"] + 2) for r in t.collect()}
    return {s: got.get(s, 0.5) for s in ("symbol", "other", "question")}


def histogram(stated: DataFrame, trusted: dict[str, float]) -> list[tuple]:
    """(kind, unit or None, factor, bin, n) over all rows; kinds, factors and bins are from fixed sets.

    Units of the same factor are one, named by the commonest. A row without unit counts as much as its
    kind is trusted.
    """
    h = stated.filter((F.col("kind") != "") & (F.col("number") != 0) & (F.coalesce("shift", F.lit(0.0)) == 0)).groupBy(
        "kind", "unit", "factor", F.when(F.col("factor").isNull(), F.col("guess_source")).alias("open"), F.floor(F.log10(F.abs("number")) / BIN).alias("bin")
    )
    rows = h.agg(F.count(F.lit(1)).alias("n")).collect()
    names: dict[tuple, dict[tuple, int]] = {}
    for r in rows:
        if not r["open"]:
            of = names.setdefault((r["kind"], f"{r['factor']:.9e}"), {})
            of[(r["unit"], r["factor"])] = of.get((r["unit"], r["factor"]), 0) + r["n"]
    best = {k: min(v, key=lambda u: (-v[u], u)) for k, v in names.items()}
    out = []
    for r in rows:
        unit, factor = (None, None) if r["open"] else best[(r["kind"], f"{r['factor']:.9e}")]
        out.append((r["kind"], unit, factor, r["bin"], r["n"] * trusted[r["open"]] if r["open"] else r["n"]))
    return out


def fit(hist: list[tuple], rounds: int = 30) -> dict[str, dict]:
    """Per kind: mean and deviation of log10(SI value), and each unit with its exact factor and weight."""
    out = {}
    for kind in sorted({h[0] for h in hist}):
        rows = [h for h in hist if h[0] == kind]
        units = sorted({(h[2], h[1]) for h in rows if h[1] is not None})
        if not units:
            continue
        x = np.array([(h[3] + 0.5) * BIN for h in rows])
        n = np.array([h[4] for h in rows], float)
        off = np.log10([f for f, _ in units])
        known = np.array([[float((h[2], h[1]) == u) for u in units] for h in rows])
        free = np.array([h[1] is None for h in rows])
        w = (known * n[:, None]).sum(0) + 0.5
        w /= w.sum()
        resp = np.where(free[:, None], w[None, :], known)
        for _ in range(rounds):
            mass = resp * n[:, None]
            si = x[:, None] + off[None, :]
            mean = (mass * si).sum() / mass.sum()
            dev = max(0.15, math.sqrt((mass * (si - mean) ** 2).sum() / mass.sum()))
            w = mass.sum(0) + 0.5
            w /= w.sum()
            p = np.log(w)[None, :] - 0.5 * ((si - mean) / dev) ** 2
            p = np.exp(p - p.max(1, keepdims=True))
            resp = np.where(free[:, None], p / p.sum(1, keepdims=True), known)
        out[kind] = {"mean": mean, "dev": dev, "units": [u for _, u in units], "factors": [f for f, _ in units], "weight": w.tolist()}
    return out


def posterior(number: float, model: dict) -> tuple[str, float, float]:
    """(unit, exact factor, probability) of the likeliest unit of a number without unit."""
    x = math.log10(abs(number)) + np.log10(model["factors"])
    p = np.log(model["weight"]) - 0.5 * ((x - model["mean"]) / model["dev"]) ** 2
    p = np.exp(p - p.max())
    p /= p.sum()
    i = int(p.argmax())
    return model["units"][i], model["factors"][i], float(p[i])


def convert(stated: DataFrame, models: dict[str, dict], trusted: dict[str, float], sure: float = 0.9) -> DataFrame:
    """Adds si_value (text), probability and uncertain to STATED rows; missing units get unit_source 'posterior'.

    A number whose kind is unknown, ratios among them, keeps an empty si_unit and is uncertain.
    """
    schema = STATED + ", si_value string, probability double, uncertain boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                source, unit, si, f, s, p = r.unit_source, r.unit, r.si_unit, r.factor, r.shift, 1.0
                if not source:
                    p = 0.0
                    if r.kind in models and r.number:
                        unit, f, p = posterior(r.number, models[r.kind])
                        source, si, s, p = "posterior", r.kind, 0.0, p * trusted[r.guess_source]
                value = f"{r.number * f + s:.5e}" if si else ""
                rows.append((r.src_table, r.row_id, r.field, r.number, unit, source, si, f, s, r.kind, r.guess, r.guess_source, value, p, p < sure))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return stated.mapInPandas(run, schema)


def to_si(df: DataFrame, sure: float = 0.9) -> DataFrame:
    """All quantities of df (see `stated_values`) in SI units, missing units assigned by posterior."""
    from quaesta.common import durable

    stated = durable(stated_values(df))
    trusted = trust(stated)
    return convert(stated, fit(histogram(stated, trusted)), trusted, sure)


def changed(si: DataFrame) -> DataFrame:
    """Quantities with a stated unit whose number changes when it is expressed in SI.

    A factor is one if it is so within a relative 1e-9; zero changes only where the unit has an offset.
    """
    moved = ((F.abs(F.col("factor") - 1) > 1e-9) & (F.col("number") != 0)) | (F.col("shift") != 0)
    return si.filter(F.col("unit_source").isin("text", "column", "question") & moved).select("src_table", "row_id", "field", "si_unit", "si_value")


def unit_counts(si: DataFrame) -> DataFrame:
    """Values per field, SI unit and source of the unit, with how many are uncertain."""
    return si.groupBy("src_table", "field", "si_unit", "unit_source").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("uncertain").alias("n_uncertain"))
