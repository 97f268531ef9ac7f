"""Texts that stop before their end: hashed logistic regression on how a text closes.

The model is fitted on all rows. Negatives are values of closed structure (nothing left open,
something that closes a text); positives are the same values cut at random places, all of them. Every
record is then scored, and the score alone decides. Field limits, one of the features, come from the
lengths of all rows of each source.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaesta.common import durable, join_small
from quaesta.llm.texts import Closing, closing, is_blank

DIMS = 1 << 13
#: Gradients are summed in integers of this part of the whole: exactly, whatever the order and the tasks.
_PARTS = float(1 << 52)
SCORED = "row_id bigint, source string, probability double, truncated boolean"


def field_limits(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """limit_chars and limit_bytes of each source, null where its lengths show no limit.

    Lengths are counted over all rows: the limit is the greatest length if at least 3 rows and 0.5 %
    of the source have it (in bytes: or up to three less, where a character was split).
    """
    n = df.filter(F.col(text).isNotNull()).groupBy(source, F.length(text).alias("c"), F.octet_length(text).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(source).agg(F.max("c").alias("mc"), F.max("o").alias("mo"), F.sum("n").alias("rows"))
    j = n.join(top.withColumnRenamed(source, "__s"), F.col(source).eqNullSafe(F.col("__s")))
    j = j.groupBy(source, "mc", "mo", "rows").agg(F.sum(F.when(F.col("c") == F.col("mc"), F.col("n"))).alias("at_c"), F.sum(F.when(F.col("o") >= F.col("mo") - 3, F.col("n"))).alias("at_o"))
    enough = lambda c: F.col(c) >= F.greatest(F.lit(3), F.col("rows") * 0.005)
    return j.select(source, F.when(enough("at_c") & (F.col("mc") > 20), F.col("mc")).alias("limit_chars"), F.when(enough("at_o") & (F.col("mo") > 20), F.col("mo")).alias("limit_bytes"))


def _fills(t: str, chars: float, size: float) -> bool:
    return bool((chars == chars and chars and len(t) >= chars - 1) or (size == size and size and len(t.encode("utf-8", "replace")) >= size - 3))


def features(t: str, full: bool, tail: bool = False, c: Closing | None = None) -> list[int]:
    """Hashed features of a text's closing: last characters and their shapes, last word, punctuation, open markup, field filled. c: its Closing, if known."""
    u = t.rstrip()
    c = c or closing(u, tail)
    end = u[-8:]
    shape = re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "a", end))
    last = u[-600:].rsplit("\n", 1)[-1]
    words = last.split()
    f = [f"1{end[-1:]}", f"2{end[-2:]}", f"3{end[-3:]}", f"s{shape[-2:]}", f"t{shape[-4:]}", f"w{words[-1][-12:] if words else ''}", f"fs{full}{shape[-1:]}", f"n{min(len(words), 6)}", f"ln{min(len(u) // 20, 5)}"]
    return [*map(_hash, f), *_state(c, full)]


@lru_cache(maxsize=200_000)
def _hash(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "replace")) % DIMS


@lru_cache(maxsize=10_000)
def _state(c: Closing, full: bool) -> tuple[int, ...]:
    """Hashed features of what the closing shows, alone and together with the filled field."""
    state = f"{c.markup}|{c.sign}|{c.sentence}|{c.closer}|{c.result}|{c.bare}"
    f = [f"m{c.markup}", f"g{c.sign}", f"p{c.sentence}", f"q{c.closer}", f"r{c.result}", f"k{c.bare}", f"i{c.intact()}", f"f{full}", f"c{state}", f"cf{full}{state}", "bias"]
    return tuple(map(_hash, f))


def artificial_cut(t: str, rnd: random.Random) -> str | None:
    """A text cut at a random place after its first third, three in ten with a sign of loss; None if it is too short to cut."""
    if len(t) <= 12:
        return None
    cut = t[: rnd.randrange(len(t) // 3, len(t) - 1)]
    if rnd.random() < 0.3:
        cut = cut.rstrip() + rnd.choice(["…", "...", "\ufffd", "…[cut]", " [truncated]"])
    return None if is_blank(cut) else cut


def examples(t: str, full: bool, seed: int = 7) -> tuple[list[int] | None, list[int] | None]:
    """Features of a text as a negative and, cut at random, as a positive; None for what it is not.

    Intact values (closed structure) are negatives, a seventh of them as if they happened to fill
    their field; a random cut of each that is no bare answer is a positive, made by a field limit (so
    that it fills the field) or in transfer (so that it does not), at even odds. The draws follow from
    the text alone, so they are the same in any task.
    """
    if is_blank(t):
        return None, None
    c = closing(t)
    if not c.intact():
        return None, None
    rnd = random.Random(seed << 32 | zlib.crc32(t.encode("utf-8", "replace")))
    whole = features(t, full or rnd.random() < 1 / 7, c=c)
    cut = None if c.bare else artificial_cut(t, rnd)
    return whole, features(cut, rnd.random() < 0.5) if cut else None


def _gradient(w: np.ndarray, x: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Gradient of the loss, both classes weighing the same, over rows of features x that occur n[:, 0]
    times whole and n[:, 1] times cut, of `total` in all: integers, in 1 / _PARTS."""
    p = 1 / (1 + np.exp(-w[x].sum(1)))
    r = np.rint((p * n[:, 0] / total[0] - (1 - p) * n[:, 1] / total[1]) * (_PARTS / 2))
    return np.bincount(x.ravel(), np.repeat(r, x.shape[1]), DIMS)


def _descend(gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float, l2: float) -> np.ndarray:
    """Weights after so many steps along the whole gradient."""
    w, m, v = np.zeros(DIMS), np.zeros(DIMS), np.zeros(DIMS)
    for i in range(1, steps + 1):
        g = gradient(w) / _PARTS + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return w


def train(texts: list[tuple[str, bool]], seed: int = 7, steps: int = 200, rate: float = 0.3, l2: float = 1e-3) -> np.ndarray:
    """Weights of the logistic regression from (text, whether it fills its field), all `examples` of them."""
    rows = [(f, cut) for t, full in texts for cut, f in enumerate(examples(t, full, seed)) if f]
    x, n = np.array([f for f, _ in rows]), np.array([(1 - cut, cut) for _, cut in rows]).reshape(-1, 2)
    if not n.sum(0).all():
        return np.zeros(DIMS)
    return _descend(lambda w: _gradient(w, x, n, n.sum(0)), steps, rate, l2)


def probability(w: np.ndarray, feats: list[list[int]], prior: float = 0.25) -> np.ndarray:
    """Probability that a text is cut; `prior` is the share of cut records expected, as training weighs both classes alike."""
    return 1 / (1 + np.exp(-w[np.array(feats, dtype=np.int64)].sum(1)) * (1 - prior) / prior) if feats else np.zeros(0)


def with_limits(df: DataFrame, text: str = "text") -> DataFrame:
    """df with limit_chars and limit_bytes of each row's source."""
    return join_small(df, field_limits(df, "source", text), {"source": "source"})


def _blocks(df: DataFrame, text: str, seed: int) -> DataFrame:
    """The different feature rows of all texts and how often each occurs, in blocks: rows, whole, cut, x, n.

    Repeated texts count once. Only features and a hash of the text are moved.
    """
    t = with_limits(df.filter(F.col(text).isNotNull()).select("source", text), text).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"), "limit_chars", "limit_bytes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            chars, size = p["limit_chars"].astype(float), p["limit_bytes"].astype(float)
            once = dict.fromkeys((h, t, _fills(t, c, b)) for h, t, c, b in zip(p["h"], p["t"], chars, size))
            made = [(h, full, *(np.array(f, np.uint16).tobytes() if f else None for f in examples(t, full, seed))) for h, t, full in once]
            yield pd.DataFrame([r for r in made if r[2]], columns=["h", "full", "whole", "cut"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                n = p[["whole", "cut"]].to_numpy(np.int64)
                yield pd.DataFrame({"rows": [len(p)], "whole": [n[:, 0].sum()], "cut": [n[:, 1].sum()], "x": [b"".join(p["x"])], "n": [n.tobytes()]})

    one = t.mapInPandas(run, "h bigint, full boolean, whole binary, cut binary").distinct()
    each = one.select(F.explode(F.array(F.struct(F.col("whole").alias("x"), F.lit(0).alias("y")), F.struct(F.col("cut").alias("x"), F.lit(1).alias("y"))))).select("col.*").filter(F.col("x").isNotNull())
    same = each.groupBy("x").agg(F.count_if(F.col("y") == 0).alias("whole"), F.count_if(F.col("y") == 1).alias("cut"))
    return durable(same.mapInPandas(pack, "rows bigint, whole bigint, cut bigint, x binary, n binary"))


def _unpack(x: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(n, np.int64).reshape(-1, 2)
    return np.frombuffer(x, np.uint16).reshape(len(n), -1).astype(np.int64), n


def fit(df: DataFrame, text: str = "text", seed: int = 7, steps: int = 200, rate: float = 0.3, l2: float = 1e-3, driver_rows: int = 400_000) -> np.ndarray:
    """Fit on all rows of df(source, text): `train` on all different texts, whatever their number and length.

    Up to `driver_rows` different feature rows (22 MB) the driver goes along the gradient by itself;
    beyond that each step is a Spark job over all of them. The weights are the same either way.
    """
    blocks = _blocks(df, text, seed)
    size = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "whole", "cut")]).collect()[0]
    total = np.array([size["whole"], size["cut"]], float)
    if not total.all():
        return np.zeros(DIMS)

    def along(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = np.zeros(DIMS)
            for p in batches:
                for x, n in zip(p["x"], p["n"]):
                    g += _gradient(w, *_unpack(x, n), total)
            yield pd.DataFrame({"g": [g.tobytes()]})

        return sum(np.frombuffer(r["g"]) for r in blocks.select("x", "n").mapInPandas(run, "g binary").collect())

    if size["rows"] > driver_rows:
        return _descend(along, steps, rate, l2)
    parts = [(r["x"], r["n"]) for r in blocks.select("x", "n").collect()]
    return _descend(lambda w: sum(_gradient(w, *_unpack(x, n), total) for x, n in parts), steps, rate, l2)


def judge(texts: list[str], chars: list[float], size: list[float], weights: np.ndarray, tail: bool = False) -> np.ndarray:
    """Probability that each text stops before its end; 0 for blank ones, which are no case. Equal texts are judged once."""
    seen: dict[tuple[str, bool], int] = {}
    at = [seen.setdefault((t, not tail and _fills(t, c, b)), len(seen)) for t, c, b in zip(texts, chars, size)]
    blank = np.array([is_blank(t) for t, _ in seen], dtype=bool)
    p = probability(weights, [features(t, f, tail) for t, f in seen])
    return np.where(blank, 0.0, p)[at] if seen else np.zeros(0)


def score(df: DataFrame, weights: np.ndarray, tail: bool = False, threshold: float = 0.5) -> DataFrame:
    """Score every record of df(row_id, source, text): SCORED columns; truncated where the probability exceeds `threshold`.

    Null, empty and blank texts and placeholders have probability 0; whole texts are read, however
    long. A repeated record gives repeated rows.
    """
    d = with_limits(df.select("row_id", "source", "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            texts = [t if isinstance(t, str) else "" for t in p["text"]]
            prob = judge(texts, p["limit_chars"].astype(float).tolist(), p["limit_bytes"].astype(float).tolist(), weights, tail)
            yield pd.DataFrame({"row_id": p["row_id"], "source": p["source"], "probability": prob, "truncated": prob > threshold})

    return d.mapInPandas(run, SCORED)


def truncation_rates(scored: DataFrame) -> DataFrame:
    """How often each source truncates; a repeated record counts once."""
    one = scored.groupBy("source", "row_id").agg(F.max("truncated").alias("truncated"))
    return one.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if("truncated").alias("n_truncated"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("rate")
    )
