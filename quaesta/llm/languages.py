"""Language of a text's prose by a character trigram model, fitted on labelled documents.

Each language is a multinomial over hashed trigrams of letters; a further class stands for languages
the model does not know: its log-likelihood per trigram is a constant, fitted so that all but a small
share of known text lies above it. Batches of texts are scored at once on arrays of code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 17
OTHER = "other"
#: Least sum of log-odds, and least number of letters, that make a language sure.
LEAST_ODDS, LEAST_ODDS_OTHER, LEAST_LETTERS = 6.0, 20.0, 14
# What is no prose: formulas, code, tags, commands, predicates.
_NO_PROSE = re.compile(r"\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]|\\[a-z]+\{[^{}]*\}|```.*?```|</?[A-Za-z_]{3,}>|\\[a-zA-Z]+", re.S)
_BREAK = re.compile(r"[.?!:。！？：;；\n]+")
_UNIT = re.compile(r"(\d)\s?[^\W\d_]{1,3}(?!\w)")
# Lines and results that are labels in every language.
_LABELS = frozenset(["does not change", "do not change", "cannot be determined", "zero by symmetry", "perpendicular to the plates", "final answer", "the answer is", "answer is", "answer", "unknown", "uncertain", "declined", "true", "false", "result"])


class Model(NamedTuple):
    names: list[str]  # languages, then OTHER
    weights: np.ndarray  # trigram hash x language: log-likelihood
    other: float  # log-likelihood of a trigram in an unknown language


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram hashes of the texts' prose, and for each the number of its sentence; per sentence its text and letters.

    Runs of anything but letters are one space; Han, kana and Hangul count as two letters.
    """
    parts: list[str] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        if not t:
            continue
        if "$" in t or "\\" in t or "<" in t or "`" in t:
            t = _NO_PROSE.sub("\n", t)
        for s in _BREAK.split(_UNIT.sub(r"\1 ", t).lower()):
            if s and not s.isspace() and s.strip(" *_#>") not in _LABELS:
                parts.append(s)
                owner.append(i)
    c = np.frombuffer("".join(f"\n{s}" for s in parts).encode("utf-32-le", "replace"), dtype=np.uint32)
    x = _CLEAN[np.minimum(c, len(_CLEAN) - 1)]
    cut = c == 10
    keep = x != 32
    keep[1:] |= keep[:-1]  # one space for a run
    keep |= cut
    x, cut = x[keep], cut[keep]
    sent = np.cumsum(cut) - 1
    letters = np.add.reduceat(_LETTER[x], np.flatnonzero(cut), dtype=np.int64) if parts else np.zeros(0, np.int64)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.array(owner, dtype=np.int64), letters
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    inside = (sent[:-2] == sent[2:]) & (x[1:-1] != 32)
    return (h >> np.uint32(32 - BITS))[inside].astype(np.int64), sent[1:-1][inside], np.array(owner, dtype=np.int64), letters


def _letters() -> np.ndarray:
    """Letters of each code point of the basic plane: 1, or 2 for signs that stand for a syllable or word."""
    a = np.fromiter((chr(i).isalpha() for i in range(0x10000)), dtype=np.int8, count=0x10000)
    a[0xD800:0xE000] = 0
    for lo, hi in ((0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7A4)):
        a[lo:hi] *= 2
    a[0x0300:0x0370] = 0
    for lo, hi in ((0x0370, 0x0400),):  # Greek letters are symbols here
        a[lo:hi] = 0
    return a


_LETTER = _letters()
#: What each code point counts as: itself or, for all that is no letter, a space.
_CLEAN = np.where(_LETTER > 0, np.arange(len(_LETTER)), 32).astype(np.uint32)


def _counts(pairs: list[tuple[str, str]], number: dict[str, int], least: float = -np.inf, known: np.ndarray | None = None) -> np.ndarray:
    """Trigram counts by language; with `known`, of those sentences only whose mean under their own label reaches `least`."""
    g, sent, owner, _ = _points([t for t, _ in pairs])
    at = g * len(number) + np.array([number[x] for _, x in pairs], dtype=np.int64)[owner][sent]
    if known is not None and len(g):
        fits = np.bincount(sent, known.ravel()[at], len(owner)) >= least * np.bincount(sent, minlength=len(owner))
        at = at[fits[sent]]
    return np.bincount(at, minlength=len(number) << BITS).reshape(1 << BITS, -1)


def _means(pairs: list[tuple[str, str]], number: dict[str, int], w: np.ndarray) -> np.ndarray:
    """Mean log-likelihood, under its own label, of each sentence that has enough letters; to four places, so that there are few different ones."""
    g, sent, owner, letters = _points([t for t, _ in pairs])
    own = np.array([number[x] for _, x in pairs], dtype=np.int64)[owner]
    n = np.bincount(sent, minlength=len(owner))
    fair = (letters >= LEAST_LETTERS) & (n > 0)
    return np.round((np.bincount(sent, w[g, own[sent]], len(owner)) / np.maximum(n, 1))[fair], 4)


def _log(count: np.ndarray) -> np.ndarray:
    c = count + 0.1
    return np.log(c / c.sum(0)).astype(np.float32)


def _model(names: list[str], count: np.ndarray, level: Callable[[np.ndarray], float], more: Callable[[float, np.ndarray], np.ndarray] | None) -> Model:
    """The model of the counts and of those of `more` that fit it; the level is that of held-out text."""
    w = _log(count)
    at = level(w)
    if more:
        w = _log(count + more(at - 1.0, w))
        at = level(w)
    return Model([*names, OTHER], w, at)


def train(texts: list[str], labels: list[str], more: list[tuple[str, str]] = (), share: float = 0.002) -> Model:
    """Fit on labelled texts and on `more` (text, label), whose labels may be wrong now and then: of
    these, sentences that look foreign to their label are left out.

    The unknown class is fitted on every fifth labelled text, which the languages do not see.
    """
    names = sorted(set(labels))
    if not names:
        return Model([OTHER], np.zeros((1 << BITS, 0), np.float32), -np.inf)
    number = {x: i for i, x in enumerate(names)}
    pairs = list(zip(texts, labels))
    held = pairs[::5]

    def level(w: np.ndarray) -> float:
        m = _means(held, number, w)
        return float(np.quantile(m, share)) if len(m) else -np.inf

    fitting = lambda least, w: _counts([p for p in more if p[1] in number], number, least, w)
    return _model(names, _counts([p for i, p in enumerate(pairs) if i % 5], number), level, fitting if more else None)


def languages(model: Model, texts: list[str]) -> list[str]:
    """Language in which most of each text's prose is written: sentences vote with their letters; '' without evidence.

    OTHER stands for a language the model does not know.
    """
    out = [""] * len(texts)
    g, sent, owner, letters = _points(texts)
    if not len(g):
        return out
    k = len(model.names)
    n_sent = len(owner)
    ll = np.empty((n_sent, k))
    for j, w in enumerate(np.ascontiguousarray(model.weights.T)):
        ll[:, j] = np.bincount(sent, w[g], n_sent)
    ll[:, k - 1] = np.bincount(sent, minlength=n_sent) * model.other if np.isfinite(model.other) else -np.inf
    order = np.sort(ll, axis=1)
    best = ll.argmax(1)
    odds = order[:, -1] - order[:, -2] if k > 1 else np.full(n_sent, np.inf)
    votes, proof = np.zeros((len(texts), k)), np.zeros((len(texts), k))
    ok = letters > 0
    np.add.at(votes, (owner[ok], best[ok]), letters[ok])
    np.add.at(proof, (owner[ok], best[ok]), odds[ok])
    top = votes.argmax(1)
    row = np.arange(len(texts))
    sure = (votes[row, top] >= LEAST_LETTERS) & (proof[row, top] >= np.where(top == k - 1, LEAST_ODDS_OTHER, LEAST_ODDS))
    return [model.names[j] if s else "" for j, s in zip(top, sure)]


def _pieces(p: pd.DataFrame, chars: int = 1 << 20) -> Iterator[list[tuple[str, str]]]:
    """The (text, label) of a batch in pieces of about so many characters."""
    piece, size = [], 0
    for x in zip(p["t"], p["l"]):
        piece.append(x)
        size += len(x[0])
        if size >= chars:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def _table(df: DataFrame, number: dict[str, int], least: float = -np.inf, known: np.ndarray | None = None) -> np.ndarray:
    """`_counts` over all rows of df(t, l): summed in Spark, one number per trigram and language moved to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            count = np.zeros((1 << BITS, len(number)), np.int64)
            for x in _pieces(p):
                count += _counts(x, number, least, known)
            at = np.flatnonzero(count)
            yield pd.DataFrame({"at": at, "n": count.ravel()[at]})

    got = df.mapInPandas(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(number) << BITS)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(1 << BITS, -1)


def _quantile(df: DataFrame, number: dict[str, int], w: np.ndarray, share: float) -> float:
    """The quantile of `_means` over all rows of df(t, l)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            m, n = np.unique(np.concatenate([np.zeros(0), *(_means(x, number, w) for x in _pieces(p))]), return_counts=True)
            yield pd.DataFrame({"m": m, "n": n})

    one = df.mapInPandas(run, "m double, n bigint").groupBy("m").agg(F.sum("n").alias("n"))
    at = one.agg(F.percentile("m", share, F.col("n")).alias("m")).collect()[0]["m"]
    return -np.inf if at is None else at


def fit(docs: DataFrame, more: DataFrame | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", share: float = 0.002) -> Model:
    """Fit on all labelled documents and all rows of `more` (text, lang), whose labels may be wrong now and then, as `train` does.

    The held-out fifth is chosen by hash of key and text. Labels are two or three letters in any case;
    null, `und` and other labels tell nothing, nor do null and empty texts.
    """

    def labelled(df: DataFrame, *keys: str) -> DataFrame:
        label = F.lower(F.trim(lang))
        held = F.pmod(F.xxhash64(*keys, text), F.lit(5)) == 0
        return df.filter(F.col(text).isNotNull() & (F.length(text) > 0) & label.rlike("^[a-z]{2,3}$") & (label != "und")).select(F.col(text).alias("t"), label.alias("l"), held.alias("held"))

    got = labelled(docs, key)
    names = sorted(r["l"] for r in got.select("l").distinct().collect())
    if not names:
        return train([], [])
    number = {x: i for i, x in enumerate(names)}
    held = got.filter("held").select("t", "l")
    fitting = None if more is None else lambda least, w: _table(labelled(more).filter(F.col("l").isin(names)).select("t", "l"), number, least, w)
    return _model(names, _table(got.filter("not held").select("t", "l"), number), lambda w: _quantile(held, number, w, share), fitting)
