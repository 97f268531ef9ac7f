"""Broken prompt and response pairs: truncated, refusal, copy, language, empty, in this order.

One pass over the responses in Arrow batches; the tables joined to them (questions, field limits) are
broadcast only after their size is checked. Truncation is the score of `truncation`; refusals are
local alignments with refusal templates beyond a fitted threshold; copies are found by shingle
containment and longest common subsequence against the question; the language of the prose is that
of a trigram model fitted on labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaesta.common import join_small
from quaesta.llm import refusals, texts
from quaesta.llm.languages import OTHER, Model, languages
from quaesta.llm.truncation import field_limits, judge

DEFECTS = "sample_id bigint, source string, defect string"


def questions(val: DataFrame) -> DataFrame:
    """question_id, question (after the premises), lang, from the first user message of the prompt."""
    user = F.element_at(F.filter("prompt", lambda m: m["role"] == "user"), 1)["content"]
    q = F.regexp_replace(user, r"(?s)^.*\bQuestion:\s*", "")
    return val.filter(F.size(F.filter("prompt", lambda m: m["role"] == "user")) > 0).select("question_id", q.alias("question"), F.lower("lang").alias("lang")).dropDuplicates(["question_id"])


class Models(NamedTuple):
    """What is fitted: weights of the truncation model, refusal threshold, language model."""

    weights: np.ndarray
    threshold: float
    languages: Model


def defect(response: str | None, extracted: str | None, question: str | None, cut: bool, want: str, have: str, has_extracted: bool, threshold: float) -> str:
    """First defect that fits, '' if none. want, have: languages of question and response, '' if unknown."""
    if texts.is_empty(response):
        return "empty"
    if cut:
        return "truncated"
    if refusals.is_refusal(response, threshold):
        return "refusal"
    if texts.is_copy(response, question):
        return "copy"
    if want and have and want != have:
        return "language"
    if has_extracted and texts.is_empty(extracted):
        return "empty"
    return ""


def broken_pairs(pairs: DataFrame, models: Models, tail: bool = False, threshold: float = 0.5) -> DataFrame:
    """Each defective pair of df(sample_id, source, response, extracted, question, lang): DEFECTS columns.

    tail: responses may begin anywhere and have no extracted answer to judge. lang is the language of
    the question; where it is null it is read from the question. Null questions make no copy and,
    without lang, no language defect. Repeated records give one row.
    """
    d = join_small(pairs.select("sample_id", "source", "response", "extracted", "question", "lang"), field_limits(pairs, "source", "response"), {"source": "source"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[str, str] = {}
        for p in batches:
            text, question, extracted, lang = ([t if isinstance(t, str) else None for t in p[c]] for c in ("response", "question", "extracted", "lang"))
            prob = judge([t or "" for t in text], p["limit_chars"].astype(float).tolist(), p["limit_bytes"].astype(float).tolist(), models.weights, tail)
            once: dict[str, int] = {}
            at = [once.setdefault(t or "", len(once)) for t in text]
            have = languages(models.languages, list(once))
            new = list({q for q, w in zip(question, lang) if q and not w} - asked.keys())
            if len(asked) > 200_000:
                asked.clear()
                new = list({q for q, w in zip(question, lang) if q and not w})
            asked.update(zip(new, languages(models.languages, new)))
            out = []
            seen: dict[tuple, str] = {}
            for i, (t, q, e, w, c) in enumerate(zip(text, question, extracted, lang, prob > threshold)):
                key = (t, q, e, w, bool(c))
                if key not in seen:
                    want = w or asked.get(q, "")
                    seen[key] = defect(t, e, q, bool(c), "" if want == OTHER else want, have[at[i]], not tail, models.threshold)
                if seen[key]:
                    out.append((p["sample_id"].iat[i], p["source"].iat[i], seen[key]))
            yield pd.DataFrame(out, columns=["sample_id", "source", "defect"])

    return d.mapInPandas(run, DEFECTS).dropDuplicates(["sample_id", "defect"])
