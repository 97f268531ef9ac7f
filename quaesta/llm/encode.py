"""Encoding a corpus with a public byte-level BPE: a table of distinct words, encoded once each.

Texts are split into words in Spark by the tokenizer's own pattern; each distinct word is encoded
once; ids are joined back by position. The `frequent` most frequent words (up to 512 characters: a
fixed bound, so their table may be broadcast) are looked up where the text is read, which also takes
every hot word out of the shuffle; only occurrences of other words are joined by word and put into
the gaps they left.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaesta.common import durable

TOKENIZERS = os.environ.get("QUAESTA_TOKENIZERS", "/opt/tokenizers")
#: Pattern of the tokenizer; (?U) makes \s mean Unicode white space, as it does there.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN_PY = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 512


def rank_file(name: str = "byte_bpe_50k", path: str = TOKENIZERS) -> bytes:
    with open(os.path.join(path, f"{name}.tiktoken"), "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoder(ranks: bytes):
    import tiktoken

    r = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN_PY, mergeable_ranks=r, special_tokens={})


def encode_words(words: DataFrame, ranks: bytes) -> DataFrame:
    """word, ids, n for each row of words(word, n): each distinct word is encoded once."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(shared.value)
        for pdf in batches:
            yield pdf.assign(ids=[enc.encode_ordinary(w) for w in pdf["word"]])

    return words.mapInPandas(run, "word string, n bigint, ids array<int>")


def _occurrences(docs: DataFrame) -> DataFrame:
    text = docs.filter(F.length("text") > 0).select("doc_id", "text")
    return text.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("pos", "word"))


def word_table(docs: DataFrame, tokenizer: str = "byte_bpe_50k", path: str = TOKENIZERS) -> DataFrame:
    """word, n, ids of every distinct word of the corpus, written once to the shared folder."""
    n = _occurrences(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return durable(encode_words(n, rank_file(tokenizer, path)))


GAP = -1
PART = "doc_id bigint, h bigint, ids array<int>, rare array<string>"


def _near(docs: DataFrame, words: DataFrame, frequent: int) -> DataFrame:
    """doc_id, h, ids, rare: texts encoded by the table of frequent words where they are read. Each
    occurrence of any other word leaves a GAP in ids and stands in rare, in order."""
    top = words.filter(F.length("word") <= LONG).orderBy(F.desc("n"), "word").limit(frequent).select("word", "ids").collect()
    shared = docs.sparkSession.sparkContext.broadcast(([r["word"] for r in top], [list(r["ids"]) for r in top] + [[GAP]]))
    text = docs.filter(F.length("text") > 0).select("doc_id", "text")
    occ = text.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = pa.array(shared.value[0], pa.string()), pa.array(shared.value[1], pa.list_(pa.int32()))
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                lists = batch.column("words")
                flat = lists.flatten()
                found = pc.index_in(flat, value_set=known)
                gap = pc.is_null(found)
                per_word = ids.take(pc.fill_null(found, pa.scalar(len(known), pa.int32())))
                n_words = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
                n_ids = np.concatenate(([0], np.cumsum(pc.list_value_length(per_word).to_numpy(zero_copy_only=False))))
                n_gaps = np.concatenate(([0], np.cumsum(gap.to_numpy(zero_copy_only=False).astype(np.int64))))
                out = pa.ListArray.from_arrays(pa.array(n_ids[n_words], pa.int32()), per_word.flatten())
                rare = pa.ListArray.from_arrays(pa.array(n_gaps[n_words], pa.int32()), flat.filter(gap))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), out, rare], ["doc_id", "h", "ids", "rare"])

    return occ.mapInArrow(run, PART)


def _rare(part: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, h, k, more: ids of the k-th gap of each text; only these occurrences are shuffled by word."""
    return part.filter(F.size("rare") > 0).select("doc_id", "h", F.posexplode("rare").alias("k", "word")).join(words.select("word", F.col("ids").alias("more")), "word").drop("word")


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k", path: str = TOKENIZERS, frequent: int = 20_000) -> DataFrame:
    """doc_id, ids: each document's token ids without special tokens; [] for an empty or null text.

    Whole texts are encoded, white space and all. Repeated rows (same doc_id and text) give one row;
    one doc_id with two texts gives two rows.
    """
    words = word_table(docs, tokenizer, path)
    part = durable(_near(docs, words, frequent))
    cut = part.filter(F.size("rare") > 0).select("doc_id", "h", "ids", F.lit(None).cast("int").alias("k"), F.lit(None).cast("array<int>").alias("more"))
    both = cut.unionByName(_rare(part, words).select("doc_id", "h", F.lit(None).cast("array<int>").alias("ids"), "k", "more"))
    whole = both.groupBy("doc_id", "h").agg(F.max("ids").alias("ids"), F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "more")))).alias("m"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ids, m in zip(pdf["ids"], pdf["m"]):
                x = np.asarray(ids, np.int32)
                gaps = np.flatnonzero(x == GAP)
                fillers = {p["k"]: p["more"] for p in m}  # repeated rows name a gap twice
                pieces_, at = [], 0
                for k, g in enumerate(gaps):
                    pieces_ += [x[at:g], np.asarray(fillers[k], np.int32)]
                    at = g + 1
                out.append(np.concatenate([*pieces_, x[at:]]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": out})

    done = part.filter(F.size("rare") == 0).select("doc_id", "h", "ids").dropDuplicates(["doc_id", "h"]).select("doc_id", "ids")
    empty = docs.filter(F.col("text").isNull() | (F.length("text") == 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.array().cast("array<int>").alias("ids")).distinct()
    return done.unionByName(whole.mapInPandas(fill, "doc_id bigint, ids array<int>")).unionByName(empty)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k", path: str = TOKENIZERS, frequent: int = 20_000) -> DataFrame:
    """doc_id, n_tokens, by the same word table; only numbers and rare words are shuffled. 0 for empty or null texts."""
    words = word_table(docs, tokenizer, path)
    part = durable(_near(docs, words, frequent))
    near = part.select("doc_id", "h", F.lit(-1).alias("k"), (F.size("ids") - F.size("rare")).cast("long").alias("n"))
    far = _rare(part, words).select("doc_id", "h", "k", F.size("more").cast("long").alias("n"))
    full = near.unionByName(far).groupBy("doc_id", "h", "k").agg(F.max("n").alias("n")).groupBy("doc_id", "h").agg(F.sum("n").alias("n_tokens")).drop("h")
    return full.unionByName(docs.filter(F.col("text").isNull() | (F.length("text") == 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens")).distinct())


def pieces(spark: SparkSession, tokenizer: str = "byte_bpe_50k", path: str = TOKENIZERS) -> DataFrame:
    """id, piece (hex of its bytes): a table of fixed size, one row per id of the vocabulary."""
    rows = [(int(b), base64.b64decode(a).hex()) for a, b in map(bytes.split, rank_file(tokenizer, path).splitlines())]
    return spark.createDataFrame(rows, "id int, piece string")


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", path: str = TOKENIZERS) -> DataFrame:
    """doc_id, text from doc_id, ids through an id-to-piece join; '' for []; an unknown id is left out."""
    p = F.broadcast(pieces(encoded.sparkSession, tokenizer, path))
    e = encoded.select("doc_id", F.xxhash64("ids").alias("h"), F.posexplode_outer("ids").alias("pos", "id")).join(p, "id", "left")
    t = e.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("pos", "piece"))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), "UTF-8")
    return t.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))


def size_report(encoded: DataFrame, docs: DataFrame) -> DataFrame:
    """Tokens per language label: documents, tokens, and characters per token."""
    d = docs.select("doc_id", F.lower(F.coalesce("lang", F.lit(""))).alias("lang"), F.coalesce(F.length("text"), F.lit(0)).alias("c"))
    j = d.join(encoded.select("doc_id", F.size("ids").alias("k")), "doc_id")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("k").alias("n_tokens"), F.round(F.sum("c") / F.sum("k"), 4).alias("chars_per_token"))
