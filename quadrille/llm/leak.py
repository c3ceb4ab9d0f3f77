"""Finding held-out passages in a corpus by winnowing.

Texts are compared as sequences of words (NFKC, lower case, maximal runs of letters and digits).  Of
every window of ``span - k + 1`` successive k-word hashes the least one is kept as a fingerprint, so two
texts that share ``span`` consecutive words share a fingerprint of that passage, while only about
2/(window + 1) of the positions are kept.  Fingerprints of the test side are joined with those of
the corpus, and every hit is extended word by word to both sides: hash collisions and
shorter passages fall away, so the answer is exact.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.bpe import slices
from quadrille.operators.hotjoin import salted_join
from quadrille.storage import Scratch

#: Consecutive words that make a leak, and words in a hashed gram.
SPAN, GRAM = 12, 6
#: Fingerprints of the test side that are broadcast (12 MB); beyond that the join is shuffled.
BROADCAST_ROWS = 500_000
MEMORY_WORDS = 500_000

_CUT = None
_HASHES: dict[str, int] = {}


def text_words(text: str | None) -> list[str]:
    global _CUT
    if _CUT is None:
        import regex

        _CUT = regex.compile(r"[\p{L}\p{Nd}]+").findall
    if not text:
        return []
    return _CUT((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > MEMORY_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = _Hashes()


def fingerprints(texts: list[str | None], span: int = SPAN, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word position, hash) of the winnowed grams of all texts."""
    words = [text_words(t) for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter((_HASH[w] for ws in words for w in ws), np.uint64, int(size.sum()))
    none = np.zeros(0, np.int64)
    window = span - k + 1
    if len(h) < span:
        return none, none, none
    gram = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(gram)]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    text_of = np.repeat(np.arange(len(words)), size)
    first = np.arange(len(h) - span + 1)
    first = first[text_of[first] == text_of[first + span - 1]]
    # The rightmost least hash of each window.
    view = np.lib.stride_tricks.sliding_window_view(gram[::-1], window)
    picked = np.empty(len(first), np.int64)
    for a in range(0, len(first), 1 << 18):
        f = first[a : a + (1 << 18)]
        rows = view[len(gram) - window - f]
        picked[a : a + len(f)] = f + window - 1 - rows.argmin(axis=1)
    picked = np.unique(picked)
    start = np.cumsum(size) - size
    return text_of[picked], picked - start[text_of[picked]], gram[picked].view(np.int64)


def fingerprint_rows(texts: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """(id, text) to (id, pos, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist()
            for a, b in slices(own):
                n, pos, fp = fingerprints(own[a:b], span, k)
                if len(n):
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(n)), pa.array(pos, pa.int32()), pa.array(fp, pa.int64())], names=["id", "pos", "fp"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, pos int, fp long")


def shared_span(doc: list[str], item: list[str], at: int, item_at: int, k: int) -> int:
    """Words in the longest common passage through a hit; 0 if the grams differ."""
    if doc[at : at + k] != item[item_at : item_at + k] or at + k > len(doc) or item_at + k > len(item):
        return 0
    left = 0
    while at - left > 0 and item_at - left > 0 and doc[at - left - 1] == item[item_at - left - 1]:
        left += 1
    right = k
    while at + right < len(doc) and item_at + right < len(item) and doc[at + right] == item[item_at + right]:
        right += 1
    return left + right


def leaks(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """(doc_id, text) and (item_id, text) to the pairs (item_id, doc_id) that share ``span`` consecutive words.

    Null, empty and shorter texts are in no pair; with a repeated id each of its texts is compared and
    a pair comes out once; null ids are left out; extra columns are ignored; an empty side gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    docs = docs.select(F.col("doc_id").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    items = scratch.table(items.select(F.col("item_id").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL"))
    marks = scratch.table(fingerprint_rows(items, span, k).select(F.col("id").alias("item_id"), F.col("pos").alias("item_at"), "fp").distinct())
    prints = fingerprint_rows(docs, span, k)
    # Passages repeated everywhere make hot fingerprints: without a broadcast they are salted.
    hits = prints.join(F.broadcast(marks), "fp") if marks.count() <= BROADCAST_ROWS else salted_join(scratch.table(prints), marks, "fp")
    hits = hits.select("item_id", F.col("id").alias("doc_id"), "pos", "item_at")
    # One hit a diagonal and stretch is enough to find the passage around it; equal hits are combined
    # before the shuffle.  A pair's hits are bounded by the two texts.
    pairs = scratch.table(hits.groupBy("item_id", "doc_id").agg(F.collect_set(F.struct("pos", "item_at")).alias("hits")))
    texts = docs.join(pairs.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("doc_id"), F.col("text").alias("doc_text"))
    full = pairs.join(texts, "doc_id").join(items.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id")
    kinds = dict(pairs.dtypes)

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for hits, a, b in zip(pdf["hits"], pdf["doc_text"], pdf["item_text"]):
                doc, item = text_words(a), text_words(b)
                keep.append(any(shared_span(doc, item, int(h["pos"]), int(h["item_at"]), k) >= span for h in hits))
            yield pdf.loc[keep, ["item_id", "doc_id"]]

    return full.mapInPandas(extend, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}").distinct()
