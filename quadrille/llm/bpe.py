"""Encoding a corpus with a public byte-level BPE tokenizer.

Texts are cut into words by the tokenizer's pattern.  The corpus's frequent words, counted over all
documents, are compiled with their ids into a transducer lexicon (``lexicon.Lexicon``) that is written
to the shared folder once and memory-mapped by every worker.  Per slice of documents the distinct words
are looked up together; words the lexicon lacks are merged exactly, pair by pair in rank
order.  The lexicon only saves work: ids don't depend on what is in it.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.lexicon import Lexicon
from quadrille.storage import Scratch, shared_folder

#: Fixed value: how the tokenizer cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = "/opt/tokenizers"
#: Words in the lexicon, the most frequent of the corpus; about 4 MB.
LEXICON_WORDS = 65_536
#: Bytes of the longest word in the lexicon: a look-up goes byte by byte through all words at once.
LEXICON_BYTES = 48
#: Bytes up to which a word is merged in a plain list.
SHORT_WORD, NO_RANK = 80, 1 << 60
#: Characters tokenized at a time.
SLICE_CHARS = 2_000_000
#: Words a worker remembers between slices before it starts afresh.
MEMORY_WORDS = 400_000
#: Distinct words counted in memory before partial counts are handed on.
COUNT_WORDS = 300_000


def vocabulary(directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> bytes:
    """The tokenizer's rank file: one line per token, base64 and rank."""
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact ids of one word: always join the adjacent pair of least rank, the leftmost of equals.

    Short words are joined in a plain list, which is faster there; longer ones by a heap over a linked list, so that
    a word of n bytes takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n <= SHORT_WORD:
        get, parts = ranks.get, [word[i : i + 1] for i in range(n)]
        rank = [get(word[i : i + 2], NO_RANK) for i in range(n - 1)]
        while rank and (least := min(rank)) < NO_RANK:
            i = rank.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], NO_RANK)
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
        return [ranks[x] for x in parts]
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once merged away
    prev = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            prev[stop] = i
            if (q := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (q, i, end[stop]))
        if (h := prev[i]) >= 0 and (q := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (q, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


@cache
def cutter() -> Callable[[str], list[str]]:
    """The pattern's cut.  The standard library's engine is twice as fast and agrees wherever a text has
    none of the characters both see differently (numbers that aren't digits, unassigned and separator controls)."""
    import regex

    exact = regex.compile(PATTERN).findall
    fast = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A).findall
    controls = re.compile("[\x1c-\x1f]").search
    same: set[str] = set()

    def strange(text: str) -> bool:
        new = set(text) - same
        odd = {c for c in new if unicodedata.category(c) in ("No", "Nl", "Cn") or "\x1c" <= c <= "\x1f"}
        same.update(new - odd)
        return bool(odd)

    def cut(text: str) -> list[str]:
        if text.isascii():
            return (exact if controls(text) else plain)(text)
        return (exact if strange(text) else fast)(text)

    return cut


class _Index(dict):
    """Numbers words in the order of their first look-up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """A worker's tokenizer: vocabulary, memory-mapped lexicon and the words met so far."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon | None):
        self.ranks, self.lexicon, self.cut = ranks, lexicon, cutter()
        self._fresh()

    def _fresh(self) -> None:
        self.index, self.words = _Index(), []
        self.count, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self) -> None:
        new = [w.encode() for w in list(self.index)[len(self.count) :]]
        if not new:
            return
        number = self.lexicon.lookup(new) if self.lexicon is not None else np.full(len(new), -1)
        ids = [self.lexicon.ids_of(k) if k >= 0 else merge_word(w, self.ranks) for w, k in zip(new, number.tolist())]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.count = np.concatenate([self.count, size])
        self.flat = np.concatenate([self.flat, np.fromiter((x for i in ids for x in i), np.int32, int(size.sum()))])

    def encode(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; tokens of every word of all texts; all ids; where each text's ids end."""
        if len(self.index) > MEMORY_WORDS:
            self._fresh()
        words = [self.cut(t) if t else [] for t in texts]
        per_text = np.fromiter(map(len, words), np.int64, len(words))
        number = self.index.__getitem__
        code = np.fromiter(map(number, chain.from_iterable(words)), np.int64, int(per_text.sum()))
        self._learn()
        size = self.count[code]
        last = np.cumsum(size)
        total = int(last[-1]) if len(last) else 0
        at = np.arange(total) + np.repeat(self.start[code] - (last - size), size)
        ends = np.concatenate([[0], last])[np.cumsum(per_text)]
        return words, size, self.flat[at], ends


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; a longer text is alone."""
    at = held = 0
    for n, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield at, n + 1
            at, held = n + 1, 0
    if at < len(texts):
        yield at, len(texts)


def publish(spark: SparkSession, data: bytes, label: str) -> tuple[str, str]:
    """Put a file into the shared folder; (kind, name) for :func:`obtain` on the workers."""
    import uuid

    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}.bin"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(jpath)
    out.write(bytearray(data))
    out.close()
    fs.deleteOnExit(jpath)
    if fs.getUri().getScheme() == "file":
        return "path", jpath.toUri().getPath()
    spark.sparkContext.addFile(path)  # each executor fetches it once
    return "spark", path.rsplit("/", 1)[1]


def obtain(where: tuple[str, str]) -> str:
    return where[1] if where[0] == "path" else SparkFiles.get(where[1])


_ENCODERS: dict = {}


def worker_encoder(ranks, where: tuple[str, str] | None) -> Encoder:
    """One encoder a worker process and lexicon."""
    if where not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[where] = Encoder(parse_ranks(ranks.value), Lexicon.open(obtain(where)) if where else None)
    return _ENCODERS[where]


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n) over all texts, counted on the workers before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = cutter(), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(cut(text.as_py() or ""))
                if len(held) >= COUNT_WORDS:
                    yield flush()
        yield flush()

    return texts.select(column).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(texts: DataFrame, column: str = "text", directory: str = TOKENIZERS, limit: int = LEXICON_WORDS):
    """(ranks as a broadcast variable, where the lexicon lies).

    The frequent words are those above a count, so the driver sees ``limit`` words at most from all tasks
    together, and before them one row per sixteenth of a power of two of the counts.
    """
    spark = texts.sparkSession
    data = vocabulary(directory)
    ranks = parse_ranks(data)
    size = F.floor(F.log2("n") * 16).cast("int")
    counts = Scratch(spark, "words").table(word_counts(texts, column).where((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES)).withColumn("size", size))
    # Of the step at which the lexicon is full a share by hash: what is in it is only a matter of speed.
    taken, room = F.lit(False), limit
    for step in counts.groupBy("size").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("size")).collect():
        share = int(min(1.0, 0.97 * room / step["words"]) * 1000) if step["words"] > room else 1000
        taken, room = taken | ((F.col("size") == step["size"]) & (F.pmod(F.xxhash64("word"), F.lit(1000)) < share)), room - step["words"]
        if room <= 0:
            break
    top = counts.where(taken).select("word").collect()
    lexicon = Lexicon.build([(w, merge_word(w, ranks)) for w in (r["word"].encode() for r in top)])
    return spark.sparkContext.broadcast(data), publish(spark, lexicon.to_bytes(), "lexicon")


def encode_corpus(docs: DataFrame, key: str = "doc_id", column: str = "text", directory: str = TOKENIZERS, limit: int = LEXICON_WORDS) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    Null and empty texts give the empty list; strings of special tokens are ordinary text; repeated
    and null keys pass through; extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(key).alias("k"), F.col(column).alias("text"))
    ranks, where = build_lexicon(docs, "text", directory, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(ranks, where)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                _, _, ids, ends = enc.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=["k", "ids"])

    kind = docs.schema["k"].dataType.simpleString()
    return docs.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode_corpus(encoded: DataFrame, key: str = "doc_id", directory: str = TOKENIZERS) -> DataFrame:
    """(key, ids) to (key, text): what the ids spell; null ids and empty lists are the empty text.

    Ids outside the vocabulary are errors; bytes that are no UTF-8 become replacement characters.
    """
    data = encoded.sparkSession.sparkContext.broadcast(vocabulary(directory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: word for word, rank in parse_ranks(data.value).items()}
        for batch in batches:
            texts = [b"".join([token[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("k"), "ids").mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
