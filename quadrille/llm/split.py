"""Splitting oversized texts into overlapping pieces at natural boundaries.

The separator hierarchy - section, paragraph, sentence, word, character - is applied recursively: a span that
doesn't fit is cut into its units of the highest level, units are packed into the piece as long as the
limit leaves room, and only if not even the first unit fits is that unit cut on the next level.
Pieces are runs of the text's own token list, so joining them without the overlaps gives back that list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.bpe import TOKENIZERS, Encoder, build_lexicon, parse_ranks, slices, worker_encoder

LIMIT, OVERLAP = 1024, 64
BREAKS = re.compile("(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])+")
ONE_BREAK = re.compile("\r\n|[\n\r\x0b\x85\u2028]")
#: What may end a sentence, closing quotes and brackets included, before white space; wide stops need none.
#: A colon is a full stop only in Armenian, directly after a letter.
STOP = re.compile("(?:[.!?…։۔।]|(?<=[Ա-Ֆա-և]):)[\"'’”»)\\]]*(?:[ \u00a0\u202f]»)?(?=\\s)|[。！？]+[」』”]*")
#: Abbreviations after whose full stop a sentence goes on (lower case, without the stop).
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof st no nos vol vols p pp fig figs sec secs art arts para paras cf vs e.g i.e viz al approx dept est gen col capt lt sgt rev hon gov sen rep pres jr sr messrs a.m p.m u.s u.k "
    "nr abs z.b d.h u.a vgl bzw ca hr fr frl bd s ff evtl ggf inkl insb sog str usw vorm zzgl zt geb gest jh mio mrd tel "
    "m mm mme mlle mlles me mgr ste av boul chap env éd ex p.ex c.-à-d hab n° r réf suiv t".split()
)
WORD_BEFORE = re.compile(r"[^\s\"'’”»)\]«(\[„“]+\Z")
LEVELS = ("anywhere", "word", "sentence", "paragraph", "section")


def ends_sentence(text: str, start: int, end: int) -> bool:
    """Whether the stop at ``text[start:end]`` ends a sentence: full stops of abbreviations, initials, ordinal numbers and
    list numbers don't, nor does any before a lower-case letter."""
    if text[start] not in ".…":
        return True
    after = end
    while after < len(text) and text[after].isspace():
        after += 1
    follows = text[after : after + 1]
    if follows and (follows.islower() or follows in ",;:"):
        return False
    if text[start] == "…":
        return True
    m = WORD_BEFORE.search(text, max(0, start - 24), start)
    word = m.group(0).lower() if m else ""
    if word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()):
        return False
    if re.fullmatch(r"(?:\w\.)+\w", word):  # initials and short forms in one: J.R, z.B, p.m
        return False
    # One or two digits are an ordinal or a list number; years and amounts end sentences.
    return not re.fullmatch(r"[0-9]{1,2}|[ivxlc]{1,5}", word) or not follows


class Boundaries:
    """Where paragraphs, sentences and words of a text end, as numbers of its words; each level is only
    looked for once it is needed."""

    def __init__(self, text: str, words: list[str]):
        self.text, self.words = text, words
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        self.found: dict[int, np.ndarray] = {}

    def _line_ends(self) -> None:
        """Ends of sections, of paragraphs and of other lines: where white space with line breaks begins."""
        self.sections, self.paragraphs, self.lines, done, text = [], [], [], 0, self.text
        for m in BREAKS.finditer(text):
            if m.start() < done:
                continue
            a, b = m.start(), m.end()
            while a > done and text[a - 1].isspace():
                a -= 1
            while b < len(text) and text[b].isspace():
                b += 1
            done, gap = b, text[a:b]
            if a:
                breaks = len(ONE_BREAK.findall(gap))
                (self.sections if "\x0c" in gap or breaks > 2 else self.paragraphs if "\u2029" in gap or breaks > 1 else self.lines).append(a)

    def at(self, level: int) -> np.ndarray:
        """Sorted numbers of the words that end something of ``level`` (4 section, 3 paragraph, 2 sentence, 1 word) or more."""
        if level not in self.found:
            if level == 4:
                self._line_ends()
                places = self.sections
            elif level == 3:
                self.at(4)
                places = self.sections + self.paragraphs
            elif level == 2:
                self.at(3)
                places = self.sections + self.paragraphs + self.lines + [m.end() for m in STOP.finditer(self.text) if ends_sentence(self.text, m.start(), m.end())]
            else:
                before = np.array([w[0].isspace() for w in self.words[1:]], bool)
                places = np.concatenate([self.ends[:-1][before & ~np.array([w[-1].isspace() for w in self.words[:-1]], bool)], self.ends[self.at(2)]])
            at = np.unique(np.array(places, np.int64))
            k = np.searchsorted(self.ends, at)
            k = k[k < len(self.ends)]
            self.found[level] = k[self.ends[k] == at[: len(k)]]
        return self.found[level]


def pack(low: int, high: int, level: int, word_end: np.ndarray, found: Boundaries, whole=None) -> tuple[int, int]:
    """(stop, level) of a piece that has to end after token ``low`` and no later than ``high``.

    Units of ``level`` are taken as long as they end in time; if not one does, all of the span lies inside
    one unit, which is cut on the next level.  Level 0 cuts between characters.
    """
    if level == 0:
        k = int(np.searchsorted(word_end, high, "right")) - 1
        if k >= 0 and word_end[k] > low:
            return int(word_end[k]), 0  # between two parts the tokenizer's pattern tells apart
        return (high if whole is None else whole(low, high)), 0
    ends = word_end[found.at(level)]
    k = int(np.searchsorted(ends, high, "right")) - 1
    return (int(ends[k]), level) if k >= 0 and ends[k] > low else pack(low, high, level - 1, word_end, found, whole)


def cuts(total: int, word_end: np.ndarray, found: Boundaries, limit: int = LIMIT, overlap: int = OVERLAP, whole=None) -> list[tuple[int, int, int]]:
    """(first, stop, level) token ranges.  ``word_end``: tokens up to the end of each word.

    ``whole(low, high)`` may move a cut inside a word back to the end of a whole character.
    """
    out, at = [], 0
    while total - at > limit:
        stop, level = pack(at + overlap, at + limit, 4, word_end, found, whole)
        out.append((at, stop, level))
        at = stop - overlap
    out.append((at, total, 3))
    return out


def split_text(text: str, words: list[str], size: np.ndarray, ids: np.ndarray, token: list[bytes], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    if len(ids) <= limit:
        return []

    def whole(low: int, high: int) -> int:
        # The bytes of the whole text are those of its tokens; a character starts where no
        # continuation byte stands.
        for stop in range(high, max(low, high - 8), -1):
            if token[ids[stop]][0] & 0xC0 != 0x80:
                return stop
        return high

    return cuts(len(ids), np.cumsum(size), Boundaries(text, words), limit, overlap, whole)


_TOKENS: dict = {}


def _token_bytes(enc: Encoder) -> list[bytes]:
    if id(enc) not in _TOKENS:
        _TOKENS.clear()
        out = [b"\0"] * (max(enc.ranks.values()) + 1)
        for token, rank in enc.ranks.items():
            out[rank] = token
        _TOKENS[id(enc)] = out
    return _TOKENS[id(enc)]


def split_oversized(docs: DataFrame, key: str = "doc_id", column: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, directory: str = TOKENIZERS) -> DataFrame:
    """Pieces of the texts with more than ``limit`` tokens: (key, piece_no, first_token, stop_token, ends_at, ids).

    Pieces of a text are numbered from 0, hold ``limit`` tokens at most, cover all tokens, and each
    after the first starts with the last ``overlap`` tokens of the one before.  ``ends_at`` is what
    the piece ends at: section, paragraph, sentence, word or anywhere.  Texts up to the limit, null and
    empty ones give no row; repeated keys give each text's pieces; extra columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap has to be smaller than the limit")
    kind = docs.schema[key].dataType.simpleString()
    # A token has at least one byte: shorter texts can't be oversized and never leave the scan.
    docs = docs.select(F.col(key).alias("k"), F.col(column).alias("text")).where(F.octet_length("text") > limit)
    ranks, where = build_lexicon(docs, "text", directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(ranks, where)
        token = _token_bytes(enc)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                words, size, ids, ends = enc.encode(texts[a:b])
                rows, w, t = [], 0, 0
                for n in range(a, b):
                    ws, own = words[n - a], ids[t : ends[n - a]]
                    for no, (first, stop, level) in enumerate(split_text(texts[n], ws, size[w : w + len(ws)], own, token, limit, overlap)):
                        rows.append((keys[n], no, first, stop, LEVELS[level], own[first:stop]))
                    w, t = w + len(ws), int(ends[n - a])
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cols[0], batch.schema.field(0).type), *[pa.array(c, pa.int32()) for c in cols[1:4]], pa.array(cols[4], pa.string()),
                            pa.array(cols[5], pa.list_(pa.int32())),
                        ],
                        names=["k", "piece_no", "first_token", "stop_token", "ends_at", "ids"],
                    )

    schema = f"k {kind}, piece_no int, first_token int, stop_token int, ends_at string, ids array<int>"
    return docs.mapInArrow(run, schema).withColumnRenamed("k", key)


__all__ = ["split_oversized", "split_text", "cuts", "Boundaries", "parse_ranks"]
