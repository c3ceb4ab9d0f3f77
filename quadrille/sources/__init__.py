"""Reading and writing quads: formats are told by file extensions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quadrille.model import NAMESPACES, bag_union
from quadrille.sources.documents import PARSERS, format_of, read_documents, read_packed_lines
from quadrille.sources.lines import read_lines, write_lines

#: Compressions that are written, by extension.
CODECS = {"gz": "gzip", "bz2": "bzip2"}
LINE_FORMATS = ("nt", "nq", "tql")


def base_iri(text: str) -> str:
    """An option value to an IRI: a prefix alone (with or without ':') or a short name is expanded."""
    prefix, _, local = text.partition(":")
    return NAMESPACES[prefix] + local if prefix in NAMESPACES else text


def read_quads(spark: SparkSession, *locations: str, base: str = "", rewrite_bnodes: bool = False) -> DataFrame:
    """Read locations of any supported formats; ``.ext:path`` overrides the extension; duplicates stay."""
    lines, parts = [], []
    for where in locations:
        form = None
        if m := re.fullmatch(r"\.([\w.]+):(.*)", where):
            form, where = m[1].split(".")[0], m[2]
        found, codecs = format_of(where)
        if (form or found) in LINE_FORMATS and not set(codecs) - {"gz", "bz2"}:
            lines.append(where)
        elif (form or found) in LINE_FORMATS:
            parts.append(read_packed_lines(spark, where, rewrite_bnodes=rewrite_bnodes))
        else:
            # Files in a directory that was written here have no extension of their own.
            parts.append(read_documents(spark, where, form=form or (found if found in PARSERS else None), base=base_iri(base), rewrite_bnodes=rewrite_bnodes))
    if lines:
        parts.append(read_lines(spark, *lines, rewrite_bnodes=rewrite_bnodes))
    if not parts:
        raise ValueError("nothing to read")
    return bag_union(*parts)


def write_quads(df: DataFrame, *locations: str, chunk: int = 1, prefixes: dict[str, str] | None = None) -> None:
    """Write to one or more locations; several get the statements in turn, a chunk at a time.

    ``prefixes`` (name to namespace) shorten the terms of Turtle and TriG.  What can't be compressed as named is an error.
    """
    from pyspark.sql import functions as F

    from quadrille.sources.writers import write_documents

    n = len(locations)
    if n > 1:
        slot = F.floor(F.monotonically_increasing_id() / chunk) % n
        df = df.withColumn("slot", slot)
    for i, where in enumerate(locations):
        part = df.where(F.col("slot") == i) if n > 1 else df
        form, codecs = format_of(where)
        if len(codecs) > 1 or set(codecs) - set(CODECS):
            raise ValueError(f"can't write {where}: of compressions {', '.join(CODECS)} can be written, one at a time")
        codec = CODECS[codecs[0]] if codecs else None
        if form in LINE_FORMATS:
            write_lines(part, where, codec)
        else:
            write_documents(part, where, form, compression=codec, prefixes=prefixes)
