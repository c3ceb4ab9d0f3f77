"""Terms as single strings: what joins, rules and queries compare.

An IRI is itself, a blank node starts with ``_:``, a literal is ``"label"`` followed by ``@lang`` or
``^^datatype``.  Equal strings are equal terms, so every join key is one plain string column.
The default graph is the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.model import BNODE, IRI, LITERAL, QUAD

TERM_LITERAL = r'(?s)^"(.*)"(?:@([^"]*)|\^\^([^"]*))?\z'


def encode_object() -> Column:
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^"), F.col("o_dt"))).otherwise("")
    return F.when(F.col("o_kind") == LITERAL, F.concat(F.lit('"'), F.col("o"), F.lit('"'), tail)).otherwise(F.col("o"))


def encode(df: DataFrame) -> DataFrame:
    """Quads to (s, p, o, g) strings."""
    return df.select("s", "p", encode_object().alias("o"), F.coalesce("g", F.lit("")).alias("g"))


def kind_of(term: Column) -> Column:
    return F.when(term.startswith('"'), LITERAL).when(term.startswith("_:"), BNODE).otherwise(IRI).cast("tinyint")


def decode(df: DataFrame) -> DataFrame:
    """(s, p, o, g) strings to quads; statements with a literal subject or non-IRI predicate are dropped."""
    o, lit = F.col("o"), F.col("o").startswith('"')
    part = lambda n: F.regexp_extract(o, TERM_LITERAL, n)
    some = lambda c: F.when(c != "", c)
    ok = ~F.col("s").startswith('"') & (kind_of(F.col("p")) == IRI) & ~F.col("g").startswith('"')
    return df.where(ok).select(
        "s", kind_of(F.col("s")).alias("s_kind"), "p", F.when(lit, part(1)).otherwise(o).alias("o"), kind_of(o).alias("o_kind"), F.when(lit, some(part(2))).alias("o_lang"),
        F.when(lit, some(part(3))).alias("o_dt"), some(F.col("g")).alias("g"), F.when(F.col("g") != "", kind_of(F.col("g"))).cast("tinyint").alias("g_kind"),
    ).select(*QUAD)
