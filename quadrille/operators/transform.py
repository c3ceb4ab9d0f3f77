"""Filtering and rewriting statements: the ``+X -X =X`` mini-language as Catalyst expressions.

``+so a b`` keeps statements whose s and o are among the values, ``-X`` drops them, ``=X v`` replaces;
X is any of ``spoc``.  Filters look at the old values, replacements come after.  Since rules compile to
columns, they reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.model import BNODE, FULL, IRI, LITERAL, NAMESPACES, NIL, QUAD, SCHEMA, Vocabulary, as_quads, bag_union, nothing, valid

COLUMN = {"s": "s", "p": "p", "o": "o", "c": "g"}


class Term:
    """A constant term: value, kind, language, datatype."""

    def __init__(self, value: str, kind: int, lang: str | None = None, dt: str | None = None):
        self.value, self.kind, self.lang, self.dt = value, kind, lang, dt

    def __eq__(self, other) -> bool:
        return isinstance(other, Term) and vars(self) == vars(other)

    def __hash__(self) -> int:
        return hash((self.value, self.kind, self.lang, self.dt))

    def __repr__(self) -> str:
        return f"Term{(self.value, self.kind, self.lang, self.dt)}"


def expand(name: str, prefixes: dict[str, str] | None = None, vocab: Vocabulary = FULL) -> str:
    prefix, sep, local = name.partition(":")
    known = {**NAMESPACES, **(prefixes or {})}
    if not sep or prefix not in known:
        raise ValueError(f"unknown prefix in {name!r}")
    if vocab.short and prefix in NAMESPACES and prefix not in (prefixes or {}):
        return name
    return known[prefix] + local


def parse_term(text: str, prefixes: dict[str, str] | None = None, vocab: Vocabulary = FULL) -> Term:
    """``<iri>``, ``p:name``, ``_:id``, ``"v"``, ``"v"@en``, ``"v"^^<dt>`` or ``"v"^^p:name``."""
    if text.startswith("<") and text.endswith(">"):
        return Term(text[1:-1], IRI)
    if text.startswith("_:"):
        return Term(text, BNODE)
    if text[:1] in "\"'":
        label, _, tail = text[1:].rpartition(text[0])
        if tail.startswith("@"):
            return Term(label, LITERAL, lang=tail[1:])
        if tail.startswith("^^"):
            return Term(label, LITERAL, dt=parse_term(tail[2:], prefixes, vocab).value)
        return Term(label, LITERAL)
    return Term(expand(text, prefixes, vocab), IRI)


class Place:
    """The columns of one component."""

    def __init__(self, letter: str, nil: str = NIL):
        name = COLUMN[letter]
        self.letter, self.nil = letter, nil
        self.value = F.col(name)
        self.kind = F.lit(IRI) if letter == "p" else F.col(f"{name}_kind")
        if letter == "c":  # the default graph goes by the name sesame:nil
            self.value, self.kind = F.coalesce(self.value, F.lit(nil)), F.coalesce(self.kind, F.lit(IRI))
        self.lang = F.col("o_lang") if letter == "o" else F.lit(None).cast("string")
        self.dt = F.col("o_dt") if letter == "o" else F.lit(None).cast("string")


def _matches(place: Place, pattern: str, prefixes: dict[str, str] | None, vocab: Vocabulary) -> Column:
    string = vocab("xsd:string")
    literal = place.kind == LITERAL
    if pattern == "<*>":
        return place.kind == IRI
    if pattern == "_:*":
        return place.kind == BNODE
    if pattern == "*":  # plain or xsd:string
        return literal & place.lang.isNull() & (place.dt.isNull() | (place.dt == string))
    if pattern == "*@*":
        return literal & place.lang.isNotNull()
    if pattern.startswith("*@"):
        return literal & place.lang.eqNullSafe(pattern[2:])
    if pattern == "*^^*":
        return literal & place.dt.isNotNull()
    if pattern.startswith("*^^"):
        dt = pattern[3:]
        if dt.endswith(":*"):
            return literal & F.coalesce(place.dt.startswith(expand(dt[:-1], prefixes, vocab)), F.lit(False))
        return literal & place.dt.eqNullSafe(parse_term(dt, prefixes, vocab).value)
    if pattern.startswith("<") and pattern.endswith("*>"):
        return (place.kind == IRI) & place.value.startswith(pattern[1:-2])
    if re.fullmatch(r"[^\"'<_][^\"']*:\*", pattern):
        return (place.kind == IRI) & place.value.startswith(expand(pattern[:-1], prefixes, vocab))
    t = parse_term(pattern, prefixes, vocab)
    same = (place.value == t.value) & (place.kind == t.kind)
    return same & place.lang.eqNullSafe(t.lang) & place.dt.eqNullSafe(t.dt) if t.kind == LITERAL else same


def any_of(letter: str, patterns: Sequence[str], prefixes: dict[str, str] | None = None, vocab: Vocabulary = FULL) -> Column:
    place = Place(letter, vocab("sesame:nil"))
    return reduce(lambda a, b: a | b, [_matches(place, p, prefixes, vocab) for p in patterns])


def _clauses(spec: str) -> list[tuple[str, str, list[str]]]:
    out: list[tuple[str, str, list[str]]] = []
    for word in spec.split():
        if re.fullmatch(r"[+=-][spoc]+", word):
            out.append((word[0], word[1:], []))
        elif not out:
            raise ValueError(f"a rule has to start with a selector: {spec!r}")
        else:
            out[-1][2].append(word)
    return out


def predicate(spec: str, prefixes: dict[str, str] | None = None, vocab: Vocabulary = FULL, replaces: bool = False) -> Column:
    """The filter of a spec.  ``+X`` and ``-X`` on one component exclude each other; a selector without values does nothing."""
    cond, signs = F.lit(True), {}
    for sign, letters, values in _clauses(spec):
        if sign == "=":
            if not replaces:
                raise ValueError("a predicate can't replace")
            continue
        if not values:
            warnings.warn(f"selector {sign}{letters} without values has no effect", stacklevel=2)
            continue
        for letter in letters:
            if signs.setdefault(letter, sign) != sign:
                raise ValueError(f"both + and - for {letter}")
            hit = any_of(letter, values, prefixes, vocab)
            cond = cond & (hit if sign == "+" else ~hit)
    return cond


def assign(df: DataFrame, letter: str, term: Term, nil: str = NIL) -> DataFrame:
    """Replace one component by a constant; an impossible kind leaves no statement."""
    if term.kind == LITERAL and letter != "o" or letter == "p" and term.kind != IRI:
        return nothing(df)
    if letter == "p":
        return df.withColumn("p", F.lit(term.value))
    default = letter == "c" and term.value == nil
    new = {COLUMN[letter]: F.lit(None if default else term.value).cast("string"), f"{COLUMN[letter]}_kind": F.lit(None if default else term.kind).cast("tinyint")}
    if letter == "o":
        new |= {"o_lang": F.lit(term.lang).cast("string"), "o_dt": F.lit(term.dt).cast("string")}
    return df.withColumns(new)


def transform(df: DataFrame, spec: str, prefixes: dict[str, str] | None = None, vocab: Vocabulary = FULL) -> DataFrame:
    """Filter by old values, then replace; the last ``=`` value of a component wins.

    Null components match nothing but keep their row under ``-``; other columns are dropped.
    """
    if spec.startswith("py:"):
        from quadrille.operators.script import script

        return script(df, spec[3:])
    out = as_quads(df).where(predicate(spec, prefixes, vocab, replaces=True))
    for sign, letters, values in _clauses(spec):
        if sign == "=" and values:
            for letter in letters:
                out = assign(out, letter, parse_term(values[-1], prefixes, vocab), vocab("sesame:nil"))
    return out


# -- programmatic forms ---------------------------------------------------------------------------


def keep(df: DataFrame, cond: Column) -> DataFrame:
    return as_quads(df).where(cond)


def keep_components(df: DataFrame, letters: str, cond: Callable[[Place], Column]) -> DataFrame:
    """Statements all of whose chosen components satisfy ``cond``."""
    return keep(df, reduce(lambda a, b: a & b, [cond(Place(x)) for x in letters]))


def map_components(df: DataFrame, letters: str, function: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Apply a vectorised function to the text of components; a null result drops the statement."""
    udf = F.pandas_udf(function, "string")
    out = as_quads(df).withColumns({COLUMN[x]: udf(COLUMN[x]) for x in letters})
    return valid(out.where(reduce(lambda a, b: a & b, [F.col(COLUMN[x]).isNotNull() | (F.lit(x == "c") & F.col("g_kind").isNull()) for x in letters])))


def map_rows(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Batches of statements to batches of statements; ill-typed ones are dropped."""
    return valid(as_quads(df).mapInPandas(lambda batches: (function(b)[QUAD] for b in batches), SCHEMA))


def set_components(df: DataFrame, letters: str, *terms: Term) -> DataFrame:
    """Assign constants in order; the last one repeats."""
    out = as_quads(df)
    for i, letter in enumerate(letters):
        out = assign(out, letter, terms[min(i, len(terms) - 1)])
    return out


def in_sequence(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return (lambda df: reduce(lambda d, f: f(d), steps, df)) if steps else nothing


def in_parallel(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: bag_union(*[f(df) for f in steps]) if steps else nothing(df)


# -- many patterns at once ------------------------------------------------------------------------


def match_patterns(df: DataFrame, patterns: Sequence[tuple[str | None, str | None, str | None, str | None, str]], statement_id: Sequence[str] = QUAD) -> DataFrame:
    """Statements with the values of every (s, p, o, c, value) pattern they match; null is a wildcard.

    Patterns are grouped by which components they fix (at most 16 shapes); each shape is one hash
    join with its patterns, so the cost doesn't grow with their number.  Statements without a match are left out.
    """
    spark, parts = df.sparkSession, []
    shapes: dict[str, list[tuple]] = {}
    for row in patterns:
        shapes.setdefault("".join(c for c, v in zip("spoc", row) if v is not None), []).append(row)
    for shape, rows in shapes.items():
        cols = ["spoc".index(c) for c in shape]
        if not cols:
            parts += [as_quads(df).withColumn("value", F.lit(r[4])) for r in rows]
            continue
        table = spark.createDataFrame([(*[r[i] for i in cols], r[4]) for r in rows], ", ".join([*(f"m_{COLUMN[c]} string" for c in shape), "value string"]))
        on = reduce(lambda a, b: a & b, [F.col(COLUMN[c]) == F.col(f"m_{COLUMN[c]}") for c in shape])
        parts.append(as_quads(df).join(F.broadcast(table) if len(rows) <= 100_000 else table, on).select(*QUAD, "value"))
    if not parts:
        return as_quads(df).withColumn("value", F.lit(None).cast("string")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts).distinct()


def template(df: DataFrame, s: str, p: str, o: str, c: str = "=c") -> DataFrame:
    """Head statements from body statements: ``=x`` copies component x, anything else is a constant term.

    Ill-typed results are dropped.
    """
    old = {x: Place(x) for x in "spo"} | {"c": None}
    cols: dict[str, Column] = {}
    for letter, spec in zip("spoc", (s, p, o, c)):
        name = COLUMN[letter]
        if spec.startswith("="):
            x = spec[1]
            value, kind = (F.col("g"), F.col("g_kind")) if x == "c" else (old[x].value, old[x].kind)
            lang, dt = (F.col("o_lang"), F.col("o_dt")) if x == "o" else (F.lit(None), F.lit(None))
        else:
            t = parse_term(spec)
            value, kind, lang, dt = F.lit(t.value), F.lit(t.kind), F.lit(t.lang), F.lit(t.dt)
        cols[name] = value.cast("string")
        cols["p_kind" if letter == "p" else f"{name}_kind"] = kind.cast("tinyint")
        if letter == "o":
            cols |= {"o_lang": lang.cast("string"), "o_dt": dt.cast("string")}
    out = df.select(*[v.alias(k) for k, v in cols.items()])
    return as_quads(valid(out.where(F.col("p_kind") == IRI)))
