"""Scripted transforms: a Python snippet per statement, run on Arrow batches.

The snippet sees ``q s p o c t l d`` (statement, its components, rdf:type object, language, datatype) and
emits with ``emit()``, ``emit_if(cond)``, ``emit_if_not(cond)``, ``emit(s, p, o, c)``; ``error(m)`` stops
the job and ``log(m)`` writes to the worker's log.  ``<iri>`` and ``prefix:name`` in the source are constants.
A script that defines functions may have ``init(args)``, ``start()``, ``handle()`` and ``end()``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.model import BNODE, FULL, IRI, LITERAL, NAMESPACES, QUAD, SCHEMA, Vocabulary, as_quads

_STRING = r"(\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\#[^\n]*)"


class Term(str):
    """An IRI or blank node."""


class Literal(str):
    lang: str | None = None
    dt: str | None = None


def literal(text, lang: str | None = None, dt: str | None = None) -> Literal:
    out = Literal(text)
    out.lang, out.dt = lang, dt
    return out


def with_constants(source: str, vocab: Vocabulary = FULL, prefixes: dict[str, str] | None = None) -> str:
    """Replace ``<iri>`` and ``prefix:name`` outside strings by term constants."""
    known = {**NAMESPACES, **(prefixes or {})}

    def one(m: re.Match) -> str:
        if m[1]:
            return m[0]
        if m[2]:
            return f"Term({m[2][1:-1]!r})"
        prefix, _, local = m[3].partition(":")
        if prefix not in known:
            return m[0]
        name = m[3] if vocab.short and prefix in NAMESPACES else known[prefix] + local
        return f"Term({name!r})"

    return re.sub(_STRING + r"|(<[a-z][\w+.-]*:[^<>\s]*>)|(?<![\w.:])([A-Za-z][\w-]*:[A-Za-z_][\w-]*)", one, source, flags=re.S)


class Script:
    """The running snippet: one per task."""

    def __init__(self, source: str, args: tuple = (), vocab: Vocabulary = FULL, prefixes: dict[str, str] | None = None):
        self.out: list[tuple] = []
        self.type = vocab("rdf:type")
        self.env: dict = {
            "Term": Term, "literal": literal, "emit": self.emit, "emit_if": lambda c: self.emit() if c else None, "emit_if_not": lambda c: None if c else self.emit(),
            "error": self.error, "log": lambda m: print(m, file=sys.stderr), "quad": lambda s, p, o, c=None: (s, p, o, c), "args": args,
        }
        code = compile(with_constants(source, vocab, prefixes), "<script>", "exec")
        self.functions = bool(re.search(r"^def (handle|init|start|end)\b", source, re.M))
        if self.functions:
            exec(code, self.env)  # noqa: S102 - running the user's script is the feature
        self.code = code
        self.call("init", args)

    def call(self, name: str, *a) -> None:
        if self.functions and callable(self.env.get(name)):
            self.env[name](*a)

    def error(self, message, cause=None):
        raise RuntimeError(message) from cause

    def emit(self, *terms) -> None:
        """The current (possibly changed) statement, a quad, or components; invalid ones are left out."""
        e = self.env
        if len(terms) == 1 and isinstance(terms[0], tuple):
            terms = terms[0]
        s, p, o, c = (*terms, *[None] * (4 - len(terms))) if terms else (e["s"], e["p"], e["o"], e["c"])
        if not terms:
            if e["t"] is not None and e["t"] is not self.current_type:
                p, o = Term(self.type), e["t"]
            elif isinstance(o, str) and not isinstance(o, (Term, Literal)):
                o = literal(o, e["l"], e["d"])
        if s is None or p is None or o is None or isinstance(s, Literal) or isinstance(p, Literal) or p.startswith("_:") or isinstance(c, Literal):
            return
        kind = lambda t: BNODE if t.startswith("_:") else IRI
        if isinstance(o, Term):
            obj = (str(o), kind(o), None, None)
        else:
            obj = (str(o), LITERAL, getattr(o, "lang", None), getattr(o, "dt", None))
        self.out.append((str(s), kind(s), str(p), *obj, None if c is None else str(c), None if c is None else kind(c)))

    def handle(self, r) -> None:
        o = Term(r.o) if r.o_kind != LITERAL else literal(r.o, r.o_lang, r.o_dt)
        t = o if r.p == self.type and isinstance(o, Term) else None
        self.current_type = t
        g = None if r.g is None else Term(r.g)
        self.env.update(s=Term(r.s), p=Term(r.p), o=o, c=g, t=t, l=r.o_lang, d=r.o_dt, q=(Term(r.s), Term(r.p), o, g))
        if self.functions:
            self.env["handle"]()
        else:
            exec(self.code, self.env)  # noqa: S102

    def drain(self) -> pd.DataFrame:
        out, self.out = self.out, []
        return pd.DataFrame(out, columns=QUAD)


def script(df: DataFrame, source: str, args: tuple = (), pooled: bool = True, vocab: Vocabulary = FULL, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Run a snippet on every statement.  ``pooled`` scripts keep their state per task and run in
    parallel; others see all statements in one task, which only suits small data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live = Script(source, args, vocab, prefixes)
        live.call("start")
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for r in pdf.itertuples(index=False):
                live.handle(r)
            yield live.drain()
        live.call("end")
        yield live.drain()

    df = as_quads(df)
    return (df if pooled else df.coalesce(1)).mapInPandas(run, SCHEMA)


def load_set(df: DataFrame, components: str = "spoc") -> DataFrame:
    """(value, kind, lang, dt) - the distinct terms in the components of a file's statements."""
    col = {
        "s": F.struct(F.col("s").alias("value"), F.col("s_kind").alias("kind"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("dt")),
        "p": F.struct(F.col("p").alias("value"), F.lit(0).cast("tinyint").alias("kind"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("dt")),
        "o": F.struct(F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_lang").alias("lang"), F.col("o_dt").alias("dt")),
        "c": F.struct(F.col("g").alias("value"), F.col("g_kind").alias("kind"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("dt")),
    }
    return df.select(F.explode(F.array(*[col[c] for c in components])).alias("x")).select("x.*").where("value IS NOT NULL").distinct()


def match_set(df: DataFrame, values: DataFrame, components: str = "spo", bound: int = 500_000) -> DataFrame:
    """Statements with at least one of the components in a value set.

    The set is broadcast up to ``bound`` values and joined by shuffling beyond; components are
    probed one after another, each only for statements no earlier one let through.
    """
    few = values.limit(bound + 1).count() <= bound
    out, rest = None, as_quads(df)
    for c in components:
        name = {"s": "s", "p": "p", "o": "o", "c": "g"}[c]
        kind = F.lit(0) if c == "p" else F.col(f"{name}_kind")
        v = values.select(*[F.col(x).alias(f"v_{x}") for x in ("value", "kind", "lang", "dt")])
        v = F.broadcast(v) if few else v
        on = (F.col(name) == F.col("v_value")) & (kind == F.col("v_kind"))
        on = on & (F.col("o_lang").eqNullSafe(F.col("v_lang")) & F.col("o_dt").eqNullSafe(F.col("v_dt")) if c == "o" else F.col("v_lang").isNull())
        hit = rest.join(v, on, "left_semi")
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(v, on, "left_anti")
    return out
