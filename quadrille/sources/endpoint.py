"""SPARQL endpoints as source and sink, over plain HTTP."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import groupby
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.model import BNODE, IRI, LITERAL, QUAD, SCHEMA
from quadrille.model import quad_line


#: Rows handed on at a time.
AT_ONCE = 50_000


def http(url: str, fields: dict[str, str], accept: str) -> str:
    request = Request(url, urlencode(fields).encode(), {"Accept": accept, "Content-Type": "application/x-www-form-urlencoded"})
    with urlopen(request, timeout=600) as r:  # noqa: S310 - the user names the endpoint
        if r.status != 200:
            raise RuntimeError(f"the endpoint answered {r.status}")
        return r.read().decode("utf-8")


def bindings_to_rows(text: str) -> list[tuple]:
    """Quads of a SELECT result: variables are told by their first letter, s, p, o, anything else the graph."""
    out = []
    for b in json.loads(text)["results"]["bindings"]:
        got: dict = {}
        for name, v in b.items():
            got.setdefault(name[0] if name[0] in "spo" else "c", v)
        if not {"s", "p", "o"} <= set(got):
            continue
        term = lambda v: ("_:" + v["value"] if v["type"] == "bnode" else v["value"], {"uri": IRI, "bnode": BNODE}.get(v["type"], LITERAL))
        (s, sk), (p, pk), (o, ok) = (term(got[x]) for x in "spo")
        g, gk = term(got["c"]) if "c" in got else (None, None)
        if sk < LITERAL and pk == IRI and gk != LITERAL:
            out.append((s, sk, p, o, ok, got["o"].get("xml:lang"), got["o"].get("datatype"), g, gk))
    return out


def download(spark: SparkSession, url: str, query: str, fetch: Callable[[str, dict, str], str] = http, rewrite_bnodes: bool = False) -> DataFrame:
    """The result of a query as quads; CONSTRUCT and DESCRIBE give statements in the default graph.

    One task fetches and reads the answer, the driver never holds it.  ``rewrite_bnodes`` gives blank nodes
    names of their own for this endpoint and query.
    """
    from quadrille.sources.documents import _scoped
    from quadrille.sources.lines import parse_statements

    one, tag = spark.range(0, 1, 1, 1), sha256(f"{url} {query}".encode()).hexdigest()[:16]
    if query.lstrip().upper().startswith(("CONSTRUCT", "DESCRIBE")) or " CONSTRUCT" in query.upper():

        def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _ in batches:
                found = fetch(url, {"query": query}, "application/n-triples").splitlines()
                for a in range(0, len(found), AT_ONCE):
                    yield pd.DataFrame({"value": found[a : a + AT_ONCE]})

        return parse_statements(one.mapInPandas(lines, "value string"), file=F.lit(tag) if rewrite_bnodes else None)

    def bindings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            rows = bindings_to_rows(fetch(url, {"query": query}, "application/sparql-results+json"))
            rows = [_scoped(r, tag) for r in rows] if rewrite_bnodes else rows
            for a in range(0, len(rows), AT_ONCE):
                yield pd.DataFrame(rows[a : a + AT_ONCE], columns=QUAD)

    return one.mapInPandas(bindings, SCHEMA)


def insert_texts(rows: list[tuple[str | None, str, str, str]]) -> str:
    """One INSERT DATA for rows (graph, subject, predicate, object) already in term syntax."""
    out = []
    for g, own in groupby(sorted(rows, key=lambda r: (r[0] or "", r[1], r[2], r[3])), lambda r: r[0]):
        subjects = []
        for s, of_s in groupby(own, lambda r: r[1]):
            props = [f"{p} {', '.join(r[3] for r in of_p)}" for p, of_p in groupby(of_s, lambda r: r[2])]
            subjects.append(f"{s} {' ; '.join(props)} .")
        body = " ".join(subjects)
        out.append(f"GRAPH {g} {{ {body} }}" if g else body)
    return "INSERT DATA { " + " ".join(out) + " }"


def upload(df: DataFrame, url: str, size: int = 1024, send: Callable[[str, dict, str], str] = http) -> int:
    """Insert statements in chunks of ``size``, each partition on its own; returns the number sent."""
    from quadrille.model import format_term

    rows = df.select(
        F.when(F.col("g").isNotNull(), format_term(F.col("g"), F.col("g_kind"))).alias("g"), format_term(F.col("s"), F.col("s_kind")).alias("s"),
        F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("p"), format_term(F.col("o"), F.col("o_kind"), F.col("o_lang"), F.col("o_dt")).alias("o"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [tuple(None if pd.isna(x) else x for x in r) for r in pdf.itertuples(index=False)]
            for a in range(0, len(own), size):
                send(url, {"update": insert_texts(own[a : a + size])}, "*/*")
            yield pd.DataFrame({"n": [len(own)]})

    return int(rows.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0)


__all__ = ["download", "upload", "bindings_to_rows", "insert_texts", "quad_line"]
