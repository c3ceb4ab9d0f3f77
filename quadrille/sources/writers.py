"""Writing document formats: statements are brought together by subject, each part file is a document."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, groupby, islice
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

from quadrille.model import LITERAL, NAMESPACES, QUAD

RDF = NAMESPACES["rdf"]


def _text(v: str) -> str:
    return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007F")


def _iri(v: str) -> str:
    return "<" + "".join(f"\\u{ord(c):04X}" if c in '<>"{}|^`\\' or c <= " " else c for c in v) + ">"


def _name(v: str, prefixes: dict[str, str]) -> str:
    """A prefixed name where the namespace is known and the rest is plain, else the IRI."""
    cut = max(v.rfind("#"), v.rfind("/"), v.rfind(":")) + 1
    short = prefixes.get(v[:cut])
    return f"{short}:{v[cut:]}" if short is not None and re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", v[cut:]) else _iri(v)


def _node(v: str, kind: int, lang=None, dt=None) -> str:
    if kind == LITERAL:
        return _text(v) + (f"@{lang}" if lang else f"^^{_iri(dt)}" if dt else "")
    return v if kind == 1 else _iri(v)


def _clean(r):
    return [None if pd.isna(x) else x for x in r]


def turtle(rows: list, graphs: bool, prefixes: dict[str, str] | None = None) -> Iterator[str]:
    known = {ns: name for name, ns in sorted((prefixes or {}).items(), reverse=True)}
    node = lambda v, kind, lang=None, dt=None: _name(v, known) if kind == 0 else _text(v) + f"^^{_name(dt, known)}" if kind == LITERAL and dt and not lang else _node(v, kind, lang, dt)
    yield from (f"@prefix {name}: {_iri(ns)} ." for ns, name in known.items())
    for (g, gk), in_graph in groupby(rows, lambda r: (r[7], r[8])):
        if graphs and g is not None:
            yield node(g, gk) + " {"
        for (s, sk), own in groupby(in_graph, lambda r: (r[0], r[1])):
            lines = [f"{'a' if r[2] == RDF + 'type' else _name(r[2], known)} {node(*r[3:7])}" for r in own]
            yield f"{node(s, sk)} " + " ;\n    ".join(lines) + " ."
        if graphs and g is not None:
            yield "}"


def rdf_xml(rows: list) -> Iterator[str]:
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">'
    for (s, sk), own in groupby(rows, lambda r: (r[0], r[1])):
        yield "<rdf:Description " + (f"rdf:nodeID={quoteattr(s[2:])}" if sk == 1 else f"rdf:about={quoteattr(s)}") + ">"
        for _, _, p, o, ok, lang, dt, *_ in own:
            cut = max(p.rfind("#"), p.rfind("/"), p.rfind(":")) + 1
            tag = f"ns:{p[cut:]} xmlns:ns={quoteattr(p[:cut])}"
            if ok == LITERAL:
                extra = f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(dt)}" if dt else ""
                yield f"  <{tag}{extra}>{escape(o)}</ns:{p[cut:]}>"
            else:
                yield f"  <{tag} " + (f"rdf:nodeID={quoteattr(o[2:])}" if ok == 1 else f"rdf:resource={quoteattr(o)}") + "/>"
        yield "</rdf:Description>"
    yield "</rdf:RDF>"


def rdf_json(rows: list) -> Iterator[str]:
    out: dict = {}
    for s, _, p, o, ok, lang, dt, *_ in rows:
        v = {"value": o, "type": ("uri", "bnode", "literal")[ok]}
        if lang:
            v["lang"] = lang
        if dt:
            v["datatype"] = dt
        out.setdefault(s, {}).setdefault(p, []).append(v)
    yield json.dumps(out, ensure_ascii=False)


def json_ld(rows: list) -> Iterator[str]:
    def obj(r):
        if r[4] != LITERAL:
            return {"@id": r[3]}
        return {"@value": r[3], **({"@language": r[5]} if r[5] else {"@type": r[6]} if r[6] else {})}

    graphs = []
    for (g, _), in_graph in groupby(rows, lambda r: (r[7], r[8])):
        nodes = []
        for (s, _), own in groupby(in_graph, lambda r: (r[0], r[1])):
            node: dict = {"@id": s}
            for r in own:
                if r[2] == RDF + "type" and r[4] != LITERAL:
                    node.setdefault("@type", []).append(r[3])
                else:
                    node.setdefault(r[2], []).append(obj(r))
            nodes.append(node)
        graphs += nodes if g is None else [{"@id": g, "@graph": nodes}]
    yield json.dumps({"@graph": graphs}, ensure_ascii=False)


def trix(rows: list) -> Iterator[str]:
    def term(v, kind, lang=None, dt=None):
        if kind == LITERAL:
            return f"<typedLiteral datatype={quoteattr(dt)}>{escape(v)}</typedLiteral>" if dt else f"<plainLiteral{f' xml:lang={quoteattr(lang)}' if lang else ''}>{escape(v)}</plainLiteral>"
        return f"<id>{escape(v[2:])}</id>" if kind == 1 else f"<uri>{escape(v)}</uri>"

    yield '<?xml version="1.0" encoding="UTF-8"?>\n<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">'
    for (g, gk), own in groupby(rows, lambda r: (r[7], r[8])):
        yield "<graph>" + (term(g, gk) if g is not None else "")
        for r in own:
            yield f"  <triple>{term(r[0], r[1])}{term(r[2], 0)}{term(*r[3:7])}</triple>"
        yield "</graph>"
    yield "</TriX>"


FORMATS = {
    "ttl": lambda r: turtle(r, False), "n3": lambda r: turtle(r, False), "trig": lambda r: turtle(r, True), "rdf": rdf_xml, "xml": rdf_xml, "owl": rdf_xml, "rj": rdf_json, "jsonld": json_ld, "trix": trix,
}


def render(rows: list, form: str) -> str:
    """One document; rows have to be sorted by graph and subject."""
    return "\n".join(FORMATS[form](rows))


def write_documents(df: DataFrame, path: str, form: str, lines_at_once: int = 10_000, compression: str | None = None, prefixes: dict[str, str] | None = None) -> None:
    """A directory of documents, one per part.

    Parts are ranges of (graph, subject, predicate, object), so even a subject with very many
    statements is spread over parts; within a part statements stream through the renderer.
    """
    if form not in FORMATS:
        raise ValueError(f"can't write .{form}")
    order = ["g", "g_kind", "s", "s_kind", "p", "o"]
    out = df.select(*QUAD).repartitionByRange("g", "s", "p", "o").sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (_clean(r) for pdf in batches for r in pdf.itertuples(index=False))
        first = next(rows, None)
        if first is None:
            return
        rows = chain([first], rows)
        lines = turtle(rows, form == "trig", prefixes) if prefixes and form in ("ttl", "n3", "trig") else FORMATS[form](rows)
        while block := list(islice(lines, lines_at_once)):
            yield pd.DataFrame({"value": block})

    out.mapInPandas(run, "value string").write.text(path, compression=compression or "none")
