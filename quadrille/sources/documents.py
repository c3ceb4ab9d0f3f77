"""Document formats that can't be cut at line ends: Turtle, TriG, N3, RDF/XML, RDF/JSON, JSON-LD, TriX, GeoNames.

Each file is parsed whole by one task (they have no safe split points); many files are parsed in
parallel, so keep single files moderate.  Parsers are small, self-contained and yield rows of ``model.QUAD``.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import re
import zipfile
from collections.abc import Callable, Iterator
from hashlib import sha256
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F

from quadrille.model import BNODE, IRI, LITERAL, NAMESPACES, NIL, QUAD

RDF, XSD, XML = NAMESPACES["rdf"], NAMESPACES["xsd"], "{http://www.w3.org/XML/1998/namespace}"
Row = tuple


def row(s: str, p: str, o: str, g: str | None = None, literal: bool = False, lang: str | None = None, dt: str | None = None) -> Row:
    kind = lambda t: BNODE if t.startswith("_:") else IRI
    g = None if g == NIL else g
    return (s, kind(s), p, o, LITERAL if literal else kind(o), lang.lower() if lang else None, dt, g, None if g is None else kind(g))


# -- Turtle, TriG, N3 -----------------------------------------------------------------------------

_TTL = re.compile(
    r"""(?:\s|\#[^\n]*)*(?:
    (?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\.)*>) | (?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''') | (?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*') |
    (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*) | (?P<dt>\^\^) | (?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)) | (?P<bnode>_:[\w·](?:[\w·.-]*[\w·-])?) |
    (?P<name>[^\W\d_]?[\w.-]*:(?:(?:[\w:%-]|\\.)(?:(?:[\w:.%-]|\\.)*(?:[\w:%-]|\\.))?)?) | (?P<word>[A-Za-z]\w*) | (?P<op>[\[\](){}.,;=]) | (?P<end>\Z))""",
    re.X,
)
_ESC = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_NAMED = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _plain(t: str) -> str:
    return _ESC.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _NAMED.get(m[1], m[1]), t) if "\\" in t else t


class Turtle:
    def __init__(self, text: str, base: str = ""):
        self.text, self.at, self.base, self.prefixes, self.rows, self.graph, self.n = text, 0, base, {}, [], None, 0
        self.advance()

    def advance(self) -> None:
        m = _TTL.match(self.text, self.at)
        if not m:
            raise ValueError(f"can't read {self.text[self.at : self.at + 40]!r}")
        self.kind, self.value, self.at = m.lastgroup, m[m.lastgroup], m.end()

    def eat(self, value: str) -> bool:
        if self.kind in ("op", "word", "dt") and self.value.lower() == value:
            self.advance()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.eat(value):
            raise ValueError(f"expected {value!r}, found {self.value!r}")

    def fresh(self) -> str:
        self.n += 1
        return f"_:gen{self.n}"

    def emit(self, s, p, o) -> None:
        self.rows.append(row(s, p, o[0], self.graph, *o[1:]))

    def parse(self) -> list[Row]:
        while self.kind != "end":
            low = self.value.lower()
            if low in ("@prefix", "prefix", "@base", "base") and self.kind in ("lang", "word"):
                dotted = self.value.startswith("@")
                self.advance()
                if low.endswith("prefix"):
                    name = self.value[:-1]
                    self.advance()
                    self.prefixes[name] = self.iri()
                else:
                    self.base = self.iri()
                if dotted:
                    self.need(".")
            elif self.eat("graph"):
                self.block(self.node()[0])
            elif self.kind == "op" and self.value == "{":
                self.block(None)
            else:
                start = self.node(alone=True)
                if self.kind == "op" and self.value == "{":
                    self.block(start[0])
                else:
                    if not (self.kind == "op" and self.value == "."):
                        self.properties(start[0])
                    self.need(".")
        return self.rows

    def block(self, graph: str | None) -> None:
        self.need("{")
        old, self.graph = self.graph, graph
        while not self.eat("}"):
            s = self.node(alone=True)[0]
            if not (self.kind == "op" and self.value in ".}"):
                self.properties(s)
            if not self.eat("."):
                self.need("}")
                break
        self.graph = old
        self.eat(".")

    def properties(self, s: str) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                self.advance()
                p = RDF + "type"
            elif self.eat("="):
                p = NAMESPACES["owl"] + "sameAs"
            else:
                p = self.iri()
            while True:
                self.emit(s, p, self.node())
                if not self.eat(","):
                    break
            more = False
            while self.eat(";"):
                more = True
            if not more or self.kind == "op" and self.value in ".]}":
                return

    def iri(self) -> str:
        kind, value = self.kind, self.value
        self.advance()
        if kind == "iri":
            return urljoin(self.base, _plain(value[1:-1])) if self.base else _plain(value[1:-1])
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(f"expected an IRI, found {value!r}")

    def node(self, alone: bool = False) -> tuple:
        kind, value = self.kind, self.value
        if kind in ("iri", "name"):
            return (self.iri(),)
        self.advance()
        if kind == "bnode":
            return (value,)
        if kind in ("str", "long"):
            label = _plain(value[3:-3] if kind == "long" else value[1:-1])
            if self.kind == "lang":
                lang = self.value[1:]
                self.advance()
                return (label, True, lang)
            if self.eat("^^"):
                return (label, True, None, self.iri())
            return (label, True)
        if kind == "num":
            return (value, True, None, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"))
        if kind == "word" and value in ("true", "false"):
            return (value, True, None, XSD + "boolean")
        if value == "[":
            s = self.fresh()
            if not self.eat("]"):
                self.properties(s)
                self.need("]")
            return (s,)
        if value == "(":
            items = []
            while not self.eat(")"):
                items.append(self.node())
            head = RDF + "nil"
            for x in reversed(items):
                cell = self.fresh()
                self.emit(cell, RDF + "first", x)
                self.emit(cell, RDF + "rest", (head,))
                head = cell
            return (head,)
        raise ValueError(f"unexpected {value!r}")


# -- RDF/XML --------------------------------------------------------------------------------------


class RdfXml:
    def __init__(self, text: str | bytes, base: str = ""):
        self.root, self.base, self.rows, self.n = ElementTree.fromstring(text), base, [], 0

    def fresh(self) -> str:
        self.n += 1
        return f"_:gen{self.n}"

    def parse(self) -> list[Row]:
        r = "{" + RDF + "}"
        base, lang = self.root.get(XML + "base", self.base), self.root.get(XML + "lang")
        if self.root.tag == r + "RDF":
            for e in self.root:
                self.node(e, base, lang)
        else:
            self.node(self.root, base, lang)
        return self.rows

    @staticmethod
    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def node(self, e, base: str, lang: str | None) -> str:
        r = "{" + RDF + "}"
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        if e.get(r + "about") is not None:
            s = urljoin(base, e.get(r + "about"))
        elif e.get(r + "ID") is not None:
            s = urljoin(base, "#" + e.get(r + "ID"))
        else:
            s = "_:" + e.get(r + "nodeID") if e.get(r + "nodeID") else self.fresh()
        if e.tag != r + "Description":
            self.rows.append(row(s, RDF + "type", self.name(e.tag)))
        self.attributes(e, s, base, lang)
        n = 0
        for p in e:
            name = self.name(p.tag)
            if p.tag == r + "li":
                n += 1
                name = f"{RDF}_{n}"
            self.property(s, name, p, base, lang)
        return s

    def attributes(self, e, s: str, base: str, lang: str | None) -> None:
        for k, v in e.attrib.items():
            name = self.name(k)
            if k.startswith(XML) or name in (RDF + "about", RDF + "ID", RDF + "nodeID", RDF + "resource", RDF + "parseType", RDF + "datatype") or not k.startswith("{"):
                continue
            self.rows.append(row(s, name, urljoin(base, v)) if name == RDF + "type" else row(s, name, v, None, True, lang))

    def property(self, s: str, p: str, e, base: str, lang: str | None) -> None:
        r = "{" + RDF + "}"
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        mode = e.get(r + "parseType")
        if e.get(r + "resource") is not None or e.get(r + "nodeID") is not None:
            o = urljoin(base, e.get(r + "resource")) if e.get(r + "resource") is not None else "_:" + e.get(r + "nodeID")
            self.rows.append(row(s, p, o))
            self.attributes(e, o, base, lang)
        elif mode == "Resource":
            o = self.fresh()
            self.rows.append(row(s, p, o))
            for x in e:
                self.property(o, self.name(x.tag), x, base, lang)
        elif mode == "Collection":
            items, head = [self.node(x, base, lang) for x in e], RDF + "nil"
            for x in reversed(items):
                cell = self.fresh()
                self.rows += [row(cell, RDF + "first", x), row(cell, RDF + "rest", head)]
                head = cell
            self.rows.append(row(s, p, head))
        elif mode == "Literal":
            inner = (e.text or "") + "".join(ElementTree.tostring(x, encoding="unicode") for x in e)
            self.rows.append(row(s, p, inner, None, True, None, RDF + "XMLLiteral"))
        elif len(e):
            self.rows.append(row(s, p, self.node(e[0], base, lang)))
        else:
            dt = e.get(r + "datatype")
            if not (e.text or "").strip() and any(k.startswith("{") and not k.startswith(XML) and k not in (r + "ID", r + "datatype") for k in e.attrib):
                o = self.fresh()
                self.rows.append(row(s, p, o))
                self.attributes(e, o, base, lang)
            else:
                self.rows.append(row(s, p, e.text or "", None, True, None if dt else lang, urljoin(base, dt) if dt else None))


# -- JSON and XML syntaxes ------------------------------------------------------------------------


def parse_rdf_json(text: str, base: str = "") -> list[Row]:
    out = []
    for s, props in json.loads(text).items():
        for p, values in props.items():
            for v in values:
                out.append(row(s, p, v["value"], None, v["type"] == "literal", v.get("lang"), v.get("datatype")))
    return out


class JsonLd:
    """JSON-LD with local contexts: terms, prefixes, @vocab, @base, type coercion, lists, named graphs."""

    def __init__(self, text: str, base: str = ""):
        self.doc, self.base, self.rows, self.n = json.loads(text), base, [], 0

    def fresh(self) -> str:
        self.n += 1
        return f"_:gen{self.n}"

    def parse(self) -> list[Row]:
        for x in self.doc if isinstance(self.doc, list) else [self.doc]:
            self.top(x, {}, None)
        return self.rows

    def context(self, ctx: dict, own) -> dict:
        for c in own if isinstance(own, list) else [own]:
            if isinstance(c, str):
                raise ValueError("remote contexts aren't read")
            ctx = {**ctx, **(c or {})}
        return ctx

    def expand(self, name: str, ctx: dict, vocab: bool) -> str | None:
        if name.startswith(("@", "_:")):
            return name
        if vocab and name in ctx:
            d = ctx[name]
            d = d.get("@id", name) if isinstance(d, dict) else d
            return None if d is None else d if d == name else self.expand(d, ctx, True)
        prefix, sep, local = name.partition(":")
        if sep and not local.startswith("//") and prefix in ctx:
            d = ctx[prefix]
            d = d["@id"] if isinstance(d, dict) else d
            return (d if d.partition(":")[0] == prefix else self.expand(d, ctx, True)) + local
        if sep:
            return name
        if vocab:
            return ctx["@vocab"] + name if "@vocab" in ctx else None
        return urljoin(ctx.get("@base", self.base) or "", name)

    def top(self, x: dict, ctx: dict, g: str | None) -> None:
        ctx = self.context(ctx, x["@context"]) if "@context" in x else ctx
        if "@graph" in x:
            keys = set(x) - {"@context", "@graph"}
            inner = g
            if keys:
                inner = self.node({k: v for k, v in x.items() if k != "@graph"}, ctx, g)
            for y in x["@graph"] if isinstance(x["@graph"], list) else [x["@graph"]]:
                self.top(y, ctx, inner)
        else:
            self.node(x, ctx, g)

    def node(self, x: dict, ctx: dict, g: str | None) -> str:
        ctx = self.context(ctx, x["@context"]) if "@context" in x else ctx
        alias = {(ctx[k] if isinstance(ctx.get(k), str) else k): v for k, v in x.items()}
        s = self.expand(alias["@id"], ctx, False) if "@id" in alias else self.fresh()
        for k, values in x.items():
            key = ctx[k] if isinstance(ctx.get(k), str) and ctx[k].startswith("@") else k
            if key in ("@context", "@id", "@graph"):
                continue
            many = values if isinstance(values, list) else [values]
            if key == "@type":
                for t in many:
                    self.rows.append(row(s, RDF + "type", self.expand(t, ctx, True), g))
                continue
            if key == "@reverse":
                for p, vs in values.items():
                    for v in vs if isinstance(vs, list) else [vs]:
                        self.rows.append(row(self.node(v, ctx, g) if isinstance(v, dict) else self.expand(v, ctx, False), self.expand(p, ctx, True), s, g))
                continue
            p = self.expand(key, ctx, True)
            if p is None or p.startswith("@"):
                continue
            coerce = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            if coerce.get("@container") == "@language" and isinstance(values, dict):
                many = [{"@value": v, "@language": tag} for tag, vs in values.items() for v in (vs if isinstance(vs, list) else [vs])]
            if coerce.get("@container") == "@list":
                many = [{"@list": many}]
            for v in many:
                self.value(s, p, v, ctx, g, coerce)
        return s

    def value(self, s: str, p: str, v, ctx: dict, g: str | None, coerce: dict) -> None:
        if v is None:
            return
        o = self.object(v, ctx, g, coerce)
        self.rows.append(row(s, p, o[0], g, *o[1:]))

    def object(self, v, ctx: dict, g: str | None, coerce: dict) -> tuple:
        if isinstance(v, dict):
            if "@value" in v:
                o = self.object(v["@value"], ctx, g, {})
                dt, lang = v.get("@type"), v.get("@language")
                return (o[0], True, None if dt else lang, self.expand(dt, ctx, True) if dt else o[3] if len(o) > 3 and not lang else None)
            if "@list" in v or "@set" in v:
                items, head = v.get("@list", v.get("@set")), RDF + "nil"
                for x in reversed(items if isinstance(items, list) else [items]):
                    cell, o = self.fresh(), self.object(x, ctx, g, coerce)
                    self.rows += [row(cell, RDF + "first", o[0], g, *o[1:]), row(cell, RDF + "rest", head, g)]
                    head = cell
                return (head,)
            return (self.node(v, ctx, g),)
        kind = coerce.get("@type")
        if kind in ("@id", "@vocab") and isinstance(v, str):
            return (self.expand(v, ctx, kind == "@vocab"),)
        if isinstance(v, bool):
            return ("true" if v else "false", True, None, XSD + "boolean")
        if isinstance(v, (int, float)):
            return (str(v), True, None, self.expand(kind, ctx, True) if kind else XSD + ("integer" if isinstance(v, int) else "double"))
        if kind:
            return (v, True, None, self.expand(kind, ctx, True))
        return (v, True, coerce.get("@language", ctx.get("@language")), None)


def parse_trix(text: str, base: str = "") -> list[Row]:
    out, cut = [], lambda tag: tag.rpartition("}")[2]

    def term(e):
        kind = cut(e.tag)
        if kind == "uri":
            return ((e.text or "").strip(),)
        if kind == "id":
            return ("_:" + (e.text or "").strip(),)
        return (e.text or "", True, e.get(XML + "lang"), e.get("datatype"))

    for graph in ElementTree.fromstring(text):
        name = None
        for e in graph:
            if cut(e.tag) in ("uri", "id"):
                name = term(e)[0]
            elif cut(e.tag) == "triple":
                s, p, o = (term(x) for x in e)
                out.append(row(s[0], p[0], o[0], name, *o[1:]))
    return out


def parse_geonames(data: bytes, base: str = "") -> list[Row]:
    """A zip (or text) of pairs of lines: an IRI, then an RDF/XML document about it."""
    texts = [data]
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            texts = [z.read(n) for n in z.namelist()]
    out = []
    for k, text in enumerate(texts):
        for n, line in enumerate(text.decode("utf-8").splitlines()):
            if line.startswith("<"):
                out += [_scoped(r, f"{k}x{n}") for r in RdfXml(line, base).parse()]
    return out


def _scoped(r: Row, tag: str) -> Row:
    name = lambda t, kind: f"{t}x{tag}" if kind == BNODE else t
    return (name(r[0], r[1]), r[1], r[2], name(r[3], r[4]), *r[4:7], name(r[7], r[8]), r[8])


def parse_lines_whole(data: bytes, base: str = "") -> list[Row]:
    """A line format by the stricter name rules of ``operators.rejects``; malformed lines are dropped.

    ``read_quads`` doesn't come here: it reads packed line files by ``read_packed_lines``.
    """
    import pyarrow as pa

    from quadrille.operators.rejects import quads_of

    lines = re.split("\r?\n", data.decode("utf-8", "replace"))
    return [tuple(r[c] for c in QUAD) for r in quads_of(pa.array(lines, pa.string()))]


PARSERS: dict[str, Callable] = {
    "nt": parse_lines_whole, "nq": parse_lines_whole, "tql": parse_lines_whole,
    "ttl": lambda d, b: Turtle(d.decode("utf-8-sig"), b).parse(), "trig": lambda d, b: Turtle(d.decode("utf-8-sig"), b).parse(), "n3": lambda d, b: Turtle(d.decode("utf-8-sig"), b).parse(),
    "rdf": lambda d, b: RdfXml(d, b).parse(), "xml": lambda d, b: RdfXml(d, b).parse(), "owl": lambda d, b: RdfXml(d, b).parse(), "rj": lambda d, b: parse_rdf_json(d.decode(), b),
    "jsonld": lambda d, b: JsonLd(d.decode(), b).parse(), "trix": lambda d, b: parse_trix(d.decode(), b), "geonames": parse_geonames,
}
OPENERS = {"gz": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress}


def format_of(path: str) -> tuple[str, list[str]]:
    """(format, compressions from the outside) by extensions."""
    name, codecs = re.split(r"[?#]", path)[0].rsplit("/", 1)[-1].lower(), []
    parts = name.split(".")
    while len(parts) > 1 and parts[-1] in (*OPENERS, "lz4", "7z", "zst"):
        codecs.append(parts.pop())
    return parts[-1], codecs


def unpack(data: bytes, codecs: list[str]) -> bytes:
    for c in codecs:
        if c not in OPENERS:
            raise ValueError(f"can't decompress .{c} here")
        data = OPENERS[c](data)
    return data


def parse_document(data: bytes, path: str, form: str | None = None, base: str = "", rewrite_bnodes: bool = False) -> list[Row]:
    found, codecs = format_of(path)
    data = unpack(data, codecs)
    rows = PARSERS[form or found](data, base or path)
    if rewrite_bnodes:
        tag = sha256(path.encode()).hexdigest()[:16]
        rows = [_scoped(r, tag) for r in rows]
    return rows


def read_documents(spark, *paths: str, form: str | None = None, base: str = "", rewrite_bnodes: bool = False):
    """Quads of document files, one task per file at a time."""
    from quadrille.model import SCHEMA

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                rows = parse_document(bytes(data), path, form, base, rewrite_bnodes)
                for a in range(0, len(rows), 50_000):
                    yield pd.DataFrame(rows[a : a + 50_000], columns=QUAD)

    return files.mapInPandas(run, SCHEMA)


def read_packed_lines(spark, *paths: str, rewrite_bnodes: bool = False):
    """Quads of line files that Spark's text source can't unpack (xz): the same lines by the same grammar."""
    from quadrille.sources.lines import parse_statements

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                # As the text source does: a byte order mark is skipped, a carriage return alone ends a line.
                lines = re.split(b"\r\n|\n|\r", unpack(bytes(data), format_of(path)[1]).removeprefix(b"\xef\xbb\xbf"))
                for a in range(0, len(lines), 50_000):
                    yield pd.DataFrame({"value": lines[a : a + 50_000], "path": path})

    lines = files.mapInPandas(run, "value binary, path string").withColumn("value", F.col("value").cast("string"))
    return parse_statements(lines, file=F.col("path") if rewrite_bnodes else None)
