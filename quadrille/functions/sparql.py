"""The SPARQL 1.1 function library as column expressions.

Values are typed columns: ``term`` (an encoded term, see ``rules.terms``), ``str``, ``int``, ``bool`` and ``number``, a
struct of a numeric type's rank (1 integer, 2 decimal, 3 float, 4 double) with the exact integer, the exact decimal and the double.
Every function maps values to a value; a type error is null, as an unbound result is.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.model import FULL, NAMESPACES, Vocabulary
from quadrille.rules.terms import TERM_LITERAL

NUMERIC = "integer decimal double float int long short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split()
#: Direct parents of the built-in datatypes.
PARENT = {
    "integer": "decimal", "nonPositiveInteger": "integer", "negativeInteger": "nonPositiveInteger", "long": "integer", "int": "long", "short": "int", "byte": "short",
    "nonNegativeInteger": "integer", "unsignedLong": "nonNegativeInteger", "unsignedInt": "unsignedLong", "unsignedShort": "unsignedInt", "unsignedByte": "unsignedShort",
    "positiveInteger": "nonNegativeInteger", "normalizedString": "string", "token": "normalizedString", "language": "token", "Name": "token", "NMTOKEN": "token", "NCName": "Name",
}


#: Exact types: integers of 38 digits, decimals of 22 digits before and 16 after the point.
WHOLE, EXACT = "decimal(38,0)", "decimal(38,16)"
#: Operands of this type multiply and divide without loss of digits the result could hold.
NARROW = "decimal(19,9)"
TYPES = {1: "xsd:integer", 2: "xsd:decimal", 3: "xsd:float", 4: "xsd:double"}


def let(f: Callable[..., Column], *values: Column) -> Column:
    """``f`` of values that are worked out once, however often ``f`` uses them: nested expressions stay small."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(bound), lambda z: f(*[z[f"v{i}"] for i in range(len(values))]))[0]


def pack(rank: Column, whole: Column, exact: Column, real: Column) -> Column:
    """The struct of a ``number`` value; null if the rank is."""
    whole = F.when(rank == 1, whole.try_cast(WHOLE))
    exact = F.when(rank == 1, whole.try_cast(EXACT)).when(rank == 2, exact.try_cast(EXACT))
    real = F.when(rank == 1, whole.cast("double")).when(rank == 2, exact.cast("double")).otherwise(real)
    return F.when(rank.isNotNull() & real.isNotNull(), F.struct(rank.cast("int").alias("r"), whole.alias("i"), exact.alias("d"), real.alias("f")))


@dataclass
class Value:
    col: Column
    kind: str = "term"


def constant(term: str) -> Value:
    return Value(F.lit(term))


def label(c: Column) -> Column:
    """The text of an encoded term."""
    return F.when(c.startswith('"'), F.regexp_extract(c, TERM_LITERAL, 1)).otherwise(c)


def lang_of(c: Column) -> Column:
    return F.when(c.startswith('"'), F.regexp_extract(c, TERM_LITERAL, 2))


def datatype_of(c: Column, vocab: Vocabulary = FULL) -> Column:
    dt = F.regexp_extract(c, TERM_LITERAL, 3)
    tagged = F.regexp_extract(c, TERM_LITERAL, 2) != ""
    return F.when(c.startswith('"'), F.when(dt != "", dt).when(tagged, vocab("rdf:langString")).otherwise(vocab("xsd:string")))


class Library:
    def __init__(self, vocab: Vocabulary = FULL):
        self.vocab = vocab
        self.numeric = [vocab(f"xsd:{n}") for n in NUMERIC]

    # -- conversions -----------------------------------------------------------------------------

    def typed(self, c: Column, dt: str) -> Column:
        return F.concat(F.lit('"'), c, F.lit(f'"^^{self.vocab(dt)}'))

    def term(self, v: Value) -> Column:
        if v.kind == "term":
            return v.col
        if v.kind == "str":
            return F.concat(F.lit('"'), v.col, F.lit('"'))
        if v.kind == "number":
            return let(self._number_term, v.col)
        return self.typed(v.col.cast("string"), {"int": "xsd:integer", "bool": "xsd:boolean"}[v.kind])

    def _number_term(self, n: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(n["d"].cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
        text = F.when(n["r"] == 1, n["i"].cast("string")).when(n["r"] == 2, digits).when(n["r"] == 3, n["f"].cast("float").cast("string")).otherwise(n["f"].cast("string"))
        name = F.element_at(F.array(*[F.lit(self.vocab(x)) for x in TYPES.values()]), n["r"])
        return F.concat(F.lit('"'), F.replace(text, F.lit("Infinity"), F.lit("INF")), F.lit('"^^'), name)

    def text(self, v: Value) -> Column:
        return label(v.col) if v.kind == "term" else let(label, self.term(v)) if v.kind == "number" else v.col.cast("string")

    def num(self, v: Value) -> Column:
        """The ``number`` struct of a value; null if it is no number."""
        if v.kind == "number":
            return v.col
        none = F.lit(None)
        if v.kind == "int":
            return pack(F.when(v.col.isNotNull(), 1), v.col, none, none)
        if v.kind != "term":
            return pack(none.cast("int"), none, none, none)
        return F.when(v.col.startswith('"'), let(self._parse, datatype_of(v.col, self.vocab), F.trim(label(v.col))))

    def _parse(self, dt: Column, text: Column) -> Column:
        none = F.lit(None)
        of = lambda n: dt == self.vocab(f"xsd:{n}")
        whole = dt.isin([x for x in self.numeric if not x.endswith(("decimal", "double", "float"))]) & text.rlike(r"^[+-]?[0-9]+\z")
        rank = F.when(whole, 1).when(of("decimal") & text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z"), 2).when(of("float"), 3).when(of("double"), 4)
        real = F.when(text == "INF", float("inf")).when(text == "-INF", float("-inf")).otherwise(text.try_cast("double"))
        # Integers beyond 38 digits stay numbers, as doubles.
        packed = pack(rank, text, text.try_cast(EXACT), real)
        return F.coalesce(packed, F.when(rank < 3, pack(F.lit(4), none, none, real)))

    def is_numeric(self, v: Value) -> Column:
        if v.kind in ("str", "bool"):
            return F.lit(False)
        return self.num(v).isNotNull()

    def number(self, v: Value) -> Column:
        """The value as a double."""
        return v.col.try_cast("double") if v.kind == "str" else self.num(v)["f"]

    def truth(self, v: Value) -> Column:
        """Effective boolean value."""
        if v.kind == "bool":
            return v.col
        if v.kind == "int":
            return v.col != 0
        if v.kind == "number":
            return (v.col["f"] != 0) & ~F.isnan(v.col["f"])
        if v.kind == "str":
            return v.col != ""
        dt, text = datatype_of(v.col, self.vocab), label(v.col)
        return F.when(dt == self.vocab("xsd:boolean"), text.isin("true", "1")).when(self.is_numeric(v), self.number(v) != 0).when(v.col.startswith('"'), text != "")

    # -- operators -------------------------------------------------------------------------------

    def equal(self, a: Value, b: Value) -> Column:
        """Numbers by value, plain and xsd:string literals as one, everything else as terms."""
        suffix = f"^^{self.vocab('xsd:string')}"
        cut = '(?<=")' + re.escape(suffix) + r"\z"
        plain = lambda v: F.regexp_replace(self.term(v), cut, "")
        return F.coalesce(self.compare(a, b, lambda x, y: x == y), plain(a) == plain(b))

    def compare(self, a: Value, b: Value, op: Callable[[Column, Column], Column]) -> Column:
        """Two numbers: integers and decimals exactly, others as doubles; null if one is no number."""
        if "str" in (a.kind, b.kind) or "bool" in (a.kind, b.kind):
            return F.lit(None).cast("boolean")

        def both(x: Column, y: Column) -> Column:
            exact = x["d"].isNotNull() & y["d"].isNotNull()
            return F.when((x["r"] == 1) & (y["r"] == 1), op(x["i"], y["i"])).when(exact, op(x["d"], y["d"])).otherwise(op(x["f"], y["f"]))

        return let(both, self.num(a), self.num(b))

    def less(self, a: Value, b: Value, op: Callable[[Column, Column], Column]) -> Column:
        x, y = self.is_numeric(a), self.is_numeric(b)  # a number and anything else don't compare
        return F.coalesce(self.compare(a, b, op), F.when(~x & ~y, op(self.text(a), self.text(b))))

    def arithmetic(self, op: str, a: Value, b: Value) -> Value:
        """The type is the higher of both; integers divide to a decimal; a division by zero is an error but for floats."""
        return Value(let(lambda x, y: self._calculate(op, x, y), self.num(a), self.num(b)), "number")

    def _calculate(self, op: str, x: Column, y: Column) -> Column:
        rank = F.greatest(x["r"], y["r"], *([F.lit(2)] if op == "/" else []))
        rank = F.when(x.isNotNull() & y.isNotNull(), rank)
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
        exact = f(x["d"], y["d"])
        if op in "*/":
            short = lambda c: F.when(c.try_cast(NARROW).cast(EXACT) == c, c.try_cast(NARROW))
            exact = F.coalesce(f(short(x["d"]), short(y["d"])).try_cast(EXACT), exact.try_cast(EXACT))
        real = {"+": x["f"] + y["f"], "-": x["f"] - y["f"], "*": x["f"] * y["f"], "/": F.coalesce(F.try_divide(x["f"], y["f"]), F.when(x["f"] > 0, float("inf")).when(x["f"] < 0, float("-inf")).otherwise(float("nan")))}[op]
        return pack(rank, f(x["i"], y["i"]) if op != "/" else F.lit(None), exact, real)

    def negative(self, v: Value) -> Value:
        return self.arithmetic("-", Value(F.lit(0).cast("long"), "int"), v)

    def total(self, v: Value, distinct: bool, mean: bool) -> Column:
        """SUM or AVG of the numbers among the values, of the highest type among them; 0 if there is none."""
        n = self.num(v)
        add = F.sum_distinct if distinct else F.sum
        rank = F.max(n["r"])
        count = (F.countDistinct if distinct else F.count)(n["f"])
        whole, exact, real = (F.sum_distinct(n["i"]), F.sum_distinct(n["d"]), F.sum_distinct(n["f"])) if distinct else (F.try_sum(n["i"]), F.try_sum(n["d"]), add(n["f"]))
        if mean:
            short = lambda c: F.when(c.try_cast(NARROW).cast(EXACT) == c, c.try_cast(NARROW))
            sums = exact.try_cast(EXACT)
            exact = F.coalesce(F.try_divide(short(sums), count.cast(NARROW)).try_cast(EXACT), F.try_divide(sums, count.cast(WHOLE)).try_cast(EXACT))
            real, rank = F.try_divide(real, count), F.greatest(rank, F.lit(2))
        none = F.lit(None)
        return F.when(count == 0, pack(F.lit(1), F.lit(0), none, none)).otherwise(pack(rank, whole, exact, real))

    # -- functions -------------------------------------------------------------------------------

    def call(self, name: str, args: list[Value]) -> Value:
        f = getattr(self, "fn_" + name.lower(), None)
        if f is None:
            short = name
            for prefix, ns in NAMESPACES.items():
                if name.startswith(ns):
                    short = f"{prefix}:{name[len(ns):]}"
            if short.startswith("xsd:"):
                return self.cast(short, args[0])
            own = re.split(r"[#/:]", name)[-1].lower()
            if own in ("mint", "compatibledatatype", "starselectgraph"):
                return getattr(self, "fn_" + own)(*args)
            raise ValueError(f"unknown function {name!r}")
        return f(*args)

    def cast(self, dt: str, v: Value) -> Value:
        text = F.trim(self.text(v))
        if dt in ("xsd:integer", "xsd:int", "xsd:long", "xsd:decimal", "xsd:double", "xsd:float"):
            typed = datatype_of(v.col, self.vocab) == self.vocab("xsd:boolean") if v.kind == "term" else F.lit(v.kind == "bool")
            return Value(let(lambda n, x, b: self._cast_number(dt, n, x, b), self.num(v), text, typed), "number")
        if dt == "xsd:boolean":
            return Value(F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False), "bool")
        if dt == "xsd:string":
            return Value(self.text(v), "str")
        kind = "date" if dt == "xsd:date" else "timestamp"
        return Value(F.when(text.try_cast(kind).isNotNull(), self.typed(text, dt)))

    @staticmethod
    def _cast_number(dt: str, n: Column, text: Column, is_bool: Column) -> Column:
        none = F.lit(None)
        truth = F.when(is_bool, F.when(text.isin("true", "1"), 1).when(text.isin("false", "0"), 0))
        if dt in ("xsd:double", "xsd:float"):
            real = F.coalesce(n["f"], truth.cast("double"), F.when(text == "INF", float("inf")).when(text == "-INF", float("-inf")).otherwise(text.try_cast("double")))
            return pack(F.when(real.isNotNull(), 4 if dt == "xsd:double" else 3), none, none, real)
        decimal = F.coalesce(n["d"], truth.try_cast(EXACT), F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z"), text.try_cast(EXACT)), n["f"].try_cast(EXACT))
        if dt == "xsd:decimal":
            return let(lambda d: pack(F.when(d.isNotNull(), 2), none, d, none), decimal)
        cut = F.when(n.isNotNull() | truth.isNotNull(), let(lambda d: F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).try_cast(WHOLE), decimal))
        whole = F.coalesce(n["i"], F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast(WHOLE)), cut)
        return let(lambda i: pack(F.when(i.isNotNull(), 1), i, none, none), whole)

    def fn_str(self, v):
        return Value(self.text(v), "str")

    def fn_lang(self, v):
        return Value(lang_of(self.term(v)), "str")

    def fn_datatype(self, v):
        return Value(datatype_of(self.term(v), self.vocab))

    def fn_iri(self, v):
        return Value(self.text(v))

    fn_uri = fn_iri

    def fn_bnode(self, *v):
        return Value(F.concat(F.lit("_:b"), F.lower(F.hex(F.xxhash64(self.text(v[0]))))) if v else F.concat(F.lit("_:b"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))

    def fn_strdt(self, v, dt):
        return Value(F.concat(F.lit('"'), self.text(v), F.lit('"^^'), self.text(dt)))

    def fn_strlang(self, v, lang):
        return Value(F.concat(F.lit('"'), self.text(v), F.lit('"@'), self.text(lang)))

    def fn_uuid(self):
        return Value(F.concat(F.lit("urn:uuid:"), F.uuid()))

    def fn_struuid(self):
        return Value(F.uuid(), "str")

    def fn_isiri(self, v):
        t = self.term(v)
        return Value(~t.startswith('"') & ~t.startswith("_:"), "bool")

    fn_isuri = fn_isiri

    def fn_isblank(self, v):
        return Value(self.term(v).startswith("_:"), "bool")

    def fn_isliteral(self, v):
        return Value(self.term(v).startswith('"'), "bool")

    def fn_isnumeric(self, v):
        return Value(self.is_numeric(v), "bool")

    def fn_sameterm(self, a, b):
        return Value(self.term(a) == self.term(b), "bool")

    def fn_strlen(self, v):
        return Value(F.char_length(self.text(v)).cast("long"), "int")

    def fn_substr(self, v, start, length=None):
        at = self.number(start).cast("int")
        return Value(F.substring(self.text(v), at, self.number(length).cast("int") if length else F.lit(2147483647)), "str")

    def fn_ucase(self, v):
        return Value(F.upper(self.text(v)), "str")

    def fn_lcase(self, v):
        return Value(F.lower(self.text(v)), "str")

    def fn_strstarts(self, a, b):
        return Value(F.startswith(self.text(a), self.text(b)), "bool")

    def fn_strends(self, a, b):
        return Value(F.endswith(self.text(a), self.text(b)), "bool")

    def fn_contains(self, a, b):
        return Value(F.contains(self.text(a), self.text(b)), "bool")

    def fn_strbefore(self, a, b):
        x, y = self.text(a), self.text(b)
        at = F.position(y, x)
        return Value(F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(""), "str")

    def fn_strafter(self, a, b):
        x, y = self.text(a), self.text(b)
        at = F.position(y, x)
        return Value(F.when(at > 0, F.substring(x, at + F.char_length(y), F.char_length(x))).otherwise(""), "str")

    def fn_encode_for_uri(self, v):
        out = F.url_encode(self.text(v))
        for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return Value(out, "str")

    def fn_concat(self, *v):
        return Value(F.concat(*[self.text(x) for x in v]) if v else F.lit(""), "str")

    def fn_langmatches(self, a, b):
        tag, want = F.lower(self.text(a)), F.lower(self.text(b))
        return Value(F.when(want == "*", tag != "").otherwise((tag == want) | F.startswith(tag, F.concat(want, F.lit("-")))), "bool")

    def _pattern(self, pattern: Value, flags: Value | None) -> Column:
        p = self.text(pattern)
        return p if flags is None else F.when(self.text(flags) == "", p).otherwise(F.concat(F.lit("(?"), F.replace(self.text(flags), F.lit("q"), F.lit("")), F.lit(")"), p))

    def fn_regex(self, v, pattern, flags=None):
        return Value(F.regexp_like(self.text(v), self._pattern(pattern, flags)), "bool")

    def fn_replace(self, v, pattern, new, flags=None):
        return Value(F.regexp_replace(self.text(v), self._pattern(pattern, flags), self.text(new)), "str")

    def _round(self, v, exact: Callable[[Column], Column], real: Callable[[Column], Column]):
        each = lambda n: pack(n["r"], exact(n["i"]), exact(n["d"]).try_cast(EXACT), real(n["f"]).cast("double"))
        return Value(let(each, self.num(v)), "number")

    def fn_abs(self, v):
        return self._round(v, F.abs, F.abs)

    def fn_round(self, v):
        return self._round(v, lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)")), lambda x: F.floor(x + 0.5))

    def fn_ceil(self, v):
        return self._round(v, F.ceil, F.ceil)

    def fn_floor(self, v):
        return self._round(v, F.floor, F.floor)

    def fn_rand(self):
        none = F.lit(None)
        return Value(pack(F.lit(4), none, none, F.rand()), "number")

    def fn_now(self):
        return Value(self.typed(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "xsd:dateTime"))

    def _part(self, v, n):
        form = r"^(-?\d{4,})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?))?(Z|[+-]\d{2}:\d{2})?\z"
        x = F.regexp_extract(self.text(v), form, n)
        return F.when(x != "", x)

    def fn_year(self, v):
        return Value(self._part(v, 1).cast("long"), "int")

    def fn_month(self, v):
        return Value(self._part(v, 2).cast("long"), "int")

    def fn_day(self, v):
        return Value(self._part(v, 3).cast("long"), "int")

    def fn_hours(self, v):
        return Value(self._part(v, 4).cast("long"), "int")

    def fn_minutes(self, v):
        return Value(self._part(v, 5).cast("long"), "int")

    def fn_seconds(self, v):
        none, part = F.lit(None), self._part(v, 6)
        return Value(pack(F.when(part.isNotNull(), 2), none, part, none), "number")

    def fn_tz(self, v):
        return Value(F.coalesce(self._part(v, 7), F.lit("")), "str")

    def fn_timezone(self, v):
        z = self._part(v, 7)
        hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
        text = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
        zero = (z == "Z") | ((hours == 0) & (minutes == 0))
        return Value(F.when(z.isNotNull(), self.typed(F.when(zero, "PT0S").otherwise(text), "xsd:dayTimeDuration")))

    def fn_md5(self, v):
        return Value(F.md5(self.text(v)), "str")

    def fn_sha1(self, v):
        return Value(F.sha1(self.text(v)), "str")

    def fn_sha256(self, v):
        return Value(F.sha2(self.text(v), 256), "str")

    def fn_sha384(self, v):
        return Value(F.sha2(self.text(v), 384), "str")

    def fn_sha512(self, v):
        return Value(F.sha2(self.text(v), 512), "str")

    def fn_coalesce(self, *v):
        return Value(F.coalesce(*[self.term(x) for x in v]))

    def fn_if(self, c, a, b):
        if a.kind == b.kind:
            return Value(F.when(self.truth(c), a.col).otherwise(b.col), a.kind)
        return Value(F.when(self.truth(c), self.term(a)).otherwise(self.term(b)))

    def fn_bound(self, v):
        return Value(v.col.isNotNull(), "bool")

    def fn_mint(self, *v):
        """A new IRI from terms: namespace of the first IRI, readable name, hash of all terms."""
        from quadrille.model import local_name, namespace

        iris = [F.when(~self.term(x).startswith('"') & ~self.term(x).startswith("_:"), self.term(x)) for x in v]
        first = F.coalesce(*iris)
        name = F.regexp_replace(local_name(F.coalesce(first, self.text(v[0]))), r"[^\p{L}\p{N}]+", "_")
        h = F.lower(F.hex(F.xxhash64(*[self.term(x) for x in v])))
        return Value(F.concat(F.coalesce(namespace(first), F.lit("urn:hash:")), name, F.lit("_"), h))

    def fn_compatibledatatype(self, parent, child):
        """Whether values of ``child`` are values of ``parent``."""
        pairs = []
        for t in {*PARENT, *PARENT.values()}:
            up = t
            while True:
                pairs.append(f"{self.vocab('xsd:' + up)} {self.vocab('xsd:' + t)}")
                if up not in PARENT:
                    break
                up = PARENT[up]
        a, b = self.text(parent), self.text(child)
        return Value((a == b) | F.concat_ws(" ", a, b).isin(sorted(pairs)), "bool")

    def fn_starselectgraph(self, common, *graphs):
        """The one graph besides the common one, the common one if there is none, null if several."""
        own = F.array_except(F.array_distinct(F.array(*[self.term(g) for g in graphs])), F.array(self.term(common)))
        return Value(F.when(F.size(own) == 0, self.term(common)).when(F.size(own) == 1, F.element_at(own, 1)))


NAMES = sorted(n[3:] for n in dir(Library) if n.startswith("fn_"))
