"""Evaluating SPARQL by translation to DataFrame joins; Catalyst plans the rest."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.sparql import Library, Value
from quadrille.model import FULL, Vocabulary, as_quads
from quadrille.operators.closure import transitive
from quadrille.rules.terms import decode, encode, kind_of
from quadrille.sparql.parse import Query, parse_query
from quadrille.storage import Scratch


@dataclass
class Solutions:
    """Rows of encoded terms, a column per variable; ``maybe``: variables that may be unbound."""

    df: DataFrame
    maybe: frozenset[str] = frozenset()

    @property
    def names(self) -> list[str]:
        return self.df.columns


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _unbound(df: DataFrame, names: list[str]) -> list[dict[str, bool]]:
    """Which of ``names`` are unbound together, in any row: at most one row per combination comes to the driver."""
    found = df.select(*[_q(n).isNull().alias(f"x{i}") for i, n in enumerate(names)]).distinct().collect()
    return [dict(zip(names, r)) for r in found]


def _compatible(left: DataFrame, right: DataFrame, shared: list[str], loose: list[str], how: str, where=None, keyed: bool = False) -> DataFrame:
    """Join on compatibility where variables may be unbound, without a nested loop over all rows.

    ``right`` has its columns prefixed with r.  Rows of either side are told apart by which ``loose`` variables are unbound;
    each pair of such parts is an equi-join on the variables bound in both.  ``keyed``: parts without such a variable
    don't join (MINUS); otherwise all their rows do, as SPARQL wants.  ``how``: inner, left, left_semi or left_anti.
    """
    scratch = Scratch(left.sparkSession, "compatible")
    left, right = scratch.table(left), scratch.table(right)
    free_right = [{n[1:]: v for n, v in p.items()} for p in _unbound(right, ["r" + n for n in loose])]
    out = []
    for mine in _unbound(left, loose):
        rest = part = left.where(reduce(Column.__and__, [_q(n).isNull() if v else _q(n).isNotNull() for n, v in mine.items()], F.lit(True)))
        for theirs in free_right:
            keys = [n for n in shared if not mine.get(n) and not theirs.get(n)]
            other = right.where(reduce(Column.__and__, [_q("r" + n).isNull() if v else _q("r" + n).isNotNull() for n, v in theirs.items()], F.lit(True)))
            if not keys and keyed:
                continue
            cond = reduce(Column.__and__, [_q(n) == _q("r" + n) for n in keys], F.lit(True))
            cond = cond if where is None else cond & where
            if how in ("inner", "left"):
                out.append(part.join(other, cond, "inner"))
            elif where is None:
                other = other.select(*["r" + n for n in keys]).distinct() if keys else other.limit(1)
            if how == "left_semi":
                out.append(rest.join(other, cond, "left_semi"))
            if how != "inner":
                rest = rest.join(other, cond, "left_anti")
        if how == "left":
            out.append(rest.select("*", *[F.lit(None).cast("string").alias(n) for n in right.columns]))
        elif how == "left_anti":
            out.append(rest)
    return reduce(DataFrame.unionByName, out) if out else left.join(right, F.lit(False), how)


def join(a: Solutions, b: Solutions, how: str = "inner", where=None) -> Solutions:
    """Compatible solutions; an unbound variable is compatible with anything."""
    shared = [n for n in b.names if n in a.names]
    loose = [n for n in shared if n in a.maybe or n in b.maybe]
    right = b.df.select(*[_q(n).alias("r" + n) for n in b.names])
    extra = None if where is None else where([n for n in b.names])
    if loose:
        both = _compatible(a.df, right, shared, loose, how, extra)
    else:
        cond = reduce(Column.__and__, [_q(n) == _q("r" + n) for n in shared], F.lit(True))
        both = a.df.join(right, cond if extra is None else cond & extra, how)
    cols = [(F.coalesce(_q(n), _q("r" + n)) if n in loose else _q(n)).alias(n) for n in a.names] + [_q("r" + n).alias(n) for n in b.names if n not in a.names]
    maybe = (a.maybe | b.maybe) - {n for n in shared if n not in a.maybe or (how == "inner" and n not in b.maybe)}
    if how == "left":
        maybe |= {n for n in b.names if n not in a.names}
    return Solutions(both.select(*cols), frozenset(maybe))


class Evaluator:
    def __init__(self, data: DataFrame, vocab: Vocabulary = FULL):
        self.quads, self.vocab, self.lib = encode(as_quads(data)), vocab, Library(vocab)
        self.spark, self.every_graph = data.sparkSession, False
        self.scratch = Scratch(self.spark, "sparql")

    @staticmethod
    def of(encoded: DataFrame, vocab: Vocabulary = FULL, every_graph: bool = False) -> "Evaluator":
        """For encoded statements (s, p, o, g); with ``every_graph`` GRAPH ?g also binds the default graph, as ''."""
        out = Evaluator.__new__(Evaluator)
        out.quads, out.vocab, out.lib, out.spark, out.every_graph = encoded, vocab, Library(vocab), encoded.sparkSession, every_graph
        out.scratch = Scratch(out.spark, "sparql")
        return out

    # -- patterns --------------------------------------------------------------------------------

    def source(self, graph: str | None) -> DataFrame:
        """Triples of the graph; without GRAPH those of all graphs, each once."""
        if graph is None:
            return self.quads.select("s", "p", "o").distinct()
        named = self.quads if self.every_graph else self.quads.where("g <> ''")
        return named if graph.startswith("?") else named.where(F.col("g") == graph)

    def pairs(self, path, src: DataFrame, extra: list[str]) -> DataFrame:
        """(a, b[, g]) for a property path."""
        kind = path[0]
        if kind == "iri":
            return src.where(F.col("p") == path[1]).select(F.col("s").alias("a"), F.col("o").alias("b"), *extra)
        if kind == "not":
            return src.where(~F.col("p").isin(path[1])).select(F.col("s").alias("a"), F.col("o").alias("b"), *extra)
        if kind == "inv":
            return self.pairs(path[1], src, extra).select(F.col("b").alias("a"), F.col("a").alias("b"), *extra)
        if kind == "alt":
            return reduce(DataFrame.unionByName, [self.pairs(p, src, extra) for p in path[1]])
        if kind == "seq":
            out = self.pairs(path[1][0], src, extra)
            for p in path[1][1:]:
                nxt = self.pairs(p, src, extra).withColumnRenamed("a", "mid")
                out = out.withColumnRenamed("b", "mid").join(nxt, ["mid", *extra]).drop("mid")
            return out
        if extra:
            raise ValueError("paths of any length need a fixed graph")
        step = self.pairs(path[1], src, [])
        nodes = src.select("s").unionByName(src.select(F.col("o").alias("s"))).distinct().select(F.col("s").alias("a"), F.col("s").alias("b"))
        if kind == "maybe":
            return step.unionByName(nodes).distinct()
        closed = transitive(step, self.scratch)
        return closed if kind == "plus" else closed.unionByName(nodes).distinct()

    def triple(self, s: str, path, o: str, graph: str | None) -> Solutions:
        src = self.source(graph)
        extra = ["g"] if graph and graph.startswith("?") else []
        if path[0] == "var":
            rows, places = src, [("s", s), ("p", path[1]), ("o", o)]
        elif path[0] == "iri":
            rows, places = src.where(F.col("p") == path[1]), [("s", s), ("o", o)]
        else:
            rows, places = self.pairs(path, src, extra), [("a", s), ("b", o)]
        if extra:
            places.append(("g", graph))
        cond, cols = F.lit(True), {}
        for c, t in places:
            if not t.startswith("?"):
                cond = cond & (F.col(c) == t)
            elif t in cols:
                cond = cond & (F.col(c) == cols[t])
            else:
                cols[t] = F.col(c)
        rows = rows.where(cond)
        return Solutions(rows.select(*([c.alias(n) for n, c in cols.items()] or [F.lit("").alias("?_")])))

    def bgp(self, triples: list, graph: str | None, start: Solutions | None) -> Solutions | None:
        """Join triple patterns: always one connected to what is bound, most constants first."""
        left, out = list(triples), start
        names = lambda t: {x for x in (t[0], t[1][1] if t[1][0] == "var" else "", t[2]) if x.startswith("?")}
        while left:
            bound = set(out.names) if out else set()
            t = min(left, key=lambda t: (bool(out) and not names(t) & bound, len(names(t) - bound)))
            left.remove(t)
            part = self.triple(t[0], t[1], t[2], graph)
            out = part if out is None else join(out, part)
        return out

    def unit(self) -> Solutions:
        return Solutions(self.spark.createDataFrame([("",)], "`?_` string"))

    def group(self, elements: list, graph: str | None = None) -> Solutions:
        out: Solutions | None = None
        filters = []
        for e in elements:
            kind = e[0]
            if kind == "bgp":
                out = self.bgp(e[1], graph, out)
            elif kind == "filter":
                filters.append(e[1])
            elif kind == "optional":
                inner = [x for x in e[1] if x[0] != "filter"]
                conds = [x[1] for x in e[1] if x[0] == "filter"]
                base = out or self.unit()
                part = self.group(inner, graph)
                where = None
                if conds:

                    def where(names, conds=conds, base=base):
                        look = lambda n: _q(n) if n in base.names else _q("r" + n) if n in names else F.lit(None).cast("string")
                        return reduce(lambda a, b: a & b, [F.coalesce(self.lib.truth(self.value(c, look)), F.lit(False)) for c in conds])

                out = join(base, part, "left", where)
            elif kind == "union":
                parts = [self.group(g, graph) for g in e[1]]
                names = list(dict.fromkeys(n for p in parts for n in p.names if n != "?_"))
                frames = [p.df.select(*[(_q(n) if n in p.names else F.lit(None).cast("string")).alias(n) for n in names] or [F.lit("").alias("?_")]) for p in parts]
                maybe = {n for n in names if any(n not in p.names or n in p.maybe for p in parts)}
                part = Solutions(reduce(DataFrame.unionByName, frames), frozenset(maybe))
                out = part if out is None else join(out, part)
            elif kind == "minus":
                part, base = self.group(e[1], graph), out or self.unit()
                shared = [n for n in part.names if n in base.names and n != "?_"]
                if shared:
                    right = part.df.select(*[_q(n).alias("r" + n) for n in shared]).distinct()
                    loose = [n for n in shared if n in base.maybe or n in part.maybe]
                    if loose:
                        out = Solutions(_compatible(base.df, right, shared, loose, "left_anti", keyed=True), base.maybe)
                    else:
                        out = Solutions(base.df.join(right, reduce(Column.__and__, [_q(n) == _q("r" + n) for n in shared]), "left_anti"), base.maybe)
            elif kind == "graph":
                part = self.group(e[2], e[1])
                out = part if out is None else join(out, part)
            elif kind == "bind":
                base = out or self.unit()
                v = self.lib.term(self.value(e[1], self.looker(base)))
                out = Solutions(base.df.withColumn(e[2], v), base.maybe | {e[2]})
            elif kind == "values":
                rows = [tuple(r) for r in e[2]]
                table = self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in e[1]))
                maybe = {n for i, n in enumerate(e[1]) if any(r[i] is None for r in rows)}
                part = Solutions(table, frozenset(maybe))
                out = part if out is None else join(out, part)
            elif kind == "sub":
                part = self.select(e[1])
                out = part if out is None else join(out, part)
        out = out or self.unit()
        for f in filters:
            out = self.filter(out, f, graph)
        return out

    def filter(self, sol: Solutions, cond, graph: str | None) -> Solutions:
        if cond[0] == "and":
            return self.filter(self.filter(sol, cond[1], graph), cond[2], graph)
        negated = cond[0] == "not" and cond[1][0] == "exists"
        if cond[0] == "exists" or negated:
            _, yes, elements = cond[1] if negated else cond
            inner = self.group(elements, graph)
            shared = [n for n in inner.names if n in sol.names and n != "?_"]
            right = inner.df.select(*[_q(n).alias("r" + n) for n in shared]).distinct() if shared else inner.df.limit(1)
            how = "left_semi" if yes != negated else "left_anti"
            loose = [n for n in shared if n in sol.maybe or n in inner.maybe]
            if loose:
                return Solutions(_compatible(sol.df, right, shared, loose, how), sol.maybe)
            return Solutions(sol.df.join(right, reduce(Column.__and__, [_q(n) == _q("r" + n) for n in shared], F.lit(True)), how), sol.maybe)
        return Solutions(sol.df.where(F.coalesce(self.lib.truth(self.value(cond, self.looker(sol))), F.lit(False))), sol.maybe)

    # -- expressions -----------------------------------------------------------------------------

    @staticmethod
    def looker(sol: Solutions):
        return lambda n: _q(n) if n in sol.names else F.lit(None).cast("string")

    def value(self, e, look) -> Value:
        lib, kind = self.lib, e[0]
        sub = lambda x: self.value(x, look)
        if kind == "var":
            return Value(look(e[1]))
        if kind == "const":
            return Value(F.lit(e[1]))
        if kind == "int":
            return Value(F.lit(e[1]).cast("long"), "int")
        if kind == "and":
            return Value(lib.truth(sub(e[1])) & lib.truth(sub(e[2])), "bool")
        if kind == "or":
            return Value(lib.truth(sub(e[1])) | lib.truth(sub(e[2])), "bool")
        if kind == "not":
            return Value(~lib.truth(sub(e[1])), "bool")
        if kind == "compare":
            a, b, op = sub(e[2]), sub(e[3]), e[1]
            if op in ("=", "!="):
                same = lib.equal(a, b)
                return Value(same if op == "=" else ~same, "bool")
            f = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
            return Value(lib.less(a, b, f), "bool")
        if kind == "in":
            a = sub(e[1])
            return Value(reduce(lambda x, y: x | y, [lib.equal(a, sub(i)) for i in e[2]], F.lit(False)), "bool")
        if kind == "math":
            return lib.arithmetic(e[1], sub(e[2]), sub(e[3]))
        if kind == "call":
            return lib.call(e[1], [sub(a) for a in e[2]])
        if kind == "column":
            return Value(_q(e[1]), e[2])
        raise ValueError(f"{kind} isn't allowed here")

    # -- query forms -----------------------------------------------------------------------------

    def aggregates(self, e, look, found: dict, before: dict) -> tuple:
        """The expression with aggregates replaced by columns, which are collected in ``found``; what they aggregate is
        collected in ``before``, to be worked out once a row."""
        if not isinstance(e, tuple):
            return e
        if e[0] == "agg":
            _, name, distinct, arg, sep = e
            v = Value(F.lit(1), "int") if arg == ("all",) else self.value(arg, look)
            n = len(before)
            before[f"arg{n}"] = self.lib.term(v)
            if name in ("SUM", "AVG", "MIN", "MAX"):
                before[f"num{n}"] = self.lib.num(v)
            term, number = _q(f"arg{n}"), Value(_q(f"num{n}"), "number")
            v, num = Value(term), _q(f"num{n}")["f"]
            if name == "COUNT":
                col, kind = (F.countDistinct(term) if distinct else F.count(term)).cast("long"), "int"
            elif name in ("SUM", "AVG"):
                col, kind = self.lib.total(number, distinct, name == "AVG"), "number"
            elif name in ("MIN", "MAX"):
                f = F.min if name == "MIN" else F.max
                order = F.struct(number.col.isNotNull().alias("a"), num.alias("b"), term.alias("c"))
                col, kind = f(order)["c"], "term"
            elif name == "SAMPLE":
                col, kind = F.min(term), "term"
            else:
                got = F.collect_set(self.lib.text(v)) if distinct else F.collect_list(self.lib.text(v))
                col, kind = F.array_join(F.sort_array(got), sep), "str"
            key = f"agg{len(found)}"
            found[key] = col
            return ("column", key, kind)
        return tuple([self.aggregates(x, look, found, before) if isinstance(x, tuple) else [self.aggregates(y, look, found, before) for y in x] if isinstance(x, list) else x for x in e])

    @staticmethod
    def has_aggregate(e) -> bool:
        return isinstance(e, (tuple, list)) and (bool(e) and e[0] == "agg" or any(Evaluator.has_aggregate(x) for x in e))

    def select(self, q: Query) -> Solutions:
        sol = self.group(q.where)
        look = self.looker(sol)
        grouped = bool(q.group) or any(self.has_aggregate(e) for e, _ in q.items)
        hidden = lambda n: n.startswith(("?_",))
        items = q.items or [(("var", n), n) for n in sol.names if not hidden(n)]
        order = q.order
        if grouped:
            found: dict[str, Column] = {}
            before: dict[str, Column] = {}
            items = [(self.aggregates(e, look, found, before), n) for e, n in items]
            having = [self.aggregates(e, look, found, before) for e in q.having]
            order = [(self.aggregates(e, look, found, before), up) for e, up in q.order]
            keys = [self.lib.term(self.value(e, look)).alias(n) for e, n in q.group]
            df = sol.df.select(*keys, *[c.alias(n) for n, c in before.items()]).groupBy(*[_q(n) for _, n in q.group]).agg(*[c.alias(n) for n, c in found.items()] or [F.count(F.lit(1)).alias("agg_all")])
            sol = Solutions(df)
            look = self.looker(sol)
            for h in having:
                df = df.where(F.coalesce(self.lib.truth(self.value(h, look)), F.lit(False)))
        else:
            df = sol.df
        out = {n: self.lib.term(self.value(e, look)) for e, n in items}
        df = df.select("*", *[c.alias("out" + n) for n, c in out.items()])
        # Ordering sees the result's names first; after DISTINCT it sees nothing else.
        final = lambda n: _q("out" + n) if n in out else F.lit(None).cast("string") if q.distinct else look(n)
        keys = []
        for e, up in order:
            v = self.value(e, final)
            for k in (self.lib.number(v), self.lib.text(v)):
                keys.append(k.asc_nulls_first() if up else k.desc_nulls_last())
        if q.distinct:
            df = df.select(*[_q("out" + n) for n in out]).distinct()
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        maybe = frozenset(n for n, (e, _) in zip(out, items) if not (e[0] == "var" and e[1] in sol.names and e[1] not in sol.maybe))
        return Solutions(df.select(*[_q("out" + n).alias(n) for n in out]), maybe)


def select(df: DataFrame, text: str, vocab: Vocabulary = FULL, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A SELECT query: one column of encoded terms per variable (without '?'); null is unbound."""
    q = parse_query(text, vocab, prefixes)
    if q.form != "SELECT":
        raise ValueError("not a SELECT query")
    out = Evaluator(df, vocab).select(q).df
    return out.select(*[_q(n).alias(n[1:]) for n in out.columns])


def ask(df: DataFrame, text: str, vocab: Vocabulary = FULL, prefixes: dict[str, str] | None = None) -> bool:
    q = parse_query(text, vocab, prefixes)
    return not Evaluator(df, vocab).group(q.where).df.isEmpty()


def construct(df: DataFrame, text: str, vocab: Vocabulary = FULL, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A CONSTRUCT query: distinct quads in the default graph; ill-typed and unbound ones are dropped."""
    q = parse_query(text, vocab, prefixes)
    sol = Evaluator(df, vocab).group(q.where)
    look = Evaluator.looker(sol)
    value = lambda t: look(t) if t.startswith("?") and t in sol.names else F.concat(F.lit("_:" + t[2:]), F.lower(F.hex(F.xxhash64(*[_q(n) for n in sol.names])))) if t.startswith("?_") else look(t) if t.startswith("?") else F.lit(t)
    rows = F.array(*[F.struct(value(s).alias("s"), value(p[1]).alias("p"), value(o).alias("o"), F.lit("").alias("g")) for s, p, o in q.template])
    out = sol.df.select(F.explode(rows).alias("x")).select("x.*").dropna(subset=["s", "p", "o"]).distinct()
    return decode(out.where(kind_of(F.col("s")) < 2))


def describe(df: DataFrame, text: str, vocab: Vocabulary = FULL, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A DESCRIBE query: the quads in which a described resource is subject or object."""
    q = parse_query(text, vocab, prefixes)
    ev = Evaluator(df, vocab)
    parts = [ev.spark.createDataFrame([(n,)], "term string") for e, n in q.items if e[0] == "const"]
    if q.where:
        sol = ev.group(q.where)
        parts += [sol.df.select(_q(n).alias("term")) for e, n in q.items if e[0] == "var"]
    terms = reduce(DataFrame.unionByName, parts).distinct()
    rel = ev.quads
    return decode(rel.join(terms, F.col("s") == F.col("term"), "left_semi").unionByName(rel.join(terms, F.col("o") == F.col("term"), "left_semi")).distinct())
