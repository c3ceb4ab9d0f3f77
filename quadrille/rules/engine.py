"""Forward chaining to a fixpoint with DataFrame joins.

Rules are grouped into phases.  A phase without deletions is evaluated semi-naively: a round joins the
statements of the last round with all statements, once per body pattern, and keeps what is
new.  A phase with deletions is re-evaluated as a whole until nothing changes.  Statements live in
tables in the shared folder; a round adds one, and many small ones are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.model import LITERAL, Vocabulary, FULL, as_quads
from quadrille.rules.model import Pattern, Rule, merge_same_where
from quadrille.rules.terms import decode, encode, kind_of
from quadrille.storage import Scratch, fingerprint

COLS = ["s", "p", "o", "g", "scope"]
#: Tables of known statements before they are merged into one.
MANY = 5
#: Distinct predicates and (type, class) pairs looked at to leave out rules that can't fire.
SHAPES = 20_000
#: Namespace of helper statements, which never leave the engine.
HELPER = "urn:quadrille:"


def _bind(data: DataFrame, pattern: Pattern, graph: str | None) -> DataFrame:
    """Solutions of one pattern: a column per variable; constants and repeated variables filter."""
    cond, cols = F.lit(True), {}
    for col, term in zip(("s", "p", "o"), pattern):
        if not term.startswith("?"):
            cond = cond & (F.col(col) == term)
        elif term in cols:
            cond = cond & (F.col(col) == cols[term])
        else:
            cols[term] = F.col(col)
    if graph:
        cols[graph] = F.col("g")
    out = data.where(cond).select(F.col("scope").alias("?scope"), *[c.alias(v) for v, c in cols.items()])
    return out if graph else out.distinct() if len(cols) < 3 else out


def _evaluate(rule: Rule, data: DataFrame, mode: str) -> DataFrame:
    """Solutions of a SPARQL body: against the merge of all graphs, or in each graph apart (mode separate)."""
    from quadrille.sparql.evaluate import Evaluator

    if mode == "star":
        raise ValueError(f"rule {rule.id}: graph mode star needs a body of triple patterns")
    apart = mode == "separate"
    sol = Evaluator.of(data.select("s", "p", "o", "g"), every_graph=apart).group(list(rule.body), "?graph" if apart else None)
    names = [n for n in sol.names if not n.startswith("?_")]
    return sol.df.select(F.lit("").alias("?scope"), *[F.col(f"`{n}`") for n in names]).distinct()


class Shapes:
    """Which constant predicates and classes occur in some statements; unknown if there are too many."""

    def __init__(self, data: DataFrame, type_names: set[str]):
        o = F.when(F.col("p").isin(sorted(type_names)), F.col("o")) if type_names else F.lit(None).cast("string")
        rows = data.select("p", o.alias("o")).distinct().limit(SHAPES + 1).collect()
        self.known = len(rows) <= SHAPES
        self.types = type_names
        self.predicates, self.pairs = {r[0] for r in rows}, {(r[0], r[1]) for r in rows}

    def may_match(self, pattern: Pattern) -> bool:
        _, p, o = pattern
        if not self.known or p.startswith("?"):
            return True
        return p in self.predicates and (p not in self.types or o.startswith("?") or (p, o) in self.pairs)

    def add(self, other: "Shapes") -> "Shapes":
        self.known &= other.known
        self.predicates |= other.predicates
        self.pairs |= other.pairs
        return self


def _order(patterns: Sequence[Pattern], first: int) -> list[int]:
    """Start with ``first``, then always a pattern that shares a variable, most constants first."""
    left, out = [i for i in range(len(patterns)) if i != first], [first]
    bound = {t for t in patterns[first] if t.startswith("?")}
    while left:
        rank = lambda i: (not bound & set(patterns[i]), sum(t.startswith("?") and t not in bound for t in patterns[i]))  # noqa: E731, B023
        best = min(left, key=rank)
        left.remove(best)
        out.append(best)
        bound |= {t for t in patterns[best] if t.startswith("?")}
    return out


def solutions(rule: Rule, data: DataFrame, delta: DataFrame | None, mode: str, shapes: Shapes | None = None, fresh: Shapes | None = None) -> Iterable[DataFrame]:
    """Solutions of the body; with ``delta`` those that use at least one statement of it.

    Bodies with a pattern nothing can match (by ``shapes`` of all and ``fresh`` of new statements) give none.
    """
    n = len(rule.where)
    if rule.body:
        yield _evaluate(rule, data, mode)
        return
    if shapes is not None and not all(shapes.may_match(p) for p in rule.where):
        return
    if n == 0:
        yield data.sparkSession.createDataFrame([("",)], "`?scope` string")
        return
    for at in range(n) if delta is not None else (0,):
        if fresh is not None and not fresh.may_match(rule.where[at]):
            continue
        out = None
        for i in _order(rule.where, at):
            graph = "?graph" if mode == "separate" else f"?graph{i}" if mode == "star" else None
            part = _bind(delta if delta is not None and i == at else data, rule.where[i], graph)
            out = part if out is None else out.join(part, [c for c in part.columns if c in out.columns])
        for a, op, b in rule.filters:
            value = lambda t: F.col(f"`{t}`") if t.startswith("?") else F.lit(t)
            out = out.where(value(a) != value(b) if op == "!=" else value(a) == value(b))
        for name, iri, term in rule.mints:
            out = out.withColumn(name, F.concat(F.lit(iri + "/"), F.col(f"`{term}`") if term.startswith("?") else F.lit(term)))
        yield out


def _heads(rule: Rule, patterns: Sequence[Pattern], found: DataFrame, mode: str, target: str) -> DataFrame:
    """Statements of the head patterns for the solutions; ill-typed ones are dropped."""
    value = lambda t: F.col(f"`{t}`") if t.startswith("?") else F.lit(t)
    n = len(rule.where) or len(rule.body)
    graph: Column = F.lit(target)
    found = found.dropna(subset=[f"`{t}`" for t in sorted({t for p in patterns for t in p if t.startswith("?") and t in found.columns})]) if rule.body else found
    if mode == "separate" and n:
        graph = F.col("`?graph`")
    if mode == "star" and n:
        # Allowed if all graphs but the global one are the same; the head goes there.
        own = F.array_distinct(F.array(*[F.col(f"`?graph{i}`") for i in range(n)]))
        own = F.array_except(own, F.array(F.lit(target)))
        found = found.withColumn("?own", own).where(F.size("?own") <= 1)
        graph = F.coalesce(F.try_element_at("?own", F.lit(1)), F.lit(target))
    rows = F.array(*[F.struct(*[value(t).alias(c) for c, t in zip(("s", "p", "o"), p)], graph.alias("g"), F.col("`?scope`").alias("scope")) for p in patterns])
    out = found.select(F.explode(rows).alias("x")).select("x.*")
    return out.where((kind_of(F.col("s")) < LITERAL) & (kind_of(F.col("p")) == 0))


class RuleEngine:
    """``mode`` of graphs: none or global (bodies match any graph, heads go to ``graph``), separate (all
    patterns and the head in one graph), star (any mix with the global graph)."""

    def __init__(self, rules: Iterable[Rule], mode: str = "none", graph: str | None = None, merge: bool = True):
        rules = list(rules)
        for r in rules:
            if not r.is_safe():
                raise ValueError(f"unsafe rule {r.id}: a head variable isn't bound by the body")
        if mode not in ("none", "global", "separate", "star"):
            raise ValueError(f"unknown graph mode {mode!r}")
        self.rules = merge_same_where(rules) if merge else rules
        self.mode, self.target = mode, graph or ""

    def predicates(self) -> set[str] | None:
        """The predicates in the rules; None if a rule has a variable for one or a body that may look at any statement."""
        patterns = [p for r in self.rules for p in (*r.where, *r.insert, *r.delete)]
        return None if any(r.body for r in self.rules) or any(p[1].startswith("?") for p in patterns) else {p[1] for p in patterns}

    def phases(self) -> list[list[Rule]]:
        out: list[list[Rule]] = []
        for r in sorted(self.rules, key=lambda r: (r.phase, r.fixpoint, r.id)):
            if out and (out[-1][0].phase, out[-1][0].fixpoint) == (r.phase, r.fixpoint):
                out[-1].append(r)
            else:
                out.append([r])
        return out

    def _infer(self, rules: list[Rule], data: DataFrame, delta: DataFrame | None, shapes: Shapes | None = None, fresh: Shapes | None = None) -> DataFrame | None:
        parts = []
        for r in rules:
            for found in solutions(r, data, delta, self.mode, shapes, fresh) if r.insert else ():
                parts.append(_heads(r, r.insert, found, self.mode, self.target))
        return reduce(DataFrame.unionByName, parts).distinct() if parts else None

    def _semi_naive(self, rules: list[Rule], known: DataFrame, scratch: Scratch) -> DataFrame:
        tables, delta, first = [known], None, True
        names = {p[1] for r in rules for p in r.where if not p[1].startswith("?") and not p[2].startswith("?")}
        shapes, fresh_shapes = Shapes(known, names), None
        while True:
            data = reduce(DataFrame.unionByName, tables)
            # In the first round everything is new; rules without a body only fire there.
            active = [r for r in rules if first or r.where]
            fresh = self._infer(active, data, None if first else delta, shapes, fresh_shapes)
            if fresh is None:
                break
            new, n = scratch.counted(fresh.join(data, COLS, "left_anti"))
            if not n["rows"] or not rules[0].fixpoint:
                tables.append(new)
                break
            tables.append(new)
            delta, first = new, False
            fresh_shapes = Shapes(new, names)
            shapes.add(fresh_shapes)
            if len(tables) > MANY:
                merged = scratch.table(reduce(DataFrame.unionByName, tables))
                scratch.drop(*[t for t in tables if t is not delta])
                tables = [merged]
        return scratch.table(reduce(DataFrame.unionByName, tables))

    def _naive(self, rules: list[Rule], known: DataFrame, scratch: Scratch) -> DataFrame:
        mark = fingerprint(known)
        while True:
            gone = [_heads(r, r.delete, f, self.mode, self.target) for r in rules if r.delete for f in solutions(r, known, None, self.mode)]
            kept = known
            if gone:
                # Without graphs in the rules a deletion takes the statement out of every graph.
                on = ["s", "p", "o", "scope"] + (["g"] if self.mode in ("separate", "star") else [])
                kept = known.join(reduce(DataFrame.unionByName, gone).select(*on).distinct(), on, "left_anti").select(*COLS)
            fresh = self._infer(rules, known, None)
            new = scratch.table((kept if fresh is None else kept.unionByName(fresh)).distinct())
            before, mark, known = mark, fingerprint(new), new
            if mark == before or not rules[0].fixpoint:
                return known

    def run(self, encoded: DataFrame) -> DataFrame:
        """Closure of (s, p, o, g[, scope]) statements, each once."""
        scratch = Scratch(encoded.sparkSession, "rules")
        if "scope" in encoded.columns and any(r.body for r in self.rules):
            raise ValueError("rules with SPARQL bodies can't be partitioned")
        if "scope" not in encoded.columns:
            encoded = encoded.withColumn("scope", F.lit(""))
        encoded = encoded.select(*COLS).distinct()
        rest, reach = None, self.predicates()
        if reach is not None:  # statements no rule can match, derive or delete pass by
            touched = F.coalesce(F.col("p").isin(sorted(reach)), F.lit(False))
            rest, encoded = encoded.where(~touched), encoded.where(touched)
        known = scratch.table(encoded)
        for rules in self.phases():
            known = self._naive(rules, known, scratch) if any(r.delete or r.body for r in rules) else self._semi_naive(rules, known, scratch)
            scratch.keep_only(known)
        return known if rest is None else known.unionByName(rest)


def apply_rules(
    df: DataFrame, rules: Iterable[Rule], mode: str = "none", graph: str | None = None, partition: str = "none", bindings: dict[str, str] | None = None,
    drop_bnode_types: bool = False, tbox: DataFrame | None = None, emit_tbox: str | None = None, vocab: Vocabulary = FULL,
) -> DataFrame:
    """The input with everything the rules derive, each statement once.

    ``partition`` 'entity' reasons among the statements that share a subject or resource object,
    'graph' within each graph, 'none' over everything.  ``tbox`` statements take part but are only in
    the result with ``emit_tbox`` ('' keeps their graphs, an IRI puts them there).  ``bindings`` fix
    rule variables.  An empty input gives what rules without a body assert.
    """
    rules = [r.rewrite(bindings or {}) for r in rules]
    data = as_quads(df)
    full = data if tbox is None else data.unionByName(as_quads(tbox))
    rel = encode(full)
    if partition == "entity":
        key = F.array_distinct(F.when(kind_of(F.col("o")) < LITERAL, F.array("s", "o")).otherwise(F.array("s")))
        rel = rel.select("*", F.explode(key).alias("scope"))
    elif partition == "graph":
        rel = rel.withColumn("scope", F.col("g"))
    elif partition != "none":
        raise ValueError(f"unknown partitioning {partition!r}")
    out = RuleEngine(rules, mode, graph).run(rel)
    # Other rules may say something about the helper names of rules, too.
    names = sorted({t for r in rules for p in (*r.where, *r.insert) for t in p if t.startswith(HELPER)})
    helper = F.col("p").startswith(HELPER)
    for c in ("s", "o") if names else ():
        helper = reduce(Column.__or__, [F.col(c).startswith(iri + "/") for iri in sorted({m[1] for r in rules for m in r.mints})], helper | F.col(c).isin(names))
    out = out.where(~helper).select("s", "p", "o", "g")
    if partition != "none":  # a statement may have been derived in several parts
        out = out.distinct()
    if tbox is not None:
        schema = RuleEngine(rules, mode, graph).run(encode(as_quads(tbox))).select("s", "p", "o", "g").distinct()
        mine = encode(data).distinct()
        out = out.join(schema, ["s", "p", "o", "g"], "left_anti").unionByName(mine.join(schema, ["s", "p", "o", "g"], "left_semi"))
        if emit_tbox is not None:
            out = out.unionByName(schema.withColumn("g", F.lit(emit_tbox)) if emit_tbox else schema).distinct()
    out = decode(out)
    if drop_bnode_types:
        out = out.where(~((F.col("p") == vocab("rdf:type")) & (F.col("o_kind") == 1)))
    return out
