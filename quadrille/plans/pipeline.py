"""The pipeline language: ``@op args`` in sequence, ``{ branch , branch }S`` in parallel.

A specification becomes a function from quads to quads; nothing runs until a sink or the caller asks.
Sinks (``@write``, ``@upload``) are recorded and run in order by :meth:`Pipeline.run`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quadrille.model import FULL, Vocabulary, as_quads, bag_union, nothing, quads
from quadrille.operators import mapreduce, rdfs, script, semantic, setops, stats, transform, unique
from quadrille.storage import Scratch

Step = Callable[[DataFrame], DataFrame]


def tokenize(text: str) -> list[str]:
    """Split at blanks; ``'`` and ``"`` quote a token they start, a backslash takes the next character as it is."""
    out, cur, quote, live = [], "", "", False
    chars = iter(text)
    for ch in chars:
        if ch == "\\":
            cur += next(chars, "")
            live = True
        elif quote:
            if ch == quote:
                quote = ""
            else:
                cur += ch
        elif ch in "'\"" and not live:
            quote, live = ch, True
        elif ch.isspace():
            if live:
                out.append(cur)
            cur, live = "", False
        else:
            cur += ch
            live = True
    if quote:
        raise ValueError("a quote isn't closed")
    if live:
        out.append(cur)
    return out


@dataclass(frozen=True)
class Flag:
    """A flag of an operator: ``-name``, with one value after it if ``value`` says what that is."""

    name: str
    help: str
    value: str = ""


@dataclass(frozen=True)
class Arguments:
    """What an operator takes: flags in any place, and between ``least`` and ``most`` plain arguments called ``plain``."""

    flags: tuple[Flag, ...] = ()
    plain: str = ""
    least: int = 0
    most: int = 0

    def read(self, args: Sequence[str]) -> tuple[dict[str, str], list[str]]:
        """Flags by name - those without a value have an empty one - and the plain arguments."""
        known = {f"-{f.name}": f for f in self.flags}
        found, rest, waiting = {}, [], list(args)
        while waiting:
            word = waiting.pop(0)
            flag = known.get(word)
            if flag is None:
                rest.append(word)
            elif not flag.value:
                found[flag.name] = ""
            elif waiting:
                found[flag.name] = waiting.pop(0)
            else:
                raise ValueError(f"{word} needs {flag.value}")
        if not self.least <= len(rest) <= self.most:
            raise ValueError(f"unexpected number of arguments: {rest}" if rest else f"needs {self.plain}")
        return found, rest

    def usage(self) -> str:
        lines = [f"  -{f.name}{' ' + f.value if f.value else ''}: {f.help}" for f in self.flags]
        return "\n".join([*lines, *([f"  {self.plain}"] if self.plain else [])])


MANY = 1 << 30
#: Statements of a file that describes rules.
RULE_STATEMENTS = 100_000
_BASE, _BNODES = Flag("b", "base IRI of what is read", "IRI"), Flag("w", "give blank nodes names of their own per file")
_TYPES, _TARGET, _DEFAULT = Flag("t", "leave out types that are blank nodes"), Flag("c", "emit the closed schema into this graph", "IRI"), Flag("C", "emit the closed schema into the default graph")
#: What each operator takes, by its first name.
ARGUMENTS = {
    "read": Arguments((_BASE, _BNODES), "files", 1, MANY),
    "write": Arguments((Flag("c", "statements a file gets in turn", "number"),), "files", 1, MANY),
    "download": Arguments((Flag("q", "the query", "query"), Flag("f", "a file with the query", "file"), _BNODES), "endpoint", 1, 1),
    "upload": Arguments((Flag("s", "statements a request", "number"),), "endpoint", 1, 1),
    "transform": Arguments((), "rules", 1, 1),
    "mapreduce": Arguments(
        (
            Flag("e", "only groups with such a statement", "rules"), Flag("a", "only groups of such statements", "rules"), Flag("b", "statements that pass by", "rules"), Flag("r", "reducer script", "script"),
            Flag("u", "each result once"),
        ), "mappers", 1, MANY,
    ),
    "unique": Arguments((Flag("m", "merge the graphs of equal triples"),)),
    "smush": Arguments((), "namespaces, best first", 0, MANY),
    "tbox": Arguments(),
    "prefix": Arguments((Flag("f", "file of namespaces and prefixes", "file"),)),
    "rdfs": Arguments((Flag("e", "rules to leave out", "names"), Flag("d", "add the RDFS part of OWL axioms"), _TYPES, _DEFAULT, _TARGET, _BASE, _BNODES), "schema files", 0, MANY),
    "rules": Arguments(
        (
            Flag("r", "rulesets", "names or files"), Flag("B", "bindings of rule variables", "pairs"), Flag("p", "partitioning: none, entity or graph", "mode"), Flag("g", "graphs: none, global, separate or star", "mode"),
            Flag("G", "the global graph", "IRI"), _TYPES, Flag("u", "each result once (always so)"), _DEFAULT, _TARGET, _BASE, _BNODES,
        ), "schema files", 0, MANY,
    ),
    "stats": Arguments(
        (
            Flag("n", "namespace of the names minted", "IRI"), Flag("p", "property that links graphs to sources", "IRI"), Flag("c", "graph with these links", "IRI"), Flag("t", "least entities or triples of a partition", "number"),
            Flag("o", "count classes and properties of every dataset"),
        ),
    ),
}


@dataclass
class Pipeline:
    spark: SparkSession
    vocab: Vocabulary = FULL
    prefixes: dict[str, str] = field(default_factory=dict)
    sinks: list[Callable[[], None]] = field(default_factory=list)
    bindings: DataFrame | None = None
    tracked: list[Observation] = field(default_factory=list)

    def parse(self, spec: str | Sequence[str]) -> Step:
        tokens = tokenize(spec) if isinstance(spec, str) else list(spec)
        step, at = self._sequence(tokens, 0)
        if at != len(tokens):
            raise ValueError(f"unexpected {tokens[at]!r}")
        return step

    def run(self, spec: str | Sequence[str], source: DataFrame | None = None) -> DataFrame:
        """Build the pipeline on ``source`` (or nothing), run its sinks in order, return the result."""
        out = self.parse(spec)(quads(self.spark, []) if source is None else as_quads(source))
        for sink in self.sinks:
            sink()
        return out

    # -- grammar ---------------------------------------------------------------------------------

    def _sequence(self, tokens: list[str], at: int) -> tuple[Step, int]:
        steps = []
        while at < len(tokens) and tokens[at] != "," and not tokens[at].startswith("}"):
            if tokens[at] == "{":
                step, at = self._parallel(tokens, at + 1)
            elif tokens[at].startswith("@"):
                name, args, at = tokens[at][1:], [], at + 1
                while at < len(tokens) and tokens[at] not in ("{", ",") and not tokens[at].startswith(("@", "}")):
                    args.append(tokens[at])
                    at += 1
                step = self.operator(name, args)
            else:
                raise ValueError(f"expected an operator, found {tokens[at]!r}")
            steps.append(step)
        if not steps:
            return as_quads, at
        return transform.in_sequence(*steps), at

    def _parallel(self, tokens: list[str], at: int) -> tuple[Step, int]:
        branches = []
        while True:
            step, at = self._sequence(tokens, at)
            branches.append(step)
            if at >= len(tokens):
                raise ValueError("a { isn't closed")
            if tokens[at] == ",":
                at += 1
                continue
            op = setops.check(tokens[at][1:] or "a")

            def fused(df: DataFrame) -> DataFrame:
                shared = self.share(df) if len(branches) > 1 else df
                return setops.combine(op, [b(shared) for b in branches])

            return fused, at + 1

    def operator(self, name: str, args: list[str]) -> Step:
        build = OPERATORS.get(name.lower())
        if build is None:
            raise ValueError(f"unknown operator @{name}")
        return build(self, args)

    # -- operators -------------------------------------------------------------------------------

    def read(self, args):
        from quadrille.sources import read_quads

        o, files = ARGUMENTS["read"].read(args)
        return lambda df: bag_union(df, read_quads(self.spark, *files, base=str(o.get("b", "")), rewrite_bnodes="w" in o))

    def write(self, args):
        from quadrille.sources import write_quads

        o, files = ARGUMENTS["write"].read(args)
        def sink(df: DataFrame) -> None:
            # What @prefix found before: at most as many names as its table has.
            found = {} if self.bindings is None else {r["prefix"]: r["ns"] for r in self.bindings.collect()}
            write_quads(df, *files, chunk=int(o.get("c", 1)), prefixes=found)

        return self.tee(sink)

    def tee(self, sink: Callable[[DataFrame], object]) -> Step:
        """Pass statements through and hand them to a sink when the pipeline runs."""

        def step(df: DataFrame) -> DataFrame:
            df = self.share(df)
            self.sinks.append(lambda: sink(df))
            return df

        return step

    def share(self, df: DataFrame) -> DataFrame:
        """Statements that several branches or sinks read: worked out and written once, unless reading them again
        is only a scan of Parquet files or of rows at hand, whose filters and columns each reader pushes down itself."""
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        nodes = {re.match(r"[\s:+-]*(\w+)", x)[1] for x in plan.splitlines() if re.match(r"[\s:+-]*(\w+)", x)}
        if nodes <= {"Project", "Filter", "Relation", "LocalRelation"} and not re.search(r"Relation \[[^\n]*\] (?!parquet)\w", plan):
            return df
        return Scratch(self.spark, "shared").table(df)

    def download(self, args):
        from quadrille.sources.endpoint import download

        o, (url,) = ARGUMENTS["download"].read(args)
        query = str(o["q"]) if "q" in o else open(str(o["f"])).read()
        return lambda df: bag_union(df, download(self.spark, url, query, rewrite_bnodes="w" in o))

    def upload(self, args):
        from quadrille.sources.endpoint import upload

        o, (url,) = ARGUMENTS["upload"].read(args)
        return self.tee(lambda df: upload(df, url, int(o.get("s", 1024))))

    def transform(self, args):
        _, (spec,) = ARGUMENTS["transform"].read(args)
        return lambda df: transform.transform(df, spec, self.prefixes, self.vocab)

    def script(self, args):
        pooled = args[:1] == ["-p"]
        source, *rest = args[1:] if pooled else args
        if source.endswith((".py", ".txt")):
            source = open(source).read()
        source = source.removeprefix("py:")
        return lambda df: script.script(df, source, tuple(rest), pooled, self.vocab, self.prefixes)

    def mapreduce(self, args):
        o, mappers = ARGUMENTS["mapreduce"].read(args)
        cond = lambda k: transform.predicate(str(o[k]), self.prefixes, self.vocab) if k in o else None
        reducer = None
        if "r" in o:
            env: dict = {}
            exec(str(o["r"]).removeprefix("py:"), env)  # noqa: S102 - the user's reducer
            reducer = env["reduce"]
        return lambda df: mapreduce.map_reduce(df, mappers[0] if len(mappers) == 1 else mappers, reducer, cond("e"), cond("a"), cond("b"), "u" in o)

    def unique(self, args):
        o, _ = ARGUMENTS["unique"].read(args)
        return unique.unique_merge if "m" in o else unique.unique

    def smush(self, args):
        _, spaces = ARGUMENTS["smush"].read(args)
        known = [transform.expand(x if ":" in x else x + ":", self.prefixes, FULL) if not x.startswith("<") and "/" not in x else x.strip("<>") for x in spaces]
        return lambda df: semantic.smush(df, known, self.vocab)

    def tbox(self, args):
        ARGUMENTS["tbox"].read(args)
        return lambda df: semantic.tbox(df, self.vocab)

    def prefix(self, args):
        o, _ = ARGUMENTS["prefix"].read(args)
        table = semantic.read_prefix_file(open(str(o["f"])).read()) if "f" in o else None

        def step(df: DataFrame) -> DataFrame:
            self.bindings = semantic.prefix_bindings(df, table)
            return df

        return step

    def rdfs(self, args):
        from quadrille.sources import read_quads

        o, files = ARGUMENTS["rdfs"].read(args)
        emit = "" if "C" in o else str(o["c"]) if "c" in o else None
        exclude = [x for x in str(o.get("e", "")).split(",") if x]

        def step(df: DataFrame) -> DataFrame:
            schema = read_quads(self.spark, *files, base=str(o.get("b", "")), rewrite_bnodes="w" in o) if files else None
            return rdfs.rdfs(df, schema, exclude, "d" in o, "t" in o, emit, self.vocab)

        return step

    def rules(self, args):
        from quadrille.rules.engine import apply_rules
        from quadrille.rules.model import parse_dlog, parse_rules, rules_from_statements
        from quadrille.rules.rulesets import ruleset
        from quadrille.sources import read_quads
        from quadrille.sources.documents import PARSERS, format_of

        o, files = ARGUMENTS["rules"].read(args)
        if "r" not in o:
            raise ValueError("@rules needs -r with rulesets")
        found = []
        for name in str(o["r"]).split(","):
            if name.endswith(".dlog"):
                found += parse_dlog(open(name).read(), self.vocab)
            elif name.endswith((".rules", ".txt")):
                found += parse_rules(open(name).read(), self.vocab, self.prefixes)
            elif format_of(name)[0] in PARSERS:
                rows = read_quads(self.spark, name).select("s", "p", "o").limit(RULE_STATEMENTS + 1).collect()
                if len(rows) > RULE_STATEMENTS:
                    raise ValueError(f"{name} has too many statements for a ruleset")
                found += rules_from_statements([tuple(r) for r in rows], self.vocab)
            else:
                found += ruleset(name, self.vocab)
        bindings = {}
        for pair in str(o.get("B", "")).replace(",", " ").split():
            k, _, v = pair.partition("=")
            bindings[k.lstrip("?")] = v.strip("<>") if v.startswith("<") else transform.expand(v, self.prefixes, self.vocab)
        emit = "" if "C" in o else str(o["c"]) if "c" in o else None

        def step(df: DataFrame) -> DataFrame:
            schema = read_quads(self.spark, *files, base=str(o.get("b", "")), rewrite_bnodes="w" in o) if files else None
            return apply_rules(df, found, str(o.get("g", "none")), o.get("G"), str(o.get("p", "none")), bindings, "t" in o, schema, emit, self.vocab)

        return step

    def stats(self, args):
        o, _ = ARGUMENTS["stats"].read(args)
        name = lambda k: None if k not in o else str(o[k]).strip("<>") if "/" in str(o[k]) else transform.expand(str(o[k]), self.prefixes, self.vocab)
        return lambda df: stats.stats_quads(df, str(o.get("n", "stats:")), int(o.get("t", 0)), name("p"), name("c"), self.vocab, "o" in o)

    def track(self, args):
        """Count statements as they pass."""
        seen = Observation()
        self.tracked.append(seen)
        return lambda df: df.observe(seen, F.count(F.lit(1)).alias("statements"))

    def nil(self, args):
        return nothing

    def identity(self, args):
        return as_quads


#: Operators by their names in specifications.
OPERATORS: dict[str, Callable[[Pipeline, list[str]], Step]] = {}
for _names, _build in {
    "read r": Pipeline.read, "write w": Pipeline.write, "download query": Pipeline.download, "upload update": Pipeline.upload, "transform t": Pipeline.transform,
    "script py groovy": Pipeline.script, "mapreduce": Pipeline.mapreduce, "unique u": Pipeline.unique, "smush": Pipeline.smush, "tbox": Pipeline.tbox, "prefix p": Pipeline.prefix,
    "rdfs": Pipeline.rdfs, "rules": Pipeline.rules, "stats": Pipeline.stats, "track": Pipeline.track, "nil": Pipeline.nil, "identity": Pipeline.identity,
}.items():
    for _n in _names.split():
        OPERATORS[_n] = _build


def register(name: str, build: Callable[[Pipeline, list[str]], Step]) -> None:
    """Add an operator to the language."""
    OPERATORS[name.lower()] = build
