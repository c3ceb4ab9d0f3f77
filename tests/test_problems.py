"""The general problems on small cases: nulls, ties, repeats, empties, extra columns."""

import datetime
import random

import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from quadrille.operators import hierarchy, hotjoin, rejects, skew, widen
from quadrille.operators.rejects import MESSAGES

LINKS = "child string, parent string, root string"


def tree(spark, pairs, **options):
    df = spark.createDataFrame([(c, p, "extra") for c, p in pairs], LINKS)
    return {r["node"]: r for r in hierarchy.resolve_hierarchy(df, **options).collect()}


def brute(pairs):
    up = {}
    for c, p in pairs:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    out = {}
    for n in {*up, *up.values()}:
        way, x = [n], n
        while x in up and len(way) <= len(up) + 1:
            x = up[x]
            way.append(x)
        out[n] = ("", -1, None) if x in up else (x, len(way) - 1, way[::-1])
    return out


def test_hierarchy_shapes(spark):
    pairs = [("b", "a"), ("c", "b"), ("d", "b"), ("c", "b"), (None, "a"), ("x", None), ("loop", "loop"), ("p", "q"), ("q", "p"), ("below", "p"), ("e", "d"), ("two", "b"), ("two", "a")]
    got = tree(spark, pairs, with_paths=True)
    assert {k: (r["root"], r["node_depth"], r["path"]) for k, r in got.items()} == brute(pairs)


def test_hierarchy_random_forest_with_cycles_and_long_chain(spark):
    rnd = random.Random(3)
    pairs = [(f"n{i}", f"n{rnd.randrange(i)}") for i in range(1, 150)] + [(f"c{i}", f"c{i + 1}") for i in range(60)]
    pairs += [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [(f"s{i}", "r3") for i in range(20)] + [(f"star{i}", "hub") for i in range(100)]
    got = tree(spark, pairs)
    want = brute(pairs)
    assert {k: (r["root"], r["node_depth"]) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}


def test_hierarchy_empty_and_descendants(spark):
    assert tree(spark, []) == {}
    nodes = hierarchy.resolve_hierarchy(spark.createDataFrame([("b", "a", ""), ("c", "b", ""), ("z", "z", "")], LINKS), with_paths=True)
    assert rows(hierarchy.descendants(nodes)) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


SPECS = [("p:n", "num", "integer"), ("p:d", "dec", "decimal"), ("p:t", "day", "date"), ("p:b", "flag", "boolean"), ("p:s", "txt", "string")]
EAV = "s string, p string, o string, o_kind int, quad_id long, num string"


def test_widen_types_ties_and_gaps(spark):
    data = [
        ("a", "p:n", " 12\t", 2, 1, None), ("a", "p:n", "13", 2, 2, None), ("a", "p:n", "x", 2, 3, None), ("a", "p:d", "-.5", 2, 4, None), ("a", "p:t", "2024-02-29", 2, 5, None),
        ("b", "p:t", "2023-02-29", 2, 6, None), ("b", "p:t", "0000-01-01", 2, 7, None), ("b", "p:b", "TRUE", 2, 8, None), ("b", "p:b", "0", 2, 8, None), ("c", "p:s", "  ", 2, 9, None), ("c", "p:s", None, 2, 10, None),
        ("d", "p:n", "7", 0, 11, None), (None, "p:n", "7", 2, 12, None), ("e", "other", "7", 2, 13, None), ("f", "p:n", "9" * 40, 2, 14, None), ("g", "p:n", "5\n", 2, 15, None), ("h", "p:s", "x" * 100000, 2, 16, None),
    ]
    df = spark.createDataFrame(data, EAV)
    got = {r["s"]: r for r in widen.widen(df, SPECS).collect()}
    assert set(got) == set("abcdfgh")
    assert (int(got["a"]["num"]), float(got["a"]["dec"]), got["a"]["day"]) == (13, -0.5, datetime.date(2024, 2, 29))
    assert got["b"]["flag"] is True and got["b"]["day"] is None and got["f"]["num"] is None and len(got["h"]["txt"]) == 100000
    assert rows(widen.unreadable(df, SPECS)) == sorted([("p:t", "b"), ("p:s", "c"), ("p:n", "d"), ("p:n", "g")], key=str)
    assert widen.widen(df.limit(0), SPECS).count() == 0


def test_widen_many_attributes(spark):
    specs = [(f"p:{i}", f"c{i}", "integer") for i in range(11)]
    df = spark.createDataFrame([(f"e{i % 5}", f"p:{i}", str(i), 2, i, "") for i in range(11)], EAV)
    got = {r["s"]: r.asDict() for r in widen.widen(df, specs).collect()}
    assert all(got[f"e{e}"][f"c{i}"] == (i if i % 5 == e else None) for e in range(5) for i in range(11))


LINES = [
    ("<a> <b> <c> .", None), ("<a><b>_:x<g>.", None), ("_:x1 <b> \"v\"@en-GB <g> .\r", None), ("<a> <b> 'it''s' .", "kind"), ("", ""), (" \t", ""), ("# x", ""), ("<a> <b> \"x\\u00e9\" .", None), ("<a> <b> \"1\"^^<xsd:integer> .", None),
    ("<a> <b> \"+" + "9" * 60 + "\"^^<xsd:integer> .", None), ("<a> <b> \" 1\"^^<xsd:integer> .", "value"), ("<a> <b> \"\"^^<xsd:integer> .", "value"), ("<a> <b> \"2023-1-1\"^^<xsd:date> .", "value"), ("<a> <b> \"TRUE\"^^<xsd:boolean> .", "value"),
    ("<a> <b> \"1.\"^^<xsd:decimal> .", None), ("<a> <b> \"1e3\"^^<xsd:decimal> .", "value"), ("<a> <b> .", "few"), ("<a> <b> <c> <d> <e> .", "many"), ("<a> <b> <c>", "stop"), ("<a> <b> <c> . x", "after"), ("<a> <b> \"x .", "quote"),
    ("\"s\" <b> <c> .", "kind"), ("<a> _:b <c> .", "kind"), ("<a> <b> <c> \"g\" .", "kind"), ("<a> <b> \"x\"@en- .", "lang"), ("<a> <b> \"x\\u12\" .", "escape"), ("<a> <b> \"x\"^<y> .", "mark"), ("<a> <b> _:-x .", "bnode"),
    ("<a\tb> <b> <c> .", "iri"), ("hello", "none"), (None, "none"), ("<a> <b> \"a\x1fb\tc\" .", None), ("<a> <b> \"" + "y" * 300000 + "\" .", None), ("<a> <b> \"q\\\"q\\\\\" <sesame:nil> .", None),
]


def test_rejected_lines(spark):
    data = [(n % 2, n, t, "extra") for n, (t, _) in enumerate(LINES)]
    df = spark.createDataFrame(data, "file_no int, line_no int, raw_line string, message string")
    got = {r["line_no"]: r for r in rejects.parse_lines(df).collect()}
    want = {n: MESSAGES[k] if k else None for n, (_, k) in enumerate(LINES) if k != ""}
    assert {n: r["message"] for n, r in got.items()} == want
    assert got[7]["o"] == "xé" and got[2]["o_lang"] == "en-GB" and got[1]["g"] == "g" and got[31]["o"] == "a\x1fb\tc"
    assert got[33]["o"] == 'q"q\\' and got[33]["g"] is None and got[9]["o_dt"] == "xsd:integer" and len(got[32]["o"]) == 300000
    assert rejects.parse_lines(df.limit(0)).count() == 0


class Scanner:
    """A brute-force reader, character by character."""

    def __init__(self, text):
        self.t, self.i = text, 0

    def skip(self):
        while self.i < len(self.t) and self.t[self.i] in " \t":
            self.i += 1

    def escaped(self):
        self.i += 1
        n = {"u": 4, "U": 8}.get(self.t[self.i : self.i + 1], 0)
        if self.i >= len(self.t) or n and not all(c in "0123456789abcdefABCDEF" for c in self.t[self.i + 1 : self.i + 1 + n].ljust(n)):
            raise ValueError
        self.i += 1 + n

    def until(self, end, controls):
        self.i += 1
        while True:
            if self.i >= len(self.t):
                raise ValueError
            c = self.t[self.i]
            if c == end:
                self.i += 1
                return
            if c == "\\":
                self.escaped()
                continue
            if controls and c < " ":
                raise ValueError
            self.i += 1

    def term(self):
        self.skip()
        c = self.t[self.i : self.i + 1]
        if c == "<":
            self.until(">", True)
            return "i"
        if c and c in "\"'":
            self.until(c, False)
            if self.t[self.i : self.i + 1] == "@":
                start = self.i = self.i + 1
                dash = False
                while self.i < len(self.t) and self.t[self.i].isascii() and (self.t[self.i].isalpha() or self.i > start and (self.t[self.i] == "-" or dash and self.t[self.i].isdigit())):
                    dash |= self.t[self.i] == "-"
                    self.i += 1
                if self.i == start or self.t[self.i - 1] == "-":
                    raise ValueError
            elif self.t[self.i : self.i + 2] == "^^":
                self.i += 2
                if self.t[self.i : self.i + 1] != "<":
                    raise ValueError
                self.until(">", True)
            return "l"
        if self.t[self.i : self.i + 2] == "_:" and (self.t[self.i + 2 : self.i + 3].isalnum() or self.t[self.i + 2 : self.i + 3] == "_"):
            self.i += 3
            while self.i < len(self.t) and (self.t[self.i].isalnum() or self.t[self.i] in "_-"):
                self.i += 1
            return "b"
        raise ValueError

    def good(self):
        try:
            kinds = self.term() + self.term() + self.term()
            self.skip()
            if self.t[self.i : self.i + 1] != ".":
                kinds += self.term()
                self.skip()
            if self.t[self.i : self.i + 1] != ".":
                return False
            self.i += 1
            self.skip()
            return self.i == len(self.t) and kinds[0] in "ib" and kinds[1] == "i" and kinds[3:] in ("", "i", "b")
        except ValueError:
            return False


def test_rejects_against_brute_force():
    rnd = random.Random(5)
    bits = ["<a>", "<b c>", "_:x", "_:", '"v"', "'w'", '"v"@en', '"v"@en-1', '"v"^^<t>', ".", " ", "\t", "\\", '"', "<", ">", "@", "-", "^^", "x", "\\u00e9", "_:y_-"]
    lines = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(3, 11))) for _ in range(1500)]
    lines += [" ".join(rnd.choice(bits[:9]) for _ in range(rnd.randrange(2, 6))) + rnd.choice([" .", "."]) for _ in range(1500)]
    lines = [x for x in lines if x.strip(" \t") and not x.lstrip(" \t").startswith("#")]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(lines), pa.int32()), pa.array(range(len(lines)), pa.int32()), pa.array(lines)], names=["file_no", "line_no", "raw_line"])
    bad = {r["line_no"] for b in rejects._batches(iter([batch])) for r in b.to_pylist() if r["message"]}
    assert bad == {n for n, x in enumerate(lines) if not Scanner(x).good()}


def test_skew(spark):
    df = spark.createDataFrame([(1, "a", 5)] * 60 + [(1, None, None), (2, "a", 1), (None, "b", 2)], "k int, v string, n int")
    dim = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (3, "y"), (None, "z")], "code int, n string")
    df.createOrReplaceTempView("lhs"), dim.createOrReplaceTempView("rhs")
    want = rows(spark.sql("SELECT r.n, count(*), sum(l.n), count(DISTINCT v) FROM lhs l JOIN rhs r ON k = code GROUP BY r.n"))
    assert rows(skew.eager_join(df, dim, ("k", "code"), ["n"], ["n"], "v"), "n", "n_rows", "sum_n", "n_distinct") == want
    assert skew.eager_join(df.limit(0), dim, ("k", "code"), ["n"]).count() == 0
    # Groups of one key each, groups by a left column, no groups, and a hot key whose values have to be joined.
    df.createOrReplaceTempView("lhs")
    want = rows(spark.sql("SELECT k, n, count(*), count(DISTINCT v) FROM lhs WHERE k IS NOT NULL GROUP BY k, n"))
    assert rows(skew.eager_join(df, spark.range(400).selectExpr("int(id) code", "id n"), ("k", "code"), keep=["k", "n"], distinct="v"), "k", "n", "n_rows", "n_distinct") == want
    want = rows(spark.sql("SELECT l.n, r.n, count(*), count(DISTINCT v) FROM lhs l JOIN rhs r ON k = code GROUP BY l.n, r.n"))
    got = skew.eager_join(df, dim.withColumnRenamed("n", "name"), ("k", "code"), ["name"], distinct="v", keep=["n"])
    assert rows(got, "n", "name", "n_rows", "n_distinct") == want
    want = rows(spark.sql("SELECT count(*), count(DISTINCT v) FROM lhs JOIN rhs r ON k = code"))
    assert rows(skew.eager_join(df, dim, ("k", "code"), distinct="v"), "n_rows", "n_distinct") == want
    counts = skew.per_key(df.withColumn("grp", F.lit("g")), "grp", "k", "v")
    assert rows(counts, "k", "n_rows", "n_distinct") == rows(spark.sql("SELECT k, count(*), count(DISTINCT v) FROM lhs GROUP BY k"))
    assert rows(skew.frequent(counts.where("k IS NOT NULL"), 20), "k") == [(1,)]


def test_hot_join(spark):
    left = spark.range(2000).selectExpr("CASE WHEN id % 3 > 0 THEN 7 ELSE id END k", "id v")
    right = spark.range(1500).selectExpr("id k", "id * 2 w")
    assert hotjoin.hot_keys(left, "k") == [7]
    assert rows(hotjoin.hot_join(left, right, "k"), "k", "v", "w") == rows(left.join(right, "k"), "k", "v", "w")
    right = right.unionByName(right.withColumn("w", F.col("w") + 1))
    assert rows(hotjoin.salted_join(left, right, "k"), "k", "v", "w") == rows(left.join(right, "k"), "k", "v", "w")
    nulls = spark.range(400).selectExpr("CAST(NULL AS BIGINT) k", "id v")
    assert hotjoin.hot_keys(nulls, "k") == [] and hotjoin.hot_keys(left.limit(0), "k") == []
    assert rows(hotjoin.salted_join(left.unionByName(nulls), right, "k"), "k", "v", "w") == rows(left.join(right, "k"), "k", "v", "w")


def test_numbers_beyond_their_columns(spark):
    data = [("a", "0.12345678901", 1), ("b", "-123456789012345678901234567890.5", 2), ("c", "+007.500", 3), ("d", "-0.0", 4), ("e", "9" * 45 + "." + "1" * 9, 5), ("f", ".", 6)]
    df = spark.createDataFrame([(i, s, "d", o, 2) for s, o, i in data] + [(9, "a", "i", "1" * 45, 2), (8, "b", "i", "-0012", 2)], "quad_id int, s string, p string, o string, o_kind int")
    out = widen.widen(df, [("d", "num", "decimal"), ("i", "whole", "integer")])
    assert out.columns == ["s", "num", "num_text", "whole", "whole_text"]
    got = {r["s"]: (r[1], r[2]) for r in out.select("s", widen.exact_text(out, "num"), widen.exact_text(out, "whole")).collect()}
    assert got == {
        "a": ("0.12345678901", "1" * 45), "b": ("-123456789012345678901234567890.5", "-12"), "c": ("7.5", None), "d": ("0", None), "e": ("9" * 45 + "." + "1" * 9, None), "f": (None, None)
    }
    small = widen.widen(df.where("s IN ('a', 'c') AND p = 'd'"), [("d", "num", "decimal")])
    assert small.dtypes == [("s", "string"), ("num", "decimal(12,11)")]
    assert widen.widen(df.limit(0), [("d", "num", "decimal")]).count() == 0


def test_wide_rows_of_a_hot_entity(spark):
    df = spark.range(3000).selectExpr("id quad_id", "CASE WHEN id % 3 > 0 THEN 'hot' ELSE 's' || id END s", "CASE WHEN id % 2 = 0 THEN 'p' ELSE 'q' END p", "CASE WHEN id % 5 = 0 THEN 'x' ELSE string(id) END o", "2 o_kind")
    got = {r["s"]: (r["a"], r["b"]) for r in widen.widen(df, [("p", "a", "integer"), ("q", "b", "string")]).collect()}
    assert len(got) == 1001 and got["hot"] == (2998, "2999")
    plan = widen.widen(df, [("p", "a", "integer"), ("q", "b", "string")])
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "- Sort (" not in text and "- Exchange (" not in text
