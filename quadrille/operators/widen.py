"""Entity-attribute-value rows to one wide, typed row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.hotjoin import hot_keys
from quadrille.storage import Scratch

KINDS = ("string", "integer", "decimal", "date", "boolean")
#: Digits a number column holds; longer numbers keep their text in a column beside it.
DIGITS = 38
#: Lexical forms by kind; \z, not $, since $ also matches before a final line break.
FORMS = {
    "string": r"(?s)^.+\z",
    "integer": r"^[+-]?[0-9]+\z",
    "decimal": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z",
    "boolean": r"(?i)^(true|false|1|0)\z",
}
#: Attributes the list may have: it defines the result's columns.
MOST = 2000
#: Attributes joined onto one scan of the entities before the blocks are joined pairwise.
BLOCK = 4


def readable(text: Column, kind: str) -> Column:
    """Whether trimmed ``text`` is a value of ``kind``; never null for non-null text."""
    fits = text.rlike(FORMS[kind])
    if kind == "date":
        fits = fits & ~text.startswith("0000") & text.try_cast("date").isNotNull()
    return fits


def canonical(text: Column) -> Column:
    """A readable number as shortest exact text: no plus, no idle zeros or point; zero is ``0``."""
    whole = F.regexp_extract(text, r"^[+-]?0*([0-9]*)", 1)
    part = F.regexp_extract(text, r"\.([0-9]*?)0*$", 1)
    body = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    return F.when(text.startswith("-") & (body != "0"), F.concat(F.lit("-"), body)).otherwise(body)


def narrow_rows(rows: DataFrame, specs: list[tuple[str, str, str]]) -> DataFrame:
    """(s, p, o, o_kind, quad_id) rows to at most one row per entity and attribute: s, attr (col_name), best.

    ``best`` is the trimmed text of the readable row with the greatest quad_id, null if no row is readable; numbers
    in canonical form.  One exchange on the entity serves this and all that follows: rows of an entity with a large
    share of them are combined beforehand.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = name = F.lit(None)
    text = F.btrim(F.col("o"), F.lit(" \t"))
    for p, col, kind in specs:
        ok = (F.col("o_kind") == 2) & readable(text, kind)
        fits = F.when(F.col("p") == p, F.when(ok, canonical(text) if kind in ("integer", "decimal") else text)).otherwise(fits)
        name = F.when(F.col("p") == p, F.lit(col)).otherwise(name)
    rows = rows.where(F.col("p").isin([p for p, _, _ in specs]) & F.col("s").isNotNull())
    hot = hot_keys(rows, "s")
    # Ties on quad_id go to the greatest text.
    best = F.max(F.when(F.col("fit").isNotNull(), F.struct(F.col("quad_id").alias("at"), F.col("fit").alias("text"))))
    rows = rows.select("s", name.alias("attr"), "quad_id", fits.cast("string").alias("fit"))
    feed = rows
    if hot:  # an attribute without a readable value keeps its row
        head = rows.where(F.col("s").isin(hot)).groupBy("s", "attr").agg(best.alias("b")).select("s", "attr", F.col("b.at").alias("quad_id"), F.col("b.text").alias("fit"))
        feed = rows.where(~F.col("s").isin(hot)).unionByName(head)
    return feed.repartition(parts, "s").groupBy("s", "attr").agg(best.alias("b")).select("s", "attr", F.col("b.text").alias("best"))


def number_types(narrow: DataFrame, specs: list[tuple[str, str, str]]) -> dict[str, tuple[str, bool]]:
    """Per number attribute its column's type, fitted to the longest readable values, and whether any value doesn't fit it.

    One row an attribute comes to the driver: the most digits before and after the point.
    """
    numbers = [c for _, c, k in specs if k in ("integer", "decimal")]
    whole, part = F.length(F.regexp_extract("best", "^-?([0-9]+)", 1)), F.length(F.regexp_extract("best", r"\.([0-9]+)$", 1))
    long = F.max((whole + part > DIGITS).cast("int"))
    found = {r[0]: r for r in narrow.where(F.col("attr").isin(numbers) & F.col("best").isNotNull()).groupBy("attr").agg(F.max(whole), F.max(part), long).collect()}
    out = {}
    for c in numbers:
        _, before, after, over = found.get(c, (c, 1, 0, 0))
        after = min(after, DIGITS - 1)
        width = min(DIGITS, before + after)
        out[c] = (f"decimal({width},{after})", bool(over or before + after > DIGITS))
    return out


class Wide:
    """The narrow tables of some attributes, each typed, and what their wide row is made of."""

    def __init__(self, rows: DataFrame, specs: list[tuple[str, str, str]]):
        spark = rows.sparkSession
        self.specs, self.scratch = specs, Scratch(spark, "widen")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Exchanged on the entity as the buckets are, so each task writes one sorted file per attribute and nothing is shuffled again.
        self.narrow = self.scratch.bucketed(narrow_rows(rows, specs), self.buckets, ["s"], split="attr")
        self.spine = self.scratch.bucketed(self.narrow.select("s").distinct(), self.buckets, ["s"])
        self.types = number_types(self.narrow, specs)

    def column(self, col: str, kind: str, marks: bool) -> DataFrame:
        best = F.col("best")
        value = {"date": best.try_cast("date"), "boolean": F.lower(best).isin("true", "1")}.get(kind, best)
        extra = []
        if kind in ("integer", "decimal"):
            type_, over = self.types[col]
            value = best.try_cast(type_)
            if over:
                # A cast may round: only a value that comes back as it was fits.
                exact = canonical(value.cast("string")) == best
                extra = [F.when(best.isNotNull() & ~F.coalesce(exact, F.lit(False)), best).alias(f"{col}_text")]
                value = F.when(exact, value)
        if marks:
            value, extra = F.struct(value.alias("value"), best.isNotNull().alias("fits")), []
        return self.narrow.where(F.col("attr") == col).select("s", value.alias(col), *extra)

    def frame(self, marks: bool = False) -> DataFrame:
        def tree(part: list[tuple[str, str, str]]) -> DataFrame:
            if len(part) <= BLOCK:
                out = self.spine
                for _, col, kind in part:
                    out = out.join(self.column(col, kind, marks).hint("merge"), "s", "left")
                return out
            half = BLOCK * ((len(part) + 2 * BLOCK - 1) // (2 * BLOCK))
            return tree(part[:half]).join(tree(part[half:]).hint("merge"), "s", "left")

        return tree(self.specs)


def widen(rows: DataFrame, specs: list[tuple[str, str, str]], marks: bool = False) -> DataFrame:
    """One row per entity ``s`` with one typed column per attribute.

    Rows are reduced to one per entity and attribute and written once as narrow tables, split by attribute,
    bucketed and sorted by entity, beside the entity list.  Each attribute, typed, is then outer joined to
    the entities; blocks of attributes are joined pairwise in a balanced tree.  All tables share the bucketing
    and order and an outer join keeps those of its left side, so the whole tree merges in one stage without
    a further shuffle or sort, and rows grow wide only near the root of the tree.

    Integers and decimals come as decimal columns wide enough for the longest readable values, so no value is
    rounded; where that takes more than ``DIGITS`` digits, the values that don't fit are null in the column
    and stand as exact text in a column ``<name>_text`` beside it, which exists only then.

    With ``marks`` each column is a struct (value, fits): null if the entity lacks the attribute,
    fits = false if it has it without a readable value.  Values are null where nothing is readable;
    of several readable values the one with the greatest quad_id counts (ties: the greatest text).
    An entity whose attributes all lack a readable value keeps its row of nulls.  Null entities and
    attributes outside ``specs`` are left out; extra columns are ignored; no rows give no rows.
    """
    return Wide(rows, specs).frame(marks)


def exact_text(wide: DataFrame, col: str) -> Column:
    """A number column of :func:`widen` as canonical text, long values included."""
    text = canonical(F.col(col).cast("string"))
    return F.coalesce(text, F.col(f"{col}_text")) if f"{col}_text" in wide.columns else text


def unreadable(rows: DataFrame, specs: list[tuple[str, str, str]]) -> DataFrame:
    """(p, s) of the attributes an entity has without any readable value, read off the wide rows."""
    wide = widen(rows, specs, marks=True)
    flags = F.array(*[F.when(~F.col(f"{col}.fits"), F.lit(p)) for p, col, _ in specs])
    return wide.select(F.explode(F.array_compact(flags)).alias("p"), "s")


def attribute_specs(df: DataFrame) -> list[tuple[str, str, str]]:
    """The attribute list as plain data: it defines the result's columns, so more than ``MOST`` are an error."""
    found = df.select("p", "col_name", "col_kind").distinct().orderBy("col_name").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} attributes don't make a table")
    for r in found:
        if r["col_kind"] not in KINDS:
            raise ValueError(f"unknown kind of attribute: {r['col_kind']}")
    return [(r["p"], r["col_name"], r["col_kind"]) for r in found if r["p"] is not None]
