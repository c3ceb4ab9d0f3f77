"""Line formats (nt, nq, tql) read and written with JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.model import BNODE, IRI, LITERAL, NIL, QUAD, quad_line

_IRI = r"<((?:[^\x00-\x1f>\\]|\\.)*+)>"
_BNODE = r"(_:[\p{L}\p{N}_][\p{L}\p{N}\p{M}_.·-]*(?<!\.))"
_LITERAL = r"""(?:(")((?:[^"\\]|\\.)*+)"|(')((?:[^'\\]|\\.)*+)')(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*+)|\^\^<((?:[^\x00-\x1f>\\]|\\.)*+)>)?"""
#: Groups: subject IRI, bnode; predicate; object IRI, bnode, quote and literal in " or ', language, datatype; graph IRI, bnode.
GROUPS = 13
STATEMENT = rf"(?s)^[ \t]*(?:{_IRI}|{_BNODE})[ \t]*{_IRI}[ \t]*(?:{_IRI}|{_BNODE}|{_LITERAL})[ \t]*(?:{_IRI}|{_BNODE})?[ \t]*\.[ \t]*(?:#.*)?\r?\z"
NAMED_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", ">": ">"}


def unescape(c: Column) -> Column:
    """Resolve \\uXXXX, \\UXXXXXXXX and named escapes; text without a backslash passes untouched."""

    def coded(text: Column, letter: str, digits: int, charset: str) -> Column:
        pieces = F.split(text, r"\\" + letter)
        rest = F.transform(
            F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
            lambda x: F.concat(F.coalesce(F.decode(F.unhex(F.substring(x, 1, digits)), charset), F.lit("�")), F.substring(x, digits + 1, 2147483647)),
        )
        return F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))

    def plain(part: Column) -> Column:
        # A pair of surrogates written as two escapes is one character.
        part = F.regexp_replace(part, r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})", r"\\P$1$2")
        part = coded(part, "P", 8, "UTF-16BE")
        part = coded(coded(part, "U", 8, "UTF-32"), "u", 4, "UTF-16BE")
        for letter, char in NAMED_ESCAPES.items():
            part = F.replace(part, F.lit("\\" + letter), F.lit(char))
        return part

    return F.when(~F.contains(c, F.lit("\\")), c).otherwise(F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\"))


def parse_statements(lines: DataFrame, column: str = "value", nil: str = NIL, file: Column | None = None) -> DataFrame:
    """Lines to quads; blank lines and comments give nothing, malformed lines are dropped.

    Use ``operators.rejects`` where malformed lines have to be reported.  A graph ``sesame:nil`` is the
    default graph.  ``file`` (an expression) makes blank node names unique per file.
    """
    # One match a line: its groups are written out with separators and split; a separator that is part
    # of the text is escaped before and restored after.
    line = F.col(column)
    own = line.rlike("[\x1e\x1f]")
    line = F.when(own, F.replace(F.replace(line, F.lit("\x1e"), F.lit("\x1e0")), F.lit("\x1f"), F.lit("\x1e1"))).otherwise(line)
    laid = F.regexp_replace(line, STATEMENT, "".join(f"\x1f${i}" for i in range(1, GROUPS + 1)))
    parts = lines.select(F.split(laid, "\x1f").alias("x"), *([file.alias("file")] if file is not None else [])).where(F.size("x") == GROUPS + 1)
    # Escapes and separators are resolved in one place for all groups, and only in lines that hold any.
    text = F.array_join("x", "")
    back = lambda c: F.replace(F.replace(c, F.lit("\x1e1"), F.lit("\x1f")), F.lit("\x1e0"), F.lit("\x1e"))
    plain = F.when(F.contains(text, F.lit("\\")) | F.contains(text, F.lit("\x1e")), F.transform("x", lambda c: unescape(back(c)))).otherwise(F.col("x"))
    parts = parts.select(plain.alias("x"), *(["file"] if file is not None else []))
    x = lambda n: F.get("x", F.lit(n))
    some = lambda n: F.when(x(n) != "", x(n))

    def node(iri: int, bnode: int) -> Column:
        name = x(bnode)
        if file is not None:
            name = F.concat(F.lit("_:b"), F.substring(F.sha2(F.concat_ws("|", name, "file"), 256), 1, 24))
        return F.when(x(bnode) != "", name).otherwise(x(iri))

    literal = (x(6) != "") | (x(8) != "")
    kind = lambda bnode: F.when(x(bnode) != "", BNODE).otherwise(IRI).cast("tinyint")
    graph = F.when((x(12) != "") | (x(13) != ""), node(12, 13))
    graph = F.when(graph != nil, graph)
    return parts.select(
        node(1, 2).alias("s"), kind(2).alias("s_kind"), x(3).alias("p"),
        F.when(literal, F.concat(x(7), x(9))).otherwise(node(4, 5)).alias("o"), F.when(literal, LITERAL).otherwise(kind(5)).cast("tinyint").alias("o_kind"),
        some(10).alias("o_lang"), some(11).alias("o_dt"), graph.alias("g"), F.when(graph.isNotNull(), kind(13)).alias("g_kind"),
    ).select(*QUAD)


def read_lines(spark: SparkSession, *paths: str, rewrite_bnodes: bool = False, nil: str = NIL) -> DataFrame:
    """Quads of nt, nq or tql files (plain, gz, bz2…); directories and globs are fine."""
    lines = spark.read.text(list(paths))
    return parse_statements(lines, nil=nil, file=F.input_file_name() if rewrite_bnodes else None)


def to_lines(df: DataFrame) -> DataFrame:
    """One column ``value`` with a line per statement."""
    return df.select(quad_line().alias("value"))


def write_lines(df: DataFrame, path: str, compression: str | None = None, parts: int | None = None) -> None:
    """Write nt/nq/tql: a directory of part files written in parallel; ``parts`` fixes their number."""
    out = to_lines(df)
    writer = (out.repartition(parts) if parts else out).write
    (writer.option("compression", compression) if compression else writer).text(path)
