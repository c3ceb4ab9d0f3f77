"""VOID-style statistics of datasets, classes and properties.

All counts are over distinct statements, context included.  Source null stands for the whole data;
with a source property, graphs linked to sources by it give one more dataset each.  Every
distinct count is a two-step aggregation over narrow keys, so no counting state grows with a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.model import FULL, IRI, LITERAL, QUAD, TBOX_CLASSES, Vocabulary, as_quads, format_term, local_name
from quadrille.operators.semantic import is_tbox


def with_sources(df: DataFrame, source_property: str | None = None, source_graph: str | None = None) -> DataFrame:
    """Distinct statements with ``source``: once with null, and once per source of their graph."""
    base = as_quads(df).distinct()
    whole = base.withColumn("source", F.lit(None).cast("string"))
    if source_property is None:
        return whole
    links = base.where((F.col("p") == source_property) & (F.col("o_kind") == IRI))
    if source_graph is not None:
        links = links.where(F.col("g") == source_graph)
    links = links.select(F.col("s").alias("g"), F.col("o").alias("source")).distinct()
    return whole.unionByName(base.join(links, "g").select(*QUAD, "source"))


def _marks(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    is_type = (F.col("p") == vocab("rdf:type")) & (F.col("o_kind") == IRI) & ~F.col("o").isin([vocab(c) for c in TBOX_CLASSES])
    one = lambda c: F.when(c, 1).otherwise(0)
    return df.withColumns({"is_tbox": one(is_tbox(vocab)), "is_type": one(is_type), "is_same": one(F.col("p") == vocab("owl:sameAs"))})


SUMS = ("triples", "tbox_triples", "abox_triples", "type_triples", "same_as_triples")


def _per_subject(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One row per (source, subject): statement counts and distinct predicates."""
    by_p = _marks(df, vocab).groupBy("source", "s", "s_kind", "p").agg(
        F.count(F.lit(1)).alias("triples"), F.sum("is_tbox").alias("tbox_triples"), F.sum(1 - F.col("is_tbox")).alias("abox_triples"),
        F.sum("is_type").alias("type_triples"), F.sum("is_same").alias("same_as_triples"),
    )
    return by_p.groupBy("source", "s", "s_kind").agg(*[F.sum(c).alias(c) for c in SUMS], F.count(F.lit(1)).alias("predicates")).withColumn("entity", F.when(F.col("s_kind") == IRI, 1).otherwise(0))


def source_stats(df: DataFrame, source_property: str | None = None, source_graph: str | None = None, vocab: Vocabulary = FULL) -> DataFrame:
    """(source, entities, triples, tbox/abox/type/same_as_triples, classes, properties) per dataset."""
    d = with_sources(df, source_property, source_graph)
    base = _per_subject(d, vocab).groupBy("source").agg(F.sum("entity").alias("entities"), *[F.sum(c).alias(c) for c in SUMS])
    t = (F.col("p") == vocab("rdf:type")) & (F.col("o_kind") == IRI)
    terms = d.select("source", F.when(t, "class").otherwise("property").alias("role"), F.when(t, F.col("o")).otherwise(F.col("p")).alias("term")).distinct()
    terms = terms.groupBy("source").agg(F.count(F.when(F.col("role") == "class", 1)).alias("classes"), F.count(F.when(F.col("role") == "property", 1)).alias("properties"))
    return base.join(terms.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")), "left").drop("src")


def class_stats(df: DataFrame, threshold: int = 0, source_property: str | None = None, source_graph: str | None = None, vocab: Vocabulary = FULL) -> DataFrame:
    """(source, class, entities, triples, …, average_properties) per class: sums over its members."""
    d = with_sources(df, source_property, source_graph)
    subjects = _per_subject(d, vocab)
    types = d.where((F.col("p") == vocab("rdf:type")) & (F.col("o_kind") == IRI)).select(F.col("source").alias("src"), F.col("s").alias("member"), F.col("o").alias("class")).distinct()
    both = types.join(subjects, F.col("source").eqNullSafe(F.col("src")) & (F.col("s") == F.col("member")))
    out = both.groupBy("source", "class").agg(F.sum("entity").alias("entities"), *[F.sum(c).alias(c) for c in SUMS], F.sum("predicates").alias("properties_sum"))
    out = out.withColumn("average_properties", F.when(F.col("entities") > 0, F.col("properties_sum") / F.col("entities")))
    return out.drop("properties_sum").where(F.col("entities") >= threshold)


def cooccurrence(df: DataFrame, source_property: str | None = None, source_graph: str | None = None, vocab: Vocabulary = FULL) -> DataFrame:
    """(source, class, classes, properties): distinct types and other properties of the members of each class."""
    d = with_sources(df, source_property, source_graph)
    is_type = (F.col("p") == vocab("rdf:type")) & (F.col("o_kind") == IRI)
    types = d.where(is_type).select(F.col("source").alias("src"), F.col("s").alias("member"), F.col("o").alias("class")).distinct()
    used = d.select("source", "s", is_type.alias("typed"), F.when(is_type, F.col("o")).otherwise(F.col("p")).alias("term")).distinct()
    both = used.join(types, F.col("source").eqNullSafe(F.col("src")) & (F.col("s") == F.col("member"))).select("source", "class", "typed", "term").distinct()
    return both.groupBy("source", "class").agg(F.count(F.when(F.col("typed"), 1)).alias("classes"), F.count(F.when(~F.col("typed"), 1)).alias("properties"))


#: Statements in the example of a class, and characters of an object in any example.
EXAMPLE_LINES, EXAMPLE_WIDTH = 20, 40


def _short(value: Column) -> Column:
    return F.when(F.char_length(value) > EXAMPLE_WIDTH, F.concat(F.left(value, F.lit(EXAMPLE_WIDTH)), F.lit("..."))).otherwise(value)


def _object_text() -> Column:
    return format_term(_short(F.col("o")), F.col("o_kind"), F.col("o_lang"), F.col("o_dt"))


def class_examples(df: DataFrame, vocab: Vocabulary = FULL) -> DataFrame:
    """(class, example): the first IRI that is a member, with up to ``EXAMPLE_LINES`` of its statements in order.

    First members are a mergeable minimum; lines are cut to the first ones on either side of the shuffle.
    """
    base = as_quads(df)
    members = base.where((F.col("p") == vocab("rdf:type")) & (F.col("o_kind") == IRI) & (F.col("s_kind") == IRI)).groupBy(F.col("o").alias("class")).agg(F.min("s").alias("s"))
    # One line a statement and member, then those of each class it stands for.
    lines = base.join(members.select("s").distinct(), "s", "left_semi").select("s", F.concat(F.lit("    <"), F.col("p"), F.lit("> "), _object_text()).alias("line")).distinct()
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("line"))).where(F.col("n") <= EXAMPLE_LINES)
    text = lines.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("line")), ";\n").alias("lines"))
    return members.join(text, "s").select("class", F.concat(F.lit("<"), "s", F.lit(">\n"), "lines", F.lit(".")).alias("example"))


def property_examples(df: DataFrame) -> DataFrame:
    """(property, example): the first statement with each kind of object, of subjects that are IRIs."""
    line = F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), _object_text(), F.lit(" ."))
    first = as_quads(df).where(F.col("s_kind") == IRI).groupBy("p", "o_kind").agg(F.min(line).alias("line"))
    return first.groupBy(F.col("p").alias("property")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("example"))


def property_stats(df: DataFrame, threshold: int = 0, source_property: str | None = None, source_graph: str | None = None, vocab: Vocabulary = FULL) -> DataFrame:
    """(source, property, triples, distinct_subjects, entities, distinct_objects, detected_type,
    functional, inverse_functional) per property.  IRI objects of rdf:type don't count as objects."""
    d = with_sources(df, source_property, source_graph)
    subj = d.groupBy("source", "p", "s", "s_kind").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("o_kind") == LITERAL).cast("int")).alias("lit"), F.min((F.col("o_kind") == LITERAL).cast("int")).alias("all_lit"))
    subj = subj.groupBy("source", "p").agg(
        F.sum("n").alias("triples"), F.count(F.lit(1)).alias("distinct_subjects"), F.sum(F.when(F.col("s_kind") == IRI, 1).otherwise(0)).alias("entities"),
        F.max("lit").alias("lit"), F.min("all_lit").alias("all_lit"),
    )
    typed = (F.col("p") == vocab("rdf:type")) & (F.col("o_kind") == IRI)
    obj = d.where(~typed).select("source", "p", "o", "o_kind", "o_lang", "o_dt").distinct().groupBy(F.col("source").alias("src"), F.col("p").alias("prop")).agg(F.count(F.lit(1)).alias("distinct_objects"))
    out = subj.join(obj, F.col("source").eqNullSafe(F.col("src")) & (F.col("p") == F.col("prop")), "left")
    kind = F.when(F.col("all_lit") == 1, "owl:DatatypeProperty").when(F.col("lit") == 0, "owl:ObjectProperty").otherwise("rdf:Property")
    n = F.coalesce("distinct_objects", F.lit(0))
    return out.select(
        "source", F.col("p").alias("property"), "triples", "distinct_subjects", "entities", n.alias("distinct_objects"), kind.alias("detected_type"),
        (F.col("triples") == F.col("distinct_subjects")).alias("functional"), (F.col("triples") == n).alias("inverse_functional"),
    ).where(F.col("triples") >= threshold)


def stats_quads(df: DataFrame, ns: str = "stats:", threshold: int = 0, source_property: str | None = None, source_graph: str | None = None, vocab: Vocabulary = FULL, cooccurrences: bool = False) -> DataFrame:
    """The statistics as VOID statements in the default graph; zero counts are not written.

    Partitions are linked to their dataset and the terms to their partitions; those over the whole data have examples.
    With ``cooccurrences`` datasets and class partitions also tell how many classes and properties they use.
    Partitions are named ``ns`` + local name (+ source), with a number in term order where names clash.
    """
    d = df
    src = source_stats(d, source_property, source_graph, vocab)
    cls = class_stats(d, threshold, source_property, source_graph, vocab)
    prop = property_stats(d, threshold, source_property, source_graph, vocab)
    base = lambda t, s: F.concat(F.lit(ns), local_name(t), F.when(s.isNotNull(), F.concat(F.lit("_"), local_name(s))).otherwise(""))
    def named(frame: DataFrame, term: str) -> DataFrame:
        name = base(F.col(term), F.col("source"))
        n = F.row_number().over(Window.partitionBy(name).orderBy(F.col("source").asc_nulls_first(), term))
        return frame.withColumn("id", F.when(n == 1, name).otherwise(F.concat(name, F.lit("_"), (n - 1).cast("string"))))

    if cooccurrences:
        both = cooccurrence(d, source_property, source_graph, vocab).select(F.col("source").alias("src"), F.col("class").alias("of"), "classes", "properties")
        cls = cls.join(both, F.col("source").eqNullSafe(F.col("src")) & (F.col("class") == F.col("of")), "left").drop("src", "of")
    whole = F.col("source").isNull()
    cls = cls.join(class_examples(d, vocab), "class", "left").withColumn("example", F.when(whole, F.col("example")))
    prop = prop.join(property_examples(d), "property", "left").withColumn("example", F.when(whole, F.col("example")))
    dataset = F.concat(F.lit(ns), F.coalesce(local_name(F.col("source")), F.lit("all")))
    sets = src.withColumn("id", F.concat(F.lit(ns), F.coalesce(local_name(F.col("source")), F.lit("all"))))
    cls, prop = named(cls, "class"), named(prop, "property")
    number = {"entities": "void:entities", "triples": "void:triples", "tbox_triples": "voidx:tboxTriples", "abox_triples": "voidx:aboxTriples", "type_triples": "voidx:typeTriples", "same_as_triples": "voidx:sameAsTriples"}
    full = lambda n: vocab(n) if not n.startswith("voidx:") else ("urn:voidx:" if not vocab.short else "voidx:") + n[6:]

    def literal(c, dt: str):
        return F.struct(c.cast("string").alias("o"), F.lit(LITERAL).alias("k"), F.lit(vocab(dt)).alias("dt"))

    def iri(c):
        return F.struct(c.cast("string").alias("o"), F.lit(IRI).alias("k"), F.lit(None).cast("string").alias("dt"))

    def emit(frame: DataFrame, facts: list) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(full(p)).alias("p"), o.alias("x")) for p, o in facts])
        out = frame.select("id", F.explode(rows).alias("f")).where("f.x.o IS NOT NULL AND NOT (f.x.k = 2 AND f.x.o IN ('0', '0.0', ''))")
        return out.select(
            F.col("id").alias("s"), F.lit(IRI).cast("tinyint").alias("s_kind"), F.col("f.p").alias("p"), F.col("f.x.o").alias("o"), F.col("f.x.k").cast("tinyint").alias("o_kind"),
            F.lit(None).cast("string").alias("o_lang"), F.col("f.x.dt").alias("o_dt"), F.lit(None).cast("string").alias("g"), F.lit(None).cast("tinyint").alias("g_kind"),
        )

    counts = [(number[c], literal(F.col(c), "xsd:long")) for c in number]
    flags = F.concat(F.when(F.col("functional"), "F").otherwise(""), F.when(F.col("inverse_functional"), "I").otherwise(""))
    letter = F.when(F.col("detected_type") == "owl:DatatypeProperty", "D").when(F.col("detected_type") == "owl:ObjectProperty", "O").otherwise("P")
    label = lambda t, n, extra: F.concat(local_name(F.col(t)), F.lit(" ("), F.col(n).cast("string"), extra, F.lit(")"))
    terms = [("void:classes", literal(F.col("classes"), "xsd:long")), ("void:properties", literal(F.col("properties"), "xsd:long"))] if cooccurrences else []
    example = ("voidx:example", literal(F.col("example"), "xsd:string"))

    def links(frame: DataFrame, term: str, partition: str) -> DataFrame:
        """Dataset to partition, and term to partition."""
        own = frame.select(F.col("id").alias("part"), dataset.alias("id"), F.col(term).alias("term"), whole.alias("whole"))
        named_by = own.select("part", F.col("term").alias("id"), "whole")
        return emit(own, [(partition, iri(F.col("part")))]).unionByName(
            emit(named_by, [("voidx:globalStats", iri(F.when(F.col("whole"), F.col("part")))), ("voidx:sourceStats", iri(F.when(~F.col("whole"), F.col("part"))))])
        )

    return (
        emit(sets, [("rdf:type", iri(F.lit(full("void:Dataset")))), ("voidx:source", iri(F.col("source"))), *counts, *terms])
        .unionByName(links(cls, "class", "void:classPartition")).unionByName(links(prop, "property", "void:propertyPartition"))
        .unionByName(emit(cls, [("rdf:type", iri(F.lit(full("void:Dataset")))), ("void:class", iri(F.col("class"))), ("voidx:source", iri(F.col("source"))), ("voidx:label", literal(label("class", "entities", F.lit("")), "xsd:string")), *counts, *terms, ("voidx:averageProperties", literal(F.col("average_properties"), "xsd:double")), example]))
        .unionByName(emit(prop, [
            ("rdf:type", iri(F.lit(full("void:Dataset")))), ("void:property", iri(F.col("property"))), ("voidx:source", iri(F.col("source"))), ("voidx:label", literal(label("property", "triples", F.concat(F.lit(", "), letter, flags)), "xsd:string")),
            ("void:entities", literal(F.col("entities"), "xsd:long")), ("void:triples", literal(F.col("triples"), "xsd:long")), ("void:properties", literal(F.lit(1), "xsd:long")),
            ("void:distinctSubjects", literal(F.col("distinct_subjects"), "xsd:long")), ("void:distinctObjects", literal(F.col("distinct_objects"), "xsd:long")), example,
        ]))
    )
