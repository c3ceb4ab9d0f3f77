"""RDFS closure in a few joins: the schema is closed first, the data follow without iteration.

With the hierarchies transitively closed, every statement reaches all its super-properties in one
join, every use of a property all classes of its domain and range in another, and every type all
super-classes in a third.  Only the tail about classes and properties themselves (rdfs6, 8, 10, 12, 13)
needs rounds, over distinct classes and properties.  Inferred statements stay in the graph of the
statement they come from.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.model import FULL, IRI, LITERAL, QUAD, Vocabulary, as_quads, quads
from quadrille.operators.closure import transitive
from quadrille.operators.hotjoin import small
from quadrille.storage import Scratch

RULES = "rdfd2 rdfs1 rdfs2 rdfs3 rdfs4a rdfs4b rdfs5 rdfs6 rdfs7 rdfs8 rdfs9 rdfs10 rdfs11 rdfs12 rdfs13".split()
#: Domains and ranges of the vocabulary, as (property, domain, range).
SIGNATURES = [
    ("rdf:type", "rdfs:Resource", "rdfs:Class"), ("rdfs:domain", "rdf:Property", "rdfs:Class"), ("rdfs:range", "rdf:Property", "rdfs:Class"),
    ("rdfs:subPropertyOf", "rdf:Property", "rdf:Property"), ("rdfs:subClassOf", "rdfs:Class", "rdfs:Class"), ("rdfs:member", "rdfs:Resource", "rdfs:Resource"),
    ("rdf:subject", "rdf:Statement", "rdfs:Resource"), ("rdf:predicate", "rdf:Statement", "rdfs:Resource"), ("rdf:object", "rdf:Statement", "rdfs:Resource"),
    ("rdf:first", "rdf:List", "rdfs:Resource"), ("rdf:rest", "rdf:List", "rdf:List"), ("rdfs:seeAlso", "rdfs:Resource", "rdfs:Resource"),
    ("rdfs:isDefinedBy", "rdfs:Resource", "rdfs:Resource"), ("rdfs:comment", "rdfs:Resource", "rdfs:Literal"), ("rdfs:label", "rdfs:Resource", "rdfs:Literal"), ("rdf:value", "rdfs:Resource", "rdfs:Resource"),
]
SUBCLASSES = [("rdf:Alt", "rdfs:Container"), ("rdf:Bag", "rdfs:Container"), ("rdf:Seq", "rdfs:Container"), ("rdfs:ContainerMembershipProperty", "rdf:Property"), ("rdfs:Datatype", "rdfs:Class")]


def decompose_owl(tbox: DataFrame, vocab: Vocabulary = FULL) -> DataFrame:
    """The RDFS part of OWL axioms: classes, properties, equivalences, inverses, unions, intersections."""
    v, t = vocab, as_quads(tbox)
    typed = t.where(F.col("p") == v("rdf:type"))
    classes = typed.where(F.col("o").isin(v("owl:Class"), v("owl:Restriction"))).withColumn("o", F.lit(v("rdfs:Class")))
    kinds = [v(f"owl:{k}Property") for k in ("Object", "Datatype", "Annotation", "Functional", "InverseFunctional", "Symmetric", "Asymmetric", "Transitive", "Reflexive", "Irreflexive")]
    props = typed.where(F.col("o").isin(kinds)).withColumn("o", F.lit(v("rdf:Property")))

    def both(prop: str, sub: str) -> DataFrame:
        eq = t.where((F.col("p") == v(prop)) & (F.col("o_kind") < LITERAL)).withColumn("p", F.lit(v(sub)))
        back = eq.select(F.col("o").alias("s"), F.col("o_kind").alias("s_kind"), "p", F.col("s").alias("o"), F.col("s_kind").alias("o_kind"), *QUAD[5:])
        return eq.unionByName(back)

    inv = t.where(F.col("p") == v("owl:inverseOf")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    inv = inv.unionByName(inv.select(F.col("b").alias("a"), F.col("a").alias("b")))
    swap = {v("rdfs:domain"): v("rdfs:range"), v("rdfs:range"): v("rdfs:domain")}
    sig = t.where(F.col("p").isin(list(swap))).join(inv, F.col("s") == F.col("a"))
    flipped = sig.withColumn("s", F.col("b")).withColumn("s_kind", F.lit(IRI).cast("tinyint")).withColumn("p", F.when(F.col("p") == v("rdfs:domain"), v("rdfs:range")).otherwise(v("rdfs:domain"))).select(*QUAD)
    scratch = Scratch(tbox.sparkSession, "owl")
    rest = transitive(t.where(F.col("p") == v("rdf:rest")).select(F.col("s").alias("a"), F.col("o").alias("b")), scratch, reflexive=True)
    first = t.where((F.col("p") == v("rdf:first")) & (F.col("o_kind") < LITERAL)).select(F.col("s").alias("cell"), F.col("o").alias("member"), F.col("o_kind").alias("member_kind"))
    heads = t.where(F.col("p").isin(v("owl:unionOf"), v("owl:intersectionOf"))).select("s", "s_kind", "p", F.col("o").alias("list"), "g", "g_kind")
    cells = heads.join(rest, F.col("list") == F.col("a"), "left").withColumn("cell", F.coalesce("b", "list")).join(first, "cell")
    sub, none = F.lit(v("rdfs:subClassOf")), F.lit(None).cast("string")
    union = cells.where(F.col("p") == v("owl:unionOf")).select(F.col("member").alias("s"), F.col("member_kind").alias("s_kind"), sub.alias("p"), F.col("s").alias("o"), F.col("s_kind").alias("o_kind"), none.alias("o_lang"), none.alias("o_dt"), "g", "g_kind")
    inter = cells.where(F.col("p") == v("owl:intersectionOf")).select("s", "s_kind", sub.alias("p"), F.col("member").alias("o"), F.col("member_kind").alias("o_kind"), none.alias("o_lang"), none.alias("o_dt"), "g", "g_kind")
    for extra in (classes, props, both("owl:equivalentClass", "rdfs:subClassOf"), both("owl:equivalentProperty", "rdfs:subPropertyOf"), flipped, union, inter):
        t = t.unionByName(extra.select(*QUAD))
    return t.distinct()


def rdfs(
    df: DataFrame, tbox: DataFrame | None = None, exclude: Iterable[str] = (), decompose: bool = False, drop_bnode_types: bool = False, emit_tbox: str | None = None, vocab: Vocabulary = FULL,
) -> DataFrame:
    """The input with its RDFS inferences under the schema ``tbox`` (the input's own if null), each once.

    ``exclude`` names rules to leave out (unknown names are errors), ``decompose`` adds the RDFS part of OWL
    axioms, ``drop_bnode_types`` leaves out types that are blank nodes, ``emit_tbox`` adds the closed
    schema ('' in the default graph, an IRI in that graph).
    """
    off = {x.lower() for x in exclude}
    if off - set(RULES):
        raise ValueError(f"unknown rules: {sorted(off - set(RULES))}")
    on = lambda r: r not in off
    v, spark, scratch = vocab, df.sparkSession, Scratch(df.sparkSession, "rdfs")
    df = as_quads(df)
    schema = as_quads(df if tbox is None else tbox)
    schema = scratch.table(schema.where(F.col("p").isin([v(x) for x in ("rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range")])) if not decompose else decompose_owl(schema, v))
    pick = lambda p: schema.where((F.col("p") == v(p)) & (F.col("o_kind") < LITERAL)).select(F.col("s").alias("a"), F.col("o").alias("b"), F.col("o_kind").alias("bk"))
    axiom = lambda rows: spark.createDataFrame([(v(a), v(b), 0) for a, b in rows], "a string, b string, bk tinyint")
    sub_p = pick("rdfs:subPropertyOf").unionByName(axiom([("rdfs:isDefinedBy", "rdfs:seeAlso")]))
    sub_c = pick("rdfs:subClassOf").unionByName(axiom(SUBCLASSES))
    class_kind = sub_c.select("b", "bk").distinct()
    sp = transitive(sub_p, scratch) if on("rdfs5") else scratch.table(sub_p.select("a", "b").distinct())
    sc = transitive(sub_c, scratch) if on("rdfs11") else scratch.table(sub_c.select("a", "b").distinct())
    dom = scratch.table(pick("rdfs:domain").unionByName(axiom([(p, d) for p, d, _ in SIGNATURES])).distinct())
    rng = scratch.table(pick("rdfs:range").unionByName(axiom([(p, r) for p, _, r in SIGNATURES])).distinct())
    sc = scratch.table(sc.join(class_kind, "b", "left").withColumn("bk", F.coalesce("bk", F.lit(0).cast("tinyint"))))
    # The closed schema is joined to every statement by predicate or class, of which few hold most rows: broadcast if a count allows.
    by_p, by_class, by_dom, by_rng = small(sp), small(sc), small(dom), small(rng)
    type_, none = v("rdf:type"), F.lit(None).cast("string")

    def fact(frame: DataFrame, s: Column, sk: Column, p: Column | str, o: Column | str, ok: Column | int = IRI) -> DataFrame:
        col = lambda x: F.lit(x) if not isinstance(x, Column) else x
        return frame.select(s.alias("s"), sk.cast("tinyint").alias("s_kind"), col(p).alias("p"), col(o).alias("o"), col(ok).cast("tinyint").alias("o_kind"), none.alias("o_lang"), none.alias("o_dt"), "g", "g_kind")

    iri0, s, sk, o, ok = F.lit(IRI), F.col("s"), F.col("s_kind"), F.col("o"), F.col("o_kind")
    resource = ok < LITERAL

    def stratum(data: DataFrame) -> DataFrame:
        """Everything the closed schema gives for ``data``; each step is written once, as it is read often."""
        props = data
        if on("rdfs7"):
            props = data.unionByName(data.join(by_p, F.col("p") == F.col("a")).withColumn("p", F.col("b")).select(*QUAD))
        props = scratch.table(props.distinct())
        types = [props.where((F.col("p") == type_) & resource)]
        # Domains and ranges only look at what a type comes from, each once.
        uses = props.select("s", "s_kind", "p", "g", "g_kind").distinct()
        if on("rdfs2"):
            types.append(fact(uses.join(by_dom, F.col("p") == F.col("a")), s, sk, type_, F.col("b"), F.col("bk")))
        if on("rdfs3"):
            ends = props.where(resource).select("p", "o", "o_kind", "g", "g_kind").distinct()
            types.append(fact(ends.join(by_rng, F.col("p") == F.col("a")), o, ok, type_, F.col("b"), F.col("bk")))
        if on("rdfs4a"):
            types.append(fact(uses.select("s", "s_kind", "g", "g_kind").distinct(), s, sk, type_, v("rdfs:Resource")))
        if on("rdfs4b"):
            types.append(fact(props.where(resource), o, ok, type_, v("rdfs:Resource")))
        if on("rdfd2"):
            types.append(fact(props.select("p", "g", "g_kind").distinct(), F.col("p"), iri0, type_, v("rdf:Property")))
        if on("rdfs1"):
            types.append(fact(props.where("o_dt IS NOT NULL").select("o_dt", "g", "g_kind").distinct(), F.col("o_dt"), iri0, type_, v("rdfs:Datatype")))
        typed = scratch.table(reduce(DataFrame.unionByName, types).distinct())
        out = props.unionByName(typed)
        if on("rdfs9"):
            out = out.unionByName(fact(typed.join(by_class, o == F.col("a")), s, sk, type_, F.col("b"), F.col("bk")))
        return out.distinct()

    def tail(data: DataFrame) -> DataFrame:
        """Statements about classes and properties that the types in ``data`` call for."""
        is_ = lambda c: (F.col("p") == type_) & (o == v(c))
        rows = []
        if on("rdfs6"):
            rows.append(fact(data.where(is_("rdf:Property")), s, sk, v("rdfs:subPropertyOf"), s, sk))
        if on("rdfs8"):
            rows.append(fact(data.where(is_("rdfs:Class")), s, sk, v("rdfs:subClassOf"), v("rdfs:Resource")))
        if on("rdfs10"):
            rows.append(fact(data.where(is_("rdfs:Class")), s, sk, v("rdfs:subClassOf"), s, sk))
        if on("rdfs12"):
            rows.append(fact(data.where(is_("rdfs:ContainerMembershipProperty")), s, sk, v("rdfs:subPropertyOf"), v("rdfs:member")))
        if on("rdfs13"):
            rows.append(fact(data.where(is_("rdfs:Datatype")), s, sk, v("rdfs:subClassOf"), v("rdfs:Literal")))
        # A class used as a type is one by the range of rdf:type.
        if on("rdfs3"):
            rows.append(fact(data.where((F.col("p") == type_) & resource), o, ok, type_, v("rdfs:Class")))
        if on("rdfs9"):
            subs = data.where((F.col("p") == type_) & (o == v("rdfs:Datatype")))
            rows.append(fact(subs, s, sk, type_, v("rdfs:Class")))
        out = quads(spark, [])
        for r in rows:
            out = out.unionByName(r)
        return out.distinct()

    meta = [v(x) for x in ("rdfs:Class", "rdf:Property", "rdfs:Datatype", "rdfs:ContainerMembershipProperty")]
    known = [scratch.table(stratum(df))]
    delta = known[0].where((F.col("p") == type_) & resource)
    # Only the distinct classes and the types of classes and properties matter for the tail.
    delta = fact(delta.select("o", "o_kind", "g", "g_kind").distinct(), o, ok, type_, v("rdfs:Class")).unionByName(delta.where(o.isin(meta))).distinct() if on("rdfs3") else delta.where(o.isin(meta))
    while True:
        data = known[0]
        for k in known[1:]:
            data = data.unionByName(k)
        fresh = stratum(scratch.table(tail(delta).unionByName(delta).distinct()))
        fresh = scratch.table(fresh)
        # Only what is known of the same subjects - classes and properties - can be the same.
        data = data.join(small(scratch.table(fresh.select("s").distinct())), "s", "left_semi").select(*QUAD)
        cond = [data[c].eqNullSafe(fresh[c]) for c in QUAD]
        new, n = scratch.counted(fresh.join(data, cond, "left_anti"))
        if not n["rows"]:
            break
        known.append(new)
        delta = new.where((F.col("p") == type_) & resource)
    out = known[0]
    for k in known[1:]:
        out = out.unionByName(k)
    if emit_tbox is not None:
        where = F.lit(emit_tbox or None).cast("string")
        closed = sp.select(F.col("a").alias("s"), F.lit(v("rdfs:subPropertyOf")).alias("p"), F.col("b").alias("o"), F.lit(0).alias("bk")).unionByName(sc.select(F.col("a").alias("s"), F.lit(v("rdfs:subClassOf")).alias("p"), F.col("b").alias("o"), "bk"))
        for frame, name in ((dom, "rdfs:domain"), (rng, "rdfs:range")):
            closed = closed.unionByName(frame.select(F.col("a").alias("s"), F.lit(v(name)).alias("p"), F.col("b").alias("o"), "bk"))
        graph = closed.withColumn("g", where).withColumn("g_kind", F.when(F.col("g").isNotNull(), 0).cast("tinyint"))
        out = out.unionByName(fact(graph, F.col("s"), F.when(F.col("s").startswith("_:"), 1).otherwise(0), F.col("p"), F.col("o"), F.col("bk"))).distinct()
    if drop_bnode_types:
        out = out.where(~((F.col("p") == type_) & (F.col("o_kind") == 1)))
    return out
