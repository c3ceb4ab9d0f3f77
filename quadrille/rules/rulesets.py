"""The standard rulesets: rhodf, rdfs, horst (pD*) and owl2rl, as published by their papers and W3C tables.

Rules over RDF lists of any length use helper statements under ``urn:quadrille:`` that never
leave the engine: a property chain has a pair relation for what each list cell begins, a key of three
properties or more one for the pairs that agree on all properties before a cell.  Rules that find an inconsistency mark a member with owl:Nothing.
"""

from __future__ import annotations

from quadrille.model import FULL, Vocabulary
from quadrille.rules.engine import HELPER
from quadrille.rules.model import Rule, parse_rules

RHODF = """
rhodf-2a : ?a rdfs:subPropertyOf ?c <- ?a rdfs:subPropertyOf ?b ; ?b rdfs:subPropertyOf ?c
rhodf-2b : ?x ?b ?y <- ?a rdfs:subPropertyOf ?b ; ?x ?a ?y
rhodf-3a : ?a rdfs:subClassOf ?c <- ?a rdfs:subClassOf ?b ; ?b rdfs:subClassOf ?c
rhodf-3b : ?x a ?b <- ?a rdfs:subClassOf ?b ; ?x a ?a
rhodf-4a : ?x a ?c <- ?p rdfs:domain ?c ; ?x ?p ?y
rhodf-4b : ?y a ?c <- ?p rdfs:range ?c ; ?x ?p ?y
rhodf-6a : ?p rdfs:subPropertyOf ?p <- ?x ?p ?y
rhodf-6b : ?a rdfs:subPropertyOf ?a ; ?b rdfs:subPropertyOf ?b <- ?a rdfs:subPropertyOf ?b
rhodf-6c : rdfs:subPropertyOf rdfs:subPropertyOf rdfs:subPropertyOf ; rdfs:subClassOf rdfs:subPropertyOf rdfs:subClassOf ; rdfs:domain rdfs:subPropertyOf rdfs:domain ; rdfs:range rdfs:subPropertyOf rdfs:range ; a rdfs:subPropertyOf a <-
rhodf-6d1 : ?p rdfs:subPropertyOf ?p <- ?p rdfs:domain ?c
rhodf-6d2 : ?p rdfs:subPropertyOf ?p <- ?p rdfs:range ?c
rhodf-7a : ?a rdfs:subClassOf ?a ; ?b rdfs:subClassOf ?b <- ?a rdfs:subClassOf ?b
rhodf-7b1 : ?c rdfs:subClassOf ?c <- ?p rdfs:domain ?c
rhodf-7b2 : ?c rdfs:subClassOf ?c <- ?p rdfs:range ?c
rhodf-7b3 : ?c rdfs:subClassOf ?c <- ?x a ?c
"""

_AXIOMS = """
axioms-domain : a rdfs:domain rdfs:Resource ; rdfs:domain rdfs:domain rdf:Property ; rdfs:range rdfs:domain rdf:Property ; rdfs:subPropertyOf rdfs:domain rdf:Property ; rdfs:subClassOf rdfs:domain rdfs:Class ; rdf:first rdfs:domain rdf:List ; rdf:rest rdfs:domain rdf:List ; rdf:subject rdfs:domain rdf:Statement ; rdf:predicate rdfs:domain rdf:Statement ; rdf:object rdfs:domain rdf:Statement ; rdfs:member rdfs:domain rdfs:Resource ; rdfs:seeAlso rdfs:domain rdfs:Resource ; rdfs:isDefinedBy rdfs:domain rdfs:Resource ; rdfs:comment rdfs:domain rdfs:Resource ; rdfs:label rdfs:domain rdfs:Resource ; rdf:value rdfs:domain rdfs:Resource ; rdf:_1 rdfs:domain rdfs:Resource <-
axioms-range : a rdfs:range rdfs:Class ; rdfs:domain rdfs:range rdfs:Class ; rdfs:range rdfs:range rdfs:Class ; rdfs:subPropertyOf rdfs:range rdf:Property ; rdfs:subClassOf rdfs:range rdfs:Class ; rdf:rest rdfs:range rdf:List ; rdfs:comment rdfs:range rdfs:Literal ; rdfs:label rdfs:range rdfs:Literal ; rdf:subject rdfs:range rdfs:Resource ; rdf:predicate rdfs:range rdfs:Resource ; rdf:object rdfs:range rdfs:Resource ; rdfs:member rdfs:range rdfs:Resource ; rdf:first rdfs:range rdfs:Resource ; rdfs:seeAlso rdfs:range rdfs:Resource ; rdfs:isDefinedBy rdfs:range rdfs:Resource ; rdf:value rdfs:range rdfs:Resource ; rdf:_1 rdfs:range rdfs:Resource <-
axioms-classes : rdf:Alt rdfs:subClassOf rdfs:Container ; rdf:Bag rdfs:subClassOf rdfs:Container ; rdf:Seq rdfs:subClassOf rdfs:Container ; rdfs:ContainerMembershipProperty rdfs:subClassOf rdf:Property ; rdfs:Datatype rdfs:subClassOf rdfs:Class ; rdf:XMLLiteral a rdfs:Datatype ; rdfs:isDefinedBy rdfs:subPropertyOf rdfs:seeAlso ; rdf:nil a rdf:List ; rdf:_1 a rdfs:ContainerMembershipProperty ; rdf:XMLLiteral rdfs:subClassOf rdfs:Literal ; rdf:type a rdf:Property ; rdf:subject a rdf:Property ; rdf:predicate a rdf:Property ; rdf:object a rdf:Property ; rdf:first a rdf:Property ; rdf:rest a rdf:Property ; rdf:value a rdf:Property ; rdf:_1 a rdf:Property <-
"""
_RDFS = """
rdf1 : ?p a rdf:Property <- ?x ?p ?y
rdfs2 : ?x a ?c <- ?p rdfs:domain ?c ; ?x ?p ?y ; ?c != rdfs:Resource
rdfs3 : ?y a ?c <- ?p rdfs:range ?c ; ?x ?p ?y ; ?c != rdfs:Resource
rdfs4a : ?x a rdfs:Resource <- ?x ?p ?y
rdfs4b : ?y a rdfs:Resource <- ?x ?p ?y
rdfs5 : ?a rdfs:subPropertyOf ?c <- ?a rdfs:subPropertyOf ?b ; ?b rdfs:subPropertyOf ?c
rdfs6 : ?p rdfs:subPropertyOf ?p <- ?p a rdf:Property
rdfs7 : ?x ?b ?y <- ?a rdfs:subPropertyOf ?b ; ?x ?a ?y
rdfs8 : ?c rdfs:subClassOf rdfs:Resource <- ?c a rdfs:Class
rdfs9 : ?x a ?b <- ?a rdfs:subClassOf ?b ; ?x a ?a
rdfs10 : ?c rdfs:subClassOf ?c <- ?c a rdfs:Class
rdfs11 : ?a rdfs:subClassOf ?c <- ?a rdfs:subClassOf ?b ; ?b rdfs:subClassOf ?c
rdfs12 : ?p rdfs:subPropertyOf rdfs:member <- ?p a rdfs:ContainerMembershipProperty
rdfs13 : ?d rdfs:subClassOf rdfs:Literal <- ?d a rdfs:Datatype
"""
RDFS = _AXIOMS + _RDFS

HORST = (
    RDFS
    + """
axioms-owl : owl:FunctionalProperty rdfs:subClassOf rdf:Property ; owl:InverseFunctionalProperty rdfs:subClassOf rdf:Property ; owl:SymmetricProperty rdfs:subClassOf rdf:Property ; owl:TransitiveProperty rdfs:subClassOf rdf:Property ; owl:equivalentClass rdfs:subPropertyOf rdfs:subClassOf ; owl:equivalentProperty rdfs:subPropertyOf rdfs:subPropertyOf ; owl:sameAs a rdf:Property ; owl:differentFrom a rdf:Property ; owl:inverseOf a rdf:Property ; owl:equivalentClass a rdf:Property ; owl:equivalentProperty a rdf:Property ; owl:inverseOf rdfs:domain rdf:Property ; owl:inverseOf rdfs:range rdf:Property ; owl:equivalentClass rdfs:domain owl:Class ; owl:equivalentClass rdfs:range owl:Class ; owl:equivalentProperty rdfs:domain rdf:Property ; owl:equivalentProperty rdfs:range rdf:Property ; owl:disjointWith rdfs:domain owl:Class ; owl:disjointWith rdfs:range owl:Class ; owl:onProperty rdfs:domain owl:Restriction ; owl:onProperty rdfs:range rdf:Property ; owl:hasValue rdfs:domain owl:Restriction ; owl:someValuesFrom rdfs:domain owl:Restriction ; owl:someValuesFrom rdfs:range owl:Class ; owl:allValuesFrom rdfs:domain owl:Restriction ; owl:allValuesFrom rdfs:range owl:Class ; owl:Restriction rdfs:subClassOf owl:Class <-
rdfp1 : ?y owl:sameAs ?z <- ?p a owl:FunctionalProperty ; ?x ?p ?y ; ?x ?p ?z ; ?y != ?z
rdfp2 : ?x owl:sameAs ?z <- ?p a owl:InverseFunctionalProperty ; ?x ?p ?y ; ?z ?p ?y ; ?x != ?z
rdfp3 : ?y ?p ?x <- ?p a owl:SymmetricProperty ; ?x ?p ?y
rdfp4 : ?x ?p ?z <- ?p a owl:TransitiveProperty ; ?x ?p ?y ; ?y ?p ?z
rdfp5a : ?x owl:sameAs ?x <- ?x ?p ?y
rdfp5b : ?y owl:sameAs ?y <- ?x ?p ?y
rdfp6 : ?y owl:sameAs ?x <- ?x owl:sameAs ?y
rdfp7 : ?x owl:sameAs ?z <- ?x owl:sameAs ?y ; ?y owl:sameAs ?z
rdfp8a : ?y ?q ?x <- ?p owl:inverseOf ?q ; ?x ?p ?y
rdfp8b : ?y ?p ?x <- ?p owl:inverseOf ?q ; ?x ?q ?y
rdfp9 : ?x rdfs:subClassOf ?y <- ?x a rdfs:Class ; ?x owl:sameAs ?y
rdfp10 : ?x rdfs:subPropertyOf ?y <- ?x a rdf:Property ; ?x owl:sameAs ?y
rdfp11a : ?z ?p ?y <- ?x owl:sameAs ?z ; ?x ?p ?y ; ?x != ?z
rdfp11b : ?x ?p ?z <- ?y owl:sameAs ?z ; ?x ?p ?y ; ?y != ?z
rdfp12a : ?x rdfs:subClassOf ?y <- ?x owl:equivalentClass ?y
rdfp12b : ?y rdfs:subClassOf ?x <- ?x owl:equivalentClass ?y
rdfp12c : ?x owl:equivalentClass ?y <- ?x rdfs:subClassOf ?y ; ?y rdfs:subClassOf ?x
rdfp13a : ?x rdfs:subPropertyOf ?y <- ?x owl:equivalentProperty ?y
rdfp13b : ?y rdfs:subPropertyOf ?x <- ?x owl:equivalentProperty ?y
rdfp13c : ?x owl:equivalentProperty ?y <- ?x rdfs:subPropertyOf ?y ; ?y rdfs:subPropertyOf ?x
rdfp14a : ?x a ?r <- ?r owl:hasValue ?v ; ?r owl:onProperty ?p ; ?x ?p ?v
rdfp14b : ?x ?p ?v <- ?r owl:hasValue ?v ; ?r owl:onProperty ?p ; ?x a ?r
rdfp15 : ?x a ?r <- ?r owl:someValuesFrom ?c ; ?r owl:onProperty ?p ; ?x ?p ?y ; ?y a ?c
rdfp16 : ?y a ?c <- ?r owl:allValuesFrom ?c ; ?r owl:onProperty ?p ; ?x a ?r ; ?x ?p ?y
"""
)

_OWL_EQUALITY = """
eq-ref : ?x owl:sameAs ?x ; ?p owl:sameAs ?p ; ?y owl:sameAs ?y <- ?x ?p ?y
eq-sym : ?y owl:sameAs ?x <- ?x owl:sameAs ?y
eq-trans : ?x owl:sameAs ?z <- ?x owl:sameAs ?y ; ?y owl:sameAs ?z
eq-rep-s : ?z ?p ?y <- ?x owl:sameAs ?z ; ?x ?p ?y ; ?x != ?z
eq-rep-p : ?x ?q ?y <- ?p owl:sameAs ?q ; ?x ?p ?y ; ?p != ?q
eq-rep-o : ?x ?p ?z <- ?y owl:sameAs ?z ; ?x ?p ?y ; ?y != ?z
eq-diff1 : ?x a owl:Nothing <- ?x owl:sameAs ?y ; ?x owl:differentFrom ?y
eq-diff2 : ?x a owl:Nothing <- ?d a owl:AllDifferent ; ?d owl:members ?l ; ?l q:member ?x ; ?l q:member ?y ; ?x owl:sameAs ?y ; ?x != ?y
eq-diff3 : ?x a owl:Nothing <- ?d a owl:AllDifferent ; ?d owl:distinctMembers ?l ; ?l q:member ?x ; ?l q:member ?y ; ?x owl:sameAs ?y ; ?x != ?y
"""
_OWL = """
list-first : ?l q:member ?x <- ?l rdf:first ?x
list-rest : ?l q:member ?x <- ?l rdf:rest ?m ; ?m q:member ?x
cax-sco : ?x a ?b <- ?a rdfs:subClassOf ?b ; ?x a ?a
cax-eqc1 : ?x a ?b <- ?a owl:equivalentClass ?b ; ?x a ?a
cax-eqc2 : ?x a ?a <- ?a owl:equivalentClass ?b ; ?x a ?b
cax-dw : ?x a owl:Nothing <- ?a owl:disjointWith ?b ; ?x a ?a ; ?x a ?b
cax-adc : ?x a owl:Nothing <- ?d a owl:AllDisjointClasses ; ?d owl:members ?l ; ?l q:member ?a ; ?l q:member ?b ; ?x a ?a ; ?x a ?b ; ?a != ?b
scm-cls : ?c rdfs:subClassOf ?c ; ?c owl:equivalentClass ?c ; ?c rdfs:subClassOf owl:Thing ; owl:Nothing rdfs:subClassOf ?c <- ?c a owl:Class
scm-sco : ?a rdfs:subClassOf ?c <- ?a rdfs:subClassOf ?b ; ?b rdfs:subClassOf ?c
scm-eqc1 : ?a rdfs:subClassOf ?b ; ?b rdfs:subClassOf ?a <- ?a owl:equivalentClass ?b
scm-eqc2 : ?a owl:equivalentClass ?b <- ?a rdfs:subClassOf ?b ; ?b rdfs:subClassOf ?a
scm-op : ?p rdfs:subPropertyOf ?p ; ?p owl:equivalentProperty ?p <- ?p a owl:ObjectProperty
scm-dp : ?p rdfs:subPropertyOf ?p ; ?p owl:equivalentProperty ?p <- ?p a owl:DatatypeProperty
scm-spo : ?a rdfs:subPropertyOf ?c <- ?a rdfs:subPropertyOf ?b ; ?b rdfs:subPropertyOf ?c
scm-eqp1 : ?a rdfs:subPropertyOf ?b ; ?b rdfs:subPropertyOf ?a <- ?a owl:equivalentProperty ?b
scm-eqp2 : ?a owl:equivalentProperty ?b <- ?a rdfs:subPropertyOf ?b ; ?b rdfs:subPropertyOf ?a
scm-dom1 : ?p rdfs:domain ?b <- ?p rdfs:domain ?a ; ?a rdfs:subClassOf ?b
scm-dom2 : ?q rdfs:domain ?c <- ?p rdfs:domain ?c ; ?q rdfs:subPropertyOf ?p
scm-rng1 : ?p rdfs:range ?b <- ?p rdfs:range ?a ; ?a rdfs:subClassOf ?b
scm-rng2 : ?q rdfs:range ?c <- ?p rdfs:range ?c ; ?q rdfs:subPropertyOf ?p
scm-hv : ?a rdfs:subClassOf ?b <- ?a owl:hasValue ?v ; ?a owl:onProperty ?p ; ?b owl:hasValue ?v ; ?b owl:onProperty ?q ; ?p rdfs:subPropertyOf ?q
scm-svf1 : ?a rdfs:subClassOf ?b <- ?a owl:someValuesFrom ?c ; ?a owl:onProperty ?p ; ?b owl:someValuesFrom ?d ; ?b owl:onProperty ?p ; ?c rdfs:subClassOf ?d
scm-svf2 : ?a rdfs:subClassOf ?b <- ?a owl:someValuesFrom ?c ; ?a owl:onProperty ?p ; ?b owl:someValuesFrom ?c ; ?b owl:onProperty ?q ; ?p rdfs:subPropertyOf ?q
scm-avf1 : ?a rdfs:subClassOf ?b <- ?a owl:allValuesFrom ?c ; ?a owl:onProperty ?p ; ?b owl:allValuesFrom ?d ; ?b owl:onProperty ?p ; ?c rdfs:subClassOf ?d
scm-avf2 : ?b rdfs:subClassOf ?a <- ?a owl:allValuesFrom ?c ; ?a owl:onProperty ?p ; ?b owl:allValuesFrom ?c ; ?b owl:onProperty ?q ; ?p rdfs:subPropertyOf ?q
scm-int : ?c rdfs:subClassOf ?x <- ?c owl:intersectionOf ?l ; ?l q:member ?x
scm-uni : ?x rdfs:subClassOf ?c <- ?c owl:unionOf ?l ; ?l q:member ?x
prp-dom : ?x a ?c <- ?p rdfs:domain ?c ; ?x ?p ?y
prp-rng : ?y a ?c <- ?p rdfs:range ?c ; ?x ?p ?y
prp-fp : ?y owl:sameAs ?z <- ?p a owl:FunctionalProperty ; ?x ?p ?y ; ?x ?p ?z ; ?y != ?z
prp-ifp : ?x owl:sameAs ?z <- ?p a owl:InverseFunctionalProperty ; ?x ?p ?y ; ?z ?p ?y ; ?x != ?z
prp-irp : ?x a owl:Nothing <- ?p a owl:IrreflexiveProperty ; ?x ?p ?x
prp-symp : ?y ?p ?x <- ?p a owl:SymmetricProperty ; ?x ?p ?y
prp-asyp : ?x a owl:Nothing <- ?p a owl:AsymmetricProperty ; ?x ?p ?y ; ?y ?p ?x
prp-trp : ?x ?p ?z <- ?p a owl:TransitiveProperty ; ?x ?p ?y ; ?y ?p ?z
prp-spo1 : ?x ?q ?y <- ?p rdfs:subPropertyOf ?q ; ?x ?p ?y
prp-spo2-1 : ?q rdfs:subPropertyOf ?p <- ?p owl:propertyChainAxiom ?l ; ?l rdf:first ?q ; ?l rdf:rest rdf:nil
prp-spo2-rest : ?m q:in q:chain <- ?p owl:propertyChainAxiom ?l ; ?l rdf:rest ?m ; ?m != rdf:nil
prp-spo2-rests : ?n q:in q:chain <- ?m q:in q:chain ; ?m rdf:rest ?n ; ?n != rdf:nil
prp-spo2-last : ?m q:chain ?q <- ?m q:in q:chain ; ?m rdf:first ?q ; ?m rdf:rest rdf:nil
prp-spo2-name : ?m q:chain ?u <- ?m q:in q:chain ; ?m rdf:rest ?n ; ?n != rdf:nil ; ?u := q:chain ?m
prp-spo2-step : ?x ?u ?z <- ?m q:chain ?u ; ?m rdf:first ?q ; ?m rdf:rest ?n ; ?n q:chain ?r ; ?x ?q ?y ; ?y ?r ?z
prp-spo2 : ?x ?p ?z <- ?p owl:propertyChainAxiom ?l ; ?l rdf:first ?q ; ?l rdf:rest ?m ; ?m q:chain ?r ; ?x ?q ?y ; ?y ?r ?z
prp-eqp1 : ?x ?q ?y <- ?p owl:equivalentProperty ?q ; ?x ?p ?y
prp-eqp2 : ?x ?p ?y <- ?p owl:equivalentProperty ?q ; ?x ?q ?y
prp-pdw : ?x a owl:Nothing <- ?p owl:propertyDisjointWith ?q ; ?x ?p ?y ; ?x ?q ?y
prp-adp : ?x a owl:Nothing <- ?d a owl:AllDisjointProperties ; ?d owl:members ?l ; ?l q:member ?p ; ?l q:member ?q ; ?x ?p ?y ; ?x ?q ?y ; ?p != ?q
prp-inv1 : ?y ?q ?x <- ?p owl:inverseOf ?q ; ?x ?p ?y
prp-inv2 : ?y ?p ?x <- ?p owl:inverseOf ?q ; ?x ?q ?y
prp-key-1 : ?x owl:sameAs ?y <- ?c owl:hasKey ?l ; ?l rdf:first ?p ; ?l rdf:rest rdf:nil ; ?x a ?c ; ?y a ?c ; ?x ?p ?v ; ?y ?p ?v ; ?x != ?y
prp-key-2 : ?x owl:sameAs ?y <- ?c owl:hasKey ?l ; ?l rdf:first ?p ; ?l rdf:rest ?m ; ?m rdf:first ?q ; ?m rdf:rest rdf:nil ; ?x ?p ?v ; ?y ?p ?v ; ?x ?q ?w ; ?y ?q ?w ; ?x a ?c ; ?y a ?c ; ?x != ?y
prp-key-third : ?n q:key ?u <- ?c owl:hasKey ?l ; ?l rdf:rest ?m ; ?m rdf:rest ?n ; ?n != rdf:nil ; ?u := q:key ?n
prp-key-rest : ?n q:key ?u <- ?m q:key ?t ; ?m rdf:rest ?n ; ?n != rdf:nil ; ?u := q:key ?n
prp-key-start : ?x ?u ?y <- ?c owl:hasKey ?l ; ?l rdf:first ?p ; ?l rdf:rest ?m ; ?m rdf:first ?q ; ?m rdf:rest ?n ; ?n q:key ?u ; ?x ?p ?v ; ?y ?p ?v ; ?x ?q ?w ; ?y ?q ?w ; ?x a ?c ; ?y a ?c ; ?x != ?y
prp-key-step : ?x ?t ?y <- ?n q:key ?u ; ?n rdf:first ?p ; ?n rdf:rest ?m ; ?m q:key ?t ; ?x ?u ?y ; ?x ?p ?v ; ?y ?p ?v
prp-key-end : ?x owl:sameAs ?y <- ?n q:key ?u ; ?n rdf:first ?p ; ?n rdf:rest rdf:nil ; ?x ?u ?y ; ?x ?p ?v ; ?y ?p ?v
prp-npa1 : ?x a owl:Nothing <- ?n owl:sourceIndividual ?x ; ?n owl:assertionProperty ?p ; ?n owl:targetIndividual ?y ; ?x ?p ?y
prp-npa2 : ?x a owl:Nothing <- ?n owl:sourceIndividual ?x ; ?n owl:assertionProperty ?p ; ?n owl:targetValue ?y ; ?x ?p ?y
cls-thing : owl:Thing a owl:Class ; owl:Nothing a owl:Class <-
prp-ap : rdfs:label a owl:AnnotationProperty ; rdfs:comment a owl:AnnotationProperty ; rdfs:seeAlso a owl:AnnotationProperty ; rdfs:isDefinedBy a owl:AnnotationProperty ; owl:deprecated a owl:AnnotationProperty ; owl:versionInfo a owl:AnnotationProperty ; owl:priorVersion a owl:AnnotationProperty ; owl:backwardCompatibleWith a owl:AnnotationProperty ; owl:incompatibleWith a owl:AnnotationProperty <-
dt-type1 : rdf:PlainLiteral a rdfs:Datatype ; rdf:XMLLiteral a rdfs:Datatype ; rdfs:Literal a rdfs:Datatype ; xsd:decimal a rdfs:Datatype ; xsd:integer a rdfs:Datatype ; xsd:nonNegativeInteger a rdfs:Datatype ; xsd:nonPositiveInteger a rdfs:Datatype ; xsd:positiveInteger a rdfs:Datatype ; xsd:negativeInteger a rdfs:Datatype ; xsd:long a rdfs:Datatype ; xsd:int a rdfs:Datatype ; xsd:short a rdfs:Datatype ; xsd:byte a rdfs:Datatype ; xsd:unsignedLong a rdfs:Datatype ; xsd:unsignedInt a rdfs:Datatype ; xsd:unsignedShort a rdfs:Datatype ; xsd:unsignedByte a rdfs:Datatype ; xsd:float a rdfs:Datatype ; xsd:double a rdfs:Datatype ; xsd:string a rdfs:Datatype ; xsd:normalizedString a rdfs:Datatype ; xsd:token a rdfs:Datatype ; xsd:language a rdfs:Datatype ; xsd:Name a rdfs:Datatype ; xsd:NCName a rdfs:Datatype ; xsd:NMTOKEN a rdfs:Datatype ; xsd:boolean a rdfs:Datatype ; xsd:hexBinary a rdfs:Datatype ; xsd:base64Binary a rdfs:Datatype ; xsd:anyURI a rdfs:Datatype ; xsd:dateTime a rdfs:Datatype ; xsd:dateTimeStamp a rdfs:Datatype <-
cls-int-end : ?y q:all ?l <- ?l rdf:first ?c ; ?l rdf:rest rdf:nil ; ?y a ?c
cls-int-step : ?y q:all ?l <- ?l rdf:first ?c ; ?l rdf:rest ?m ; ?y q:all ?m ; ?y a ?c
cls-int1 : ?y a ?c <- ?c owl:intersectionOf ?l ; ?y q:all ?l
cls-int2 : ?y a ?x <- ?c owl:intersectionOf ?l ; ?l q:member ?x ; ?y a ?c
cls-uni : ?y a ?c <- ?c owl:unionOf ?l ; ?l q:member ?x ; ?y a ?x
cls-com : ?x a owl:Nothing <- ?a owl:complementOf ?b ; ?x a ?a ; ?x a ?b
cls-svf1 : ?x a ?r <- ?r owl:someValuesFrom ?c ; ?r owl:onProperty ?p ; ?x ?p ?y ; ?y a ?c
cls-svf2 : ?x a ?r <- ?r owl:someValuesFrom owl:Thing ; ?r owl:onProperty ?p ; ?x ?p ?y
cls-avf : ?y a ?c <- ?r owl:allValuesFrom ?c ; ?r owl:onProperty ?p ; ?x a ?r ; ?x ?p ?y
cls-hv1 : ?x ?p ?v <- ?r owl:hasValue ?v ; ?r owl:onProperty ?p ; ?x a ?r
cls-hv2 : ?x a ?r <- ?r owl:hasValue ?v ; ?r owl:onProperty ?p ; ?x ?p ?v
cls-maxc1 : ?x a owl:Nothing <- ?r owl:maxCardinality "0"^^xsd:nonNegativeInteger ; ?r owl:onProperty ?p ; ?x a ?r ; ?x ?p ?y
cls-maxc2 : ?y owl:sameAs ?z <- ?r owl:maxCardinality "1"^^xsd:nonNegativeInteger ; ?r owl:onProperty ?p ; ?x a ?r ; ?x ?p ?y ; ?x ?p ?z ; ?y != ?z
cls-maxqc1 : ?x a owl:Nothing <- ?r owl:maxQualifiedCardinality "0"^^xsd:nonNegativeInteger ; ?r owl:onProperty ?p ; ?r owl:onClass ?c ; ?x a ?r ; ?x ?p ?y ; ?y a ?c
cls-maxqc2 : ?x a owl:Nothing <- ?r owl:maxQualifiedCardinality "0"^^xsd:nonNegativeInteger ; ?r owl:onProperty ?p ; ?r owl:onClass owl:Thing ; ?x a ?r ; ?x ?p ?y
cls-maxqc3 : ?y owl:sameAs ?z <- ?r owl:maxQualifiedCardinality "1"^^xsd:nonNegativeInteger ; ?r owl:onProperty ?p ; ?r owl:onClass ?c ; ?x a ?r ; ?x ?p ?y ; ?x ?p ?z ; ?y a ?c ; ?z a ?c ; ?y != ?z
cls-maxqc4 : ?y owl:sameAs ?z <- ?r owl:maxQualifiedCardinality "1"^^xsd:nonNegativeInteger ; ?r owl:onProperty ?p ; ?r owl:onClass owl:Thing ; ?x a ?r ; ?x ?p ?y ; ?x ?p ?z ; ?y != ?z
cls-oo : ?x a ?c <- ?c owl:oneOf ?l ; ?l q:member ?x
"""
OWL2RL = _OWL_EQUALITY + _OWL
_TEXTS = {"rhodf": RHODF, "rdfs": RDFS, "horst": HORST, "owl2rl": OWL2RL}


def _typed_constants(rules: list[Rule], vocab: Vocabulary) -> list[Rule]:
    """Datatypes inside constant literals are names too."""

    def fix(t: str) -> str:
        if t.startswith('"') and "^^" in t:
            label, _, dt = t.rpartition("^^")
            return f"{label}^^{vocab(dt)}"
        return t

    each = lambda ps: tuple(tuple(fix(t) for t in p) for p in ps)
    return [Rule(r.id, each(r.insert), each(r.where), each(r.delete), r.filters, r.fixpoint, r.phase, r.mints) for r in rules]


def ruleset(name: str, vocab: Vocabulary = FULL, equality: bool = True) -> list[Rule]:
    """A standard ruleset.  Without ``equality`` the replacement rules of owl2rl are left out: at scale
    canonicalise with ``smush`` first, which keeps one name per individual instead of all pairs."""
    text = _TEXTS[name]
    if name == "owl2rl" and not equality:
        text = _OWL
    return _typed_constants(parse_rules(text, vocab, {"q": HELPER}), vocab)
