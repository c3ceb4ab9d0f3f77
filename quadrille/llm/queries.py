"""Queries of the llm problems with their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, components, distinct, leak, seen, split
from quadrille.operators.hotjoin import hot_join
from quadrille.storage import read


def p1_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with bounds of all groups, and next to them the stored day sketches they are merged from."""
    store = distinct.PartialStore(spark)
    store.append(read(spark, sf_dir, "stat_records"))
    return distinct.counts_with_partials(store)


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_counts(read(spark, sf_dir, "stat_records"))


def p1_within_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group's exact count, and whether it lies within the reported bounds."""
    r = read(spark, sf_dir, "stat_records").select(F.to_date("seen_at").alias("day"), "predicate", "rec_type", F.lower("subject").alias("subject"))
    held = [F.when(F.grouping(d) == 0, d) for d in distinct.DIMS]
    exact = r.cube(*distinct.DIMS).agg(F.countDistinct("subject").alias("n_exact"), F.concat_ws(",", *held).alias("grouped"))
    counts, by = p1_counts(spark, sf_dir), ["grouped", *distinct.DIMS]
    both = exact.alias("e").join(counts.alias("c"), [F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by], "full")
    return both.select(*[F.col(f"e.{c}") for c in by], "n_exact", F.coalesce(F.col("n_exact").between(F.col("low"), F.col("high")), F.lit(False)).alias("within"))


def p1_day_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily sketches as stored: one record per group and matrix row, bits by MD5."""
    return distinct.day_partials(read(spark, sf_dir, "stat_records"), hashed=distinct.md5_hash)


def p1_sketch_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits set in every group's merged sketch, hashed by MD5 so that SQL can do the same."""
    partials = distinct.day_partials(read(spark, sf_dir, "stat_records"), hashed=distinct.md5_hash)
    by = ["grouped", *distinct.DIMS]
    return distinct.all_groups(partials).groupBy(*by).agg(F.sum(F.bit_count("bits")).cast("long").alias("bits_set"))


def _coded(spark: SparkSession, sf_dir: str):
    """Rows, key columns and position; ``sesame:nil`` and null are the same graph."""
    rows = read(spark, sf_dir, "coded_quads").select("seq_no", "subj", "pred", "obj", "ctx")
    nil = read(spark, sf_dir, "dict_terms").where("term = 'sesame:nil'").select(F.col("code").alias("ctx")).distinct()
    codes = [r[0] for r in nil.limit(seen.FEW + 1).collect()]
    if len(codes) <= seen.FEW:
        ctx = F.when(F.col("ctx").isin(codes), None).otherwise(F.col("ctx")) if codes else F.col("ctx")
    else:  # a dictionary that repeats the term this often
        rows = hot_join(rows.where("ctx IS NOT NULL"), nil.withColumn("nil", F.lit(True)), "ctx").drop("nil").withColumn("ctx", F.lit(None).cast("int")).unionByName(
            rows.join(nil, "ctx", "left_anti").select(*rows.columns)
        )
        ctx = F.col("ctx")
    return rows, [F.col("subj"), F.col("pred"), F.col("obj"), ctx], F.col("seq_no")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.seen_before(*_coded(spark, sf_dir)).withColumnRenamed("pos", "seq_no")


def p2_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong answers with 60-bit hashes, measured; MD5, so that SQL can do the same."""
    return seen.error_rate(*_coded(spark, sf_dir), hashed=seen.md5_hash)


def p2_error_rate_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with hashes of 16 bits, of which many keys share one."""
    return seen.error_rate(*_coded(spark, sf_dir), hash_bits=16, hashed=seen.md5_hash)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "quads").where((F.col("p") == "owl:sameAs") & F.col("o_kind").isin(0, 1) & (F.col("s") != F.col("o")))
    return q.select(F.col("s").alias("a"), F.col("o").alias("b"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_groups(_links(spark, sf_dir)).select("rep", F.col("member").alias("linked"))


def p4_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_found(spark, sf_dir).groupBy("rep").agg((F.count(F.lit(1)) + 1).alias("n_terms"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(read(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as its ids spell it."""
    return bpe.decode_corpus(bpe.encode_corpus(read(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "test_items").select("item_id", F.col("item_text").alias("text")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(read(spark, sf_dir, "documents")).where("piece_no = 0").select("doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_distinct_counts, p1_counts, p1_within_bounds, p1_day_partials, p1_sketch_bits, p2_found, p2_error_rate, p2_error_rate_short, p4_found, p4_group_sizes, p8_ids, p8_round_trip, p9_found,
        p10_found, p10_pieces,
    )
}

_HASH = "CAST('0x' || substr(md5(lower(subject)), 1, 15) AS BIGINT)"
_RANK = f"CASE WHEN ({_HASH} >> 12) = 0 THEN 47 ELSE bit_count((({_HASH} >> 12) & -({_HASH} >> 12)) - 1) END"
_GROUPED = "concat_ws(',', CASE WHEN grouping(day) = 0 THEN 'day' END, CASE WHEN grouping(predicate) = 0 THEN 'predicate' END, CASE WHEN grouping(rec_type) = 0 THEN 'rec_type' END)"
_SEEN = (
    "WITH nil AS (SELECT code FROM dict_terms WHERE term = 'sesame:nil'), k AS (SELECT seq_no, subj, pred, obj, CASE WHEN ctx IN (SELECT code FROM nil) THEN NULL ELSE ctx END ctx FROM coded_quads), "
    "m AS (SELECT seq_no, min(seq_no) OVER (PARTITION BY subj, pred, obj, ctx) first_no FROM k) "
)


def _rates(bits: int, digits: int) -> str:
    """The rates in SQL: ``digits`` hexadecimal digits of the key's MD5 are its hash."""
    return (
        _SEEN + f", t AS (SELECT m.seq_no, first_no, md5(concat_ws('|', k.subj, k.pred, k.obj, coalesce(CAST(k.ctx AS VARCHAR), '~'))) h FROM m JOIN k ON k.seq_no = m.seq_no), "
        f"w AS (SELECT *, min(seq_no) OVER (PARTITION BY substr(h, 1, {digits})) first_h FROM t) SELECT {bits} hash_bits, count(*) n_rows, count(*) FILTER (WHERE seq_no > first_no) n_seen, "
        "count(DISTINCT first_no) n_keys, count(*) FILTER (WHERE seq_no = first_no AND seq_no > first_h) wrong_by_hash, count(*) FILTER (WHERE seq_no = first_no AND seq_no > first_h) / count(*) rate_by_hash, "
        "count(*) FILTER (WHERE h LIKE '%0') n_checked, CAST(0 AS BIGINT) wrong_verified, 0.0::DOUBLE rate_verified FROM w"
    )


_GROUPS = (
    "WITH RECURSIVE e AS (SELECT s a, o b FROM quads WHERE p = 'owl:sameAs' AND o_kind IN (0, 1) AND s <> o UNION SELECT o, s FROM quads WHERE p = 'owl:sameAs' AND o_kind IN (0, 1) AND s <> o), "
    "reach AS (SELECT a member, a seed FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.a = e.a AND f.b < e.a) UNION SELECT e.b, r.seed FROM reach r JOIN e ON e.a = r.member), "
    "g AS (SELECT member, min(seed) rep FROM reach GROUP BY member) "
)
# NFKC as far as it tells words apart in these texts: wide digits.
_WORDS = "regexp_extract_all(lower(translate(nfc_normalize({}), '０１２３４５６７８９', '0123456789')), '[\\p{{L}}\\p{{Nd}}]+')"
_SPANS = "SELECT {id}, hash(w[k:k+11]) h FROM (SELECT {id}, w, unnest(range(1, len(w) - 10)) k FROM (SELECT {id}, " + _WORDS + " w FROM {table} WHERE {text} IS NOT NULL) WHERE len(w) >= 12)"
ORACLE = {
    "p9_found": f"SELECT DISTINCT item_id, doc_id FROM ({_SPANS.format('text', id='doc_id', table='documents', text='text')}) JOIN ({_SPANS.format('item_text', id='item_id', table='test_items', text='item_text')}) USING (h)",
    "p1_day_partials": f"SELECT CAST(seen_at AS DATE) \"day\", predicate, rec_type, CAST(CASE WHEN subject IS NULL THEN 0 ELSE {_HASH} & 4095 END AS INTEGER) \"row\", "
    f"bit_or(CASE WHEN subject IS NULL THEN 0 ELSE CAST(1 AS BIGINT) << CAST({_RANK} AS INTEGER) END) bits FROM stat_records GROUP BY 1, 2, 3, 4",
    "p1_sketch_bits": f"WITH r AS (SELECT CAST(seen_at AS DATE) AS day, predicate, rec_type, CASE WHEN subject IS NULL THEN NULL ELSE ({_HASH} & 4095) * 64 + {_RANK} END AS cell FROM stat_records) "
    f"SELECT {_GROUPED} grouped, day, predicate, rec_type, count(DISTINCT cell) bits_set FROM r GROUP BY CUBE (day, predicate, rec_type)",
    "p2_found": _SEEN + "SELECT seq_no FROM m WHERE seq_no > first_no",
    "p2_error_rate": _rates(64, 15),
    "p2_error_rate_short": _rates(16, 4),
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p1_within_bounds": f"SELECT {_GROUPED} grouped, day, predicate, rec_type, count(DISTINCT lower(subject)) n_exact, true AS within "
    "FROM (SELECT CAST(seen_at AS DATE) AS day, predicate, rec_type, subject FROM stat_records) GROUP BY CUBE (day, predicate, rec_type)",
    "p4_found": _GROUPS + "SELECT rep, member linked FROM g WHERE member <> rep",
    "p4_group_sizes": _GROUPS + "SELECT rep, count(*) n_terms FROM g GROUP BY rep",
}
