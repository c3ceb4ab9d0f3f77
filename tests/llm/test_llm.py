"""The llm problems against brute force: nulls, ties, repeats, empties, extra columns."""

import random
import unicodedata

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.llm import bpe, components, distinct, leak, seen, split
from quadrille.llm.lexicon import Lexicon

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.parse_ranks(bpe.vocabulary())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


# -- 1 -----------------------------------------------------------------------------------------------


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(1)
    outside, errors = 0, []
    for n in [1, 2, 5, 40, 300, 2000, 20_000, 300_000] * 6:
        h = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        row, high = (h & np.uint64(4095)).astype(int), h >> np.uint64(12)
        low = np.where(high == 0, 1 << 47, high & (~high + np.uint64(1)))
        rank = np.minimum(np.log2(low.astype(float)).astype(int), 47)
        cells = np.zeros((4096, 48), bool)
        cells[row, rank] = True
        est, se = distinct.most_likely(cells.sum(axis=0)[None, :])
        outside += abs(est[0] - n) > 3 * se[0] + 1
        errors.append(abs(est[0] - n) / n)
    assert outside <= 2 and max(errors) < 0.06


def test_distinct_counts_groups_nulls_and_merge(spark):
    data = [(f"2026-01-0{1 + i % 3} 10:00:00", i % 2, None if i % 2 else i % 4, ("AB" if i % 5 else "ab") + str(i % 37)) for i in range(400)]
    data += [("2026-01-09 00:00:00", 9, 9, None), (None, None, None, "x"), (None, None, None, "X")] + data[:50]
    df = spark.createDataFrame(data, "seen_at string, predicate int, rec_type int, subject string").withColumn("seen_at", F.to_timestamp("seen_at")).withColumn("row", F.lit(1))
    got = {(r["grouped"], str(r["day"]), r["predicate"], r["rec_type"]): r for r in distinct.distinct_counts(df).collect()}
    want: dict = {}
    for t, p, k, s in data:
        day = t[:10] if t else "None"
        for mask in range(8):
            key = (",".join(d for i, d in enumerate(distinct.DIMS) if mask >> i & 1), day if mask & 1 else "None", p if mask & 2 else None, k if mask & 4 else None)
            want.setdefault(key, set()).update([s.lower()] if s else [])
    assert set(got) == set(want)
    for key, subjects in want.items():
        assert got[key]["low"] <= len(subjects) <= got[key]["high"] and abs(got[key]["estimate"] - len(subjects)) < 2
    parts = distinct.day_partials(df)
    halves = [distinct.day_partials(df.where(c)) for c in ("predicate = 0", "predicate <> 0 OR predicate IS NULL")]
    by = list(distinct.DIMS)
    assert rows(distinct.merge(*halves, by=by), *by, "row", "bits") == rows(parts, *by, "row", "bits")
    assert distinct.distinct_counts(df.limit(0)).count() == 0
    # Appended in batches, some of it twice, the store gives the same partial results and counts.
    store = distinct.PartialStore(spark)
    for c in ("predicate = 0", "predicate <> 0 OR predicate IS NULL", "predicate = 9 OR rec_type = 2"):
        store.append(df.where(c))
    both = distinct.counts_with_partials(store)
    assert rows(both.where("bits IS NOT NULL"), *by, "row", "bits") == rows(parts, *by, "row", "bits")
    assert {(r["grouped"], str(r["day"]), r["predicate"], r["rec_type"]): r["estimate"] for r in both.where("bits IS NULL").collect()} == {k: r["estimate"] for k, r in got.items()}
    assert {str(r["day"]) for r in store.read("2026-01-02", "2026-01-03").select("day").distinct().collect()} == {"2026-01-02", "2026-01-03"}


def test_a_million_and_more_members(spark):
    ids = spark.range(0, 3_000_000, 1, 4).withColumn("g", F.when(F.col("id") < 1_200_000, 1).otherwise(2)).select("g", F.col("id").cast("string").alias("x"))
    got = {r["g"]: r for r in distinct.estimate(distinct.sketch(ids, F.col("x"), {"g": F.col("g")}), ["g"]).collect()}
    for g, n in ((1, 1_200_000), (2, 1_800_000)):
        assert got[g]["low"] <= n <= got[g]["high"] and abs(got[g]["estimate"] / n - 1) < 0.035 and got[g]["std_error"] / n < 0.012


# -- 2 -----------------------------------------------------------------------------------------------

KEYED = "pos long, a int, b string, h int"


def feed(spark, data, **options):
    df = spark.createDataFrame([(p, a, b, 1) for p, a, b in data], KEYED)
    return sorted(r["pos"] if r["pos"] is not None else -1 for r in seen.seen_before(df, [F.col("a"), F.col("b")], F.col("pos"), **options).collect())


@pytest.mark.parametrize("bits", [64, 3])
def test_seen_against_brute_force(spark, bits):
    rnd = random.Random(2)
    data = [(i, rnd.choice([None, 1, 2, 3]), rnd.choice([None, "", "x", "y" * 2000])) for i in range(300)]
    data += [(i, 7, "hot") for i in range(300, 450)]
    first: dict = {}
    for p, a, b in data:
        first.setdefault((a, b), p)
    assert feed(spark, data, batches=5, hash_bits=bits) == [p for p, a, b in data if p > first[a, b]]


def test_seen_ties_nulls_and_empty(spark):
    assert feed(spark, [(5, 1, "a"), (5, 1, "a"), (6, 1, "a"), (6, 1, "a"), (5, 1, "b")], batches=2) == [6, 6]
    assert feed(spark, [(None, 1, "a"), (None, 1, "a"), (3, 1, "a")]) == [3]
    assert feed(spark, []) == []
    df = spark.createDataFrame([(i, i % 200, "k", 1) for i in range(400)], KEYED)
    for hashed in (None, seen.md5_hash):
        r = seen.error_rate(df, [F.col("a"), F.col("b")], F.col("pos"), hash_bits=4, hashed=hashed).first()
        assert (r["n_rows"], r["n_seen"], r["n_keys"], r["wrong_verified"]) == (400, 200, 200, 0) and r["wrong_by_hash"] >= 184 and r["n_checked"] > 0
    assert seen.error_rate(df.limit(0), [F.col("a")], F.col("pos")).first()["n_keys"] == 0


def test_error_rate_verifies_every_row(spark, monkeypatch):
    df, key, fed = spark.createDataFrame([(i, i % 200, "k", 1) for i in range(400)], KEYED), [F.col("a"), F.col("b")], seen.feed
    last = F.substring(F.md5(seen.key_text(key)), -1, 1)
    odd = [r["pos"] for r in df.where(last != seen.CHECKED).select("pos").orderBy("pos").collect()]
    missed, invented = odd[-1], odd[0]  # a seen row the store forgets, a first row it calls seen
    monkeypatch.setattr(seen, "feed", lambda *a: fed(*a).where(F.col("pos") != missed).unionByName(spark.createDataFrame([(invented,)], "pos long")))
    r = seen.error_rate(df, key, F.col("pos")).first()
    assert (r["wrong_verified"], r["rate_verified"]) == (2, 2 / 400)
    # All answers wrong.
    monkeypatch.setattr(seen, "feed", lambda *a: fed(*a).select((F.col("pos") - 200).alias("pos")))
    r = seen.error_rate(df, key, F.col("pos")).first()
    assert (r["wrong_verified"], r["rate_verified"]) == (400, 1.0)
    # Keys that look alike as text, rows that share a position, null positions: nothing is wrong.
    monkeypatch.setattr(seen, "feed", fed)
    data = [(i, str(i), "a|b", "c") for i in range(20)] + [(20 + i, str(i), "a", "b|c") for i in range(20)] + [(40 + i, None, "~", str(i)) for i in range(20)] + [(60 + i, "~", None, str(i)) for i in range(20)]
    data += [(9, "9", "a|b", "c"), (90, "9", "a|b", "c"), (90, "9", "a|b", "c"), (90, "x", "y", "z"), (None, "x", "y", "z"), (None, "x", "y", "z"), (None, "v", "w", "u")]
    r = seen.error_rate(spark.createDataFrame(data, "pos long, a string, b string, c string"), [F.col("a"), F.col("b"), F.col("c")], F.col("pos"), batches=3).first()
    assert (r["n_rows"], r["n_seen"], r["n_keys"], r["wrong_verified"]) == (87, 3, 82, 0)


def test_store_reopened_fences_and_order(spark, tmp_path):
    path, key = f"file://{tmp_path}/store", [F.col("id")]
    of = lambda a, b: spark.range(a, b)
    kinds = ["bigint"]
    store = seen.SeenStore(spark, path, kinds, blocks=8)
    for k in range(5):  # five runs become two by merges of merges
        assert store.probe(store.prepare(of(100 * k, 100 * k + 150), key, F.col("id"))).count() == (50 if k else 0)
    again = seen.SeenStore(spark, path, kinds)
    assert again.blocks == 8 and sum(e["rows"] for e in again.state["runs"]) == 550
    again.compact()
    assert [e["level"] for e in again.state["runs"]] == [2, 0]
    # A few keys reach a few blocks: the others aren't read.
    few = again.prepare(of(3, 5), key, F.col("id"))
    reach = {str(r[0]): [r[1], r[2]] for r in few.groupBy("block").agg(F.min("h"), F.max("h")).collect()}
    part = again._within(again.state["runs"][0], reach)
    with seen._runs_as_written(spark):
        probe = few.repartition(8, "block").join(part.hint("merge"), again.cols)
        plan = probe._sc._jvm.PythonSQLUtils.explainString(probe._jdf.queryExecution(), "formatted")
    assert f"SelectedBucketsCount: {len(reach)} out of 8" in plan and len(reach) < 8
    assert plan.count("- Sort (") == 1 and plan.count("- Exchange (") == 1  # the batch's
    assert sorted(r["pos"] for r in again.probe(few, add=False).collect()) == [3, 4]
    # Each block is one file sorted by hash, and a probe plans no sort above a run.
    import pyarrow.parquet as pq

    for e in again.state["runs"]:
        files = sorted((tmp_path / "store" / e["name"]).glob("*.parquet"))
        assert len({f.name.split("_")[-1].split(".")[0] for f in files}) == len(files)
        for f in files:
            h = pq.read_table(f)["h"].to_pylist()
            assert h == sorted(h)
    with pytest.raises(ValueError):
        seen.SeenStore(spark, path, ["string"])


def test_hot_key_in_a_store(spark, tmp_path):
    store = seen.SeenStore(spark, f"file://{tmp_path}/hot", ["int"], blocks=4)
    rows_of = lambda a, b: spark.range(a, b).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 7 ELSE int(id) END k")
    first = sorted(r["pos"] for r in store.probe(store.prepare(rows_of(0, 900), [F.col("k")], F.col("id"))).collect())
    assert first == [i for i in range(900) if i % 3 and i > 1]
    second = sorted(r["pos"] for r in store.probe(store.prepare(rows_of(900, 1800), [F.col("k")], F.col("id"))).collect())
    assert second == [i for i in range(900, 1800) if i % 3]


# -- 4 -----------------------------------------------------------------------------------------------


def groups(pairs):
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return sorted((n, find(n)) for n in up if find(n) != n)


def test_groups_against_brute_force(spark):
    rnd = random.Random(4)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(70)] + [("hub", f"s{i}") for i in range(300)] + [(f"x{rnd.randrange(60)}", f"x{rnd.randrange(60)}") for _ in range(45)]
    pairs += [("é", "z"), ("Z", "z"), ("self", "self"), (None, "q"), ("c3", "c1"), ("c1", "c3"), ("c1", "c3")]
    rnd.shuffle(pairs)
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], "a string, b string, hi string, n int")
    assert rows(components.connected_groups(df), "member", "rep") == sorted(groups(pairs), key=str)
    assert components.connected_groups(df.limit(0)).count() == 0


# -- 8 -----------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_merging_is_exact(text):
    data = test_merging_is_exact.__dict__.setdefault("ranks", bpe.parse_ranks(bpe.vocabulary()))
    enc = test_merging_is_exact.__dict__.setdefault("enc", tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=data, special_tokens={}))
    text = text.encode("utf-8", "ignore").decode()
    _, _, ids, _ = bpe.Encoder(data, None).encode([text])
    assert ids.tolist() == (enc.encode_ordinary(text) if text else [])


def test_lexicon_round_trip(tmp_path):
    rnd = random.Random(1)
    words = {bytes(rnd.choices(b"abcde", k=rnd.randrange(0, 8))): [rnd.randrange(99) for _ in range(rnd.randrange(1, 4))] for _ in range(2000)}
    path = tmp_path / "lexicon"
    path.write_bytes(Lexicon.build(words.items()).to_bytes())
    lex = Lexicon.open(str(path))
    asked = [*words, *(bytes(rnd.choices(b"abcdef", k=rnd.randrange(0, 9))) for _ in range(2000))]
    assert all((lex.ids_of(n) == words[w]) if w in words else n == -1 for w, n in zip(asked, lex.lookup(asked).tolist()))
    assert len(lex.key) < sum(map(len, words)) / 2  # prefixes and suffixes are shared
    assert Lexicon.build([]).lookup([b"", b"a"]).tolist() == [-1, -1]


TEXTS = [None, "", " ", "Hello world", "<|endoftext|> is text", "naïve café é", "\r\n\r\n x", "日本語" * 50, "a" * 3000, " " * 2000, "don't 123's", "Hello world"]


@pytest.mark.parametrize("limit", [5, 1000])
def test_encode_corpus(spark, reference, limit):
    df = spark.createDataFrame([(i if i else None, t, i) for i, t in enumerate(TEXTS)], "doc_id int, text string, ids int")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_corpus(df, limit=limit).collect()}
    assert got == {i if i else None: reference.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# -- 9 -----------------------------------------------------------------------------------------------


def shares(a, b, span=12):
    x, y = leak.text_words(a), leak.text_words(b)
    grams = {tuple(x[i : i + span]) for i in range(len(x) - span + 1)}
    return any(tuple(y[i : i + span]) in grams for i in range(len(y) - span + 1))


def test_leaks_against_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta", "épée", "straße", "x1", "Ünder", "twelve", "no"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([5, 12, 25])))) for i in range(25)] + [(25, None), (26, ""), (27, " ".join(["same"] * 30))]
    docs = []
    for d in range(100, 180):
        own = [word() for _ in range(rnd.randrange(0, 60))]
        if d % 3 == 0:
            src = (items[rnd.randrange(25)][1] or "").split()
            a = rnd.randrange(0, max(1, len(src) - 11))
            own[10:10] = [w.upper() if rnd.random() < 0.3 else unicodedata.normalize("NFD", w) for w in src[a : a + rnd.choice([11, 12, 20])]]
        docs.append((d, rnd.choice([" ", ", ", " -- "]).join(own), 1))
    docs += [(500, None, 1), (501, "", 1), (502, " ".join(["same"] * 5000), 1), (100, "same " * 12, 1), (None, "same " * 12, 1)]
    ddf = spark.createDataFrame(docs, "doc_id int, text string, fp int")
    idf = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id int, text string, pos int")
    want = sorted({(i, d) for i, t in items for d, x, _ in docs if d is not None and shares(t, x)}, key=str)
    assert len(want) > 8 and rows(leak.leaks(ddf, idf)) == want
    assert leak.leaks(ddf.limit(0), idf).count() == 0 and leak.leaks(ddf, idf.limit(0)).count() == 0


# -- 10 ----------------------------------------------------------------------------------------------


def test_pieces_cover_overlap_and_end_well(spark, reference):
    para = "The quick brown fox jumps over the lazy dog near the old harbour wall. It was late, and nobody saw it.\n\n"
    texts = [None, "", "short", para * 80, "word " * 3000, "日本語の文です。" * 700, " " * 1_500_000, "nospace" * 1500, ("Line one goes on and on\r\n" * 30 + "\r\n") * 30, "é" * 2500]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got: dict = {}
    for r in split.split_oversized(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    whole = {i: reference.encode_ordinary(t) for i, t in enumerate(texts) if t and i != 6}
    assert set(got) - {6} == {i for i, x in whole.items() if len(x) > 1024}
    for i, pieces in got.items():
        pieces.sort(key=lambda r: r["piece_no"])
        ids = whole.get(i)
        assert [r["piece_no"] for r in pieces] == list(range(len(pieces)))
        back = list(pieces[0]["ids"])
        for a, b in zip(pieces, pieces[1:]):
            assert list(b["ids"][:64]) == list(a["ids"][-64:]) and b["first_token"] == a["stop_token"] - 64
            back += b["ids"][64:]
        assert all(len(r["ids"]) <= 1024 for r in pieces) and (ids is None or back == ids)
    ends = lambda i: {r["ends_at"] for r in got[i][:-1]}
    assert ends(3) == {"paragraph"} and ends(4) == {"word"} and ends(5) == {"sentence"} and ends(7) == {"anywhere"}
    text = reference.decode(list(got[9][0]["ids"]))
    assert "�" not in text  # cut between characters
    for r in got[3][:-1]:
        assert reference.decode(list(r["ids"])).endswith("saw it.")


def sentence_ends(text):
    return [m.end() for m in split.STOP.finditer(text) if split.ends_sentence(text, m.start(), m.end())]


@pytest.mark.parametrize(
    "text",
    [
        "He met Dr. Smith at 5 p.m. near No. 7 harbour: the toll was due.| Then it rained.| ",
        "Am 3. März kam Prof. Dr. Huber, z.B. mit 2.5 Tonnen, bzw. mehr.| Das war 1998.| Gut?| Ja!| ",
        "M. Dupont a dit : « Oui. »| Ensuite, J. R. Tolk est parti ... et voilà.| 日本。|語。|",
        "It fell, e.g. by ca. 10 per cent.| \"Really?\"| asked Mrs. Low.| See fig. 3, sec. IV. of the act.| ",
    ],
)
def test_sentence_ends(text):
    plain, want = "", []
    for part in text.split("|")[:-1]:
        plain += part
        want.append(len(plain))
    plain += text.split("|")[-1]
    assert sentence_ends(plain + " ") == want


def test_recursion_through_the_levels(reference):
    """Each piece ends at the highest level that the limit leaves an end of."""
    text = "One two. Three four.\n\nFive six seven.\n\n\n\nEight nine ten eleven twelve. " + "x" * 60 + " end"
    words = bpe.cutter()(text)
    ids = [reference.encode_ordinary(w) for w in words]
    size, flat = np.array([len(i) for i in ids]), np.array([x for i in ids for x in i])
    token = [reference.decode_single_token_bytes(i) for i in range(50_000)]
    got = split.split_text(text, words, size, flat, token, limit=10, overlap=2)
    assert [split.LEVELS[k] for _, _, k in got][:2] == ["paragraph", "section"] and {"word", "anywhere"} <= {split.LEVELS[k] for _, _, k in got}
    for first, stop, _ in got:
        assert stop - first <= 10
    assert got[-1][1] == len(flat) and all(b[0] == a[1] - 2 for a, b in zip(got, got[1:]))


def test_colons_end_no_sentence():
    ends = sentence_ends
    assert ends("Frage 16,432: welche? Question 39 : quelle. «Note:» then. ") == [21, 43, 57]
    assert len(ends("Բարև: Այո։ ")) == 2


def test_split_small_limits(spark):
    df = spark.createDataFrame([(1, "one two three. Four five six.\n\nseven eight nine ten eleven")], "doc_id int, text string")
    got = split.split_oversized(df, limit=6, overlap=2).orderBy("piece_no").collect()
    assert got[0]["ends_at"] == "sentence" and got[-1]["stop_token"] == sum(len(r["ids"]) for r in got) - 2 * (len(got) - 1)
    with pytest.raises(ValueError):
        split.split_oversized(df, limit=4, overlap=4)
