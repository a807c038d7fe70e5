"""Each operator against SQL, a plain version or an exact round trip, and on odd tables."""

import base64
import hashlib
import inspect
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import ann, chat, common, cotrain, files, mixing, neardup, packing, repetition, sharding, tokenbin, tokens, warc
from pagequarry.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, kept boolean, rank string, size string, row string, place string, n_words string"
ODD = [
    (1, "a b c d e f g", "en", "s1", 13, 5, True, "x", "y", "z", "p", "w"), (2, "A b C d e f g", "en", "s1", 13, None, None, None, None, None, None, None),
    (3, None, None, None, None, 1, False, "", "", "", "", ""), (4, "", "en", "s2", 0, 1, True, "", "", "", "", ""), (5, " \t\n ", "en", "s2", 4, 1, True, "", "", "", "", ""),
    (6, "one two", "fr", "s2", 7, 1, True, "", "", "", "", ""), (7, "ONE two", "fr", None, 7, 1, True, "", "", "", "", ""), (8, "word " * 30000, "en", "s1", 150000, 1, True, "", "", "", "", ""),
    (9, "x y z " * 5 + "\nline\nline\n#$%", "de", "s3", 40, 1, True, "", "", "", "", ""), (None, "a b c d e f g", "en", "s1", 13, 1, True, "", "", "", "", ""),
    (1, "a b c d e f g", "en", "s1", 13, 5, True, "x", "y", "z", "p", "w"), (11, "it's 12 o'clock <|endoftext|> é你\U0001f600", "en", "s1", 30, 1, True, "", "", "", "", ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, duck, same, name):
    assert same(QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df())


# ------------------------------------------------------------------------ common


def test_feistel_is_a_bijection():
    for n in (1, 2, 3, 10, 1000, 1025):
        got = common.feistel(np.arange(n), n, 7)
        assert sorted(got.tolist()) == list(range(n))
        assert n < 10 or got.tolist() != list(range(n))


def test_word_hashes_are_those_of_words():
    texts = ["a b\taé ", "", None, "b", "a x \x0b q"]
    col = pa.array(texts)
    seen = {}
    for _, data, offsets in common.text_chunks(col, 4):
        start, end, h, bounds = common.hash_words(data, offsets)
        for a, b, x in zip(start, end, h):
            assert seen.setdefault(int(x), bytes(data[a:b])) == bytes(data[a:b])
    assert len(seen) == len({w for t in texts for w in words(t)})


def test_grouped_keeps_groups_whole(spark):
    df = spark.range(5000).withColumn("k", F.col("id") % 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        run = lambda rows, first: pa.RecordBatch.from_arrays([rows.column("k").take(pa.array(first[:-1])), pa.array(np.diff(first))], names=["k", "n"])
        got = common.grouped(df, "k", run, "k long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.k for r in got) == list(range(7)) and sum(r.n for r in got) == 5000


def test_running_start_on_hot_keys(spark):
    rows = [(0, None, i) for i in range(300)] + [(0, 5, 7)] * 250 + [(1, i, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, id long, v long").repartition(3)
    base = common.stored(common.collapsed(df).withColumn("place", common.hash52(F.col("id"))), "hot")
    got = common.running_start(base, "g", ["place", "id", "v"], F.col("v"), "s", rows_per_part=20, chunk=40)
    by = got.toPandas().sort_values(["g", "s", "v"], kind="stable")
    assert len(by) == len(rows) and sorted(by[(by.id == 5) & (by.g == 0)]["copy"]) == list(range(250))
    for _, g in by.groupby("g"):
        g = g.sort_values(["place", "id", "v", "copy"], na_position="first")
        assert g.s.tolist() == [0, *np.cumsum(g.v)[:-1]]
    spread = common.stored(base.repartitionByRange(8, "g", "place", "id", "v").withColumn("p", F.spark_partition_id()), "p").groupBy("p").count().toPandas()["count"]
    assert spread.max() <= 2 * spread.median()


def test_numbered_hot_keys(spark):
    rows = [("a", 1, i) for i in range(500)] + [("b", i % 30, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, j long, v long").repartition(6)
    hot = df.groupBy("k", "j").count().where("count > 40")
    for chunk, some in ((40, hot), (1000, hot.where("false"))):
        got = common.numbered(df, ["k", "j"], some, "n", chunk).toPandas()
        assert len(got) == 600 and sorted(got.v) == sorted(r[2] for r in rows)
        assert all(sorted(g.n) == list(range(len(g))) for _, g in got.groupby(["k", "j"]))


# ------------------------------------------------------------------------ mixing


def test_mix_of_null_ids_and_one_long_document(spark):
    rows = [(None, f"w{i % 40} b c", "s1", "x") for i in range(400)] + [(None, None, "s1", "x")] * 200 + [(1, "long " * 5000, "s2", "x"), (2, "a b", "s2", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n string").repartition(5)
    plan, again = (sorted(map(tuple, mixing.mix_plan(df).select("doc_id", "tie", "copy", "taken").collect()), key=str) for _ in range(2))
    assert plan == again and len(plan) == len(rows)
    whole, pieces = (sorted(map(tuple, mixing.mix(df, chunk=c).collect()), key=str) for c in (3, 10_000))
    assert whole == pieces and {r[2] for r in whole} == {"s1", "s2"} and {r[3] for r in whole} >= {"x"}
    assert all(r[1] for r in whole)


def test_mix(spark, data, odd, none):
    got = QUERIES["op1_mix"](spark, data).toPandas()
    src = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    src["size"] = src.text.map(lambda t: len(words(t)))
    total = src.groupby("source")["size"].sum().sort_index()
    want = mixing.water_fill(total.tolist(), [1 + i % 3 for i in range(len(total))], 3)
    assert abs(sum(want) - total.sum()) < 1e-6
    by = got.merge(src[["doc_id", "source"]], on="doc_id").groupby("source")
    assert np.allclose(by.target.first().to_numpy(), want)
    assert (abs(by.taken.sum().to_numpy() - np.array(want)) <= 1).all()
    assert (got.taken <= 3 * got["size"]).all() and len(got) == len(src)
    again = QUERIES["op1_mix"](spark, data).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    plan = mixing.mix_plan(odd).toPandas()
    assert len(plan) == len(ODD) and plan[plan["size"] == 0].taken.sum() == 0
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0 and mixed.subtract(odd).count() == 0


def test_water_fill_and_split():
    assert mixing.water_fill([10, 1000], [2, 1], 3) == [30.0, 980.0]
    assert mixing.water_fill([0, 0], [1, 2], 3) == [0.0, 0.0]
    blocks = np.array([5, 0, 100, 33])
    got = mixing.split_quota(blocks, 6, 1)
    assert (got.sum(axis=0) == blocks).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 1


# -------------------------------------------------------------------- near-dedup


def plain_components(docs, k, percent):
    sets, links = {}, []
    for i, (d, t) in enumerate(docs):
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and docs[a][0] is not None and docs[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
                root[find(a)] = find(b)
    return {i: (len(sets[i]), min((docs[j][0] for j in sets if docs[j][0] is not None and find(j) == find(i)), default=None)) for i in sets}


def near_copies(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t))
    rng.shuffle(out)
    return [(i + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("options", [{}, {"leaf_docs": 3}, {"leaf_docs": 4, "leaf_shingles": 200}])
def test_neardup_against_all_pairs(spark, options):
    docs = near_copies()
    want = plain_components(docs, 5, 80)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()}
    for i, (d, _) in enumerate(docs):
        assert (got[d].n_shingles, got[d].component_id) == want[i]
        assert got[d].kept == (d == want[i][1])


def test_design_of_trees():
    assert neardup.design(85) == (10, 24, 10) and neardup.design(80)[2] == 8 and neardup.design(100)[0] == 1
    for percent in range(30, 101, 5):
        trees, positions, least = neardup.design(percent)
        t = percent / 100
        assert (1 - t * (1 - (1 - t) ** 2) ** 3) ** trees <= 5e-7 and trees <= positions
        assert sum(neardup.math.comb(positions, i) * t**i * (1 - t) ** (positions - i) for i in range(least)) <= 5e-7
    with pytest.raises(ValueError):
        neardup.design(20)


@pytest.mark.parametrize("percent", [40, 50])
def test_neardup_at_low_thresholds(spark, percent):
    docs = near_copies(9)
    docs = [(i, " ".join(t.split()[: 40 + i % 30])) for i, t in docs]
    want = plain_components(docs, 2, percent)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, percent, leaf_docs=8).collect()}
    assert all((got[d].n_shingles, got[d].component_id) == want[i] for i, (d, _) in enumerate(docs))


def test_neardup_large_family(spark):
    """A family far above the leaf limit, rows at its edge, and others that share its root tokens."""
    rng = random.Random(6)
    base = [f"f{i}" for i in range(150)]
    docs = []
    for k in range(260):
        t = list(base)
        for _ in range(k % 7):
            t[rng.randrange(150)] = f"x{k}"
        docs.append(" ".join(t))
    docs += [" ".join(base[: 60 + k % 90] + [f"y{k}_{j}" for j in range(40)]) for k in range(60)]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    want = plain_components(docs, 3, 85)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85, leaf_docs=16).collect()}
    assert all((got[d].n_shingles, got[d].component_id) == want[i] for i, (d, _) in enumerate(docs))


def shuffled(spark, run):
    """Bytes that the stages of ``run`` write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        every = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (every.apply(i) for i in range(every.size()))}

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(v for k, v in stages().items() if k not in before)


def few_copies(documents, length, family):
    """Texts of which one in ten has a near copy, and a family of near copies."""
    rng = random.Random(21)
    out = []
    for i in range(documents):
        t = [f"{rng.choice(['data', 'page', 'line', 'word'])}{rng.randrange(5000)}" for _ in range(length)]
        out += [t] if i % 10 else [t, [*t[:-1], "other"]]
    base = [f"f{i}" for i in range(length)]
    out += [[*base[:-1], f"x{k}"] for k in range(family)]
    rng.shuffle(out)
    return [(i + 1, " ".join(t)) for i, t in enumerate(out)]


def test_neardup_moves_little(spark):
    """The families stage and the sets of leaves cost a fraction of the texts (0.35 times the texts before, 0.09 now)."""
    docs = few_copies(200, 3000, 60)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = []
    moved = shuffled(spark, lambda: got.extend(neardup.near_duplicates(table, 3, 85, leaf_docs=30).collect()))
    assert sum(not r.kept for r in got) == 20 + 59
    size = sum(len(t) for _, t in docs)
    assert moved < 0.2 * size


@pytest.mark.parametrize("bits", [10, 25])
def test_neardup_sifted(spark, monkeypatch, bits):
    """With many rows of leaves, texts are sifted first; a full filter only lets more pass."""
    monkeypatch.setattr(neardup, "FEW_MEMBERS", 0)
    monkeypatch.setattr(neardup, "FILTER_BITS", bits)
    docs = near_copies(4) + [(None, "a b c"), (-5, "one text " * 30), (-5, "another text of one id " * 9), (-4, "another text of one id " * 9)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_components(docs, 3, 85)
    got = neardup.near_duplicates(table, 3, 85, leaf_docs=8).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(str((d, want[i][0], want[i][1] if d is not None else None)) for i, (d, _) in enumerate(docs))
    ids = spark.createDataFrame([(i,) for i, _ in docs[:20]] + [(-5,)], "doc_id long")
    passed = [r.doc_id for r in neardup._sifted(table, ids).collect()]
    assert {i for i, _ in docs[:20]} <= set(passed) and passed.count(-5) == 2 and (bits == 10 or len(passed) == 22)


def test_neardup_sets_of_leaves():
    texts = ["One two  three\tfour two three four", "a", "word " * 500, "\u00e9t\u00e9" * 400, "x y"] + [t for _, t in near_copies(3)]
    column = pa.array(texts)
    sets = [s for _, data, offsets in common.text_chunks(column) for s in neardup.shingle_sets(data, offsets, 3)]
    bodies = [neardup._closed(np.frombuffer(t.encode(), dtype=np.uint8), s) for t, s in zip(texts, sets)]
    assert {b[-1:] for b in bodies} == {b"s", b"t"} and all(len(b) <= s.nbytes + 1 for b, s in zip(bodies, sets))
    for most in (1, 300, 1 << 20):
        got = list(neardup._opened(pa.array(bodies, pa.binary()), 3, most))
        assert len(got) == len(sets) and all(np.array_equal(a, b) for a, b in zip(got, sets))


def test_neardup_odd(odd, none):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd, 3, 85).collect()))
    want = plain_components([(r[0], r[1]) for r in ODD], 3, 85)
    expect = sorted(((r[0] or 0, want[i][0], want[i][1] if r[0] else None, r[0] in (None, want[i][1])) for i, r in enumerate(ODD)), key=str)
    assert sorted(got, key=str) == expect
    assert neardup.near_duplicates(none).count() == 0


def test_components_of_chain(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95)]
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 90, 90: 90, 95: 90}


# ---------------------------------------------------------------------- sharding


def test_sharding(spark, odd, none):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard(ids, sharding.tree_of(8), sharding.tree_of(9)).toPandas()
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) == {8} and abs(len(moved) / 20000 - 1 / 9) < 0.01
    assert got.groupby("shard").size().between(2300, 2700).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    tree = sharding.tree_of(8)
    heavier = [tree[0], (tree[1][0], 6.0, [tree[1][2][0], (tree[1][2][1][0], 4.0, [(6, 1.0), (7, 3.0)])])]
    both = sharding.shard(ids, tree, heavier).toPandas()
    swapped = both[both.shard != both.grown_shard]
    assert (swapped.grown_shard >= 4).all() and not swapped[swapped.shard == 7].grown_shard.isin([0, 1, 2, 3, 4, 5, 6]).any()
    odd_rows = sharding.shard(odd, tree, sharding.tree_of(9)).toPandas()
    assert len(odd_rows) == len(ODD) and odd_rows[odd_rows.doc_id == 3]["size"].item() == 1
    assert sharding.shard(none, tree).count() == 0


# -------------------------------------------------------------------- repetition


def plain_repeats(w):
    out = []
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            if i != j:
                k = 0
                while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def test_suffix_repeats_against_all_pairs():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randint(0, 30))] for _ in range(4)] + [[1] * 17]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = repetition.suffix_repeats(np.array([x for t in texts for x in t], dtype=np.uint64), bounds)
        assert got.tolist() == [x for t in texts for x in plain_repeats(t)]


def test_repetition_odd(odd, none):
    got = repetition.judged(repetition.repetition(odd, keep=["doc_id"])).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert (by[3].n_words, by[3].base_failed, by[3].kept) == (0, True, False)
    assert (by[8].n_words, by[8].n_repeat_words, by[8].longest_repeat) == (30000, 30000, 29999)
    assert (by[9].n_dup_lines, by[9].n_symbols) == (1, 3)
    assert repetition.repetition(none).count() == 0


# -------------------------------------------------------------------------- warc

PAGES = "page_id long, url string, html string, payload string, size string, range string"


def test_warc_round_trip(spark, data):
    pages = [(i, f"http://x/{i}", f"<p>{i % 4}</p>" * (i % 4), "", "", "") for i in range(40)] + [(50, None, None, "", "", ""), (51, "a\r\nb", "", "", "", ""), (None, "u", "<p>1</p>", "", "", ""), (39, "again", "<p>3</p>" * 3, "", "", ""), (60, "big", "z" * 3_000_000, "", "", "")]
    df = spark.createDataFrame(pages, PAGES).repartition(5)
    one = warc.write_archives(df, range_bytes=4000, roll_bytes=600)
    two = warc.write_archives(df.repartition(2), range_bytes=4000, roll_bytes=600)
    assert files.manifest(one)["files"] == files.manifest(two)["files"] and len(files.manifest(one)["files"]) > 3
    got = warc.read_archives(spark, one).collect()
    body = lambda h: (h or "").encode()
    keeper = {}
    for p in pages:
        keeper[body(p[2])] = max(keeper.get(body(p[2]), -1), -1 if p[0] is None else p[0])
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == sorted(
        (p[0] is None, p[0] or 0, len(body(p[2])), base64.b32encode(hashlib.sha1(body(p[2])).digest()).decode(), "response" if keeper[body(p[2])] == p[0] else "revisit", 0 if keeper[body(p[2])] == p[0] else keeper[body(p[2])]) for p in pages
    )
    assert next(bytes(r.payload) for r in got if r.page_id == 60) == b"z" * 3_000_000
    assert warc.read_archives(spark, warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0
    every = warc.read_archives(spark, warc.write_archives(df, revisit_bytes=1 << 30)).where("record_type <> 'response'").count()
    assert every == 0


def test_warc_hot_page(spark):
    pages = [(None, f"u{i}", "n" * 400) for i in range(60)] + [(7, f"v{i}", f"{i}" * 400) for i in range(60)] + [(i, "w", "z") for i in range(10, 40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    uri = warc.write_archives(df, range_bytes=8000)
    listed = files.manifest(uri)["files"]
    assert max(f["records"] for f in listed) <= 30 and sum(f["records"] for f in listed) == len(pages)
    assert sorted((r.page_id or 0, r.url) for r in warc.read_archives(spark, uri).collect()) == sorted((p[0] or 0, p[1]) for p in pages)


# --------------------------------------------------------------------------- ann


def test_ann_recall_and_ties(spark, data):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    x[100:700] = x[100]
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(9000, None, ""), (9001, [0.0] * 24, ""), (9002, [float("nan")] * 24, ""), (9003, [None] + [1.0] * 23, ""), (9004, [1.0] * 3, ""), (None, [1.0] * 24, ""), (7, x[7].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), block_rows=200, block_queries=7).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 50)) and got.groupby("query_id").size().eq(5).all()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q, g in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -2
        hit += len(set(np.lexsort((np.arange(3000), -s))[:5]) & set(g.vec_id))
        assert g.sort_values("rank").score.is_monotonic_decreasing and np.allclose(g.score, s[g.vec_id])
    assert hit / got.query_id.nunique() / 5 >= 0.9
    assert got[got.query_id == 150].sort_values("rank").vec_id.tolist() == [100, 101, 102, 103, 104]
    few = df.where("vec_id in (0, 1, 2)")
    assert ann.nearest(few, few).count() == 6
    assert ann.nearest(df.where("vec_id = 9000"), df).count() == 0
    assert ann.nearest(spark.createDataFrame([], df.schema), df).count() == 0


def test_ann_keeps_distinct_ids(spark):
    rng = np.random.default_rng(2)
    q = rng.normal(size=8)
    rows = [(0, q.tolist())] + [(1, (q + 0.001 * rng.normal(size=8)).tolist()) for _ in range(200)] + [(i, (q + rng.normal(size=8)).tolist()) for i in range(2, 9)] + [(1, q.tolist())] * 50
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id = 0"), n_lists=1).toPandas().sort_values("rank")
    score = {}
    for i, v in rows[1:]:
        score[i] = max(score.get(i, -2), float(ann.cosine(q, np.array([v]))[0]))
    assert got.vec_id.tolist() == sorted(score, key=lambda i: (-score[i], i))[:5]
    again = ann.nearest(df.repartition(7), df.where("vec_id = 0"), n_lists=1).toPandas().sort_values("rank")
    assert again.equals(got) or (again.vec_id.tolist() == got.vec_id.tolist() and again.score.tolist() == got.score.tolist())


def test_ann_fills_and_takes_every_length(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(1000 + i, rng.normal(size=4).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id in (0, 50, 1000, 1005)"), n_lists=100, n_probe=1).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 5, 50: 5, 1000: 5, 1005: 5}
    assert (got.vec_id[got.query_id >= 1000] >= 1000).all() and (got.vec_id[got.query_id < 1000] < 1000).all()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_ann_recall_on_the_table(spark, folder):
    got = QUERIES["op6_ann"](spark, folder).toPandas()
    rows = [(r.vec_id, r.v) for r in ann.valid(spark.read.parquet(f"{folder}/embeddings.parquet")).collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hit = 0
    for q, g in got.groupby("query_id"):
        s = np.where(ids == q, -2, ann.cosine(x[ids == q][0], x))
        hit += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(g.vec_id))
        assert dict(zip(g.vec_id, g.score)) == {int(i): s[ids == i][0] for i in g.vec_id}
    assert set(got.query_id) == set(ids[ids % 50 == 0]) and hit / len(got) >= 0.9


@pytest.mark.parametrize("kind", ["spread", "copies", "tight", "huge"])
def test_ann_misses_no_nearer_row(spark, kind):
    """on other rows many of the nearest were missed, and of copies any instead of the first."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    if kind in ("copies", "tight"):
        x = x[rng.integers(0, 10, 3000)] + (1e-7 * rng.normal(size=x.shape) if kind == "tight" else 0)
    if kind == "huge":
        x *= 10.0 ** rng.choice([-170, 0, 170], size=3000)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), n_probe=1, block_rows=200 if kind == "spread" else 4096, block_queries=7).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 50))
    y = x / np.abs(x).max(axis=1)[:, None]
    for q, g in got.sort_values("rank").groupby("query_id"):
        s = (ann.cosine(x[q], x) if kind != "huge" else y @ y[q] / np.linalg.norm(y, axis=1)) * np.where(np.arange(3000) == q, -9, 1)
        assert g.vec_id.tolist() == np.lexsort((np.arange(3000), -s))[:5].tolist()


# -------------------------------------------------------------------------- chat


def test_chat_escapes_and_odd(spark):
    hard = "\\ <|turn|> <|end|>\n </s> <s> [INST] [/INST] <\\| \\\\n [\\INST]"
    turns = [(1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "as\\sis\ntant\\n", "x"), (1, 4, "assistant", None), (2, 1, None, None), (2, 1, None, None), (None, None, "assistant", ""), (3, 1, "assistant", "only")]
    df = spark.createDataFrame([(*t, "e") for t in turns], "conv_id long, turn long, role string, text string, start string")
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c in (1, 2, 3, None):
        mine = [t for t in turns if t[0] == c]
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = [r for r in made.where("conv_id = 1").orderBy("example").collect()]
    assert len(texts) == 2 and texts[1].text.startswith(texts[0].text) and "</s>" not in texts[1].text
    assert got[1].formatted_chars == sum(len(r.text) for r in texts)
    assert chat.read_back(chat.examples(df.where("false"))).count() == 0


# ------------------------------------------------------------------------ tokens


def hf():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library():
    rng, encode, mine = random.Random(4), hf(), tokens.Bpe()
    alphabet = [*"ab'sStmrevld  \n\t\r ​\u0085éß12²Ⅼ.,!?-_<|>́", "'re", "'ll", "'s ", " '", "你", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [None]
    got = [x.tolist() for _, part in mine.encode_column(pa.array(texts)) for x in part]
    assert got == [encode(t) for t in texts]


def check_pieces(pieces, docs, window):
    encode = hf()
    ids = sorted([*encode(t), 0] for _, t in docs)
    for r in pieces:
        assert 0 < r.length <= window
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sum(r.length for r in pieces) == sum(map(len, ids))
    return by


def test_packing(spark, data, odd, none):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    pieces = QUERIES["op10_packing"](spark, data).collect()
    by = check_pieces(pieces, docs, 1024)
    assert sum(sum(r.length for r in rows) < 1024 for rows in by.values()) <= 8
    encode, whole = hf(), dict(docs)
    for d in {r.doc_id for r in pieces}:
        ids, at = np.array([*encode(whole[d]), 0], dtype="<u4"), 0
        for r in sorted((r for r in pieces if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    check_pieces(packing.pack(odd, window=16, shard_docs=4).collect(), [(r[0], r[1]) for r in ODD], 16)
    assert packing.pack(none).count() == 0


def test_packing_retrieves_neighbours():
    docs = [np.array(x, dtype=np.uint16) for x in ([1, 2, 3], [7, 8, 9], [2, 3, 4], [8, 9, 1])]
    index = packing.Shard(docs, np.ones(16), 3.0, 32)
    index.free[0] = False
    assert index.neighbours(0, 2) == [2, 3]
    index.free[2] = False
    assert 2 not in index.neighbours(0, 4)


def test_packing_scores_all_terms_of_a_seed():
    """The order is that of the full query, also where a document shares none of the heaviest terms."""
    rng = np.random.default_rng(3)
    most = inspect.signature(packing.pack).parameters["query_terms"].default
    idf = np.linspace(1, 3, 400)
    docs = [np.arange(0, 400, 2, dtype=np.uint16), *(np.sort(rng.choice(400, rng.integers(20, 200), replace=False)).astype(np.uint16) for _ in range(60)), np.arange(0, 320, 2, dtype=np.uint16)]
    index = packing.Shard(docs, idf, 100.0, most)
    index.free[0] = False
    full = [sum(idf[t] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(d) / 100.0)) for t in set(d.tolist()) & set(docs[0].tolist())) for d in docs]
    want = sorted(range(1, len(docs)), key=lambda i: -full[i])[:4]
    assert want[0] == len(docs) - 1 and index.neighbours(0, 4) == want


def test_packing_against_plain_version(spark):
    """One index of all documents, which ``shard_docs`` can ask for, is exact: windows are those of a plain greedy fill by BM25 over all."""
    rng = random.Random(12)
    topics = [[f"{chr(97 + t)}{chr(97 + i)}q" for i in range(12)] for t in range(5)]
    docs = [(i, " ".join(rng.choice(topics[i % 5]) for _ in range(rng.randint(5, 60)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(packing.pack(df, window=64, shard_docs=1000).collect(), key=lambda r: (r.sequence_id, r.offset))
    ids = packing.to_ids(df).collect()
    body = {r.doc_id: np.frombuffer(r.ids, dtype="<u2") for r in ids}
    freq = np.bincount(np.concatenate([np.unique(x) for x in body.values()]), minlength=1 << 16)
    idf, mean = np.log(1 + (len(docs) - freq + 0.5) / (freq + 0.5)), sum(map(len, body.values())) / len(docs)
    order = [r.doc_id for r in packing.placed(packing.to_ids(df), idf, len(docs), 1000).collect()]

    def score(seed, d):
        total = 0.0
        for t, tf in zip(*np.unique(body[d], return_counts=True)):
            if t in body[seed]:
                total += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(body[d]) / mean))
        return total

    free, want, filled, sequence, seed = list(order), [], 0, 0, None

    def put(d):
        nonlocal filled, sequence
        at = 0
        while at < len(body[d]):
            take = min(len(body[d]) - at, 64 - filled)
            want.append((d, at, take, sequence))
            at, filled = at + take, filled + take
            if filled == 64:
                sequence, filled = sequence + 1, 0

    while free:
        if seed is None:
            seed = free.pop(0)
            put(seed)
            if not filled:
                seed = None
                continue
        room, best = 64 - filled, sorted(free, key=lambda d: (-round(score(seed, d), 9), order.index(d)))[:4]
        for d in best:
            free.remove(d)
            put(d)
            if len(body[d]) >= room:
                seed = d if filled else None
                break
            room -= len(body[d])
    assert [(r.doc_id, r.start, r.length) for r in got] == [w[:3] for w in want]


@pytest.mark.parametrize("groups", [100, 400])
def test_packing_meets_neighbours_from_all_over(spark, groups):
    """Copies of a text lie far apart in the input; the share that meets one in its window does not fall as documents grow."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(groups)]
    docs = [(c * groups + g, " ".join(rng.choice(vocabulary) if rng.random() < 0.05 else w for w in base[g])) for c in range(4) for g in range(groups)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    by = {}
    for r in packing.pack(df, window=512, shard_docs=32).collect():
        by.setdefault(r.sequence_id, set()).add(r.doc_id)
    met = {d for window in by.values() for d in window if any(e != d and e % groups == d % groups for e in window)}
    assert len(met) >= 0.6 * len(docs)


def test_tokenbin(spark, data, odd, none):
    encode = hf()
    got = QUERIES["op8_tokenbin"](spark, data).toPandas()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = {d: np.array([*encode(t), 0], dtype="<u4") for d, t in docs.items()}
    assert sorted(got.slot) == list(range(sum(-(-len(x) // 512) for x in ids.values())))
    assert all(zlib.crc32(ids[r.doc_id][r.part * 512 : r.part * 512 + 512].tobytes()) == r.ids_crc32 for r in got.itertuples())
    uri = tokenbin.write_slots(odd, seq_len=8, file_bytes=400)
    every = tokenbin.read_slots(spark, uri).orderBy("slot").collect()
    want = sorted(np.array([*encode(r[1]), 0], dtype="<u2")[i : i + 8].tobytes() for r in ODD for i in range(0, len(encode(r[1])) + 1, 8))
    assert sorted(bytes(r.ids) for r in every) == want
    some = tokenbin.read_slots(spark, uri, 5, 7).orderBy("slot").collect()
    assert [(r.slot, r.ids) for r in some] == [(r.slot, r.ids) for r in every[5:12]]
    assert tokenbin.read_slots(spark, tokenbin.write_slots(none)).count() == 0


# ------------------------------------------------------------------------ cotrain


def test_cotrain_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    got = cotrain.classify(docs, labels.where(part > 0), keep=["doc_id"]).join(labels.where(part == 0), "doc_id").toPandas()
    low, toxic = got.quality == 0, got.toxic == 1
    assert ((got.p_low >= 0.5) == low).mean() > 0.98
    assert ((got.p_toxic >= 0.5) == toxic).mean() > 0.95
    assert got[~low & ~toxic].kept.mean() > 0.98 and (~got[low | toxic].kept).mean() > 0.9


def test_cotrain_metadata_of_whole_values():
    batch = pa.RecordBatch.from_pydict({"lang": ["en", None, "", "en"], "source": ["site-a-webcrawl", "site-b-webcrawl", None, ""], "n_chars": [1, None, 0, 1]})
    got = cotrain.metadata(batch, 0, 4)
    assert len({tuple(r) for r in got[:, cotrain.LANGS : cotrain.LANGS + cotrain.SOURCES]}) == 4
    assert not (got[1, : cotrain.LANGS] == got[2, : cotrain.LANGS]).all()
    assert (cotrain.metadata(batch, 2, 2) == got[2:]).all()
    for n in (3, 100_000):
        slots = np.sort(np.random.default_rng(n).choice(cotrain.SLOTS, n, replace=False))
        data = cotrain._packed([slots])[0]
        assert (cotrain._unpacked(data) == slots).all() and len(data) <= cotrain.SLOTS // 8


def test_cotrain_of_repeated_ids(spark):
    rows = [(i % 40, f"good text of words number {i % 40} and more", "en", "s", 10) if i % 2 else (i % 40, f"bad # % & {i % 40} * * spam", "en", "t", 3) for i in range(400)] + [(None, "x", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = cotrain.classify(df, labels).toPandas()
    assert len(got) == len(rows) and got[got.doc_id.notna()].kept.eq(got[got.doc_id.notna()].doc_id % 2 == 1).all()


def test_cotrain_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, None, None), (None, 1, 1), (8, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = cotrain.classify(odd, labels)
    rows = got.collect()
    assert sorted(((r.doc_id, r.text, r.row) for r in rows), key=str) == sorted(((r[0], r[1], r[9]) for r in ODD), key=str)
    assert all(0 <= r.p_low <= 1 and 0 <= r.p_toxic <= 1 and r.n_words == len(words(r.text)) for r in rows)
    assert len({(r.p_low, r.p_toxic) for r in rows if r.doc_id == 1}) == 1
    free = cotrain.classify(odd, labels.where("false")).toPandas()
    assert free.kept.all() and len(free) == len(ODD)
    assert cotrain.classify(none, labels).count() == 0


# ----------------------------------------------------------------------- pipeline


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        out = common.stored(stage(spark, docs, data), name)
        assert out.columns == docs.columns
        ids, kept = {r.doc_id: r.text for r in docs.collect()}, [(r.doc_id, r.text) for r in out.collect()]
        assert kept and all(ids[d] == t for d, t in kept)
        if name == "near_dedup":
            want = plain_components(sorted(ids.items()), 5, 80)
            assert sorted(d for d, _ in kept) == sorted({c for _, c in want.values()})
        docs = out
    check_pieces(p.STAGES[-1][1](spark, docs, data).collect(), [(r.doc_id, r.text) for r in docs.collect()], 1024)


def test_pipeline_odd(spark, odd, none, data):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert stage(spark, none, data).count() == 0
    rows = {tuple(r) for r in ODD}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, odd, data)
        got = [tuple(r) for r in out.collect()]
        assert out.columns == odd.columns and set(got) <= rows
        if name == "quality_rules":
            assert got == []  # all have few words or repeat them
        if name == "mixing":
            assert not {r[0] for r in got} & {3, 4, 5} and {r[3] for r in got} >= {"s1", "s2", "s3", None}
    check_pieces(p.packing(spark, odd, data).collect(), [(r[0], r[1]) for r in ODD], 1024)
    once = p.near_dedup(spark, odd, data).collect()
    assert sorted(r.doc_id for r in once if r.doc_id) == [1, 3, 4, 5, 6, 8, 9, 11] and any(r.doc_id is None for r in once)
