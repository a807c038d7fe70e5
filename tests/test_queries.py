import pytest

from pagequarry.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, duck, same, name):
    assert same(QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_containment_takes_words_at_all_white_space(spark, tmp_path):
    texts = {1: "Les.\nErly the big\tcat  sat\n", 2: "Erly the  big cat", 3: "early the big cats", 4: "cat", 5: "", 6: None, 7: "the cat sat"}
    items = {1: "Erly the big cat", 2: " big\ncat ", 3: "cat", 4: " \n ", 5: "cat sat", 6: "the big cat sat on", 7: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    split = lambda t: (t or "").split()
    runs = lambda w, n: [w[i : i + n] for i in range(len(w) - n + 1)]
    want = sorted((i, d) for i, a in items.items() for d, b in texts.items() if split(a) and split(a) in runs(split(b), len(split(a))))
    got = sorted((r.item_id, r.doc_id) for r in QUERIES["containment"](spark, str(tmp_path)).collect())
    assert got == want and (1, 1) in got and (3, 4) in got


def test_near_names_of_all_parts_are_linked(spark, duck, same, tmp_path):
    """near names were linked within one brand and type only."""
    names = ["blue ring", "blue rings", "red ring", "blue ring", "glue ring", None, "", "ab", "blue ring", "big plate", "blue rings"]
    rows = [(None if i == 8 else 3 if i == 4 else i, t, None if i == 10 else f"Brand#{i}", "SMALL" if i % 2 else "LARGE") for i, t in enumerate(names)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES["edit_distance"](spark, str(tmp_path)).toPandas()
    assert same(out, duck.sql(ORACLES["edit_distance"].replace("FROM part ", f"FROM '{tmp_path}/part.parquet/*.parquet' ")).df())
    # every two rows meet through their classes
    links = {frozenset((r.a_text, r.b_text)): r.d for r in out.itertuples() if r.d}
    assert links == {frozenset(("blue ring", "blue rings")): 1, frozenset(("blue ring", "glue ring")): 1, frozenset(("blue rings", "glue ring")): 2, frozenset(("", "ab")): 2}
    members = out[out.d == 0]
    assert sorted(members.b_text) == sorted(t for t in names if t is not None) and (members.a_text == members.b_text).all()
    assert {r.a_text: r.a for r in members.itertuples()} == {"blue ring": 0, "blue rings": 1, "red ring": 2, "glue ring": 3, "": 6, "ab": 7, "big plate": 9}
