from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import entities as E
from tessera.operators import graph as G
from tessera.operators import joins as J
from tessera.operators import postings as P
from tessera.operators import ranking as R
from tessera.operators import retrieval as V
from tessera.operators.chains import chains, member_rows, reverse_index, split_chain


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_redirects_chains_and_cycles(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 10)]
    got = {r.node: (r.root, r.cyclic) for r in J.redirected(spark.createDataFrame(links, "node long, next long")).collect()}
    assert got[1] == got[2] == got[3] == (4, False)
    assert all(got[n] == (10, True) for n in (10, 11, 12, 20))


def test_nearest_takes_the_first_in_reach(spark):
    left = spark.createDataFrame([("f", 10), ("f", 30)], "k string, i long")
    right = spark.createDataFrame([("f", 7, "a"), ("f", 12, "b"), ("f", 13, "no"), ("f", 34, "no")], "k string, i long, value string")
    assert [(r.i, r.value) for r in J.nearest(left, right, "i", 3, 2, "k").collect()] == [(10, "a")]


def test_cascade_needs_one_target(spark):
    rows = spark.createDataFrame([(1, "x", "p"), (2, "y", "q"), (3, "z", "r")], "id long, full string, part string")
    table = spark.createDataFrame([("x", "p", 100), ("x", "p", 101), ("y", "q", 102), ("w", "p", 103)], "full string, part string, target long")
    got = {r.id: (r.method, r.target) for r in J.cascade(rows, [("exact", table, ["full"]), ("part", table, ["part"])], "id").collect()}
    assert got == {1: ("none", None), 2: ("exact", 102), 3: ("none", None)}


def test_boolean_search_falls_back_to_any(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc long, term string")
    assert [tuple(r) for r in P.boolean_search(p, ["a", "b"]).collect()] == [(1, 2, "all")]
    assert sorted(tuple(r) for r in P.boolean_search(p, ["a", "c"]).collect()) == [(1, 1, "any"), (2, 1, "any")]
    assert P.boolean_search(p, ["zz"]).count() == 0


def test_containing_is_set_inclusion(spark):
    rng = random.Random(3)
    hay = {i: set(rng.choices("abcdefgh", [9, 7, 5, 3, 2, 1, 1, 1], k=rng.randint(0, 6))) for i in range(60)}
    needles = {i: set(rng.choices("abcdefghz", k=rng.randint(0, 3))) for i in range(30)}
    rows = lambda sets, name: spark.createDataFrame([(i, t) for i, s in sets.items() for t in sorted(s)], f"{name} long, term string")
    want = sorted((n, d) for n, terms in needles.items() for d, held in hay.items() if terms and terms <= held)
    got = J.containing(rows(needles, "needle"), rows(hay, "doc"))
    assert sorted(tuple(r) for r in got.collect()) == want and want
    assert J.containing(rows(needles, "needle"), rows({}, "doc")).count() == 0
    assert J.containing(rows({}, "needle"), rows(hay, "doc")).count() == 0


def test_global_numbers(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v")).repartition(5)
    got = R.global_numbers(df, F.desc("v"), F.col("id")).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, 1001))
    assert [(r.v, r.id) for r in got] == sorted(((r.v, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_stratified_quota(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, "a").otherwise("b").alias("g"))
    got = R.stratified(df, "g", F.md5(F.col("id").cast("string")), 10).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 9, "b": 1}


KIN = {"father": {"هشام": "عروه"}, "grandfather": {"عمرو": "محمد الكبير"}, "mother": {"زيد": "هند"}, "_comment": {"_x": "y"}}


def test_chain_extraction(spark):
    cases = [
        ("حدثنا مالك عن نافع عن ابن عمر قال النبي", ["مالك", "نافع", "ابن عمر"]), ("حدثنا هشام، عن أبيه، عن عائشة رضي الله عنها", ["هشام", "عروه", "عائشة"]), ("حدثنا خالد، عن أبيه، عن عائشة", ["خالد", "عائشة"]),
        ("حدثنا أبي عن صالح عن زيد، عن أمه", ["ابي صالح", "زيد", "هند"]), ("عن عمه، واسع بن حبان، عن زيد", ["واسع بن حبان", "زيد"]), ("عن 12 عن الله عن زيد", ["زيد"]), ("عن عمرو عن جده عن زيد", ["عمرو", "محمد الكبير", "زيد"]),
        ("عن خالته عن اسماء بنت زيد عن سعد", ["اسماء بنت زيد", "سعد"]), ("عن مولاه سالم عن سعد", ["سالم", "سعد"]), (None, []), ("", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id long, t string")
    assert [r.c for r in df.select("id", chains("t", KIN).alias("c")).orderBy("id").collect()] == [c for _, c in cases]
    long = spark.createDataFrame([(" ".join(f"عن راو{chr(1575 + i)}" for i in range(12)),)], "t string")
    assert len(long.select(chains("t").alias("c")).first().c) == 8
    df = spark.createDataFrame([(1, "حدثنا مالك عن نافع عن سالم"), (2, "عن زيد"), (3, None)], "id long, t string")
    rows = member_rows(df.select("id", chains("t").alias("c")), "id", "c")
    assert [(r.id, r.pos, r.name) for r in rows.orderBy("id", "pos").collect()] == [(1, 0, "مالك"), (1, 1, "نافع"), (1, 2, "سالم")]
    assert reverse_index(rows, "name", "id", "pos", cap=1).count() == 3
    assert df.limit(1).select(split_chain(F.lit("A -> B, C → D")).alias("c")).first().c == ["A", "B", "C", "D"]


def test_weakest_link(spark):
    rows = [("s", 5, True), ("s", 3, True), ("h", 2, True), ("d", 1, True), ("m", 0, True), ("u", -1, True), ("v", 5, False)]
    got = spark.createDataFrame(rows, "k string, s int, ok boolean").groupBy("k").agg(G.weakest("s", "ok").alias("v")).collect()
    assert {r.k: r.v for r in got} == {"s": "sahih", "h": "hasan", "d": "daif", "m": "mawdu", "u": "unknown", "v": "unknown"}


def profile(i, name, death="", kunya="", city=""):
    return (i, name, death, kunya, city)


def test_duplicate_pairs_rules(spark):
    long = "محمد بن علي بن زيد"
    rows = [
        profile(1, long, "100", "ابو سلم"), profile(2, long, "102"), profile(3, long, "110", "ابو سلم"), profile(4, long + " بن عمر", "104", "", "مكة"), profile(5, "زيد", "50", "", "مكة"), profile(6, "زيد", "51", "", "مكة"),
        profile(7, "زيد", "50", "", "مصر"), profile(8, "احمد بن سعد بن عمر بن خالد"), profile(9, "احمد بن سعد بن عمر بن خالد", "70"),
    ]
    df = spark.createDataFrame(rows, "id long, full_name string, death string, kunya string, city string")
    got = {(r.id1, r.id2): (r.layer, r.reason) for r in E.duplicate_pairs(df).collect()}
    assert got[(1, 2)] == (1, "exact+death")
    assert (1, 3) not in got  # ten years apart
    assert got[(2, 4)] == (1, "prefix(3)+death")
    assert got[(5, 6)] == (1, "short+death") and (5, 7) not in got
    assert got[(8, 9)] == (2, "exact_long_no_death")


def test_conflict_split(spark):
    assert E.split_members([(1, 100), (2, 103), (3, 120), (4, None), (5, 121)], [(4, 3), (4, 5), (1, 3)]) == [[1, 2], [3, 4, 5]]
    assert E.split_members([(1, 100), (2, None)], []) == [[1, 2]]
    assert E.split_members([(1, 100), (2, 120)], [(1, 2)]) == []
    comps = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 5)], "node long, component long")
    years = spark.createDataFrame([(1, 100), (2, 103), (3, 120), (4, None), (5, 121)], "id long, year int")
    got = E.conflict_split(comps, years, spark.createDataFrame([(4, 3), (4, 5), (1, 3)], "a long, b long"))
    assert sorted((r.cluster, r.id) for r in got.collect()) == [(1, 1), (1, 2), (3, 3), (3, 4), (3, 5)]


def test_folds(spark):
    rows = spark.createDataFrame([(1, 0, "", "unknown", ["a"]), (1, 1, "x", "weak", ["b", "a"]), (1, 2, "y", "reliable", ["c"])], "k long, o long, name string, g string, names array<string>")
    assert E.folded(rows, "k", ["o"], ["name"]).first().name == "x"
    assert rows.groupBy("k").agg(E.best_grade("g", ["o"]).alias("g")).first().g == "weak"
    assert E.merged_names(rows, "k", "o", "names").first().names == ["a", "b", "c"]


def test_source_merge(spark):
    known = spark.createDataFrame([(1, "محمد علي زيد عمر"), (2, "سعد")], "id long, name string")
    entries = spark.createDataFrame([(10, "محمد علي زيد عمر خالد", 0), (11, "سعد", 1), (12, "جديد", 0), (13, "جديد", 1)], "entry_id long, name string, prio int")
    got = {r.entry_id: (r.id, r.method) for r in E.source_merge(entries, known).collect()}
    assert got == {10: (1, "prefix4"), 11: (2, "exact"), 12: (-12, "new"), 13: (-12, "exact")}


def test_gates(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 3, "a")], "id long, w long, s string")
    new = spark.createDataFrame([(1, 5, "x"), (3, 3, "a")], "id long, w long, s string")
    r = E.gate_report(old, new, "id", "w", F.col("s") != "x").first()
    assert (r.changed, r.lost, r.pass_limit, r.pass_weight, r.pass_alive, r.pass_lost) == (3, 1, True, True, False, False)


def test_vector_blocks_agree(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "id long, v array<double>")
    q = df.where("id % 5 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    one = sorted(map(tuple, V.vector_top_k(df, q, 3).collect()))
    monkeypatch.setattr(V, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, V.vector_top_k(df, q, 3).collect())) == one
    assert len(one) == 36


def test_search_index_takes_every_language(spark):
    from tessera import registry
    from tests.conftest import DATA

    plan = registry.queries()["cq_search_index"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
