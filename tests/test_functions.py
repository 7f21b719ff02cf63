from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"`{k}` {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_normalising_profiles(spark):
    assert one(spark, T.normalised("t"), t="أَحْمَدُ الفاطمةى") == "احمد الفاطمهي"
    assert one(spark, T.normalised("t", "name"), t=" أبو  بـكرة ") == "ابو بكرة"
    assert one(spark, T.normalised("t", "match"), t="عائشة") == "عائشه"
    assert one(spark, T.normalised("t"), t=None) is None
    for p in T.PROFILES:  # twice is once
        once = T.normalised("t", p)
        assert one(spark, once == T.normalised(once, p), t="إِلى ٱلـمدينةِ ہى")


def test_tokens_drop_short_and_stop_words(spark):
    assert one(spark, T.tokens("t"), t="قال إنَّما الأعمالُ بالنيات، 12 في") == ["الاعمال", "بالنيات"]
    assert one(spark, T.tokens("t"), t="") == []


@pytest.mark.parametrize(("word", "stem"), [("والكتاب", "كتاب"), ("الكتب", "كتب"), ("كتب", "كتب"), ("مسلمون", "مسلم"), ("بالمسلمين", "مسلم")])
def test_light_stem(spark, word, stem):
    assert one(spark, T.light_stem("w"), w=word) == stem


def test_root_candidates_order(spark):
    found = one(spark, T.root_candidates("w"), w="السماء")
    assert found[0] == "السماء" and "سماء" in found and "سمو" in found and "سمي" in found


def test_head_and_body(spark):
    parts = one(spark, T.head_and_body("t"), t="حدثنا فلان قال النبي خير الناس")
    assert tuple(parts) == ("حدثنا فلان قال ", "النبي خير الناس")
    assert tuple(one(spark, T.head_and_body("t"), t="خير الناس أنفعهم")) == ("", "خير الناس أنفعهم")
    parts = one(spark, T.head_and_body("t"), t="حدثنا زيد سمعت النبي : خير الناس أنفعهم")
    assert tuple(parts) == ("حدثنا زيد ", "خير الناس أنفعهم")
    parts = one(spark, T.head_and_body("t"), t="زيد قال: عمرو قال: هذا هو المتن الطويل جدا والله أعلم به")
    assert parts.body.startswith("هذا")
    assert tuple(one(spark, T.head_and_body("t"), t=None)) == ("", "")


def test_speaker(spark):
    assert one(spark, T.speaker("t"), t="Narrated Some One: text") == "Some One"
    assert one(spark, T.speaker("t"), t="X y REPORTED that") == "X y"
    assert one(spark, T.speaker("t"), t="Z : q") == "Z"


def test_tags(spark):
    assert one(spark, T.classes("t"), t="هذا حرام ويجب") == ["obligation", "prohibition"]
    assert one(spark, T.topics("t"), t=["زكاه", "صوم"]) == ["fasting", "zakat"]
    assert [tuple(m) for m in one(spark, T.markers("t"), t="في المسجد يوم الجمعة")] == [("time", ["الجمعة"]), ("place", ["المسجد"])]


def test_grades(spark):
    assert one(spark, T.raised_grade("g", "t"), g="unknown", t="صدوق ضعيف") == "weak"
    assert one(spark, T.raised_grade("g", "t"), g="reliable", t="متروك") == "reliable"
    assert one(spark, T.raised_grade("g", "t"), g=None, t=None) == "unknown"
    assert one(spark, T.grade_of_text("t"), t="Hasan (weak)") == "hasan"


def test_names(spark):
    assert one(spark, T.name_parts("n"), n="محمد بن عبد الله بن أحمد") == ["محمد", "عبد الله", "احمد"]
    assert one(spark, T.clean_name("n"), n=" عائشة رضي الله عنها ") == "عائشة"
    assert one(spark, T.kunya("n"), n="ابو صالح السمان") == "صالح"
    assert one(spark, T.kunya("n"), n="صالح") is None
    assert one(spark, T.primary_name("n"), n="زيد، ويقال عمرو: ثقة") == "زيد"
    assert [one(spark, T.valid_name("n"), n=x) for x in ("زيد", "بن زيد", "12", None, "ab")] == [True, False, False, False, False]
    assert one(spark, T.truncated("n", ["stop", "end"]), n="abcdefgh end stop") == "abcdefgh"
    assert one(spark, F.array(T.same_prefix("a", "b"), T.same_prefix("a", "c")), a=["x", "y", "z"], b=["x", "y", "z", "w"], c=["x", "q", "z"]) == [True, False]
    assert one(spark, T.artifacts({"k": F.col("k"), "l": F.col("l")}), k="حدثنا", l=None) == ["k"]


def test_markup(spark):
    assert one(spark, T.sanitised("h"), h="<p class=x>a<script>b</script><i onclick=z>c</i><u>d</u></p>") == "<p>a<i>c</i>d</p>"
    assert one(spark, T.gloss("t"), t='It means to go, and more.') == "to go"
    assert len(one(spark, T.gloss("t", ()), t="x" * 90)) == 58
    assert one(spark, T.highlighted("t", "the"), t="The other the") == "<mark>The</mark> other <mark>the</mark>"


@pytest.mark.parametrize(
    ("text", "year"),
    [
        ("مات سنة 197", 197), ("توفي سنة ست", 6), ("مات سنة خمس عشرة", 15), ("مات سنة ثماني عشرة ومائة", 118), ("توفي سنة ست وعشرين ومائة", 126), ("مات سنة ثلاثمائة", 300),
        ("قتل في سنة خمس أو ست وأربعين", 45), ("مات سنة إحدى ومائتين، وله", 201), ("توفي سنة عشرين وقيل غيرها", 20), ("مات سنة تسع وتسعين بمكة", 99), ("لا شيء", None), (None, None), ("", None), ("مات سنة مائة ألف", 100),
    ],
)
def test_years_in_words(spark, text, year):
    assert one(spark, N.years("t"), t=text) == year


def test_years_column(spark):
    df = spark.createDataFrame([("مات سنة 197",), ("x",), (None,)], "t string")
    assert [r.y for r in df.select(N.years("t").alias("y")).collect()] == [197, None, None]


def test_numbers(spark):
    assert one(spark, N.first_integer("t"), t="a 12 b 345") == 12
    assert one(spark, N.first_integer("t"), t="none") is None
    assert one(spark, N.greatest_integer("t"), t="120-345 هـ 5") == 345
    row = spark.sql("select 2.5D a, 3.5D b, -2.5D c")
    assert tuple(row.select(N.half_up("a"), N.half_even("a"), N.half_even("b"), N.half_up("c")).first()) == (3, 2, 4, -2)
    v = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = v.select(N.unit("a").alias("u"), N.unit("z").alias("z"), N.inner("a", "a").alias("i")).first()
    assert r.u == [0.6, 0.8] and r.z == [0.0, 0.0] and r.i == 25.0
    m = spark.createDataFrame([({"a": "1", "b": "2", "c": None}, {"a": "1", "b": "3", "d": "4"})], "o map<string,string>, n map<string,string>")
    assert m.select(N.changed_fields("o", "n").alias("x")).first().x == ["b", "d"]
