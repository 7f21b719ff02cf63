from __future__ import annotations

import pytest

from tessera.functions import names as N
from tessera.operators import matching as M
from tests.test_functions import one


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        ("# خ م: أحمد بن صالح: ثقة حافظ", "أحمد بن صالح"), ("[الحمصي - 6] زيد", "الحمصي زيد"), ("12 - زيد بن عمر، ويقال: عمرو", "زيد بن عمر"), ("وأحمد بن زيد", "أحمد بن زيد"), ("وهب بن منبه", "وهب بن منبه"),
        ("الله بن عمر", "عبد الله بن عمر"), ("محمد بن سعد روى عن مالك", "محمد بن سعد"), ("زيد بن علي 120", "زيد بن علي"), ("مسلم بن الحجاج", "مسلم بن الحجاج"), ("", ""),
    ],
)
def test_register_names(spark, raw, name):
    assert one(spark, N.register_name("n", ("مسلم",)), n=raw) == name


def test_book_before_a_name(spark):
    assert one(spark, N.register_name("n", ("مسلم", "النسائي")), n="مسلم النسائي أحمد بن زيد") == "أحمد بن زيد"


def test_fields(spark):
    assert one(spark, N.generation("t"), t="من العاشرة مات") == "العاشرة"
    assert one(spark, N.generation("t"), t="x") is None
    assert one(spark, N.teachers("t"), t="روى عن مالك بن أنس و سفيان الثوري، كذا. روى عنه أحمد بن حنبل.") == ["مالك بن أنس", "سفيان الثوري"]
    assert one(spark, N.students("t"), t="روى عن مالك. روى عنه أحمد بن حنبل و غيره.") == ["أحمد بن حنبل", "غيره"]
    assert one(spark, N.condensed_grade("t"), t="ليس بثقة") == "weak"
    assert one(spark, N.condensed_grade("t"), t="ضعفه فلان") == "weak" and one(spark, N.condensed_grade("t"), t="-") is None
    assert one(spark, N.defaulted("g", "s", {"mizan": "weak"}), g="unknown", s="mizan") == "weak"
    assert one(spark, N.defaulted("g", "s", {"mizan": "weak"}), g=None, s="x") == "unknown"
    assert one(spark, N.patterned_class("t", [("a", "x+"), ("b", "y")]), t="yx") == "a"
    df = spark.createDataFrame([("companion", 120, 1), ("companion", 100, 2), ("reliable", None, None)], "g string, y int, t int")
    assert [r.x for r in df.select(N.implausible("g", "y", "t").alias("x")).collect()] == [["year"], ["generation"], []]


def test_strategies(spark):
    profiles = spark.createDataFrame(
        [
            (1, "مالك بن أنس: إمام", "reliable"), (2, "سفيان بن سعيد الثوري", "reliable"), (3, "سفيان بن عيينة", "reliable"), (4, "ابو صالح السمان", "weak"), (5, "الزهري محمد", "reliable"), (6, "يحيى الزهري", "reliable"), (7, "نافع مولى عمر", "reliable"),
            (8, "عبد الله بن عباس", "companion"), (9, "علي بن زيد", "weak"), (10, "علي بن سعد", "weak"),
        ],
        "key long, name string, grade string",
    )
    names = ["مَالِك بن أنس", "سفيان الثوري", "أبي صالح", "الزهري", "نافع", "ابن عباس", "علي", "عائشة", "القعنبي", "بن"]
    aliases = spark.createDataFrame([("عائشه", None), ("القعنبي", "نافع مولى عمر")], "name string, target string")
    got = {r.name: (r.strategy, r.key) for r in M.matched(spark.createDataFrame([(n,) for n in names], "name string"), profiles, aliases).collect()}
    assert got == {
        names[0]: ("exact", 1), names[1]: ("all words", 2), names[2]: ("kunya", 4), names[3]: ("byname", 5), names[4]: ("first name", 7), names[5]: ("son of", 8), names[6]: ("none", None),
        names[7]: ("ruled out", None), names[8]: ("manual", 7), names[9]: ("none", None),
    }


def test_variants_and_resolution(spark):
    assert one(spark, M.variants("n"), n="للزهري") == ["للزهري", "الزهري"]
    assert "صالح" in one(spark, M.variants("n"), n="ابن صالح") and "ابو بكر" in one(spark, M.variants("n"), n="ابي بكر")
    index = spark.createDataFrame([("ابو بكر", 1, 5), ("ابو بكر", 2, 9), ("زيد", 3, 1)], "name string, pid long, freq long")
    got = {r.name: r.pid for r in M.resolved(spark.createDataFrame([("أبي بكر",), ("وزيد",), ("x",)], "name string"), index).collect()}
    assert got == {"أبي بكر": 2, "وزيد": 3, "x": None}
