"""Numbers: year words, first and greatest integers, rounding, vectors, differences of maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions.text import bound, col, strip_marks

#: Words for a hundred alone, which also end compounds as three-hundred.
_HUNDRED = tuple(w for w, n in L.NUMBERS.items() if n == 100)
#: The value of each word that may stand in a number, with and without a leading and.
_VALUES = {
    a + w: n
    for a in ("", "و")
    for w, n in [*L.NUMBERS.items(), *((u + h, 100 * n) for u, n in L.NUMBERS.items() if n < 10 for h in _HUNDRED)]
}
_OR = ("أو", "او")
_AND = "و"


def number_in_words(phrase: Column | str) -> Column:
    """The number that a phrase of Arabic words spells; null if it spells none.

    Each word has a role: a value, an or (the next word is an alternative and counts nothing), an and, an end, or other
    words, which end a number that has begun.  The values up to the end add up."""
    table = F.create_map(*[F.lit(x) for kv in _VALUES.items() for x in kv])
    ends = [w for w in L.NUMBER_STOPS if w not in _OR]

    def valued(w: Column) -> Column:
        return F.struct(
            F.coalesce(table[w], F.when(w.rlike("|".join(_HUNDRED)), F.lit(100)), F.lit(0)).alias("value"),
            F.regexp_replace(w, "^و(?=..)", "").isin(*_OR).alias("alternative"), w.isin(*ends).alias("ends"), (w == _AND).alias("joins"),
        )

    def read(state: Column, w: Column) -> Column:
        active = ~state["over"] & ~state["skip"]
        counts = active & (w["value"] > 0)
        over = active & ~counts & ~w["alternative"] & ~w["joins"] & (w["ends"] | (state["sum"] > 0))
        return F.struct((state["sum"] + F.when(counts, w["value"]).otherwise(0)).alias("sum"), (active & w["alternative"]).alias("skip"), (state["over"] | over).alias("over"))

    words = F.filter(F.split(strip_marks(phrase), "\\s+"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("skip"), F.lit(False).alias("over"))
    return F.nullif(F.aggregate(F.transform(words, valued), start, read)["sum"], F.lit(0))


def years(text: Column | str, most: int = 1500) -> Column:
    """The year of death that a text names in digits, or in words up to a greatest year."""
    verbs = "|".join(L.DEATH_VERBS)
    clean = strip_marks(text)
    digits = F.regexp_extract(clean, f"(?:{verbs})\\s+(?:في\\s+)?سنة\\s+(\\d+)", 1).try_cast("int")
    told = F.regexp_extract(clean, f"(?:{verbs}|وفاته)\\s+(?:في\\s+)?سنة\\s+([\\u0600-\\u06FF\\s]+)", 1)
    spelt = number_in_words(F.substring_index(told, "،", 1))
    return F.coalesce(digits, F.when(spelt <= most, spelt))


def first_integer(text: Column | str) -> Column:
    return F.regexp_extract(col(text), "(\\d+)", 1).try_cast("int")


def greatest_integer(text: Column | str) -> Column:
    """The greatest number of two to four digits."""
    return F.array_max(F.transform(F.regexp_extract_all(col(text), F.lit("\\d{2,4}"), 0), lambda x: x.try_cast("int")))


def half_up(x: Column | str) -> Column:
    return F.floor(col(x) + 0.5).cast("long")


def half_even(x: Column | str) -> Column:
    return F.bround(col(x), 0).cast("long")


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def inner(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(inner(v, v))


def unit(v: Column | str) -> Column:
    """A vector of length 1; the zero vector stays."""
    length = F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return bound(length, lambda n: F.transform(doubles(v), lambda x: x / n))


def changed_fields(old: Column | str, new: Column | str) -> Column:
    """Sorted keys of two maps whose values differ; a missing key is a null value."""
    keys = F.array_sort(F.array_union(F.map_keys(col(old)), F.map_keys(col(new))))
    return F.filter(keys, lambda k: ~F.element_at(col(old), k).eqNullSafe(F.element_at(col(new), k)))
