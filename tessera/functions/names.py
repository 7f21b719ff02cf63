"""Names in biographical registers: cleaning, generations, teachers and students, grades, plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as T

# Letters that stand for books before a name, words that complete a servant-of, names that begin with a
# waw, what a colon may introduce besides a name, alternatives, and prose that ends a name.
SIGLA = "خمدتسقعبرفهصن"
COMPLETIONS = ("الله", "الرحمن", "الملك", "العزيز", "الوهاب", "الرزاق", "الكريم", "الرحيم", "الواحد", "الصمد", "القادر")
WAW_NAMES = ("هب", "اصل", "ائل", "كيع", "اقد", "اسط", "اثلة", "الد", "رقاء", "حشي", "ابصة")
VERDICTS = ("ثقة", "صدوق", "ضعيف", "متروك", "كذاب", "مجهول", "حافظ", "مقبول", "واه", "وسط", "مقل", "محدث", "لا يعرف")
ALTERNATIVES = ("ويقال", "وقيل")
PROSE = ("روى\\s", "سمع\\s", "حدث\\s", "مات\\s", "توفي\\s", "ولد\\s", "قال\\s", "ذكره\\s", "كان\\s")

# Patterns of what goes from a heading, in the order in which they apply, and what takes its place.
STEPS = (
    ("#|PageV\\d+P\\d+|ms\\d+", ""),  # marks of the edition
    ("\\[\\s*([^\\]]*?)\\s*-\\s*\\d+\\s*\\]", "$1"),  # a variant with the number of its note
    ("[\\[(]\\s*\\d*\\s*[" + SIGLA + "\\s.]*\\d*\\s*[\\])]", ""),  # numbers and sigla in brackets
    ("\\[\\s*الوفاة[^\\]]*\\]", ""),
    ("^[" + SIGLA + "ل\\s]+:\\s*|^[" + SIGLA + "]\\s+(?=\\S)", ""),  # sigla before the name
    ("^(?:[-–—]+|\\d+\\s*[|:-])\\s*", ""),
    ("^(?:ترجمة|وفاة|وفيات|موت|ذكر|بقية)\\s+", ""),
    ("^(?:أخوه|أخته|ابنه|ابنته|أمه|أبوه)\\s*:\\s*", ""),
    ("^[\\[(]\\s*", ""),
    ("\\s*[،,]?\\s*(?:" + "|".join(ALTERNATIVES) + ")\\s*:?\\s.*$|[،,]\\s*وهو\\s.*$", ""),
    ("\\s+وهو\\s+", " "),
    (":\\s+(?:عن\\s|" + "|".join(VERDICTS) + ").*$", ""),
    ("<[^>]+>|[@$*]", ""),
    ("\\s+\\d{1,4}\\s*$", ""),
    ("[\\s،,.:)\\]]+$", ""),
    ("\\s+", " "),
)


def restored_servant(name: Column | str, words=COMPLETIONS) -> Column:
    """A name that begins with what completes a servant-of gets the servant back."""
    n = T.col(name)
    return F.when(F.substring_index(n, " ", 1).isin(*words), F.concat(F.lit("عبد "), n)).otherwise(n)


def register_name(raw: Column | str, books: tuple[str, ...] = (), most: int = 120) -> Column:
    """The name in a register's heading.

    books: names of books that may stand before it; one that a "son of" follows is a person's name and stays.  A leading and
    goes unless it belongs to the name; prose from the sixth character on ends it; long names are cut at a comma."""
    out = F.trim(T.col(raw))
    if books:
        listed = "|".join(sorted(books, key=len, reverse=True))
        out = F.regexp_replace(out, f"^(?:(?:{listed})(?!\\s+بن(?:\\s|$))\\s+)+", "")
    for pattern, new in STEPS:
        out = F.regexp_replace(out, f"(?s){pattern}", new)
    out = F.regexp_replace(F.trim(out), "^و(?!(?:" + "|".join(WAW_NAMES) + "|و)(?:\\s|$))(?=\\S{2})", "")
    prose = [f"[،,]?\\s*(?<!\\S){p}" for p in PROSE]

    def short(name: Column) -> Column:
        cut = F.substring(name, 1, most)
        comma = F.regexp_extract(cut, "^(.{41,})،", 1)
        return F.when(F.length(name) <= most, name).when(comma != "", F.trim(comma)).otherwise(F.trim(cut))

    whole = T.bound(out, lambda n: F.trim(T.truncated(n, prose)))
    return T.bound(T.bound(whole, restored_servant), short)


def generation(text: Column | str) -> Column:
    """The generation that a text names, as "of the tenth"; null without one."""
    found = F.regexp_extract(T.col(text), "من\\s+(ال[\\u0600-\\u06FF]+(?:\\s+عشرة?)?)\\s", 1)
    return F.nullif(found, F.lit(""))


def _listed(text: Column, pattern: str, most: int) -> Column:
    names = F.split(F.regexp_extract(text, f"(?s){pattern}", 1), "\\s*و(?=\\s)")
    clean = F.transform(names, lambda n: F.trim(F.regexp_replace(n, "(?s)[،,.].*", "")))
    return F.slice(F.filter(clean, lambda n: F.length(n).between(4, 79)), 1, most)


def teachers(text: Column | str, most: int = 20) -> Column:
    """Names after "narrated from", up to "narrated from him"."""
    return _listed(T.col(text), "(?:روى|يروي)\\s+عن\\s+(.*?)(?:روى\\s+عنه|$)", most)


def students(text: Column | str, most: int = 20) -> Column:
    return _listed(T.col(text), "روى\\s+عنه\\s+(.*?)(?:\\.|$)", most)


def condensed_grade(text: Column | str, negations=(("weak", ("ليس بثقة", "ليس بالقوي", "لا يحتج به")),), keywords=L.GRADE_WORDS, verbs=(("reliable", ("وثقه", "وثقوه")), ("weak", ("ضعفه", "ضعفوه"))), titles=(("reliable", ("الحافظ", "الإمام")),)) -> Column:
    """A grade by the first that speaks: negations, keywords, verbs, titles; null if none does."""
    return F.coalesce(*[T.first_class(text, ladder) for ladder in (negations, keywords, verbs, titles)])


def defaulted(grade: Column | str, source: Column | str, defaults: dict[str, str]) -> Column:
    """A grade, or the default of its source where it is null or unknown."""
    table = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else None
    g = F.nullif(T.col(grade), F.lit("unknown"))
    return F.coalesce(g, table[T.col(source)] if defaults else F.lit(None), F.lit("unknown"))


def patterned_class(text: Column | str, patterns: list[tuple[str, str]], default: str = "unknown") -> Column:
    """The class of the first pattern that occurs."""
    t, out = T.col(text), None
    for name, p in patterns:
        out = F.when(t.rlike(p), name) if out is None else out.when(t.rlike(p), name)
    return F.lit(default) if out is None else out.otherwise(default)


def implausible(grade: Column | str, year: Column | str, level: Column | str, last=L.LAST_YEARS, spans=L.GENERATIONS) -> Column:
    """What doesn't fit a grade: a year of death after its last, a generation outside its span."""
    g = T.col(grade)
    by = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[g]
    late = T.col(year) > by(last)
    outside = ~T.col(level).between(by({k: v[0] for k, v in spans.items()}), by({k: v[1] for k, v in spans.items()}))
    return F.array_compact(F.array(F.when(F.coalesce(late, F.lit(False)), "year"), F.when(F.coalesce(outside, F.lit(False)), "generation")))


def phrase_grade(text: Column | str, table: dict[str, str], default: str = "unknown") -> Column:
    """The grade of a whole phrase, else of the first phrase of the table that the text holds."""
    exact = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.trim(T.col(text))]
    return F.coalesce(exact, T.first_class(text, tuple((g, (p,)) for p, g in table.items()), default))


def recoded(code: Column | str, table: dict[str, str], default: str | None = None) -> Column:
    """A code's name; an unlisted one gets the default."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[T.col(code)], F.lit(default))


def canonical(name: Column | str, variants: dict[str, str]) -> Column:
    """The canonical spelling of a transliterated name, found without case and extra white space; others stay.

    variants go into the plan: a few thousand at most; join a table of more."""
    n = F.lower(F.trim(F.regexp_replace(T.col(name), "\\s+", " ")))
    return F.coalesce(recoded(n, variants), T.col(name))
