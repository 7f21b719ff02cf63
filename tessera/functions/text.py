"""Text functions as Column expressions: normalising, tokens, stems, tags, grades, names.

All stay in the JVM.  A null text gives null (or an empty array where an array is due); empty texts are texts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicon as L

#: Letters to replace, by profile: (diacritics removed, from, to, white space collapsed).  A letter without a partner is removed.
PROFILES = {
    "corpus": (L.DIACRITICS, "أإآةى", "اااهي", False),
    "name": (L.DIACRITICS, "أإآـ", "ااا", True),
    "registry": (L.DIACRITICS, "أإآہیکےۃـ", "اااهيكية", True),
    "match": (L.DIACRITICS, "أإآةـ", "اااه", True),
    "viewer": (L.DIACRITICS_VIEWER, "أإآةىـ", "اااهي", True),
    "retrieval": (L.DIACRITICS, "أإآٱة", "ااااه", False),
}

#: \\b as RE2 has it: the edge of a run of ASCII letters, digits and underscores.  Java's counts letters of all scripts.
ASCII_BOUNDARY = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_marks(text: Column | str, marks: str = L.DIACRITICS) -> Column:
    return F.regexp_replace(col(text), f"[{marks}]", "")


def normalised(text: Column | str, profile: str = "corpus") -> Column:
    """Text without marks and with letter variants unified, by one of PROFILES."""
    marks, old, new, collapse = PROFILES[profile]
    out = F.translate(strip_marks(text, marks), old, new)
    return F.trim(F.regexp_replace(out, "\\s+", " ")) if collapse else out


def _normal(text: str) -> str:
    """The corpus profile for a word of a list."""
    marks = re.compile(f"[{L.DIACRITICS.encode().decode('unicode_escape')}]")
    return marks.sub("", text).translate(str.maketrans("أإآةى", "اااهي"))


def words(text: Column | str, least: int = 3) -> Column:
    """Runs of at least so many letters, of any script, in lower case."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(f"\\p{{L}}{{{least},}}"), 0)


def first_words(text: Column | str, n: int, near: int = 512) -> Column:
    """The first n runs of letters in lower case; where they end within so many characters, the rest isn't looked at."""
    runs = f"^(?:[^\\p{{L}}]*+\\p{{L}}++){{1,{n}}}+"
    whole = f"^(?:[^\\p{{L}}]*+\\p{{L}}++){{{n}}}[^\\p{{L}}]"
    head = F.nullif(F.regexp_extract(F.substring(col(text), 1, near), whole, 0), F.lit(""))
    return F.filter(F.split(F.regexp_extract(F.lower(F.coalesce(head, col(text))), runs, 0), "[^\\p{L}]+"), lambda w: w != "")


def last_word(text: Column | str, near: int = 512) -> Column:
    """The last run of letters in lower case, null if there is none; where it begins within so many characters, the rest isn't looked at."""
    whole, run = "^[^\\p{L}]*+\\p{L}++[^\\p{L}]", "^[^\\p{L}]*+(\\p{L}++)"
    tail = F.nullif(F.regexp_extract(F.reverse(F.right(col(text), F.lit(near))), whole, 0), F.lit(""))
    found = F.regexp_extract(F.reverse(F.lower(F.coalesce(F.reverse(tail), col(text)))), run, 1)
    return F.nullif(F.reverse(found), F.lit(""))


def tokens(text: Column | str, least: int = 3, stop=L.STOP_WORDS) -> Column:
    """Normalised letter runs of a body text, without stop words (compared after both are normalised)."""
    found = F.regexp_extract_all(strip_marks(text), F.lit("[\\u0621-\\u063A\\u0641-\\u064A]+"), 0)
    kept = F.transform(F.filter(found, lambda w: F.length(w) >= least), lambda w: normalised(w))
    drop = F.array(*[F.lit(w) for w in sorted({_normal(w) for w in stop})]) if stop else F.array().cast("array<string>")
    return F.filter(kept, lambda w: ~F.array_contains(drop, w))


def split_words(text: Column | str, pattern: str = "\\s+", least: int = 1) -> Column:
    """Distinct words between separators, of so many characters at least."""
    return F.array_distinct(F.filter(F.split(col(text), pattern), lambda w: F.length(w) >= least))


def bound(value: Column, use) -> Column:
    """use(x) with x standing for value, which is computed once however often use names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def light_stem(word: Column | str, prefixes=L.PREFIXES, suffixes=L.SUFFIXES, normal: bool = True) -> Column:
    """One longest prefix off, then one longest suffix, each leaving two characters; words of three stay."""

    def off(x: Column, affixes: list[str], front: bool) -> Column:
        out = F.when(F.length(x) <= 3, x)
        for a in sorted(affixes, key=lambda a: (-len(a), affixes.index(a))):
            fits = (x.startswith(a) if front else x.endswith(a)) & (F.length(x) - len(a) >= 2)
            out = out.when(fits, F.substr(x, F.lit(len(a) + 1)) if front else F.substr(x, F.lit(1), F.length(x) - len(a)))
        return out.otherwise(x)

    stemmed = lambda w: bound(off(w, list(prefixes), True), lambda x: off(x, list(suffixes), False))
    return bound(normalised(word) if normal else col(word), stemmed)


def root_candidates(word: Column | str, geminate: bool = True) -> Column:
    """Spellings under which a word's root may be listed, best first: itself, its stem, without the article,
    weak last letters replaced, and two-letter stems doubled."""
    cut = lambda x: F.substr(x, F.lit(1), F.length(x) - 1)
    double = lambda x: F.when(F.length(x) == 2, F.concat(x, F.substr(x, F.lit(2), F.lit(1))))
    ends = lambda x, letter, new: F.when(x.endswith(letter), F.concat(cut(x), F.lit(new)))

    def weak(base: Column) -> Column:
        def after_hamza(trimmed: Column) -> Column:
            return bound(light_stem(trimmed, normal=False), lambda ts: F.array(trimmed, ts, ends(ts, "ا", "و"), ends(ts, "ا", "ي"), double(ts) if geminate else F.lit(None).cast("string")))

        others = F.array(ends(base, "ا", "و"), ends(base, "ه", "و"), ends(base, "ه", "ي"), ends(base, "ه", ""), ends(base, "ي", "و"))
        return F.concat(F.coalesce(bound(F.when(base.endswith("ء"), cut(base)), after_hamza), F.array().cast("array<string>")), others)

    def ways(norm: Column) -> Column:
        bare = F.when(norm.startswith("ال"), F.substr(norm, F.lit(3))).otherwise(norm)
        bases = bound(bare, lambda b: F.array(light_stem(b, normal=False), light_stem(norm, normal=False), b))

        def listed(x: Column) -> Column:
            first = F.array(norm, F.get(x, F.lit(1)), F.get(x, F.lit(2)), F.get(x, F.lit(0)))
            last = F.transform(x, lambda b: double(b)) if geminate else F.array().cast("array<string>")
            return F.concat(first, F.flatten(F.transform(x, lambda b: weak(b))), last)

        return bound(bases, listed)

    return F.array_distinct(F.filter(bound(normalised(word), ways), lambda w: w.isNotNull() & (F.length(w) > 0)))


def first_of(*columns: Column | str) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in columns])


def head_and_body(text: Column | str, starts=L.BODY_STARTS, marker: str = "قال[:\\s]", share: float = 0.8) -> Column:
    """struct(head, body): parted after the first of the patterns that occurs, else after the last marker
    if that ends before the given share of the text, else all is body.  Offsets are taken in the text without marks."""
    t = col(text)
    out = F.when(t.isNull() | (t == ""), F.struct(F.lit("").alias("head"), F.lit("").alias("body")))
    quotes = "[" + re.escape(L.BODY_QUOTES) + "]"
    for p in starts:
        whole = f"(?s)^(.*?)(?:{p})(.*)$"
        body = F.regexp_replace(F.regexp_extract(t, whole, 2), f"^{quotes}+", "")
        out = out.when(t.rlike(p), F.struct(F.regexp_extract(t, whole, 1).alias("head"), body.alias("body")))
    clean = strip_marks(t)
    head = F.regexp_extract(clean, f"(?s)^(.*(?:{marker}))", 1)
    rest = F.regexp_replace(F.substr(clean, F.length(head) + 1), "^[ :]+", "")
    out = out.when((F.length(head) > 0) & (F.length(head) < F.length(clean) * share), F.struct(head.alias("head"), rest.alias("body")))
    return out.otherwise(F.struct(F.lit("").alias("head"), t.alias("body")))


def speaker(text: Column | str) -> Column:
    """Who an English head names: "Narrated X:", "X reported", else what stands before a colon."""
    t = col(text)
    return F.coalesce(
        F.nullif(F.trim(F.regexp_extract(t, "^Narrated\\s+([^:]+):", 1)), F.lit("")),
        F.nullif(F.trim(F.regexp_extract(t, "(?i)^([^:]+)\\s+reported", 1)), F.lit("")),
        F.trim(F.substring_index(t, ":", 1)),
    )


def classes(text: Column | str, rules=L.RULES) -> Column:
    """Names of the rule classes of which a pattern occurs, sorted."""
    t = col(text)
    found = [F.when(t.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in sorted(rules.items())]
    return F.array_compact(F.array(*found))


def markers(text: Column | str, groups=L.CIRCUMSTANCES) -> Column:
    """array(struct(kind, markers)) of the markers that occur in the normalised text."""
    t = normalised(text)
    parts = [F.struct(F.lit(k).alias("kind"), F.array_compact(F.array(*[F.when(F.contains(t, F.lit(_normal(m))), F.lit(m)) for m in ms])).alias("markers")) for k, ms in groups.items()]
    return F.filter(F.array(*parts), lambda p: F.size(p["markers"]) > 0)


def topics(toks: Column | str, groups=L.TOPICS) -> Column:
    """Sorted distinct topics of tokens: by the token or its light stem."""
    table = F.create_map(*[F.lit(x) for k, ws in groups.items() for w in ws for x in (_normal(w), k)])
    found = F.flatten(F.transform(col(toks), lambda w: F.array(table[w], table[light_stem(w, normal=False)])))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def first_class(text: Column | str, ladder, default: str | None = None) -> Column:
    """The name of the first (name, words) of a ladder of which a word occurs."""
    t = col(text)
    if not ladder:
        return F.lit(default)
    out = reduce(lambda acc, x: acc.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in x[1]]), F.lit(x[0])), ladder, F.when(t.isNull(), F.lit(default)))
    return out.otherwise(F.lit(default))


def raised_grade(grade: Column | str, text: Column | str, ladder=L.GRADE_WORDS) -> Column:
    """An unknown grade, raised by the words of its text."""
    g = F.coalesce(F.nullif(col(grade), F.lit("")), F.lit("unknown"))
    return F.when(g != "unknown", g).otherwise(first_class(text, ladder, "unknown"))


def grade_of_text(text: Column | str) -> Column:
    """sahih, hasan or daif by the first that a free text names."""
    return first_class(F.lower(col(text)), (("sahih", ("sahih",)), ("hasan", ("hasan",)), ("daif", ("da'if", "daif", "weak"))))


def name_parts(name: Column | str, separator: str = "بن") -> Column:
    """Parts of a lineage between separators, normalised and without blanks."""
    parts = F.split(normalised(name, "name"), f"\\s+{separator}\\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def same_prefix(a: Column | str, b: Column | str, least: int = 3) -> Column:
    """Whether the shorter of two arrays begins the longer, and has so many parts."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    return (n >= least) & (F.slice(col(a), F.lit(1), F.greatest(n, F.lit(1))) == F.slice(col(b), F.lit(1), F.greatest(n, F.lit(1))))


def first_item(text: Column | str, separator: str = "،") -> Column:
    return normalised(F.trim(F.substring_index(col(text), separator, 1)), "name")


def primary_name(text: Column | str) -> Column:
    """The name before a colon or an alternative."""
    return normalised(F.trim(F.regexp_replace(F.substring_index(col(text), ":", 1), "(?s)،\\s?ويقال.*|،\\s?يقال.*", "")), "match")


def kunya(name: Column | str) -> Column:
    """The word after a leading father-of; null without one."""
    return F.nullif(F.regexp_extract(col(name), "^(?:ابو|ابي|أبو|أبي)\\s+(\\S+)", 1), F.lit(""))


def clean_name(text: Column | str) -> Column:
    """A chain member's name without marks, stretching, blessings and speech marks."""
    out = F.regexp_replace(strip_marks(F.trim(col(text))), "ـ", "")
    for pattern in ("\\s*رض[يى]\\s*الله\\s*عنه[ما]*\\s*", "\\s*عليه\\s*السلام\\s*", "(?s)\\s*صلى\\s*الله\\s*عليه.*", "^\\s*ان\\s+", "^\\s*انه\\s+", "\\s*قال\\s*:?\\s*\"?\\s*$"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def truncated(text: Column | str, patterns, after: int = 5) -> Column:
    """Text up to the earliest pattern that begins after so many characters."""
    t = col(text)
    at = [F.regexp_instr(F.substr(t, F.lit(after + 1)), F.lit(p)) for p in patterns]
    least = F.least(*[F.when(a > 0, a) for a in at], F.lit(None).cast("int"))
    return F.when(least.isNotNull(), F.rtrim(F.substr(t, F.lit(1), least + after - 1))).otherwise(t)


def valid_name(name: Column | str) -> Column:
    """A name has three characters, a letter, no leading separator and no leading digit, dash or hash."""
    n = F.trim(col(name))
    return F.coalesce((F.length(n) >= 3) & n.rlike("\\p{L}") & ~n.rlike("^(?:بن\\s|[\\d#\\-])"), F.lit(False))


def artifacts(fields: dict[str, Column], verbs=L.ARTIFACTS) -> Column:
    """Names of the fields in which a banned verb occurs."""
    hit = lambda c: reduce(lambda a, b: a | b, [F.coalesce(F.contains(c, F.lit(v)), F.lit(False)) for v in verbs])
    return F.array_compact(F.array(*[F.when(hit(c), F.lit(k)) for k, c in fields.items()]))


def has_letters_in_order(word: Column | str, root: str) -> Column:
    """Whether a root's letters occur in a word in their order."""
    return col(word).rlike(".*".join(re.escape(c) for c in root))


def script_share(text: Column | str, chars: str = "\\u0600-\\u06FF") -> Column:
    """Share of a text's characters in a class; 0 for an empty text."""
    t = col(text)
    n = F.length(t)
    return F.when(n > 0, (n - F.length(F.regexp_replace(t, f"[{chars}]", ""))) / n).otherwise(F.lit(0.0))


def highlighted(text: Column | str, word: str, cut: int = 140) -> Column:
    """The first characters of a text with each occurrence of a word, in any case, in marks."""
    return F.regexp_replace(F.substring(col(text), 1, cut), f"(?i)(?<!\\p{{L}})({re.escape(word)})(?!\\p{{L}})", "<mark>$1</mark>")


def sanitised(html: Column | str, allowed=("b", "i", "em", "strong", "p", "br", "span", "sup")) -> Column:
    """HTML without tags that aren't allowed, and allowed ones without attributes."""
    keep = "|".join(allowed)
    out = F.regexp_replace(col(html), "(?is)<(script|style)\\b.*?</\\1\\s*>", "")
    out = F.regexp_replace(out, f"(?i)</?(?!(?:{keep})\\b)[a-z!][^>]*>", "")
    return F.regexp_replace(out, f"(?i)<(/?)({keep})\\b[^>]*>", "<$1$2>")


def gloss(text: Column | str, patterns=("\"([^\"]{2,})\"", "means? ([^.;,]+)", "signifies ([^.;,]+)"), most: int = 60) -> Column:
    """A short meaning out of a definition: the first pattern that occurs, else its first sentence; cut to a length."""
    t = col(text)
    found = F.trim(F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns], F.substring_index(t, ".", 1)))
    return F.when(F.length(found) > most, F.concat(F.substring(found, 1, most - 3), F.lit("…"))).otherwise(found)
