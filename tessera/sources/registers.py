"""Biographical registers: one parser, configured for each source's layout.

A source says how an entry begins, which ladder grades it, what it defaults to and how much of its text is read for a
grade.  The order is: name, cross-reference skip, grade, default, mark of a companion, year of death, kunya.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import names as N
from tessera.functions import text as T
from tessera.functions.numbers import years
from tessera.sources import markup


@dataclass(frozen=True)
class Source:
    """begin: a pattern that an entry's first line matches, group 1 its number, group 2 the rest."""

    name: str
    begin: str = r"### \$ (\d+)\s*-?\s*(.*)"
    ladder: tuple = L.GRADE_WORDS
    default: str = "unknown"
    read: int = 600
    companions: tuple[str, ...] = ("صحابي", "له صحبة")
    references: tuple[str, ...] = ("تقدم", "يأتي", "انظر")
    cuts: tuple[str, ...] = field(default=("\\.", "،", ":", "\\s+(?:روى|سمع|حدث|عن)\\s"))


def parsed(texts: DataFrame, source: Source) -> DataFrame:
    """(id, name, kunya, grade_en, death, source, text) of entries of (path, text); short cross-references are left out."""
    rows = texts.select(F.explode(markup.entries("text", source.begin)).alias("entry"))
    body = F.regexp_replace(F.regexp_extract("entry", f"(?s)^{source.begin}(.*)$", 3), "\\s+", " ")
    at = rows.select(F.regexp_extract("entry", source.begin, 1).try_cast("long").alias("id"), F.trim(F.concat_ws(" ", F.regexp_extract("entry", source.begin, 2), body)).alias("text"))
    head = F.regexp_extract("text", "^(.*?)(?:" + "|".join(source.cuts) + "|$)", 1)
    name = N.register_name(head)
    refers = F.col("text").rlike("|".join(source.references)) & (F.length("text") < 60)
    graded = T.first_class(F.substring("text", 1, source.read), source.ladder, source.default)
    companion = F.substring("text", 1, 300).rlike("|".join(source.companions))
    out = at.withColumn("name", name).where(T.valid_name("name") & ~refers)
    grade = F.when((graded == source.default) & companion, "companion").otherwise(graded)
    return out.select("id", "name", T.kunya(T.normalised("name", "name")).alias("kunya"), grade.alias("grade_en"), years("text").alias("death"), F.lit(source.name).alias("source"), "text")


#: Layouts by source id; each differs from the default where its register does.
SOURCES = {
    s.name: s
    for s in (
        Source("taqrib"), Source("tahdhib_kamal", ladder=()), Source("tahdhib_tahdhib"), Source("mizan", default="weak"), Source("jarh"), Source("thiqat", default="reliable"),
        Source("kamil", begin=r"### (?:\|\|\|\| |\$ )(\d+)\s*-?\s*(.*)", default="weak"), Source("tarikh", begin=r"### \$ ?(\d*)\s*-?\s*(.*)"), Source("tabaqat", read=500), Source("siyar"),
        Source("isaba", ladder=(), default="companion"), Source("tarikh_islam", begin=r"### \$(?:BIO_MAN\$)? ?(\d*)\s*-?\s*(.*)", read=500), Source("lisan_mizan", default="weak"), Source("durar_kamina", read=400), Source("kashif"),
        Source("tadhkirat_huffaz"), Source("mughni_ducafa", default="weak"), Source("diwan_ducafa", default="weak"), Source("dhayl_diwan", default="weak"), Source("mucjam_shuyukh", begin=r"### \$ ?(\d*)\s*-?\s*(.*)"), Source("macrifa_qurra"), Source("mucin_tabaqat"),
    )
}
