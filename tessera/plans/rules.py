"""Queries that run the language rules, matching, folds and sources over tables of invented texts.

The driver's tables hold no names, chains or registers.  Where a rule needs such texts, a small table of them is dealt out over
the documents by id, so that the rule runs for every document; its SQL holds the result that was worked out by hand for each.
"""

from __future__ import annotations

import dataclasses
import io
import json
import re
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import names as N
from tessera.functions import numbers as U
from tessera.functions import text as T
from tessera.operators import chains as C
from tessera.operators import entities as E
from tessera.operators import graph as G
from tessera.operators import joins as J
from tessera.operators import matching as M
from tessera.operators import retrieval as V
from tessera.registry import register
from tessera.sources import corpus, files, html, markup, registers, sinks
from tessera.sources.tables import table


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(literal, v)) + "]"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


def dealt(spark: SparkSession, sf: str, rows: list[tuple], schema: str) -> DataFrame:
    """(doc_id, i, the columns of schema): row i of rows for each document whose id leaves i."""
    own = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    docs = table(spark, sf, "documents", "doc_id").select("doc_id", (F.col("doc_id") % len(rows)).cast("int").alias("i"))
    return docs.join(F.broadcast(own), "i")


def cases(query: str, schema: str, rows: list[tuple[tuple, tuple]], /, **outputs: Callable[[], Column]) -> None:
    """Registers a query of (i, outputs as text, n): rows are (inputs by schema, expected outputs)."""
    names = list(outputs)
    expected = values((i, *want) for i, (_, want) in enumerate(rows))
    kinds = ", ".join(f"CAST(t.{k} AS VARCHAR) AS {k}" for k in names)
    sql = f"WITH t(i, {', '.join(names)}) AS (VALUES {expected}) SELECT t.i, {kinds}, count(*) AS n FROM documents JOIN t ON t.i = CAST(doc_id % {len(rows)} AS INTEGER) GROUP BY ALL"

    def run(spark, sf):
        made = dealt(spark, sf, [given for given, _ in rows], schema).select("i", *[make().cast("string").alias(k) for k, make in outputs.items()])
        return made.groupBy("i", *names).agg(F.count("*").alias("n"))

    register(query, sql)(run)


def joined(array: Column) -> Column:
    return F.array_join(array, "|")


# --- normaliser profiles and tokens, which SQL can follow

TEXTS = ("أَحْمَدُ  بن إبراهيم، الفاطمةُ ى", "مُحَـمَّد بن ٱلحسن؛ آل ہند", "قال إنَّما الأعمالُ بالنيات، 12 في", "", "the Cat  sat; on مسجدة", "ۃ ک ے ی صلاة القرآن؛نور")
_CLASS = lambda marks: re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", marks)


def profile_sql(x: str, profile: str) -> str:
    marks, old, new, collapse = T.PROFILES[profile]
    out = f"translate(regexp_replace({x}, '[{_CLASS(marks)}]', '', 'g'), '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))" if collapse else out


_TEXTS_SQL = f"t(i, x) AS (VALUES {values(enumerate(TEXTS))}), d AS (SELECT t.* FROM documents JOIN t ON t.i = CAST(doc_id % {len(TEXTS)} AS INTEGER))"
_SETS = {"words": ("\\s+", 1), "asked": ("[\\s،؛;]+", 2)}
_SET_SQL = {k: f"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(v, '{p}'), lambda w: length(w) >= {n}))), '|')" for k, (p, n) in _SETS.items()}


@register("fx_profiles", f"WITH {_TEXTS_SQL}, p AS ({' UNION ALL '.join(f'''SELECT '{p}' AS profile, i, {profile_sql('x', p)} AS v FROM d''' for p in T.PROFILES)}) SELECT profile, i, v, {_SET_SQL['words']} AS words, {_SET_SQL['asked']} AS asked, count(*) AS n FROM p GROUP BY ALL")
def profiles(spark, sf):
    rows = dealt(spark, sf, [(t,) for t in TEXTS], "x string")
    forms = rows.select("i", F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), T.normalised("x", p).alias("v")) for p in T.PROFILES])).alias("f")).select("f.profile", "i", "f.v")
    sets = [joined(F.array_sort(T.split_words("v", p, n))).alias(k) for k, (p, n) in _SETS.items()]
    return forms.select("profile", "i", "v", *sets).groupBy("profile", "i", "v", "words", "asked").agg(F.count("*").alias("n"))


@register("fx_tokens", f"""WITH {_TEXTS_SQL}, w AS (SELECT i, unnest(regexp_extract_all(regexp_replace(x, '[{_CLASS(L.DIACRITICS)}]', '', 'g'), '[\\x{{0621}}-\\x{{063A}}\\x{{0641}}-\\x{{064A}}]+')) AS w FROM d)
SELECT {profile_sql('w', 'corpus')} AS token, count(*) AS n FROM w WHERE length(w) >= 3 AND {profile_sql('w', 'corpus')} NOT IN (SELECT {profile_sql('s', 'corpus')} FROM (VALUES {values((s,) for s in L.STOP_WORDS)}) x(s)) GROUP BY 1""")
def tokens(spark, sf):
    return dealt(spark, sf, [(t,) for t in TEXTS], "x string").select(F.explode(T.tokens("x")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# --- roots, heads and bodies, tags

ROOTS = ("كتاب", "مسلم", "دعو", "هدو", "ردد", "صلو", "قول")
cases(
    "fx_roots", "w string", [(("الكتاب",), ("كتاب",)), (("مسلمون",), ("مسلم",)), (("دعاء",), ("دعو",)), (("هدى",), ("هدو",)), (("رد",), ("ردد",)), (("صلاة",), ("صلو",)), (("قول",), ("قول",)), (("شمس",), (None,))],
    root=lambda: F.get(F.filter(T.root_candidates("w"), lambda x: x.isin(*ROOTS)), F.lit(0)),
)
cases(
    "fx_heads", "t string",
    [
        (("حدثنا مالك أن رسول الله قال: إنما الأعمال",), ("حدثنا مالك ", "إنما الأعمال")), (("عن زيد سمعت النبي : كلام",), ("عن زيد ", "كلام")), (("عن أنس قَالَ رسول الله «خير»",), ("عن أنس ", "خير»")),
        (("روى زيد قال كذا وكذا وكذا وكذا",), ("روى زيد قال ", "كذا وكذا وكذا وكذا")), (("لا شيء هنا",), ("", "لا شيء هنا")), (("",), ("", "")), ((None,), ("", "")),
    ],
    head=lambda: T.head_and_body("t")["head"], body=lambda: T.head_and_body("t")["body"],
)
cases(
    "fx_tags", "t string", [(("في المسجد يوم الجمعة",), ("time:الجمعة|place:المسجد", "prayer")), (("صلاة وزكاة ثم صيام",), ("", "fasting|prayer")), (("زكاة",), ("", "zakat")), (("شيء",), ("", "")), ((None,), ("", None))],
    markers=lambda: joined(F.transform(T.markers("t"), lambda m: F.concat_ws(":", m["kind"], F.array_join(m["markers"], ",")))), topics=lambda: joined(T.topics(T.tokens("t"))),
)

# --- names

cases(
    "fx_register_names", "t string",
    [
        (("# خ م: أحمد بن صالح: ثقة حافظ",), ("أحمد بن صالح",)), (("[الحمصي - 6] زيد",), ("الحمصي زيد",)), (("12 - زيد بن عمر، ويقال: عمرو",), ("زيد بن عمر",)), (("وأحمد بن زيد",), ("أحمد بن زيد",)), (("وهب بن منبه",), ("وهب بن منبه",)),
        (("الله بن عمر",), ("عبد الله بن عمر",)), (("محمد بن سعد روى عن مالك",), ("محمد بن سعد",)), (("زيد بن علي 120",), ("زيد بن علي",)), (("مسلم بن الحجاج",), ("مسلم بن الحجاج",)), (("مسلم النسائي أحمد بن زيد",), ("أحمد بن زيد",)), (("",), ("",)),
    ],
    name=lambda: N.register_name("t", ("مسلم", "النسائي")),
)
cases(
    "fx_name_fields", "t string",
    [
        (("ابو صالح السمان بن زيد، مولى. من العاشرة مات",), ("صالح", "العاشرة", "", "", "ابو صالح السمان|زيد، مولى. من العاشرة مات")), (("روى عن مالك بن أنس و سفيان الثوري، كذا. روى عنه أحمد بن حنبل و غيره.",), (None, None, "مالك بن أنس|سفيان الثوري", "أحمد بن حنبل|غيره", "روى عن مالك|انس و سفيان الثوري، كذا. روى عنه احمد|حنبل و غيره.")),
        (("محمد بن عبد الله بن أحمد",), (None, None, "", "", "محمد|عبد الله|احمد")), ((None,), (None, None, None, None, None)),
    ],
    kunya=lambda: T.kunya("t"), generation=lambda: N.generation("t"), teachers=lambda: joined(N.teachers("t")), students=lambda: joined(N.students("t")), parts=lambda: joined(T.name_parts("t")),
)
cases(
    "fx_chain_names", "t string",
    [
        ((" عائشة رضي الله عنها ",), ("عائشة", "عائشة رضي الله عنها", "عائشه رضي الله عنها", "عائشة رضي الله عنها")), (("زيد، ويقال عمرو: ثقة",), ("زيد، ويقال عمرو: ثقة", "زيد", "زيد", "زيد|ويقال عمرو: ثقة")),
        (("أب0 -> بكر",), ("أب0 -> بكر", "اب0 -> بكر", "اب0 -> بكر", "أبو|بكر")), ((None,), (None, None, None, None)),
    ],
    cleaned=lambda: T.clean_name("t"), first_item=lambda: T.first_item("t"), primary_name=lambda: T.primary_name("t"), chain=lambda: joined(C.split_chain(markup.repaired("t", {"0": "و"}))),
)
cases(
    "fx_canonical", "t string", [(("Abi Horaira",), ("Abu Hurayra", "x")), (("abu  huraira",), ("Abu Hurayra", "x")), (("Zayd",), ("Zayd", "x")), (("VII",), ("VII", "7")), (("II",), ("II", "2"))],
    name=lambda: N.canonical("t", {"abi horaira": "Abu Hurayra", "abu huraira": "Abu Hurayra"}), form=lambda: N.recoded("t", {"II": "2", "VII": "7"}, "x"),
)

# --- grades, numbers, markup

cases(
    "fx_grades", "g string, t string, s string",
    [
        (("unknown", "صدوق ضعيف", "mizan"), ("weak", "weak", "weak", "none", "unknown")), (("reliable", "متروك", "x"), ("reliable", "abandoned", "reliable", "left", "unknown")), ((None, "ضعفه فلان", "x"), ("unknown", "weak", "unknown", "none", "unknown")),
        (("unknown", "ليس بثقة", "x"), ("reliable", "weak", "unknown", "none", "weak")), (("weak", "-", "mizan"), ("weak", None, "weak", "none", "unknown")),
    ],
    raised=lambda: T.raised_grade("g", "t"), condensed=lambda: N.condensed_grade("t"), defaulted=lambda: N.defaulted("g", "s", {"mizan": "weak"}), patterned=lambda: N.patterned_class("t", [("left", "متر+وك"), ("dash", "^--")], "none"),
    phrase=lambda: N.phrase_grade("t", {"ليس بثقة": "weak", "حجة": "reliable"}),
)
cases(
    "fx_numbers", "t string, g string, y int, l int, o map<string,string>, w map<string,string>",
    [
        (("120-345 هـ 5", "companion", 120, 1, {"a": "1", "b": "2", "c": None}, {"a": "1", "b": "3", "d": "4"}), ("345", "120", "year", "b|d")), (("none", "companion", 100, 2, {}, {}), (None, None, "generation", "")),
        (("مات سنة ١ 77", "reliable", None, None, {"k": "v"}, {"k": "v"}), ("77", "77", "", "")), (("9999 12345", "reliable", 900, 30, {"k": "v"}, {}), ("9999", "9999", "year|generation", "k")),
    ],
    greatest=lambda: U.greatest_integer("t"), first=lambda: U.first_integer("t"), odd=lambda: joined(N.implausible("g", "y", "l")), changed=lambda: joined(U.changed_fields("o", "w")),
)
cases(
    "fx_markup", "h string",
    [
        (("<p class=x>a<script>b</script><i onclick=z>c</i><u>d</u> the</p>",), ("<p>a<i>c</i>d the</p>", "<p class=x>a<script>b</script><i onclick=z>c</i><u>d</u> <mark>the</mark></p>", None, "")),
        (("<table><tr><td>Grade</td><td>Sahih (x) </td></tr></table><div class='q'>no</div><div class=\"a b\">T<i>x</i></div>",), ("GradeSahih (x) noT<i>x</i>", "<table><tr><td>Grade</td><td>Sahih (x) </td></tr></table><div class='q'>no</div><div class=\"a b\">T<i>x</i></div>", "Sahih", "Tx")),
        (("plain The the",), ("plain The the", "plain <mark>The</mark> <mark>the</mark>", None, "")),
    ],
    clean=lambda: T.sanitised("h"), marked=lambda: T.highlighted("h", "the"), cell=lambda: html.second_cell("h"), styled=lambda: html.css_text("h", "b"),
)


@register("fx_unit_vectors", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM v)
SELECT vec_id, round(l, 6) AS length, round(e[1] / CASE WHEN l = 0 THEN 1 ELSE l END, 6) AS first, round(CASE WHEN l = 0 THEN 0 ELSE 1 END, 6) AS square FROM n""")
def unit_vectors(spark, sf):
    v = table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", U.norm("embedding").alias("l"), U.unit("embedding").alias("u"))
    return v.select("vec_id", F.round("l", 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(U.inner("u", "u"), 6).alias("square"))


# --- chains, matching, entities

KIN = {"father": {"هشام": "عروه"}, "grandfather": {"عمرو": "محمد الكبير"}, "mother": {"زيد": "هند"}}
CHAINS = (
    ("حدثنا مالك عن نافع عن ابن عمر قال النبي", ["مالك", "نافع", "ابن عمر"]), ("حدثنا هشام، عن أبيه، عن عائشة رضي الله عنها", ["هشام", "عروه", "عائشة"]), ("حدثنا أبي عن صالح عن زيد، عن أمه", ["ابي صالح", "زيد", "هند"]),
    ("عن عمه، واسع بن حبان، عن زيد", ["واسع بن حبان", "زيد"]), ("عن عمرو عن جده عن زيد", ["عمرو", "محمد الكبير", "زيد"]), ("حدثنا مالك عن نافع", ["مالك", "نافع"]), ("لا شيء", []),
)
_CHAINS_SQL = f"t(i, c) AS (VALUES {', '.join(f'({i}, CAST({literal(c)} AS VARCHAR[]))' for i, (_, c) in enumerate(CHAINS))}), m AS (SELECT doc_id, unnest(c) AS name, unnest(range(0, len(c))) AS pos FROM documents JOIN t ON t.i = CAST(doc_id % {len(CHAINS)} AS INTEGER))"


@register("cq_extracted_graph", f"WITH {_CHAINS_SQL}, e AS (SELECT name AS src, lead(name) OVER (PARTITION BY doc_id ORDER BY pos) AS dst FROM m) SELECT src, dst, count(*) AS n FROM e WHERE dst IS NOT NULL GROUP BY src, dst")
def extracted_graph(spark, sf):
    """Chains out of texts, and the graph of who follows whom."""
    chained = dealt(spark, sf, [(t,) for t, _ in CHAINS], "t string").select("doc_id", C.chains("t", KIN).alias("c"))
    return G.edge_counts(G.successions(C.member_rows(chained, "doc_id", "c"), "doc_id", ["pos"], "name")).select("src", "dst", "n")


PROFILES = (
    (1, "مالك بن أنس: إمام", "reliable"), (2, "سفيان بن سعيد الثوري", "reliable"), (3, "سفيان بن عيينة", "reliable"), (4, "ابو صالح السمان", "weak"), (5, "الزهري محمد", "reliable"), (6, "يحيى الزهري", "reliable"), (7, "نافع مولى عمر", "reliable"),
    (8, "عبد الله بن عباس", "companion"), (9, "علي بن زيد", "weak"), (10, "علي بن سعد", "weak"),
)
ALIASES = (("عائشه", None), ("القعنبي", "نافع مولى عمر"))
MATCHES = (
    ("مَالِك بن أنس", "exact", 1), ("سفيان الثوري", "all words", 2), ("أبي صالح", "kunya", 4), ("الزهري", "byname", 5), ("نافع", "first name", 7), ("ابن عباس", "son of", 8), ("علي", "none", None), ("عائشة", "ruled out", None), ("القعنبي", "manual", 7), ("بن", "none", None),
)


@register("jn_strategies", f"WITH t(i, name, strategy, key) AS (VALUES {values((i, *m) for i, m in enumerate(MATCHES))}) SELECT name, strategy, CAST(key AS BIGINT) AS key, count(*) AS n FROM documents JOIN t ON t.i = CAST(doc_id % {len(MATCHES)} AS INTEGER) GROUP BY ALL")
def strategies(spark, sf):
    """The seven strategies of matching free names to graded profiles."""
    names = dealt(spark, sf, [(m[0],) for m in MATCHES], "name string")
    found = M.matched(names, spark.createDataFrame(PROFILES, "key long, name string, grade string"), spark.createDataFrame(ALIASES, "name string, target string"))
    return names.groupBy("name").agg(F.count("*").alias("n")).join(found, "name").select("name", "strategy", "key", "n")


@register("jn_nearest", """WITH a AS (SELECT event_id, user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id AS other_at, user_id FROM events WHERE event_type = 'view')
SELECT a.event_id, a.user_id, min(other_at) AS other_at, min(other_at) % 10 AS value FROM a JOIN b ON a.user_id = b.user_id AND other_at BETWEEN event_id - 3000 AND event_id + 2000 GROUP BY a.event_id, a.user_id""")
def nearest(spark, sf):
    rows = table(spark, sf, "events", "event_id", "user_id", "event_type")
    views = rows.where("event_type = 'view'").select("event_id", "user_id", (F.col("event_id") % 10).alias("value"))
    return J.nearest(rows.where("event_type = 'purchase'").select("event_id", "user_id"), views, "event_id", 3000, 2000, "user_id")


SPLIT = ([(1, 100), (2, 103), (3, 120), (4, None), (5, 121), (6, 90)], [(4, 3), (4, 5), (1, 3)], [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)])


@register("er_year_clusters", f"SELECT CAST(n_nationkey * 100 + id AS BIGINT) AS id, CAST(n_nationkey * 100 + c AS BIGINT) AS cluster FROM nation, (VALUES {values(SPLIT[2])}) t(id, c)")
def year_clusters(spark, sf):
    """A component of members whose years conflict, in each nation."""
    nation = table(spark, sf, "nation").select((F.col("n_nationkey").cast("long") * 100).alias("at"))
    members = nation.join(F.broadcast(spark.createDataFrame(SPLIT[0], "id long, year int")))
    pairs = nation.join(F.broadcast(spark.createDataFrame(SPLIT[1], "a long, b long"))).select((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    nodes = members.select((F.col("at") + F.col("id")).alias("node"), F.col("at").alias("component"))
    return E.conflict_split(nodes, members.select((F.col("at") + F.col("id")).alias("id"), "year"), pairs).select("id", "cluster")


KNOWN = ((1, "a b c"), (2, "s"))
ENTRIES = ((10, "a b c d", 0, 1, "prefix4"), (11, "s", 1, 2, "exact"), (12, "new", 0, -12, "new"), (13, "new", 1, -12, "exact"), (14, "a b x", 2, 1, "prefix3"), (15, "b c d e", 0, -15, "new"), (16, "b c d f", 1, -15, "prefix4"))


@register("er_merge_sources", f"SELECT CAST(n_nationkey * 100 + e AS BIGINT) AS entry_id, CAST(CASE WHEN id > 0 THEN n_nationkey * 100 + id ELSE id - n_nationkey * 100 END AS BIGINT) AS id, method FROM nation, (VALUES {values((e, i, m) for e, _, _, i, m in ENTRIES)}) t(e, id, method)")
def merge_sources(spark, sf):
    """Entries of sources by priority against known profiles, in each nation, whose key is the first word of the names."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    named = lambda df, key: nation.join(F.broadcast(df)).select((F.col("k") * 100 + F.col(key)).alias(key), F.concat_ws(" ", F.concat(F.lit("n"), F.col("k")), "name").alias("name"), *[c for c in df.columns if c not in (key, "name")])
    return E.source_merge(named(spark.createDataFrame([e[:3] for e in ENTRIES], "entry_id long, name string, prio int"), "entry_id"), named(spark.createDataFrame(KNOWN, "id long, name string"), "id"))


@register("er_older_merge", """WITH s AS (SELECT c_nationkey AS k, c_custkey AS o, c_mktsegment AS source, CASE WHEN c_acctbal < 0 THEN 'weak' WHEN c_acctbal > 9500 THEN 'reliable' ELSE 'unknown' END AS g, CASE WHEN c_acctbal > 8000 THEN CAST(c_custkey % 12 AS INTEGER) END AS l FROM customer)
SELECT k, coalesce(arg_min(g, o) FILTER (source = 'BUILDING' AND g <> 'unknown'), arg_min(g, o) FILTER (g <> 'unknown'), 'unknown') AS grade, arg_min(l, o) FILTER (l IS NOT NULL) AS level, count(*) AS n FROM s GROUP BY k""")
def older_merge(spark, sf):
    grade = F.when(F.col("c_acctbal") < 0, "weak").when(F.col("c_acctbal") > 9500, "reliable").otherwise("unknown")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("o"), F.col("c_mktsegment").alias("source"), grade.alias("g"), F.when(F.col("c_acctbal") > 8000, (F.col("c_custkey") % 12).cast("int")).alias("level"))
    return rows.groupBy("k").agg(E.filled_grade("g", ["o"], F.col("source") == "BUILDING").alias("grade"), F.min_by("level", F.when(F.col("level").isNotNull(), F.col("o"))).alias("level"), F.count("*").alias("n"))


@register("er_names_union", "WITH v AS (SELECT c_nationkey AS k, v, min(c_custkey * 2 + i) AS o FROM (SELECT c_nationkey, c_custkey, unnest([c_mktsegment, 'z' || (c_custkey % 4)]) AS v, unnest([0, 1]) AS i FROM customer) GROUP BY k, v) SELECT k, string_agg(v, '|' ORDER BY o) AS names FROM v GROUP BY k")
def names_union(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", F.array("c_mktsegment", F.concat(F.lit("z"), F.col("c_custkey") % 4)).alias("names"))
    return E.merged_names(rows, "k", "c_custkey", "names").select("k", joined(F.col("names")).alias("names"))


# --- sources and sinks

def put(spark: SparkSession, path: str, content: str | bytes) -> None:
    """A small file in the shared folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()


REGISTER = "### $ 1 - محمد بن عبد الله: ثقة، مات سنة ست وعشرين ومائة\n### $ 2 - عمر بن زيد: ضعيف\n### $ 3 - زيد: تقدم\n### $ 4 - سعد بن مالك. صحابي\n"
MARKED = "######x\n#META# y\n### | Vol\n### || Chap\n# 1 - first record text that\n~~is long enough PageV01P002\n# 2 - short\n### || Next\n# 7 - another record that is long enough\nmore\n"
SOURCE_ROWS = (
    ("corpus", "0/3", "|plain|Hasan"), ("corpus", "1/7", "N:|t|Sahih"), ("corpus", "1/8", "||Da'if"), ("chapters", "0", "2.json|1"), ("chapters", "1", "1.json|2"), ("chapters", "2", "9.json|0"), ("lists", "1", "1|2"), ("lists", "2", ""), ("lists", "3", ""),
    ("docx", "0", "one two"), ("docx", "1", ""), ("marked", "Vol/Chap/1", "first record text that is long enough"), ("marked", "Vol/Next/1", "another record that is long enough more"), ("ocr", "0", "lazy"), ("log", "1", "2"),
    ("verses", "1:1/0", "x|R"), ("verses", "1:1/1", "y|"), ("commentary", "1:1", "T"), ("commentary", "1:2", "T"), ("commentary", "1:3", ""), ("roots", "x", "1|q"), ("roots", "y", "|a"), ("pages", "1", "one"), ("pages", "2", "two"),
)


@register("io_sources", f"SELECT * FROM (VALUES {values(SOURCE_ROWS)}) t(source, key, value)")
def io_sources(spark, sf):
    """Files of every layout in the shared folder, read back: JSON corpus with grade files, CSV lists, word-processor file,
    marked-up text, recognised text, verses, commentary, roots, page containers, and an audit log."""
    at = f"{G.shared_dir(spark).rstrip('/')}/tessera-sources-{uuid.uuid4().hex}"
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/></w:body></w:document>')
    contents = {
        "corpus/b1/index.json": json.dumps([{"file": "2.json", "name_ar": "x", "name_en": "X", "count": 1}, {"file": "1.json", "name_ar": "y", "name_en": "Y", "count": 2}, {"file": "9.json", "name_ar": "", "name_en": "", "count": 0}]),
        "corpus/b1/1.json": json.dumps([{"id": 1, "idInBook": 7, "arabic": "ا", "english": {"narrator": "N:", "text": "t"}, "grade": "Sahih"}, {"idInBook": 8, "arabic": "", "english": {"narrator": "", "text": ""}}]),
        "corpus/b1/2.json": json.dumps([{"id": 3, "arabic": "ب", "english": "plain", "majlisiGrading": "", "behdudiGrading": "Hasan"}]), "corpus/b1/3.json": "<html>404</html>", "corpus/b1/grades.json": json.dumps({"8": "Da'if", "7": "other"}),
        "n.csv": 'id,name,to\n1,a,"[1, 2]"\n2,b,oops\n3,c,[]\n', "docx/a.docx": word.getvalue(), "docx/b.docx": b"no zip", "m.txt": MARKED, "v.json": json.dumps([{"k": "1:1", "a": 1, "words": [{"t": "x", "r": "R"}, {"t": "y"}]}]),
        "c.json": json.dumps({"1:1": {"text": "T"}, "1:2": "1:1", "1:3": "9:9"}), "r.json": json.dumps({"x": {"f": 2, "v": ["1", "1"], "fam": "q"}, "y": {"fam": ["a", "b"]}}), "ocr.txt": "1azy",
    }
    for path, content in contents.items():
        put(spark, f"{at}/{path}", content)
    log = spark.createDataFrame([(1, "x")], "id long, g string")
    for _ in range(2):
        sinks.appended_log(log, f"{at}/log")
    books = corpus.with_grades(corpus.documents(spark, f"{at}/corpus"), corpus.grades(spark, f"{at}/corpus"))
    rows = lambda source, df, key, *value: df.select(F.lit(source).alias("source"), key.cast("string").alias("key"), F.array_join(F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in value]), "|").alias("value"))
    col = F.col
    found = [
        rows("corpus", books, F.concat_ws("/", "ch_idx", "doc_id"), col("narrator"), col("english"), col("grade")), rows("chapters", corpus.chapters(spark, f"{at}/corpus"), col("ch_idx"), col("file"), col("cnt")),
        rows("lists", files.csv(spark, f"{at}/n.csv", "id long, name string, to string", {"to": "long"}), col("id"), F.array_join("to", "|")), rows("docx", files.docx(spark, f"{at}/docx/*.docx"), col("i"), col("line")),
        rows("marked", markup.headed(markup.lines(markup.read(spark, f"{at}/m.txt"))), F.concat_ws("/", "volume", "chapter", "number"), col("text")), rows("ocr", spark.read.text(f"{at}/ocr.txt"), F.lit("0"), markup.repaired("value", {"1": "l"})),
        rows("log", sinks.read_log(spark, f"{at}/log", "id long, g string").groupBy("id").agg(F.count("*").alias("n")), col("id"), col("n")), rows("verses", corpus.verses(spark, f"{at}/v.json"), F.concat_ws("/", "verse", "pos"), col("word"), col("root")),
        rows("commentary", corpus.commentary(spark, f"{at}/c.json"), col("verse"), col("text")), rows("roots", corpus.roots(spark, f"{at}/r.json"), col("root"), F.get("v", F.lit(0)), F.get("fam", F.lit(0))),
        rows("pages", html.containers(spark.createDataFrame([("x<hr>one<hr>two",)], "h string"), "h", "<hr>"), col("pos"), col("part")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


#: By source: the grades of the register's entries 1, 2 and 4.
REGISTER_GRADES = {s: ("reliable", "weak", "companion") for s in registers.SOURCES} | {"tahdhib_kamal": ("unknown", "unknown", "companion"), "isaba": ("companion", "companion", "companion")}
REGISTER_ENTRIES = ((1, "محمد بن عبد الله", 126), (2, "عمر بن زيد", None), (4, "سعد بن مالك", None))


@register("sc_registers", "SELECT * FROM (VALUES " + values((s, i, name, g, y) for s, gs in REGISTER_GRADES.items() for (i, name, y), g in zip(REGISTER_ENTRIES, gs, strict=True)) + ") t(source, id, name, grade_en, death)")
def parsed_registers(spark, sf):
    """A register's entries through every configured layout; layouts that are alike are read once."""
    text = spark.createDataFrame([("p", REGISTER)], "path string, text string")
    alike: dict[registers.Source, list[str]] = {}
    for name, source in registers.SOURCES.items():
        alike.setdefault(dataclasses.replace(source, name=""), []).append(name)
    out = None
    for source, names in alike.items():
        each = F.explode(F.array(*[F.lit(n) for n in names])).alias("source")
        part = registers.parsed(text, source).select(each, F.col("id").cast("int").alias("id"), "name", "grade_en", "death")
        out = part if out is None else out.union(part)
    return out


@register("io_vector_store", "SELECT vec_id, len(embedding) AS dim, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS length FROM embeddings WHERE vec_id % 40 = 3")
def vector_store(spark, sf):
    """Unit vectors with their lengths as a table, and a list of ids fetched from it."""
    stored = V.stored_vectors(table(spark, sf, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    wanted = table(spark, sf, "embeddings", "vec_id").where("vec_id % 40 = 3")
    return V.fetched(stored, wanted, "vec_id").select("vec_id", F.size("unit").cast("long").alias("dim"), F.round("length", 6).alias("length"))
