from __future__ import annotations

import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from tessera.sources import corpus, files, html, markup, registers, sinks
from tessera.streaming import events as S
from tests.conftest import DATA


def test_corpus(spark, tmp_path):
    book = tmp_path / "b1"
    book.mkdir()
    (book / "index.json").write_text(json.dumps([{"file": "2.json", "name_ar": "x", "name_en": "X", "count": 1}, {"file": "1.json", "name_ar": "y", "name_en": "Y", "count": 2}, {"file": "9.json", "name_ar": "", "name_en": "", "count": 0}]))
    (book / "1.json").write_text(json.dumps([{"id": 1, "idInBook": 7, "arabic": "ا", "english": {"narrator": "N:", "text": "t"}, "grade": "Sahih"}, {"idInBook": 8, "arabic": "", "english": {"narrator": "", "text": ""}}]))
    (book / "2.json").write_text(json.dumps([{"id": 3, "arabic": "ب", "english": "plain", "majlisiGrading": "", "behdudiGrading": "Hasan"}]))
    (book / "3.json").write_text("<html>404</html>")
    (book / "grades.json").write_text(json.dumps({"8": "Da'if", "7": "other"}))
    docs = corpus.with_grades(corpus.documents(spark, str(tmp_path)), corpus.grades(spark, str(tmp_path)))
    got = sorted((r.ch_idx, r.doc_id, r.narrator, r.english, r.grade) for r in docs.collect())
    assert got == [(0, 3, "", "plain", "Hasan"), (1, 7, "N:", "t", "Sahih"), (1, 8, "", "", "Da'if")]
    assert corpus.chapters(spark, str(tmp_path)).count() == 3


def test_maps_verses_commentary(spark, tmp_path):
    (tmp_path / "kin.json").write_text(json.dumps({"_comment": "x", "a": "b"}))
    assert [tuple(r) for r in corpus.key_values(spark, str(tmp_path / "kin.json")).collect()] == [("a", "b")]
    (tmp_path / "v.json").write_text(json.dumps([{"k": "1:1", "a": 1, "words": [{"t": "x", "r": "R"}, {"t": "y"}]}]))
    assert [(r.pos, r.word, r.root) for r in corpus.verses(spark, str(tmp_path / "v.json")).collect()] == [(0, "x", "R"), (1, "y", None)]
    (tmp_path / "c.json").write_text(json.dumps({"1:1": {"text": "T"}, "1:2": "1:1", "1:3": "9:9"}))
    assert {r.verse: r.text for r in corpus.commentary(spark, str(tmp_path / "c.json")).collect()} == {"1:1": "T", "1:2": "T", "1:3": None}
    (tmp_path / "r.json").write_text(json.dumps({"x": {"f": 2, "v": ["1", "1"], "fam": "q"}, "y": {"fam": ["a", "b"]}, "z": {}}))
    got = {r.root: (r.v, r.fam) for r in corpus.roots(spark, str(tmp_path / "r.json")).collect()}
    assert got == {"x": (["1"], ["q"]), "y": (None, ["a", "b"]), "z": (None, [])}


def test_csv_lists(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,name,to\n1,a,\"[1, 2]\"\n2,b,oops\n3,c,[]\n")
    df = files.csv(spark, str(tmp_path / "n.csv"), "id long, name string, to string", {"to": "long"})
    assert [(r.id, r.to) for r in df.orderBy("id").collect()] == [(1, [1, 2]), (2, []), (3, [])]


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/></w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert [(r.i, r.line) for r in files.docx(spark, str(tmp_path / "*.docx")).orderBy("i").collect()] == [(0, "one two"), (1, "")]


def test_paged_source(spark):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            first = seen.count(self.path) == 1 and self.path.endswith("2")
            self.send_response(429 if first else 200)
            self.end_headers()
            if not first:
                self.wfile.write(json.dumps({"data": [{"p": self.path}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = files.paged(spark, f"http://127.0.0.1:{server.server_port}/x?page={{page}}", 3).collect()
    server.shutdown()
    assert sorted((r.page, json.loads(r.record)["p"]) for r in got) == [(i, f"/x?page={i}") for i in (1, 2, 3)]


def test_markup(spark, tmp_path):
    (tmp_path / "m.txt").write_text("######x\n#META# y\n### | Vol\n### || Chap\n# 1 - first record text that\n~~is long enough PageV01P002\n# 2 - short\n### || Next\n# 7 - another record that is long enough\nmore\n")
    texts = markup.read(spark, str(tmp_path / "m.txt"))
    got = markup.headed(markup.lines(texts)).orderBy("chapter").collect()
    assert [(r.volume, r.chapter, r.number, r.text) for r in got] == [("Vol", "Chap", 1, "first record text that is long enough"), ("Vol", "Next", 1, "another record that is long enough more")]
    lines = spark.createDataFrame([("f", 0, "grade early"), ("f", 1, "(5)"), ("f", 2, "good"), ("f", 3, "bad"), ("f", 4, "(6)")], "k string, i long, line string")
    number, grade = F.regexp_extract("line", r"^\((\d+)\)$", 1).try_cast("long"), F.when(F.col("line").isin("good", "bad", "grade early"), F.col("line"))
    assert [tuple(r) for r in markup.graded(lines, "k", "i", number, grade).collect()] == [("f", 5, "good")]
    assert lines.limit(1).select(markup.repaired(F.lit("a1b2"), {"1": "l", "2": "z"}).alias("x")).first().x == "albz"


def test_html(spark):
    df = spark.createDataFrame([("<table><tr><td>Grade</td><td>Sahih (x) </td></tr></table><div class='q'>no</div><div class=\"a b\">T<i>x</i></div><hr>one<hr>two",)], "h string")
    r = df.select(html.second_cell("h").alias("s"), html.css_text("h", "b").alias("c"), html.first_match("h", "zzz(.)", "<td>(G[a-z]+)").alias("f")).first()
    assert (r.s, r.c, r.f) == ("Sahih", "Tx", "Grade")
    assert [x.part for x in html.containers(df, "h", "<hr>").orderBy("pos").collect()] == ["one", "two"]
    assert spark.createDataFrame([("<p>",)], "h string").select(html.second_cell("h").alias("s")).first().s is None


def test_registers(spark):
    text = "### $ 1 - محمد بن عبد الله: ثقة، مات سنة ست وعشرين ومائة\n### $ 2 - عمر بن زيد: ضعيف\n### $ 3 - زيد: تقدم\n### $ 4 - سعد بن مالك. صحابي\n"
    df = spark.createDataFrame([("p", text)], "path string, text string")
    got = {r.id: (r.name, r.grade_en, r.death) for r in registers.parsed(df, registers.SOURCES["taqrib"]).collect()}
    assert got == {1: ("محمد بن عبد الله", "reliable", 126), 2: ("عمر بن زيد", "weak", None), 4: ("سعد بن مالك", "companion", None)}
    assert len(registers.SOURCES) == 22
    for s in registers.SOURCES.values():
        assert registers.parsed(df, s).count() >= 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, ""), (10, None)], "id long, g string")
    sinks.partitioned(df, str(tmp_path / "p"), "g")
    assert {r.g: r.id for r in spark.read.parquet(str(tmp_path / "p")).where("g = 'a'").collect()} == {"a": 1}
    assert spark.read.parquet(str(tmp_path / "p")).where("g = 'unknown'").count() == 2
    sinks.csv_union([df.select("id"), df.select("id", "g")], str(tmp_path / "c"), "id")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 6
    for n in (1, 2):
        sinks.replaced(df.limit(n), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and spark.read.parquet(str(tmp_path / "t.bak")).count() == 1
    for _ in range(2):
        sinks.appended_log(df, str(tmp_path / "log"))
    assert sinks.read_log(spark, str(tmp_path / "log"), "id long, g string").count() == 6


def test_streams_equal_batches(spark):
    sf = f"{DATA}/sf0.001"
    for f, key in ((S.tumbling, ["start", "event_type"]), (S.sliding, ["start"])):
        a = S.drained(f(S.source(spark, sf))).select(*key, "n").orderBy(*key).collect()
        assert a == f(S.batch(spark, sf)).select(*key, "n").orderBy(*key).collect() and a


def test_incremental_postings(spark, tmp_path):
    S.merged_postings(S.source(spark, f"{DATA}/sf0.001"), str(tmp_path / "inc"))
    S.merged_postings(S.source(spark, f"{DATA}/sf0.001"), str(tmp_path / "inc"))  # nothing new
    got = spark.read.parquet(str(tmp_path / "inc/rows")).agg(F.sum("n")).first()[0]
    assert got == S.batch(spark, f"{DATA}/sf0.001").count()
