from __future__ import annotations

import html as H
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text, language_id, toxicity
from tests.conftest import DATA

SF = f"{DATA}/sf0.01"


def out(i) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


def naive_phrases(codes: list[int], sample: list[int]) -> int:
    """Phrases of a greedy parse by substring search."""
    text, n, i = "".join(map(chr, sample)), 0, 0
    while i < len(codes):
        j = i + 1
        while j <= len(codes) and "".join(map(chr, codes[i:j])) in text:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def test_automaton_parses_like_substring_search():
    rng = np.random.default_rng(5)
    sample = rng.integers(1, 5, 300).tolist()
    a = language_id.Automaton(sample, 8)
    for _ in range(200):
        codes = rng.integers(1, 7, rng.integers(1, 60)).tolist()
        state, n = a.start, 0
        for c in codes:
            value = int(a.table[state + c])
            n, state = n + (value & 1), value >> 1
        assert n == naive_phrases(codes, sample)


def test_language_id_held_out(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = language_id.query(spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_id_odd_rows(spark):
    train = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 12)] + [(None, "x", "xx"), (99, None, "yy"), (98, "zz", None)], "doc_id long, text string, lang string")
    model = language_id.fitted(train)
    assert model.languages == ["de", "en"]
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 !? ", "q"), (None, "the dog", "q"), (4, "THE CAT " * 3000, "q"), (5, "的", "q")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[None][0] == got[4][0] == "en" and got[4][1] > 0.3
    assert got[5][0] == "de" and got[5][1] < 0.1  # a letter that no sample has
    found, score = language_id.Model({"b": ["xy"], "a": ["zw"]}).predict(["q", "qq q"])
    assert found == ["a", "a"] and score.tolist() == [0, 0]  # a tie goes to the smaller value
    assert language_id.identify(df.limit(0), model).count() == 0
    none = language_id.fitted(train.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    assert sorted(r.doc_id for r in language_id.stage(spark, train.where("text is not null"), "").collect() if r.doc_id is not None) == [*range(24), 98]


def test_language_stage_goes_by_the_phrases(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("the cat and the dog are in the house", "en"), ("der hund und die katze sind in dem haus", "de")] * 12)]
    docs = spark.createDataFrame([*rows, (30, "the dog and the cat " * 20, None), (31, "слова совсем другого языка " * 4, "en"), (32, "12 !?", "en"), (33, None, "en"), (35, "zz", None)], "doc_id long, text string, lang string")
    got = language_id.stage(spark, docs.withColumn("lang", F.when(F.col("doc_id") < 30, F.col("lang"))), "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [*range(24), 30, 35]
    # nothing to learn from: texts with a letter stay
    for bare in (docs.withColumn("lang", F.lit(None).cast("string")), docs.withColumn("doc_id", F.lit(None).cast("long"))):
        assert sorted(r.text for r in language_id.stage(spark, bare, "").collect()) == sorted(r.text for r in docs.collect() if r.text and r.text != "12 !?")


def test_every_letter_and_language_is_learnt(spark, monkeypatch):
    rng = np.random.default_rng(3)
    script = lambda at, n, size: "".join(map(chr, at + rng.integers(0, n, size)))
    texts = {"zh": [script(0x4E00, 200, 4000)], "ko": [script(0xAC00, 90, 300)], "hi": [script(0x0915, 30, 300)], "ja": [script(0x3041, 80, 300)]}
    found = []
    for cells in (language_id.DENSE_CELLS, 0):
        monkeypatch.setattr(language_id, "DENSE_CELLS", cells)
        model = language_id.Model(texts)
        assert [a.keys is None for a in model.automata] == [bool(cells)] * 4
        assert all(model.predict([v[0][100:180]])[0] == [k] for k, v in texts.items())
        found.append(model.phrases([texts["ko"][0] + " x", texts["zh"][0][:700], "", None])[0].tolist())
    assert found[0] == found[1]
    rows = [(i, "".join(chr(97 + (7 * (i // 6) + j * (1 + i // 6 % 5)) % 26) for j in range(12)) * 4, f"l{i // 6:03}") for i in range(70 * 6)]
    assert len(language_id.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == 70


def test_sparse_automaton_steps_as_the_table():
    rng = np.random.default_rng(6)
    codes = rng.integers(1, 6, 200).tolist()
    dense, sparse = language_id.Automaton(codes, 9), language_id.Automaton(codes, 9, 0)
    x, y = np.full(50, dense.start), np.full(50, sparse.start)
    for _ in range(80):
        row = rng.integers(0, 9, 50)
        x, y = dense.step(x, row), sparse.step(y, row)
        assert x.tolist() == y.tolist()
        x, y = x >> 1, y >> 1


def test_lanes_keep_whole_texts():
    model = language_id.Model({"a": ["ab " * 200], "b": ["cd " * 200]})
    n, ok = model.phrases(["ab " * 1000 + "cd " * 4000, "ab " * 10])
    assert ok.all() and n[0].argmin() == 1 and n[1].argmin() == 0


def naive_cost(model, text: str) -> list[float]:
    """Normalised phrases of a whole text by substring search, language by language."""
    out = []
    for k in model.languages:
        sample = model.samples[k]
        codes = re.sub(r"[^a-z]+", " ", text.lower())
        out.append((naive_phrases(list(map(ord, codes)), list(map(ord, sample))) + sum(c not in sample for c in codes)) * np.log2(len(sample)))
    return out


def test_whole_predictions_equal_a_naive_parser():
    rng = np.random.default_rng(8)
    words = {k: ["".join(map(chr, 97 + rng.choice(26, rng.integers(2, 7), p=p))) for _ in range(60)] for k, p in zip("ab", rng.dirichlet(np.ones(26) / 2, 2), strict=True)}
    make = lambda k, n: " ".join(rng.choice(words[k], n))
    texts = {"a": [make("a", 120)], "b": [make("b", 30)]}
    model = language_id.Model(texts)
    model.samples = {k: v[0] for k, v in texts.items()}
    asked = [make(k, n) + make(j, m) for k, j, n, m in [("a", "b", 5, 2), ("b", "a", 300, 9), ("a", "a", 150, 150), ("b", "b", 1, 1)]] + ["zz " * 700, "ab" * 900]
    found, score = model.predict(asked)
    for text, lang, s in zip(asked, found, score, strict=True):
        cost = naive_cost(model, text)
        assert lang == model.languages[int(np.argmin(cost))] and abs(s - (1 - min(cost) / max(cost))) < 1e-12
    assert model.phrases(["ab" * 900])[0].tolist() == language_id.Model(texts).phrases(["ab" * 900])[0].tolist()


def test_lanes_go_on_from_the_lane_before(monkeypatch):
    rng = np.random.default_rng(9)
    sample = "".join(map(chr, 97 + rng.integers(0, 3, 500))) + "ab" * 40
    asked = ["".join(map(chr, 97 + rng.integers(0, 4, n))) for n in (5, 300, 4000)] + ["ab" * 3000, "a" * 2000, ""]
    for cells in (language_id.DENSE_CELLS, 0):
        monkeypatch.setattr(language_id, "DENSE_CELLS", cells)
        found = language_id.Model({"x": [sample]}).phrases(asked)[0][:, 0].tolist()
        assert found == [naive_phrases(list(map(ord, t)), list(map(ord, sample))) + sum(c not in sample for c in t) for t in asked]


def test_unequal_samples_and_disjoint_alphabets():
    rng = np.random.default_rng(10)
    alphabet = {"x": 0x4E00, "y": 0x6E00}
    script = lambda k, n: "".join(map(chr, alphabet[k] + rng.integers(0, 3000, n)))
    model = language_id.Model({k: [script(k, 20_000)] for k in alphabet})  # two letters in a row seldom stand in the sample
    asked = [(k, script(k, 60)) for k in alphabet for _ in range(50)]
    assert model.predict([t for _, t in asked])[0] == [k for k, _ in asked]
    # the same source of words, ten times the sample for one: the larger one isn't favoured
    words = {k: ["".join(map(chr, 97 + rng.integers(0, 12, 5))) for _ in range(300)] for k in "ab"}
    make = lambda k, n: " ".join(rng.choice(words[k], n))
    model = language_id.Model({"a": [make("a", 6000)], "b": [make("b", 140)]})
    asked = [(k, make(k, 40)) for k in "ab" for _ in range(60)]
    right = sum(a == b for a, (b, _) in zip(model.predict([t for _, t in asked])[0], asked, strict=True))
    assert right >= 0.97 * len(asked)


def test_sample_is_of_rows_however_ids_repeat(spark):
    many = [(i % 20, f"the cat {i} and the dog {'abcdefghij'[i % 10]}", "en") for i in range(3000)] + [(next(i for i in range(20) if not out(i)), "der hund und die katze", "de")] * 2000
    model = language_id.fitted(spark.createDataFrame(many, "doc_id long, text string, lang string"), rows=50)
    assert model.languages == ["de", "en"] and len(model.letters) > 10


def test_texts_in_another_language_are_not_learnt():
    texts = {"en": ["the cat and the dog", "a cat of the house", "the dog is here", "le chat dans la maison"] * 4, "fr": ["le chat et le chien", "dans la maison", "la chatte est la", "le chien est ici"] * 4}
    assert "le chat dans la maison" not in language_id.agreed(texts)["en"]
    assert language_id.agreed({"x": ["a"]}) == {"x": ["a"]} and language_id.agreed({}) == {}


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect()}
    got = toxicity.query(spark, f"{DATA}/sf0.1").collect()
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    hits = sum(p and y for p, y in held)
    assert hits >= 0.98 * sum(p for p, _ in held)  # clean texts stay
    assert hits >= 0.6 * sum(y for _, y in held)  # a few hundred labelled rows a language; more at larger sizes


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(1)
    rows = [(np.unique(np.append(rng.integers(10, 4000, 30), [3] if i % 5 == 0 else [4])), int(i % 5 == 0)) for i in range(600)]
    model = toxicity.trained(rows, bits=12)
    weight = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    assert weight[3] > 1 and len(weight) < 400


def test_features_are_words_pairs_and_skips():
    import pyarrow as pa

    from tessera.llm.common import text_bytes

    f, own = toxicity.features(*text_bytes(pa.array(["A b, c!", "a b c", None, "x"])))
    per = [sorted(f[own == i].tolist()) for i in range(4)]
    assert per[0] == per[1] and len(per[0]) == 6 and per[2] == [] and len(per[3]) == 1


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, "bad awful word" if i % 3 == 0 else "good fine word") for i in range(200)] + [(500, None), (None, "bad"), (0, "bad awful word")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0, 9) for i in range(200)] + [(None, 1, 9), (3, None, 9), (3, 0, 9)], "doc_id long, toxic int, text int")
    model = toxicity.fitted(docs, labels)
    got = toxicity.score(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == 203
    assert all(r.predicted == ("awful" in r.text) for r in got if r.text and "word" in r.text)
    assert all(0 <= r.score <= 1 for r in got)
    none = toxicity.fitted(docs, labels.limit(0))
    assert {(r.score, r.predicted) for r in toxicity.score(docs, none).collect()} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_training_equals_a_scalar_ftrl():
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 64, rng.integers(0, 12))), int(rng.random() < 0.4)) for _ in range(300)]
    model = toxicity.trained(rows, bits=6, epochs=2)
    z, n, zb, nb = [0.0] * 64, [0.0] * 64, 0.0, 0.0

    def weight(zi, ni, l1):
        return 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((toxicity.BETA + ni**0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(2):
        for index, y in rows:
            w = {int(i): weight(z[i], n[i], toxicity.L1) for i in index}
            wb = weight(zb, nb, 0.0)
            g = 1 / (1 + np.exp(-(sum(w.values()) + wb))) - y
            for i, v in w.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * v
                n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / toxicity.ALPHA * wb
            nb += g * g
    want = {i: weight(z[i], n[i], toxicity.L1) for i in range(64) if abs(z[i]) > toxicity.L1}
    assert want and model.index.tolist() == sorted(want)
    assert np.allclose(model.weight, [want[i] for i in sorted(want)]) and abs(model.bias - weight(zb, nb, 0.0)) < 1e-9


def test_training_takes_one_text_an_id_and_no_more_than_its_bytes(spark):
    rows = [(i % 8, f"word{i % 3} " * 5) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i % 8, i % 2) for i in range(500)], "doc_id long, toxic int")
    a = toxicity.fitted(docs.repartition(1), labels)
    b = toxicity.fitted(docs.repartition(7), labels.repartition(3))
    assert a.index.tolist() == b.index.tolist() and a.bias == b.bias
    none = toxicity.fitted(docs, labels, size=0)
    assert not np.isfinite(none.bias) and {r.score for r in toxicity.score(docs.limit(3), none).collect()} == {0.0}
    long = spark.createDataFrame([(1, "bad words " * 300_000), (2, "")], "doc_id long, text string")
    assert toxicity.score(long, a).count() == 2


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>My Title</h1><p class=byline>By X</p></header><p>First with <a href="x">link</a> &amp; more&nbsp;text.<p>Second<br>line<aside>Related</aside><ul><li>one<li>two</ul><div class="ad">Buy</div>
<form><input><button>Send</button></form><section id="comments"><h2>Comments</h2><p>A reader says hi in a comment of several words</p></section></article></main><footer>f</footer><script>if(a<b){"</p>"}</script></body></html>"""


def test_main_text_of_a_page():
    tree = html_text.Tree(html_text.TRAINING)
    assert html_text.main_text(PAGE, tree) == "My Title\nFirst with link & more text.\nSecond line\none\ntwo"
    assert html_text.main_text("<p>Just a long paragraph of plain words without any article element around it, which is the main text of this page.", tree).startswith("Just a long")
    assert [html_text.main_text(x, tree) for x in (None, "", "<p></p>", "<script>x", "<!-- x", "<")] == [""] * 6
    assert html_text.main_text("<article><p>cut &am", tree) == "cut &am" and html_text.main_text("<article><p>cut <a hre", tree) == "cut"


def test_wrappers_do_not_empty_an_article():
    tree = html_text.Tree(html_text.TRAINING)
    article = "<article><h1>Title</h1><p>Some text of the article in a few words.</p><div class='ad'>Buy</div><form>Send</form></article>"
    want = "Title\nSome text of the article in a few words."
    for before, after in (("<div class='layout has-sidebar'>", "</div>"), ("<div class='content widget'>", "</div>"), ("<form id='page'>", "</form>"), ("<form><div class='related'><main>", "</main></div></form>")):
        assert html_text.main_text(before + article + after, tree) == want
    for before, after in (("<nav>", "</nav>"), ("<section class='comments'>", "</section>"), ("<div class='related teasers'>", "</div>"), ("<div hidden>", "</div>")):
        assert html_text.main_text(before + article + after, tree) == ""
    assert html_text.main_text(f"<datalist><option>one<option value=2>two</datalist>{article}<select><option>x</option></select>", tree) == want
    assert html_text.main_text(f"<datalist><option>one</option></datalist>{article}", tree) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div class='site has-sidebar'>{}</div>", "{}"), ("<datalist><option><option></datalist>{}", "{}"), ("<iframe src=x>{}", "{}"), ("<main><div id='search-results'>{}</div></main>", "{}"), ("<div class='widget'>{}</div>", "{}"), ("<form action=x>{}</form>", "{}"),
        ("<article>{}<p class='advert'>Buy this now</p><p hidden>secret words</p></article>", "{}"), ("<article><p>One <span class='ad'>Buy <b>now</b></span>two.</p>{}</article>", "One two.\n{}"), ("<p class='cookie-notice'>We use cookies on this site to give you all that you may want of it, and more.</p>{}", "{}"),
        ("<article>{}<noscript>x</noscript><textarea>y</textarea></article>", "{}"), ("<nav class='menu'><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>{}<footer>All rights reserved by the owner of this page, who wrote it.</footer>", "{}"),
        ("{}<script>var a = '<p>no</p>'", "{}"),
    ],
)
def test_ordinary_pages(html, want):
    tree = html_text.Tree(html_text.TRAINING)
    paragraphs = ("The river rose for three days before it reached the lower fields, and the farmers moved their cattle up to the old road.", "By the evening of the fourth day the water had gone back, and they counted what was left of the hay.")
    assert html_text.main_text(html.format("".join(f"<p>{p}</p>" for p in paragraphs)), tree) == want.format("\n".join(paragraphs))


def test_time_grows_with_the_page():
    tree = html_text.Tree(html_text.TRAINING)

    def seconds(n):
        at = time.process_time()
        html_text.main_text("<div>x</p>" * n + "<iframe>" * n + "<option>" * n, tree)
        return time.process_time() - at

    seconds(100)
    assert seconds(40_000) < 12 * max(0.05, seconds(10_000))


def test_tree_fits_its_table():
    tree = html_text.Tree(html_text.TRAINING)
    assert sum(tree.label(r[:-1]) == r[-1] for r in html_text.TRAINING) >= 0.97 * len(html_text.TRAINING)


def test_pages_keep_exactly_their_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html_text.query(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = pages[r.page_id].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        body = re.sub(r"<[^>]*(?:>|$)", lambda m: "" if re.match(r"</?b\b", m[0]) else " " if m[0] == "<br>" else "\n", body)
        want = "\n".join(x for x in (" ".join(H.unescape(y).split()) for y in body.split("\n")) if x)
        assert r.text == want and r.n_chars == len(want)


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "u", "x"), (None, PAGE, None, "x"), (1, "", "u", "x")], "page_id long, html string, url string, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(r.n_chars for r in got.collect())[:2] == [0, 0]
    assert html_text.extract(df.limit(0)).count() == 0
