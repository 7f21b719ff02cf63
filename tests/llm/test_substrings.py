from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm import substrings as S
from tessera.llm.common import text_bytes
from tests.conftest import DATA


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def chunk_texts(text):
    at, raw = text_bytes(pa.array([text]))
    return [raw[a:b].tobytes().decode() for _, a, b, _, _ in zip(*S.chunks(at, raw), strict=True)]


def test_gear_is_the_rolling_hash():
    raw = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)
    h, want = 0, []
    for i in range(len(raw)):
        h = sum(int(S._GEAR[raw[i - j]]) << j for j in range(min(S.WINDOW, i + 1))) % 2**32
        want.append(h)
    assert S.gear(raw).tolist() == want


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(1)
    a, b = " ".join(words(rng, 400)), " ".join(words(rng, 7))
    own = chunk_texts(a)
    assert " ".join(own) == a
    assert 3 < len(a.split()) / len(own) < 8
    shifted = chunk_texts(b + " " + a)
    assert len(set(own) - set(shifted)) <= 2  # only chunks at the insertion change
    middle = a.split()
    inserted = chunk_texts(" ".join(middle[:200] + ["new", "words"] + middle[200:]))
    assert len(set(own) - set(inserted)) <= 3


def plain_chunks(text):
    """Chunks of words by the rolling hash, byte after byte."""
    raw, out, own, h = text.encode(), [], [], []
    for i in range(len(raw)):
        h.append(sum(int(S._GEAR[raw[i - j]]) << j for j in range(min(S.WINDOW, i + 1))) % 2**32)
    ends = [m.end() for m in re.finditer(rb"[^ \t-\r]+", raw)]
    for m in re.finditer(rb"[^ \t-\r]+", raw):
        own.append(m[0].decode())
        if m.end() == ends[-1] or m.end() >= S.WINDOW and (h[m.end() - 1] >> 16) * S.AVERAGE < 65536:
            out += [own[i : i + S.MOST_WORDS] for i in range(0, len(own), S.MOST_WORDS)]
            own = []
    return out


def naive(rows, least=S.LEAST_WORDS, within=False):
    """doc -> words cut, by comparing windows of adjacent chunks as texts."""
    first, out, own = {}, {}, {}
    for i, text in rows:
        chunks, found = plain_chunks(text), []
        for a in range(len(chunks)):
            b = a
            while b < len(chunks) and sum(map(len, chunks[a : b + 1])) < least:
                b += 1
            if b < len(chunks):
                found.append((a, b, tuple(map(tuple, chunks[a : b + 1]))))
        own[i] = chunks, found
        for _, _, k in found:
            first[k] = min(first.get(k, i), i)
    for i, (chunks, found) in own.items():
        seen, cut = set(), set()
        for a, b, k in found:
            if first[k] != i or within and k in seen:
                cut.update(range(a, b + 1))
            seen.add(k)
        out[i] = sum(len(chunks[j]) for j in cut)
    return out


def planted(n=80, seed=2):
    rng = random.Random(seed)
    passage = words(rng, 60)
    rows = []
    for i in range(n):
        w = words(rng, rng.randrange(20, 300))
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage
        if i % 9 == 0:
            w = list(rows[-1][1].split()) if rows else w
        rows.append((i, " ".join(w)))
    return rows, passage


def test_cuts_equal_a_direct_comparison(spark):
    rows, _ = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in S.deduplicated(df).collect()}
    assert {i: r.words_cut for i, r in got.items()} == naive(rows)
    rows = rows[:9] + [(100, " ".join([rows[1][1]] * 2)), (101, "that " * 200), (102, "x y z " + "that " * 100)]
    for within in (False, True):
        got = S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), within=within).collect()
        assert {r.doc_id: r.words_cut for r in got} == naive(rows, within=within)
    assert [r.words_cut > 60 for r in got if r.doc_id == 102] == [True]


def test_planted_passages_go_and_clean_texts_stay(spark):
    rows, passage = planted()
    got = {r.doc_id: r for r in S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = " ".join(passage)
    holders = [i for i, t in rows if whole in t]
    assert whole in got[holders[0]].text
    assert not [i for i in holders[1:] if whole in got[i].text]
    assert all(got[i].words_cut >= 20 for i in holders[1:])
    clean = [i for i, t in rows if i not in holders and i % 9 and (i + 1) % 9]
    assert all(got[i].text == t and got[i].n_cut == 0 for i, t in rows if i in clean)
    for i, t in rows:  # spans are what was cut
        raw, out, at = t.encode(), b"", 0
        for s in got[i].spans:
            out, at = out + raw[at : s.start], s.end
        assert " ".join((out + raw[at:]).decode().split()) == " ".join(got[i].text.split())


def test_odd_rows(spark):
    long = " ".join(words(random.Random(5), 300))
    df = spark.createDataFrame([(1, long, 7), (2, long, 7), (3, None, 7), (4, "", 7), (5, " \n ", 7), (None, long, 7), (2, long, 7), (6, "é " * 4000, 7)], "doc_id long, text string, n_cut int")
    got = S.deduplicated(df).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert by[1].text == by[None].text == long and by[2].text == "" and [r.text for r in got if r.doc_id == 2] == ["", ""]
    assert by[3].text is None and by[4].text == "" and by[5].text == " \n " and by[3].n_chunks == 0
    assert S.deduplicated(df.limit(0)).count() == 0


def test_query_runs_on_whole_table(spark):
    sf = f"{DATA}/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: r.words_cut for r in S.query(spark, sf).collect()} == naive(rows)


def test_only_what_stands_together_elsewhere_is_cut(spark):
    rows, passage = planted()
    whole = " ".join(passage)
    own = next(t for i, t in rows if whole not in t and len(t.split()) > 150)
    # the last text is made of another's chunks in another order
    pieces = [c for c in chunk_texts(own) if len(c) > 2 * S.WINDOW and len(c.split()) < S.LEAST_WORDS]
    scattered = " ".join(pieces[::-1])
    rows = [*rows, (500, scattered)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in S.stage(spark, df, "").collect()}
    runs = {i: {tuple(t.split()[j : j + S.LEAST_WORDS]) for j in range(len(t.split()) - S.LEAST_WORDS + 1)} for i, t in rows}
    shared = lambda i: set().union(*(runs[k] for k, _ in rows if k < i)) & runs[i]
    assert all(i in got and got[i].text == t for i, t in rows if not shared(i))
    assert not shared(500) and got[500].text == scattered
    holders = [i for i, t in rows if whole in t]
    assert whole in got[holders[0]].text and not [i for i in holders[1:] if i in got and whole in got[i].text]


def test_windows_equal_a_direct_search():
    rng = np.random.default_rng(7)
    text, words = np.sort(rng.integers(0, 9, 60)), rng.integers(1, 9, 60)
    a, b, _ = S.windows(text, words, rng.integers(0, 2**62, 60), 16)
    fits = {(i, j) for i in range(60) for j in range(i, 60) if text[i] == text[j] and words[i : j + 1].sum() >= 16}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i, j in fits if (i, j - 1) not in fits}
    none = np.zeros(0, np.int64)
    assert [len(x) for x in S.windows(none, none, none, 16)] == [0, 0, 0]


def test_a_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(words(rng, 200_000))
    df = spark.createDataFrame([(1, long[:5000]), (2, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in S.deduplicated(df).collect()}
    assert got[1].words_cut == 0 and 0 <= len(long[:5000].split()) - got[2].words_cut < 20
