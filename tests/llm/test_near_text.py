from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tessera.llm import near_text as NT
from tessera.llm.common import text_bytes, word_spans
from tests.conftest import DATA
from tests.oracle import connected, same


def naive(rows, k=4, t=85):
    """doc -> (set size, least id of its component) by comparing all pairs."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= t * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(n=260, seed=1):
    """Texts with copies, near copies at all distances, shared passages, short and empty ones."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    passage = [rng.choice(vocab) for _ in range(40)]
    texts = []
    for i in range(n):
        kind = i % 5
        if kind == 0 or not texts:
            w = [rng.choice(vocab) for _ in range(rng.choice((1, 2, 3, 4, 5, 8, 30, 90, 200)))]
            if i % 2:
                w[len(w) // 2 : len(w) // 2] = passage
        else:
            w = rng.choice(texts).split()
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 8))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    return [(i * 3, t) for i, t in enumerate(texts)] + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "ABCD  efg"), (9005, "abcd\nEFG")]


@pytest.mark.parametrize(("k", "t"), [(4, 85), (5, 80), (3, 60)])
def test_equals_all_pairs(spark, k, t):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in NT.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), k, t).collect()}
    assert got == naive(rows, k, t)


def test_big_group_is_linked_inside(spark, monkeypatch):
    """A group of near copies, many of them not linked to most others, with tiles made big and blocks small."""
    monkeypatch.setattr(NT, "BIG", 5)
    monkeypatch.setattr(NT, "BLOCK", 30)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 5, 9))):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in NT.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == naive(rows)


def test_query_equals_duckdb(spark):
    sf = f"{DATA}/sf0.001"
    same(NT.query(spark, sf), connected(sf), NT.SQL)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e", 1), (1, "a b c d e", 1), (2, "a b c d e", 1), (None, "a b c d e", 1), (3, None, 1), (4, "q", 1), (4, "z", 1), (5, "z", 1)], "doc_id long, text string, component_id int")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, r.component_id) for r in NT.near_copies(df).collect())
    assert got[1:] == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4)] and got[0][0] == -1
    assert NT.near_copies(df.limit(0)).count() == 0


def test_null_id_before_a_row_with_a_near_copy(spark):
    """A copy without an id comes first in its task; the row with an id still has its tiles and links."""
    base = [f"w{i}" for i in range(60)]
    text, near = " ".join(base), " ".join([*base[:-1], "other"])
    df = spark.createDataFrame([(None, text), (1, text), (2, near), (None, near)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in NT.near_copies(df).collect()}
    assert got[1] == got[2] == 1 and len(got) == 3


def test_stage_keeps_one_of_each_group(spark):
    rows = [(i, f"{'a b c d e f g h i j k l m n o p' if i < 3 else f'z{i} y{i} x{i} w{i} v{i} u{i}'}", "en", "s", 1) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = NT.stage(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [0, 3, 4, 5]


def test_bitmaps_bound_overlap():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 120))).astype(np.uint64) for _ in range(2))
        for bits in (64, 256, 1024):
            x, y = NT.bitmaps([a, b], bits)
            assert NT.bound(x, len(a), y, len(b)) >= len(np.intersect1d(a, b)) == NT.overlap(a, b)


def test_link_block_connects_what_is_linked():
    rng = random.Random(3)
    sets = []
    for i in range(80):
        base = set(range(40 * (i % 4), 40 * (i % 4) + 40)) - set(rng.sample(range(160), rng.randrange(30)))
        sets.append(np.array(sorted(base), np.uint64))
    want, got = list(range(80)), list(range(80))

    def merged(root, pairs):
        for a, b in pairs:
            x, y = root[a], root[b]
            root[:] = [min(x, y) if r in (x, y) else r for r in root]
        return root

    every = [(i, j) for i in range(80) for j in range(i) if NT.linked(NT.overlap(sets[i], sets[j]), len(sets[i]), len(sets[j]), 85)]
    assert merged(got, NT.link_block(sets, 85)) == merged(want, every)


def test_words_do_not_span_texts():
    import pyarrow as pa

    at, raw = text_bytes(pa.array(["ab", "cd e", None, "", " f\tg "]))
    s, e, own = word_spans(at, raw)
    assert [bytes(raw[a:b]) for a, b in zip(s, e, strict=True)] == [b"ab", b"cd", b"e", b"f", b"g"] and own.tolist() == [0, 1, 1, 4, 4]
    at, raw = text_bytes(pa.array(["xx", "ab", "cd"]).slice(1))
    assert raw.tobytes() == b"abcd" and at.tolist() == [0, 2, 4]


def test_links_of_parts_are_those_of_the_whole():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 80).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.96], rng.integers(0, 2**63, 2).astype(np.uint64)])) for _ in range(40)] + [np.unique(rng.integers(0, 2**63, 30).astype(np.uint64)) for _ in range(10)]

    def roots(links):
        forest = NT.Forest(len(sets))
        for i, j in links:
            forest.join(i, j)
        return [forest.find(i) for i in range(len(sets))]

    part = rng.integers(0, 3, len(sets))
    links = []
    for a, b in ((0, 1), (1, 2), (0, 2)):
        own = np.flatnonzero((part == a) | (part == b))
        inside = np.where(part[own] == a, b == (a + 1) % 3, a == (b + 1) % 3)
        links += [(int(own[i]), int(own[j])) for i, j in NT.link_block([sets[i] for i in own], 80, part[own], inside)]
    assert roots(links) == roots(NT.link_block(sets, 80))


def test_passed_tables_are_deleted_and_the_result_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.llm.common.shared_dir", lambda _: str(tmp_path))
    rows = corpus(120, 5)
    got = NT.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    left = [p.name.rsplit("-", 1)[0].removeprefix("tessera-") for p in tmp_path.iterdir()]
    assert not {"big", "inner", "facts", "pairs", "sets", "possible"} & set(left)
    assert left.count("inner-links") == left.count("class-links") == 1  # the last round's
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == naive(rows)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
