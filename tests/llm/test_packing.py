from __future__ import annotations

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tessera.llm import near_text, packing, substrings
from tests.conftest import DATA


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins_hold_their_pieces(lengths):
    lengths = sorted(lengths, reverse=True)
    where, offset, capacity = packing.pack(lengths, (8, 16, 32, 64), 2)
    used = defaultdict(int)
    for n, b, o in zip(lengths, where, offset, strict=True):
        assert o == used[b]
        used[b] += n
    for b, u in used.items():
        assert u <= capacity[b]
        assert capacity[b] == min(c for c in (8, 16, 32, 64) if c >= u)  # downsized to its contents
    assert sorted(used) == list(range(len(capacity)))


def test_best_fit_takes_the_least_room():
    # 60 opens 64, 40 opens 64, the 20 fits the second bin only, the 4 fits the first exactly
    where, _, capacity = packing.pack([60, 40, 20, 4], (64,), 0)
    assert where == [0, 1, 1, 0] and capacity == [64, 64]


def test_least_cost_length_is_opened():
    assert packing.pack([10], (16, 64), 1)[2] == [16]
    many = packing.pack([20] * 30, (32, 64), 8)
    assert set(many[2]) == {64}  # three to a bin cost less a token than one
    assert packing.pack([], (16,), 1) == ([], [], [])


def test_packing_wastes_little():
    rng = random.Random(1)
    lengths = sorted((min(8192, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(5000)), reverse=True)
    _, _, capacity = packing.pack(lengths)
    assert sum(lengths) >= 0.97 * sum(capacity)


def test_every_token_is_packed_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    rng = random.Random(2)
    rows = [(i, rng.choice((1, 5, 600, 8192, 8193, 30_000))) for i in range(200)] + [(7, 12), (7, 12), (None, 9), (300, 0), (301, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = packing.packed(df, shard=40).collect()
    total, spans = defaultdict(int), defaultdict(list)
    for r in got:
        total[r.doc_id] += r.n_tokens
        spans[(r.shard, r.bin, r.capacity)].append((r.offset, r.offset + r.n_tokens))
    want = defaultdict(int)
    for i, n in rows:
        if n:
            want[i] += n
    assert total == want and 300 not in total
    for (_, _, c), own in spans.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= c and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    assert packing.packed(df.limit(0)).count() == 0


def test_pipeline_stages_equal_their_parts(spark):
    """Each stage against a direct computation from what the one before kept."""
    from tests.llm.test_near_text import naive as groups
    from tests.llm.test_substrings import naive as cuts

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.written(stage(spark, frames[-1], sf), f"test-{name.replace(' ', '-')}"))
        if name != "best-fit packing":
            assert frames[-1].columns == docs.columns and dict(frames[-1].dtypes) == dict(docs.dtypes)
    texts = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames[:5]]
    assert set(texts[2]) <= set(texts[1]) <= set(texts[0]) and len(texts[2]) >= 0.8 * len(texts[0])
    near = groups(sorted(texts[2].items()), 5, 80)
    assert set(texts[3]) == {i for i, (_, c) in near.items() if c == i}
    cut = cuts(sorted((i, t) for i, t in texts[3].items() if t is not None))
    assert all((texts[4].get(i) == texts[3][i]) == (n == 0) for i, n in cut.items())
    packed = {r.doc_id for r in frames[5].collect()}
    assert packed == {i for i, t in texts[4].items() if t}
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "n_tokens").collect())) == sorted(map(str, frames[5].select("doc_id", "piece", "n_tokens").collect()))
    assert near_text.stage and substrings.stage


def plain_pack(lengths, permitted, overhead):
    """Best fit, least-cost opening and downsizing, piece after piece over plain lists."""
    bins, where = [], []
    for i, length in enumerate(lengths):
        fits = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= length]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0] - bins[b][1], b))
        else:
            def cost(c, i=i, length=length):
                rest = sorted(x for x in lengths[i + 1 :] if x <= c - length)
                return (c + overhead) / (length + min(c - length, sum(rest)))

            b = len(bins)
            bins.append([min((c for c in permitted if c >= length), key=lambda c: (cost(c), c)), 0])
        where.append((b, bins[b][1]))
        bins[b][1] += length
    return where, [min(c for c in permitted if c >= used) for _, used in bins]


def test_equals_a_plain_packer():
    rng = random.Random(12)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 90) for _ in range(rng.randint(1, 120))), reverse=True)
        permitted = tuple(sorted(rng.sample(range(90, 300), 3)))
        where, offset, capacity = packing.pack(lengths, permitted, 7)
        assert (list(zip(where, offset, strict=True)), capacity) == plain_pack(lengths, permitted, 7)


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i % 50 if i % 3 else None, 1 + i * 37 % 700) for i in range(3000)] + [(9, 25_000), (9, 25_000), (None, 3)] * 5 + [(7, 64)] * 2500
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    found = [sorted(map(tuple, packing.packed(df.repartition(n), shard=500).collect()), key=repr) for n in (1, 17)]
    assert found[0] == found[1]
    pieces = sum(-(-n // packing.LENGTHS[-1]) for _, n in rows)
    assert len(found[0]) == pieces and sum(r[3] for r in found[0]) == sum(n for _, n in rows)
    assert packing.packed(df.limit(0)).count() == 0
