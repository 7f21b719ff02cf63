"""Operator 2: n-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct k-word shingles as 64-bit hashes.  Two documents link when
100 * intersection >= threshold * union.  Every link is found; no pair list of a group of copies is made.

1. Equal sets are one class (hash of the set and its size).
2. A global order puts frequent shingles last: tasks count all shingles, the HEAVY most frequent of the sums
   are broadcast (bounded), all others go by their hash.  Any order gives the same result; this one keeps
   shared passages out of the tiles.  Linked sets share SHARED shingles, or as many as must overlap, among
   the first n - ceil(t n) + SHARED of that order.
3. Those first shingles make tiles: the classes that hold one shingle there, sorted by size; a class meets
   only the band of sizes that can link with its own.
4. Tiles of BIG classes and more, the first INNER such of each class, are linked inside, in blocks of
   BLOCK classes: bitmap signatures bound each overlap from above, what passes is intersected exactly, and
   classes that are already connected are not compared again.  In a tile of several blocks each two of them meet in a
   task.  So a large group of near copies becomes one component before pairs are made, and no pairs are made of a group
   whose members aren't linked.
5. In all tiles, pairs of classes of different components are counted; those that share enough tiles
   are checked as in 4: bitmap bound, then exact sorted-array intersection.
6. Components of the found links, by class, then by document.

Defined results: words are [^ \\t-\\r]+ after lower-casing A-Z; with fewer than k words the whole sequence is
the one shingle; a null or wordless text has an empty set and links with nothing.  Repeated rows of one id are one
row of the result and unlike texts of one id each link.  A null id gives a row of its own component (null).
Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import M1, binary, by_ids, dropped, mixed, shingles, slices, text_bytes, word_hashes, written
from tessera.llm.graphs import Forest, components

#: Most frequent shingles whose rank is broadcast (16 bytes each), and the count in a task from which they're reported.
HEAVY = 1 << 18
LOCAL = 3
#: Shingles that a pair must share among its first ones.
SHARED = 4
#: Classes from which a tile is big, and classes of a block of it.
BIG = 64
BLOCK = 512
#: Such tiles of each class, its first ones.
INNER = 2
#: Shingles that a task counts before it reports.
COUNTED = 1_500_000


def sets_of(part: pa.RecordBatch, column: str, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingles of each text, and a digest of each set (0 for an empty one)."""
    h, own = word_hashes(*text_bytes(part.column(column)))
    g, own = shingles(h, own, part.num_rows, k)
    ends = np.cumsum(np.bincount(own, minlength=part.num_rows))
    sets = [np.unique(g[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    size = np.array([len(s) for s in sets], np.uint64)
    digests = mixed(np.array([np.bitwise_xor.reduce(mixed(s * M1)) for s in sets], np.uint64) + np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64) + size)
    digests[size == 0] = 0
    return sets, digests.view(np.int64)


def least(n, t: int):
    """Least overlap with any linked set of a set of n."""
    return -(-t * n // 100)


def heavy_shingles(docs: DataFrame, column: str, k: int, most: int = HEAVY) -> np.ndarray:
    """The most frequent shingles, rarest first."""

    def counted(batches):
        held, size, seen = [], 0, set()

        def report():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n >= LOCAL], n[n >= LOCAL]
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

        for part in slices(batches, column):
            sets, digests = sets_of(part, column, k)
            for s, d in zip(sets, digests.tolist(), strict=True):
                if len(s) and d not in seen:  # copies count once in a report
                    seen.add(d)
                    held.append(s)
                    size += len(s)
            if size >= COUNTED:
                yield report()
                held, size, seen = [], 0, set()
        if held:
            yield report()

    sums = docs.select(column).mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    table = sums.orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n = np.asarray(table["token"]).astype(np.int64), np.asarray(table["n"])
    return token[np.lexsort((token, n))].view(np.uint64)


def signatures(docs: DataFrame, key: str, column: str, k: int, t: int, heavy: np.ndarray) -> DataFrame:
    """(id, n, digest, prefix): the first shingles in the global order, once for copies of a task; none for a null id, which makes no tiles."""
    order = np.argsort(heavy)
    shared = docs.sparkSession.sparkContext.broadcast((heavy[order], order))

    def first(s: np.ndarray) -> np.ndarray:
        token, rank = shared.value
        o = least(len(s), t)
        size = len(s) - o + min(SHARED, o)
        if not len(token):
            return s[:size]
        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
        hit = token[at] == s
        rare = s[~hit]
        if len(rare) >= size:
            return rare[:size]
        common = s[hit]
        return np.concatenate([rare, common[np.argsort(rank[at[hit]])]])[:size]

    def run(batches):
        seen: set[int] = set()
        for part in slices(batches, column):
            sets, digests = sets_of(part, column, k)
            prefixes = []
            for s, d, has in zip(sets, digests.tolist(), part.column("id").is_valid().to_pylist(), strict=True):
                prefixes.append(first(s) if len(s) and has and d not in seen else s[:0])
                if has:
                    seen.add(d)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)], dtype=np.int32)), pa.array(np.concatenate(prefixes).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests), lists], ["id", "n", "digest", "prefix"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(column)).mapInArrow(run, "id long, n long, digest long, prefix array<long>")


def runs_of(batches, key: str):
    """Tables of whole runs of equal key from batches sorted by it."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        x = np.asarray(table[key])
        cut = int(np.searchsorted(x, x[-1]))  # where the last, perhaps unfinished, run begins
        if cut == 0 and held and held[-1][key][0].as_py() == x[0]:
            held.append(table)
            continue
        if held:
            # what is held is one run; it ends within this batch or before it
            yield pa.concat_tables([*held, table.slice(0, cut)])
        elif cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
    if held:
        yield pa.concat_tables(held)


def tiles(signed: DataFrame) -> DataFrame:
    """(token, pos, digest, n, m) of tiles with m classes, two at least."""

    def run(batches):
        for table in runs_of(batches, "token"):
            token, n, digest, pos = (np.asarray(table[c]) for c in ("token", "n", "digest", "pos"))
            order = np.lexsort((digest, n, token))
            token, n, digest, pos = token[order], n[order], digest[order], pos[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1]) | (n[1:] != n[:-1])
            token, n, digest, pos = token[new], n[new], digest[new], pos[new]
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            m = np.repeat(np.diff([*begin, len(token)]), np.diff([*begin, len(token)]))
            keep = m > 1
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, pos, digest, n, m)], ["token", "pos", "digest", "n", "m"])

    rows = signed.where(F.size("prefix") > 0).select("digest", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "pos", "digest", "n")
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, "token long, pos int, digest long, n long, m long")


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Hashed bitmap signature of each set, as 64-bit words."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if len(row):
        bit = mixed(np.concatenate(sets)) & np.uint64(bits - 1)
        np.bitwise_or.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def width(n: int) -> int:
    """Bits of a bitmap for sets of up to n: four for each member, a power of 2 from 64 to 65536."""
    return 1 << min(16, max(6, (4 * max(1, n) - 1).bit_length()))


def bound(a: np.ndarray, na, b: np.ndarray, nb) -> np.ndarray:
    """Most members that sets with these bitmaps and sizes can share: a bit of one that the other
    lacks is at least one member the other lacks."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def linked(shared, na, nb, t: int):
    return 100 * shared >= t * (na + nb - shared)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def link_block(sets: list[np.ndarray], t: int, part: np.ndarray | None = None, inside: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets that are linked, directly or through others.  With part, sets of one part are compared
    only where they're inside."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    n = np.array([len(sets[i]) for i in order], np.int64)
    own = [sets[i] for i in order]
    bits = bitmaps(own, width(int(n[-1]) if len(n) else 1))
    forest, root, links = Forest(len(own)), np.arange(len(own)), []
    part, inside = (None, None) if part is None else (part[order], inside[order])
    for i in range(len(own)):
        last = int(np.searchsorted(n, 100 * n[i] // t, "right"))  # the band of sizes that can link
        j = np.arange(i + 1, last)
        j = j[root[j] != root[i]]
        if part is not None and not inside[i]:
            j = j[part[j] != part[i]]
        if not len(j):
            continue
        most = bound(bits[i][None, :], n[i], bits[j], n[j])
        ok = linked(most, n[i], n[j], t)
        for c in j[ok][np.argsort(-most[ok], kind="stable")].tolist():
            if root[c] != root[i] and linked(overlap(own[i], own[c]), n[i], n[c], t):
                forest.join(i, c)
                root[(root == root[c]) | (root == root[i])] = min(root[i], root[c])
                links.append((order[i], order[c]))
    return links


def arrays(docs: DataFrame, reps: DataFrame, digests: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """(digest, n, members, bits) of the given classes: the sorted shingles' bytes and the bitmap signature's."""
    ids = written(reps.join(digests, ["digest", "n"], "left_semi").select("digest", "n", F.col("rep").alias("id")), "reps")
    own = by_ids(docs.select(F.col(key).cast("long").alias("id"), F.col(column)), ids.select("id").distinct(), "id", "left_semi")

    def run(batches):
        for part in slices(batches, column):
            sets, digests = sets_of(part, column, k)
            bits = [bitmaps([s], width(len(s))).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array([len(s) for s in sets], pa.int64()), binary([s.tobytes() for s in sets]), binary(bits)], ["digest", "n", "members", "bits"])

    made = own.select(column).mapInArrow(run, "digest long, n long, members binary, bits binary")
    return made.dropDuplicates(["digest", "n"])  # an id may have several texts


def _members(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def inner_links(big: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """(a, na, b, nb) links that connect all linked classes of a tile; big is (tile, digest, n, part, inside) as of link_block."""

    def run(batches):
        for table in runs_of(batches, "tile"):
            tile, digest, n = (np.asarray(table[c]) for c in ("tile", "digest", "n"))
            members, part, inside = table["members"].to_pylist(), np.asarray(table["part"]), np.asarray(table["inside"])
            begin = [*np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])).tolist(), len(tile)]
            found = []
            for a, b in zip(begin, begin[1:], strict=False):
                if b - a > 1:
                    found += [(a + i, a + j) for i, j in link_block([_members(x) for x in members[a:b]], t, part[a:b], inside[a:b])]
            if found:
                i, j = (np.array(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digest[i], n[i], digest[j], n[j])], ["a", "na", "b", "nb"])

    full = big.join(sets, ["digest", "n"]).select("tile", "digest", "n", "part", "inside", "members")
    return full.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, na long, b long, nb long")


def candidates(tiled: DataFrame, t: int) -> DataFrame:
    """(a, na, b, nb) pairs of classes that share enough tiles, are of different components and in no big tile together,
    as all pairs of such have been compared.  tiled has component and blocks (INNER of them, nulls where fewer)."""

    def run(batches):
        for table in runs_of(batches, "token"):
            token, n, digest, component = (np.asarray(table[c]) for c in ("token", "n", "digest", "component"))
            # a missing block is a number of its own, so that it equals none
            none = -1 - np.arange(len(token) * INNER, dtype=np.int64).reshape(-1, INNER)
            own = np.stack([np.asarray(table[f"block{c}"].fill_null(0)) for c in range(INNER)], axis=1)
            own = np.where(own == 0, none, own)
            order = np.lexsort((digest, n, token))
            token, n, digest, component, own = token[order], n[order], digest[order], component[order], own[order]
            in_block = (own > 0).any(axis=1)
            begin = [*np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])).tolist(), len(token)]
            left, right, held = [], [], 0
            for a, b in zip(begin, begin[1:], strict=False):
                if (component[a:b] == component[a]).all():
                    continue
                ends = a + np.searchsorted(n[a:b], 100 * n[a:b] // t, "right")
                for i in range(a, b - 1):
                    j = np.arange(i + 1, int(ends[i - a]))
                    j = j[component[j] != component[i]]
                    if in_block[i] and len(j):
                        j = j[~(own[j][:, :, None] == own[i][None, None, :]).any(axis=(1, 2))]
                    if len(j):
                        left.append(np.full(len(j), i))
                        right.append(j)
                        held += len(j)
                    if held >= 200_000:
                        yield made(digest, n, left, right)
                        left, right, held = [], [], 0
            if held:
                yield made(digest, n, left, right)

    def made(digest, n, left, right):
        i, j = np.concatenate(left), np.concatenate(right)
        swap = digest[i] > digest[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (digest[i], n[i], digest[j], n[j])], ["a", "na", "b", "nb"])

    pairs = tiled.repartition("token").sortWithinPartitions("token").mapInArrow(run, "a long, na long, b long, nb long")
    need = F.least(F.lit(SHARED), F.ceil(F.col("na") * t / 100), F.ceil(F.col("nb") * t / 100))
    return pairs.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("shared")).where(F.col("shared") >= need).drop("shared")


def _folded(bits: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one width as rows of 64-bit words, folded to a width of size bits."""
    x = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1, size // 64)
    return np.bitwise_or.reduce(x, axis=1)


def _joined(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    x = sets.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col(column).alias("x"))
    y = sets.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col(column).alias("y"))
    return pairs.join(x, ["a", "na"]).join(y, ["b", "nb"]).select("a", "na", "b", "nb", "x", "y")


def possible(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs whose bitmaps let them be linked; a wider bitmap is folded to the width of the other."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            wx, wy = np.array([len(v) for v in x], np.int64), np.array([len(v) for v in y], np.int64)
            ok = np.zeros(len(x), bool)
            for shape in np.unique(np.stack([wx, wy], axis=1), axis=0) if len(x) else ():
                rows = np.flatnonzero((wx == shape[0]) & (wy == shape[1]))
                size = 8 * int(shape.min())
                left, right = _folded([x[i] for i in rows], size), _folded([y[i] for i in rows], size)
                ok[rows] = linked(bound(left, na[rows], right, nb[rows]), na[rows], nb[rows], t)
            if ok.any():
                yield batch.filter(pa.array(ok)).select(["a", "na", "b", "nb"])

    return _joined(pairs, sets, "bits").mapInArrow(run, "a long, na long, b long, nb long")


def checked(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The linked ones of pairs, by exact intersection."""

    def run(batches):
        for part in slices(batches, "x"):
            left, right = part.column("x").to_pylist(), part.column("y").to_pylist()
            na, nb = part.column("na").to_pylist(), part.column("nb").to_pylist()
            ok = [bool(linked(overlap(_members(x), _members(y)), n, m, t)) for x, y, n, m in zip(left, right, na, nb, strict=True)]
            if any(ok):
                yield part.filter(pa.array(ok)).select(["a", "na", "b", "nb"])

    return _joined(pairs, sets, "members").mapInArrow(run, "a long, na long, b long, nb long")


def near_copies(docs: DataFrame, k: int = 4, t: int = 85, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for each id; component_id is the least id reachable by links."""
    signed = written(signatures(docs, key, column, k, t, heavy_shingles(docs, column, k)), "signatures")
    reps = written(signed.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("digest", "n").agg(F.min("id").alias("rep")), "classes")
    # kept on the executors' disks: read twice, and made again from the signatures where an executor is lost
    tiled = tiles(signed.where(F.col("id").isNotNull())).persist(StorageLevel.DISK_ONLY)
    node = lambda d, n: F.struct(F.col(d).alias("d"), F.col(n).alias("n"))
    edge = lambda df: df.select(node("a", "na").alias("a"), node("b", "nb").alias("b"))

    # each class's first big tiles in the global order: near copies mostly have the same ones
    own_order = Window.partitionBy("digest", "n").orderBy("pos")
    big = tiled.where(F.col("m") >= BIG).withColumn("i", F.row_number().over(own_order)).where(F.col("i") <= INNER)
    # each two blocks of a tile meet in a task; a block's own classes are compared in the one with the next block
    big = big.withColumn("all", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("all")).cast("int"))
    others = F.when(F.col("all") == 1, F.array("part")).otherwise(F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda q: q != F.col("part")))
    tile = F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other"))
    inside = F.col("other") == (F.col("part") + 1) % F.col("all")
    big = written(big.select("token", "digest", "n", "i", "all", "part"), "big")
    met = big.withColumn("other", F.explode(others)).select(tile.alias("tile"), "digest", "n", "part", inside.alias("inside"))
    inner = written(inner_links(met, arrays(docs, reps, big.select("digest", "n").distinct(), key, column, k), t), "inner")
    known = components(edge(inner), "inner-links").select(F.col("node.d").alias("digest"), F.col("node.n").alias("n"), F.xxhash64("component.d", "component.n").alias("known"))
    compared = F.shiftrightunsigned(F.xxhash64("token"), 1) + F.lit(1)  # above 0
    blocks = big.groupBy("digest", "n").agg(*[F.max(F.when(F.col("i") == c + 1, compared)).alias(f"block{c}") for c in range(INNER)])
    facts = written(blocks.join(known, ["digest", "n"], "left"), "facts")
    own = tiled.select("token", "digest", "n").join(facts, ["digest", "n"], "left").withColumn("component", F.coalesce("known", F.xxhash64("digest", "n")))
    pairs = written(candidates(own, t), "pairs")
    tiled.unpersist()
    dropped(big, facts)
    ends = pairs.select(F.col("a").alias("digest"), F.col("na").alias("n")).union(pairs.select("b", "nb")).distinct()
    sets = written(arrays(docs, reps, ends, key, column, k), "sets")
    likely = written(possible(pairs, sets, t), "possible")
    links = inner.unionByName(checked(likely, sets, t))

    # components by class, named by their least document, then by document: one id may have several texts
    whole = components(edge(links), "class-links").select(F.col("node.d").alias("digest"), F.col("node.n").alias("n"), F.col("component").alias("c"))
    dropped(inner, pairs, sets, likely)
    joined = reps.join(whole, ["digest", "n"], "left").withColumn("c", F.coalesce("c", node("digest", "n")))
    first = joined.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = joined.join(first, "c").select("digest", "n", "component_id")
    by_doc = signed.where(F.col("n") > 0).join(named, ["digest", "n"], "left").select("id", "n", "component_id").union(signed.where(F.col("n") == 0).select("id", "n", F.lit(None).cast("long")))
    one = by_doc.groupBy("id").agg(F.max("n").alias("n"), F.min("component_id").alias("c"))
    return one.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with one document of each group of near copies: five words, a similarity of 0.8."""
    groups = written(near_copies(docs, k=5, t=80).where(F.col("doc_id") != F.col("component_id")).select("doc_id"), "copies")
    return by_ids(docs, groups, "doc_id", "left_anti").select(*docs.columns)


#: What DuckDB finds by joining all shingles and closing the links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.c >= 85 * (x.n + y.n - o.c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""
