"""Operator 6: substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash of the last WINDOW bytes is taken at every byte; a word end whose hash falls below a limit
ends a chunk, about AVERAGE words after the one before, and MOST_WORDS at most.  Borders depend on nearby bytes alone, so a passage
has the same chunks wherever it stands, but for its first and last few words.  Chunks have a 64-bit digest of their words (with
their places, so that white space may differ).

As short chunks of everyday words occur everywhere, chunks are compared in windows: from each chunk on, the shortest sequence of
adjacent chunks with LEAST_WORDS words, by a digest of theirs.  What is cut thus stands together in one other document.  The
document with the least id keeps a window, in all other documents it is a repeat; within=True counts those after a document's
own first place too.  The chunks of repeats are cut from their texts.  Of a repeated passage less than a chunk's words and
those of its broken first and last chunk stay at either end.

Tasks reduce equal digests of a slice before the shuffle; the join that marks repeats has one row for each
digest on its smaller side, a table of its own, so AQE may split a hot digest.

Defined results: a null text stays null and has no chunks; a text without words has none.  Rows without an id
are neither compared nor changed.  Rows of one id are told apart by their texts; equal rows get equal results,
and texts of one id don't repeat each other.  A text of any length is read whole, at about 100 bytes of memory a byte.
Columns named like the results' are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, _powers, _values, mixed, slices, small_batches, text_bytes, word_spans, written

WINDOW = 16
AVERAGE = 5
MOST_WORDS = 32
LEAST_WORDS = 16

_GEAR = (_values(21, 256) >> np.uint64(32)).astype(np.uint32)
_DIGEST = np.where(SPACES, np.uint64(0), _values(22, 256))


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2 h + G[byte] over the last WINDOW bytes, at every byte."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):  # doubling up to WINDOW
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    return h


def chunks(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk: its text's index, start and end byte, words, digest.  It begins and ends with a word."""
    starts, ends, text = word_spans(at, raw)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    last = gear(raw)[ends - 1]
    cut = (last >> np.uint32(16)).astype(np.int64) * AVERAGE < 65536
    cut &= ends - at[text] >= WINDOW  # no byte of the text before takes part
    cut[:-1] |= text[1:] != text[:-1]
    cut[-1] = True
    e = np.flatnonzero(cut)
    b = np.concatenate([[0], e[:-1] + 1])
    parts = -(-(e - b + 1) // MOST_WORDS)
    if (parts > 1).any():  # a run of one word may have no border of its own
        i = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        b, e = np.repeat(b, parts) + MOST_WORDS * i, np.repeat(e, parts)
        e = np.minimum(b + MOST_WORDS - 1, e)
    power, inverse = _powers(len(raw))
    # white space adds nothing, and what follows a chunk's last word is white space
    sums = np.add.reduceat(_DIGEST[raw] * power[: len(raw)], starts[b])
    digest = mixed(sums * inverse[starts[b]] + (e - b + 1).astype(np.uint64))
    return text[b], starts[b], ends[e], e - b + 1, digest.view(np.int64)


def _again(text: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Chunks whose digest came earlier in the same text."""
    order = np.lexsort((np.arange(len(text)), digest, text))
    same = (text[order][1:] == text[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    out = np.zeros(len(text), bool)
    out[order[1:][same]] = True
    return out


def windows(text: np.ndarray, words: np.ndarray, digest: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First chunk, last chunk and digest of the shortest sequences of a text's chunks with least words, from each chunk on."""
    to = np.cumsum(words)
    last = np.searchsorted(to, to - words + least)
    first = np.flatnonzero(last < len(text))
    last = last[first]
    same = text[first] == text[last]
    first, last = first[same], last[same]
    d = digest.view(np.uint64)
    out = mixed(d[first] + np.uint64(1)) if len(d) else d[first]
    longer = np.arange(len(first))
    for k in range(1, least):  # a chunk has a word at least
        longer = longer[(last - first)[longer] >= k]
        if not len(longer):
            break
        out[longer] = mixed(out[longer] + d[first[longer] + k])
    return first, last, out.view(np.int64)


def _compared(part, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: text, number of its first chunk in the text, and digest."""
    text, _, _, words, digest = chunks(*text_bytes(part.column("text")))
    first, _, digest = windows(text, words, digest, least)
    text_first = np.searchsorted(text, text[first])
    return text[first], first - text_first, digest


def repeated(docs: DataFrame, least: int) -> DataFrame:
    """(digest, first): windows that several documents of (id, text) have, and the least id."""

    def run(batches):
        for part in slices(batches):
            text, _, digest = _compared(part, least)
            ids = np.asarray(part.column("id"))[text]
            order = np.lexsort((ids, digest))
            ids, digest = ids[order], digest[order]
            new = np.ones(len(ids), bool)
            new[1:] = (digest[1:] != digest[:-1]) | (ids[1:] != ids[:-1])
            ids, digest = ids[new], digest[new]
            begin = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]])) if len(ids) else np.zeros(0, np.int64)
            n = np.diff([*begin, len(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(digest[begin]), pa.array(ids[begin]), pa.array(n, pa.int64())], ["digest", "first", "n"])

    sums = docs.mapInArrow(run, "digest long, first long, n long").groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    return sums.where(F.col("n") > 1).select("digest", "first")


def marked(docs: DataFrame, least: int) -> DataFrame:
    """(id, h, repeats): for texts with repeats, the sorted numbers of their first chunks."""

    def run(batches):
        for part in slices(batches):
            text, i, digest = _compared(part, least)
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(text)), part.column("h").take(pa.array(text)), pa.array(i.astype(np.int32)), pa.array(digest)], ["id", "h", "i", "digest"])

    rows = docs.mapInArrow(run, "id long, h long, i int, digest long")
    several = written(repeated(docs.select("id", "text"), least), "repeated")
    return rows.join(several, "digest").where(F.col("id") != F.col("first")).groupBy("id", "h").agg(F.array_sort(F.collect_set("i")).alias("repeats"))


def cut_text(raw: bytes, start: np.ndarray, end: np.ndarray, words: np.ndarray, repeat: np.ndarray, least: int) -> tuple[str, list[tuple[int, int]], int]:
    """Text without its runs of repeats, their byte spans, and the words cut."""
    spans, n, at, out = [], 0, 0, []
    i = 0
    while i < len(repeat):
        if not repeat[i]:
            i += 1
            continue
        j = i
        while j < len(repeat) and repeat[j]:
            j += 1
        w = int(words[i:j].sum())
        if w >= least:
            a, b = int(start[i]), int(start[j]) if j < len(repeat) else len(raw)
            spans.append((a, int(end[j - 1])))
            out.append(raw[at:a])
            at, n = b, n + w
        i = j
    out.append(raw[at:])
    text = b"".join(out)
    if spans:
        text = text.strip(b" \t\n\v\f\r")
    return text.decode("utf-8", "replace"), spans, n


def deduplicated(docs: DataFrame, key: str = "doc_id", column: str = "text", least: int = LEAST_WORDS, within: bool = False) -> DataFrame:
    """docs' columns with the text cut, and n_chunks, n_cut (chunks), words_cut, spans (bytes of the
    text before) of each row."""
    extra = "n_chunks long, n_cut long, words_cut long, spans array<struct<start: long, end: long>>"
    names = [x.split()[0] for x in extra.split(", ") if x.split()[0] != "end:"]
    kept = [f for f in docs.schema.fields if f.name not in names]
    keep = [f.name for f in kept]
    small_batches(docs.sparkSession)
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(key).cast("long").alias("_tessera_id"), F.xxhash64(column).alias("_tessera_h"))
    compared = own.where(F.col("_tessera_id").isNotNull() & F.col(column).isNotNull()).select(F.col("_tessera_id").alias("id"), F.col("_tessera_h").alias("h"), F.col(column).alias("text"))
    repeats = marked(compared, least).select(F.col("id").alias("_tessera_id"), F.col("h").alias("_tessera_h"), F.col("repeats").alias("_tessera_repeats"))
    full = own.join(repeats, ["_tessera_id", "_tessera_h"], "left").select(*[F.col(f"`{c}`") for c in keep], F.col("_tessera_id"), "_tessera_repeats")

    def run(batches):
        for part in slices(batches, column):
            at, raw = text_bytes(part.column(column))
            text, start, end, words, digest = chunks(at, raw)
            begin = np.searchsorted(text, np.arange(part.num_rows + 1))
            first, last, own = windows(text, words, digest, least)
            to = np.full(len(text), -1, np.int64)  # the last chunk of the window from each chunk on
            to[first] = last
            again = first[_again(text[first], own)] if within else first[:0]
            has = part.column("_tessera_id").is_valid().to_pylist()
            old, marks = part.column(column).to_pylist(), part.column("_tessera_repeats").to_pylist()
            texts, n, cut, cut_words, spans = [], [], [], [], []
            for r in range(part.num_rows):
                a, b = begin[r], begin[r + 1]
                starts = np.concatenate([np.array(marks[r] or [], np.int64), again[(again >= a) & (again < b)] - a]) if within else np.array(marks[r] or [], np.int64)
                edges = np.zeros(b - a + 1, np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, to[a + starts] + 1 - a, -1)
                repeat = np.cumsum(edges[:-1]) > 0
                n.append(b - a)
                if not repeat.any() or not has[r]:
                    found = old[r], [], 0
                else:
                    found = cut_text(raw[at[r] : at[r + 1]].tobytes(), start[a:b] - at[r], end[a:b] - at[r], words[a:b], repeat, least)
                texts.append(found[0])
                spans.append([{"start": x, "end": y} for x, y in found[1]])
                cut_words.append(found[2])
                cut.append(sum(int(((start[a:b] - at[r] >= x) & (end[a:b] - at[r] <= y)).sum()) for x, y in found[1]))
            columns = [pa.array(texts, pa.string()) if c == column else part.column(c) for c in keep]
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(cut_words, pa.int64()), pa.array(spans, spans_type)], [*keep, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), extra])
    return full.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = deduplicated(docs)
    return out.select("doc_id", "n_chunks", "n_cut", "words_cut", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with repeated passages cut; those of which no word is left go."""
    out = deduplicated(docs)
    out = out.where((F.col("words_cut") == 0) | (F.length("text") > 0))
    return out.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


