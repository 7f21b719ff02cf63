"""What the operators share: shared storage, size-checked joins and vectorised text work.

Texts reach Python as Arrow batches.  ``slices`` cuts each batch by bytes, so that a task holds a
few MB of text and the arrays derived from it, whatever the row count of a batch; one text longer
than that makes a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in one slice.
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch between the JVM and Python, where the session doesn't set its own number: Spark's 10,000 texts would be tens of MB.
BATCH_ROWS = 512
#: Rows of 8-byte ids up to which a semi or anti join broadcasts them (16 MB); beyond, it shuffles.
BROADCAST_IDS = 1_000_000

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; only a session on this machine alone may name none, and gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def small_batches(spark: SparkSession) -> None:
    """BATCH_ROWS rows to an Arrow batch from now on, unless the session has a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, lost executors or not."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tessera_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables as written() returned them, when all that was made of them is written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._tessera_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str, n_ids: int | None = None) -> DataFrame:
    """Semi or anti join of df with distinct ids: broadcast up to BROADCAST_IDS rows, else shuffled."""
    n = ids.count() if n_ids is None else n_ids
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, how)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of doc_id as text leaves 2 when divided by 4; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def trimmed() -> None:
    """Hands a worker's freed memory back to the system, as workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_HELD: dict[str, dict] = {}


def held(kind: str) -> dict:
    """What a worker keeps from task to task for one operator; a task of another drops it first."""
    if kind not in _HELD:
        _HELD.clear()
        trimmed()
    return _HELD.setdefault(kind, {})


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that column holds about size bytes in each, or one text; keep: whose held things stay."""
    held(keep)
    for batch in batches:
        if not batch.num_rows:
            continue
        at, _ = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
        trimmed()


def text_column(fn: Callable[[pa.Array], pa.Array], returns: str, keep: str = "") -> Callable:
    """A column function of texts: fn gets slices as of slices().  Only the texts go to Python and only fn's values come back."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            whole = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [fn(part.column("text")) for part in slices(iter([whole]), keep=keep)]
            yield pa.concat_arrays(parts) if parts else fn(column)

    return F.arrow_udf(run, returns)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def _values(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * M1 + np.uint64(seed))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _values(7, 256)[_LOWER]  # of a byte after lower-casing A-Z
#: Bytes between words: space and the controls 9 to 13.
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes between words where punctuation parts words too.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_R = 0xD6E8FEB86659FD93
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    global _POWERS
    if len(_POWERS[0]) < n:
        n = max(n, SLICE_BYTES + 4096)
        made = []
        for r in (_R, pow(_R, -1, 1 << 64)):
            x = np.full(n, r, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > 4 * SLICE_BYTES:
            return made[0], made[1]  # for one very long text: not kept
        _POWERS = made[0], made[1]
    return _POWERS


def word_spans(at: np.ndarray, raw: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (bytes not in apart; none spans two texts), and its text's index."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~apart[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True  # where a text begins or ends
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, "right") - 1


def word_hashes(at: np.ndarray, raw: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z in lower case, and its text's index."""
    starts, _, text = word_spans(at, raw, apart)
    if not len(starts):
        return np.zeros(0, np.uint64), text
    power, inverse = _powers(len(raw))
    values = np.where(apart, np.uint64(0), _BYTE)[raw] * power[: len(raw)]
    return mixed(np.add.reduceat(values, starts) * inverse[starts]), text


def shingles(words: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words and its text's index; the whole of a shorter non-empty text is one."""

    def run(first: np.ndarray, m: int) -> np.ndarray:
        out = np.full(len(first), m, np.uint64)
        for i in range(m):
            out = (out ^ words[first + i]) * M1
            out ^= out >> np.uint64(29)
        return mixed(out)

    count = np.bincount(text, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.arange(max(0, len(words) - k + 1))
    at = at[text[at] == text[at + k - 1]] if len(at) else at
    hashes, texts = [run(at, k)], [text[at]]
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            hashes.append(run(begin[short], m))
            texts.append(short)
    h, t = np.concatenate(hashes), np.concatenate(texts)
    if len(texts) > 1:
        order = np.argsort(t, kind="stable")
        h, t = h[order], t[order]
    return h, t


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
