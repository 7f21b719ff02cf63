"""Operator 10: byte-level BPE encoding and decoding through a minimal acyclic transducer.

Frequent words (pre-tokens) of the whole corpus are counted, encoded once on the driver and compiled
into a minimal acyclic automaton with shared suffixes.  Each transition carries an integer; the sum
along a word's path is the word's number, which gives its ids.  The compiled arrays are broadcast
(their size is bounded by LEXICON_WORDS), written to an unlinked local file and memory-mapped by each
Python worker.  A word that the automaton doesn't accept is merged exactly, lowest rank first.

Defined results: a null or empty text has no tokens and decodes to the empty text.  The special token's
string in a text is that token, as in the tokenizers library with add_special_tokens=False.  A text of any length is read whole;
long words are merged in n log n and not remembered.  The file that workers map is made anew from the broadcast wherever one runs,
so nothing depends on a machine's folder.  Rows are handled one by one, so ties, repeated rows, null ids and extra columns pass through unchanged.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import uuid
from collections import Counter
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held, slices, small_batches

#: Bounds of the lexicon: words, and bytes of a word.
LEXICON_WORDS = 60_000
LEXICON_BYTES = 32
#: A task sends its words with this many occurrences at least; the sums over tasks rank the words.
LEXICON_LEAST = 8
#: Words, and characters of a word, whose results a Python worker remembers before it starts anew.
MEMO_WORDS = 600_000
MEMO_CHARS = 40

# The pattern that splits text before the merges, and the ranges of code points that newer
# Unicode tables count as letters or numbers and the tokenizers library's tables do not.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEWER = (
    "՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_SPLIT = regex.compile(PATTERN)
#: PATTERN for texts of the first 256 code points alone, whose letters, numbers and white space are these.
_SPLIT_LATIN = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼-¾]+| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+"
    r"|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
_NEWER = regex.compile(f"[{NEWER}]")
_SPLIT_EXACT = regex.compile(
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{NEWER}]]+| ?[\p{{N}}--[{NEWER}]]+| ?(?:[^\s\p{{L}}\p{{N}}]|[{NEWER}])+|\s+(?!\S)|\s+"
)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tables:
    """Vocabulary of a tokenizer file: the bytes of each id, merge ranks by pair of ids, specials."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, vocab = byte_letters(), file["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.merges = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest rank first, the leftmost of equal ones."""
        ids, merges = [self.of_byte[b] for b in word], self.merges
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                m = merges.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n: a heap of candidate merges over a linked list."""
        n, merges = len(ids), self.merges
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (m := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right], m[1]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]


class Lexicon:
    """A minimal acyclic transducer from words (bytes) to their numbers, and the ids of each number.

    Arrays: keys (state * 256 + byte, sorted), target and output of each transition, final by state;
    ids of word w are ids[starts[w]:starts[w + 1]].
    """

    FIELDS = ("keys", "target", "output", "final", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for k in self.FIELDS:
            setattr(self, k, arrays[k])

    @classmethod
    def compiled(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Incremental construction from sorted words: each finished suffix is shared if it exists."""
        order = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def fixed(node: list) -> int:
            sign = (node[0], tuple(node[1].items()))
            if sign not in register:
                register[sign] = len(states)
                states.append(sign)
            return register[sign]

        path = [[False, {}]]  # nodes along the last word; children of a node that's done are state numbers
        last = b""
        for word in order:
            common = len(os.path.commonprefix([last, word]))
            for i in range(len(last), common, -1):
                path[i - 1][1][last[i - 1]] = fixed(path.pop())
            for b in word[common:]:
                path[-1][1][b] = -1
                path.append([False, {}])
            path[-1][0] = True
            last = word
        for i in range(len(last), 0, -1):
            path[i - 1][1][last[i - 1]] = fixed(path.pop())
        root = fixed(path[0])
        count = [0] * len(states)  # words accepted from a state; targets come before their sources
        keys, target, output = [], [], []
        for s, (final, edges) in enumerate(states):
            n = int(final)
            for b, t in edges:
                keys.append(s << 8 | b)
                target.append(t)
                output.append(n)
                n += count[t]
            count[s] = n
        o = np.argsort(np.array(keys, np.int64), kind="stable")
        ids = [words[w] for w in order]
        lexicon = cls({
            "keys": np.array(keys, np.int64)[o], "target": np.array(target, np.int32)[o], "output": np.array(output, np.int32)[o],
            "final": np.append(np.array([f for f, _ in states], np.int8), np.int8(0)),
            "starts": np.cumsum([0, *map(len, ids)], dtype=np.int64), "ids": np.array([x for w in ids for x in w], np.uint32),
        })
        assert root == len(states) - 1
        return lexicon

    def dumped(self) -> tuple[list[tuple[str, str, int, int]], bytes]:
        """Name, type, place and length of each array, and one buffer with all of them."""
        head, body = [], bytearray()
        for k in self.FIELDS:
            x = getattr(self, k)
            body += b"\0" * (-len(body) % 8)
            head.append((k, x.dtype.str, len(body), len(x)))
            body += x.tobytes()
        return head, bytes(body)

    @classmethod
    def mapped(cls, head: list[tuple[str, str, int, int]], body: bytes) -> Lexicon:
        """Memory-mapped from a local file that has no name any more, so nothing is left behind."""
        with tempfile.TemporaryFile() as f:
            f.write(body)
            f.flush()
            whole = np.memmap(f, np.uint8, "r", shape=(len(body),))
        return cls({k: whole[at : at + n * np.dtype(kind).itemsize].view(kind) for k, kind, at, n in head})

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1: all words walk the automaton together, byte by byte."""
        n = len(words)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        length = np.fromiter(map(len, words), np.int64, n)
        raw, at = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.concatenate([[0], np.cumsum(length)[:-1]])
        state, sums = np.full(n, len(self.final) - 2, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((length > 0) & (length <= LEXICON_BYTES))
        state[(length == 0) | (length > LEXICON_BYTES)] = len(self.final) - 1
        step = 0
        while len(live):
            key = state[live] << 8 | raw[at[live] + step]
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[j] == key
            state[live[~ok]] = len(self.final) - 1
            live, j = live[ok], j[ok]
            state[live] = self.target[j]
            sums[live] += self.output[j]
            step += 1
            live = live[length[live] > step]
        return np.where(self.final[state] > 0, sums, -1)


class Coder:
    """Encodes and decodes whole texts; words seen before come from a bounded memo."""

    def __init__(self, tables: Tables, lexicon: Lexicon | None = None):
        self.tables, self.lexicon = tables, lexicon
        self.ids: dict[str, bytes] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(tables.special, key=len, reverse=True))) + ")") if tables.special else None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens stand as they are."""
        if self.special and self.special.search(text):
            return [p for i, part in enumerate(self.special.split(text)) for p in ([part] if i % 2 else self.words(part))]
        return self.words(text)

    @staticmethod
    def words(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (_SPLIT_EXACT if _NEWER.search(text) else _SPLIT).findall(text)
        return _SPLIT_LATIN.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Puts pieces in the memo: by the transducer, else by merging."""
        if len(self.ids) + len(pieces) > MEMO_WORDS:
            self.ids.clear()
        new = [p for p in pieces if p not in self.ids]
        for p in [p for p in new if p in self.tables.special]:
            self.ids[p] = self.tables.special[p].to_bytes(4, "little")
        new = [p for p in new if p not in self.tables.special]
        raw = [p.encode() for p in new]
        number = self.lexicon.numbers(raw).tolist() if self.lexicon else [-1] * len(raw)
        for p, word, w in zip(new, raw, number, strict=True):
            if w >= 0:
                ids = self.lexicon.ids[self.lexicon.starts[w] : self.lexicon.starts[w + 1]]
            else:
                ids = np.array(self.tables.merge(word), np.uint32)
            self.ids[p] = ids.astype("<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.pieces(t) if t else [] for t in texts]
        distinct = set(chain.from_iterable(pieces))
        unseen = distinct.difference(self.ids)
        if unseen:
            known = len(self.ids)
            self.learn(unseen)
            if len(self.ids) < known + len(unseen):  # the memo began anew
                self.learn(distinct)
        get = self.ids.__getitem__
        out = [b"".join(map(get, own)) for own in pieces]
        for p in unseen:
            if len(p) > MEMO_CHARS:
                self.ids.pop(p, None)
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tables.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def coder_of(shared) -> Coder:
    """This worker's coder for a broadcast: its memo lives on from task to task."""
    name, tables, head, body = shared.value
    own = held("bpe")
    if name not in own:
        own.clear()
        own[name] = Coder(tables, Lexicon.mapped(head, body))
    return own[name]


def frequent_words(docs: DataFrame, column: str = "text", least: int = LEXICON_LEAST, most: int = LEXICON_WORDS) -> list[str]:
    """The corpus's most frequent pre-tokens: words between spaces that are one pre-token with the space
    before them.  Every task counts all its texts and adds up what it sends; the sums over tasks rank."""

    def counted(batches):
        total: Counter = Counter()
        for part in slices(batches, column):
            for text in part.column(column).to_pylist():
                if text:
                    words = text.split(" ")
                    # long words don't rank; a text of such isn't kept
                    total.update(words if len(text) < LEXICON_BYTES * len(words) else [w for w in words if len(w) < LEXICON_BYTES])
            if len(total) > 2 * MEMO_WORDS:  # what is rare among so many words is let go, as it can't rank
                total = Counter({w: n for w, n in total.items() if n >= least})
        rows = [(" " + w, n) for w, n in total.items() if n >= least and 0 < len(w) < LEXICON_BYTES]
        rows = [(w, n) for w, n in rows if len(w.encode()) <= LEXICON_BYTES and len(Coder.words(w)) == 1]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

    words = docs.select(column).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in words.orderBy(F.desc("n"), "word").limit(most).collect()]


def compiled_lexicon(tables: Tables, words: list[str]) -> Lexicon:
    """The vocabulary's own words and the given ones with their ids."""
    return Lexicon.compiled({w: tables.merge(w) for w in [x.encode() for x in words]})


def encode_decode(docs: DataFrame, path: str, column: str = "text", out: str = "ids binary, n_tokens long, decoded string", lexicon: bool = True) -> DataFrame:
    """docs' columns but the text's, and for each row what out names: ids (little-endian unsigned 32-bit),
    n_tokens, decoded, ids_sha256, decoded_sha256.

    path: a byte-level BPE tokenizer file on the driver.  lexicon=False: exact merging alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(path)
    compiled = compiled_lexicon(tables, frequent_words(docs, column) if lexicon else [])
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, tables, *compiled.dumped()))
    names = [x.split()[0] for x in out.split(", ")]
    kept = [f for f in docs.schema.fields if f.name != column and f.name not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), out])
    keep = [f.name for f in kept]

    def run(batches):
        coder = coder_of(shared)
        for part in slices(batches, column, keep="bpe"):
            ids = coder.encode_all(part.column(column).to_pylist())
            made = {"ids": lambda ids=ids: pa.array(ids, pa.binary()), "n_tokens": lambda ids=ids: pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": lambda ids=ids: pa.array([sha256(x).hexdigest() for x in ids])}
            if "decoded" in names or "decoded_sha256" in names:
                texts = [coder.decode(x) for x in ids]
                made |= {"decoded": lambda texts=texts: pa.array(texts, pa.string()), "decoded_sha256": lambda texts=texts: pa.array([sha256(t.encode()).hexdigest() for t in texts])}
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(made[n]() for n in names)], [*keep, *names])

    return docs.select(*keep, column).mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, tokenizer_path("byte_bpe_50k.json"), out="n_tokens long, ids_sha256 string, decoded_sha256 string")
