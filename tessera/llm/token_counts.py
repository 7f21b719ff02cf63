"""Operator 1: token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates, at each end, all vocabulary pieces that end there; dynamic
programming carries the best score and its number of pieces, and no back pointers.  Ties fall as in the
tokenizers library's unigram model: matches come longest first and only a greater score replaces.

Texts are cut as its Metaspace rule does (a space becomes U+2581 and begins a word; a text that doesn't
begin with one gets one), so that words are independent and each distinct word of a slice is searched once: all words walk
along together, a numpy step for each place and length of a piece.  Frequent words are remembered by the worker.  A character without a piece costs the least score less 10; with byte fallback it counts as its
UTF-8 bytes, else a run of them as one piece.

Defined results: a null or empty text has 0 tokens.  A text of any length is read whole; a word without spaces takes about
200 bytes of memory a character.  Rows are handled one by one; other columns pass through, and one named n_tokens is replaced.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import held, slices, small_batches

#: Words, and characters of a word, whose counts a Python worker remembers before it starts anew: at most about 40 MB.
MEMO_WORDS = 200_000
MEMO_CHARS = 40
#: Characters of words searched together.
TOGETHER = 1 << 16
#: What an unknown character costs beyond the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Matcher:
    """The Aho-Corasick automaton as arrays, for many words at a time.

    keys (state << 21 | character, sorted) and target: the trie; fail: the longest suffix that is a state; first: the
    longest piece that ends at a state (its state, or 0), next: the next shorter one; length and score of a piece's state.
    """

    def __init__(self, pieces: dict[str, float]):
        edges: dict[int, int] = {}
        self_score: dict[int, float] = {}
        depth = [0]
        for piece, score in pieces.items():
            s = 0
            for c in map(ord, piece):
                t = edges.get(s << 21 | c)
                if t is None:
                    t = edges[s << 21 | c] = len(depth)
                    depth.append(depth[s] + 1)
                s = t
            if s:
                self_score[s] = score
        n = len(depth)
        fail, first, after, score = [0] * n, [0] * n, [0] * n, np.zeros(n)
        for key, t in sorted(edges.items(), key=lambda e: depth[e[1]]):  # suffixes are shorter
            s, c = key >> 21, key & 0x1FFFFF
            f = fail[s]
            while s and f and (f << 21 | c) not in edges:
                f = fail[f]
            fail[t] = edges.get(f << 21 | c, 0) if s else 0
            if t in self_score:
                first[t], after[t], score[t] = t, first[fail[t]], self_score[t]
            else:
                first[t] = first[fail[t]]
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.target = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.fail, self.first, self.next = (np.array(x, np.int64) for x in (fail, first, after))
        self.length, self.score = np.array(depth, np.int64), score

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states after reading a character each."""
        out, live = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(live):
            key = state << 21 | char
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[j] == key
            out[live[hit]] = self.target[j[hit]]
            again = ~hit & (state > 0)
            live, state, char = live[again], self.fail[state[again]], char[again]
        return out


class Counter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        scores = dict(pieces)
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
            self.matcher = Matcher(scores)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count, run = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        matches = iter(self.automaton.iter(word)) if len(self.automaton) else iter(())
        match = next(matches, None)
        for end in range(1, n + 1):
            single = False
            while match is not None and match[0] == end - 1:
                length, score = match[1]
                x = best[end - length] + score
                if best[end] is None or x > best[end]:
                    best[end], count[end], run[end] = x, count[end - length] + 1, False
                single = single or length == 1
                match = next(matches, None)
            if not single:
                x = best[end - 1] + self.unknown
                if best[end] is None or x > best[end]:
                    more = len(word[end - 1].encode()) if self.bytes else int(not run[end - 1])
                    best[end], count[end], run[end] = x, count[end - 1] + more, True
        return count[n]

    def words(self, words: list[str]) -> list[int]:
        """word() of each, all together."""
        if not words or not len(self.automaton):
            return [self.word(w) for w in words]
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        sizes = size[order].tolist()
        out = np.zeros(len(words), np.int64)
        first = 0
        while first < len(words):  # words of like length, a bounded number of characters
            last = first + 1
            while last < len(words) and (last - first + 1) * sizes[last] <= TOGETHER:
                last += 1
            own = order[first:last]
            if sizes[last - 1] > 256 or len(own) < 8:
                out[own] = [self.word(words[i]) for i in own.tolist()]
            else:
                out[own] = self._searched([words[i] for i in own.tolist()], size[own])
            first = last
        return out.tolist()

    def _searched(self, words: list[str], size: np.ndarray) -> np.ndarray:
        n, most = len(words), int(size[-1])
        start = np.concatenate([[0], np.cumsum(size[:-1])])
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        points = text[np.minimum(np.arange(most)[:, None] + start[None, :], len(text) - 1)]  # by place and word
        more = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)  # UTF-8 bytes
        m = self.matcher
        best, count, run = np.full((most + 1, n), -np.inf), np.zeros((most + 1, n), np.int64), np.zeros((most + 1, n), bool)
        best[0] = 0.0
        state, begin = np.zeros(n, np.int64), 0
        for place in range(1, most + 1):
            begin = int(np.searchsorted(size, place))  # shorter words are done
            w = np.arange(begin, n)
            state[w] = m.step(state[w], points[place - 1, w])
            now, counts, single = best[place], count[place], np.zeros(n, bool)
            match = m.first[state[w]]
            while True:  # the pieces that end here, longest first
                has = match > 0
                if not has.all():
                    w, match = w[has], match[has]
                    if not len(w):
                        break
                length = m.length[match]
                from_ = place - length
                x = best[from_, w] + m.score[match]
                better = x > now[w]
                own = w[better]
                now[own], counts[own] = x[better], count[from_[better], own] + 1
                single[w[length == 1]] = True
                match = m.next[match]
            x = best[place - 1] + self.unknown
            own = np.flatnonzero(~single & (x > now))
            own = own[own >= begin]
            if len(own):
                now[own] = x[own]
                counts[own] = count[place - 1, own] + (more[place - 1, own] if self.bytes else ~run[place - 1, own])
                run[place, own] = True
        return count[size, np.arange(n)]

    def text(self, text: str | None) -> int:
        return self.texts([text])[0]

    def texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        cut = []
        for text in texts:
            own = text.replace(SPACE, " ").split(" ") if text else []
            if own and own[0] == "":
                del own[0]
            cut.append(own)
        memo = self.memo
        new = list(set(chain.from_iterable(cut)).difference(memo))
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list(set(chain.from_iterable(cut)))
        memo.update(zip(new, self.words([SPACE + w for w in new]), strict=True))
        get = memo.__getitem__
        out = [sum(map(get, own)) for own in cut]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out


def counter_of(shared) -> Counter:
    """This worker's counter for a broadcast: its memo lives on from task to task."""
    name, pieces = shared.value
    own = held("token counts")
    if name not in own:
        own.clear()
        own[name] = Counter(pieces)
    return own[name]


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], column: str = "text") -> DataFrame:
    """docs' columns but the text's, and n_tokens long.  pieces: vocabulary entries with their scores by id
    (bounded: a tokenizer's), broadcast to the workers."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, pieces))
    kept = [f for f in docs.schema.fields if f.name not in (column, "n_tokens")]
    keep = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long"])

    def run(batches):
        counter = counter_of(shared)
        for part in slices(batches, column, keep="token counts"):
            n = counter.texts(part.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return docs.select(*keep, column).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import tokenizer_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, vocabulary(tokenizer_path("piece_bpe_32k.model")))
