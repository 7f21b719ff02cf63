"""Operator 4: language identification by cross-parsing entropy.

For each language a suffix automaton is built from labelled text.  A text is parsed greedily into the
longest phrases that occur in a language's text; the language that needs the fewest normalised phrases wins.  As the
longest matches grow with the logarithm of the text they are searched in, phrases are multiplied by that of the
language's sample: unequal samples don't favour the larger one.  A letter that a language's sample lacks is a phrase and
counts twice, as it takes more to tell than one that is there.  All texts of a slice walk the automata together: whole
texts are laid out in lanes of LANE characters, one numpy step moves all lanes, and each lane whose phrase before its border
goes on is walked again from that state until both walks agree, so that the parse is the one of the whole text.

Fitting takes a bounded sample of labelled rows: per language SAMPLE_CHARS characters of at most
SAMPLE_ROWS distinct rows, ROW_CHARS of each, in the order of a hash of the row; every language and every letter of the samples
is learnt, and prediction reads every whole text.

Defined results: und with score 0 where the text is null, empty or has no letter, or where nothing was
learnt (the pipeline's stage then keeps all texts with a letter); equal normalised counts go to the smaller language value; the
score is 1 less the ratio of the fewest to the second fewest (1 if only one language was learnt).  A null doc_id counts as not
held out and isn't learnt from; repeated rows are learnt once.  A text of any length is read whole, at about 40 bytes of memory a
character.  Rows are handled one by one; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import held_out, small_batches, text_column

#: Bounds of what is fitted on: characters and rows per language.
SAMPLE_CHARS = 40_000
SAMPLE_ROWS = 300
#: Characters that one row adds to the sample, so that many rows make it up.
ROW_CHARS = 1_000
#: Cells of all automata's total tables together; further automata keep only the transitions they have.
DENSE_CELLS = 1 << 24
LANE = 256
#: Rounds in which all unfinished lanes are walked together; beyond, one by one.
ROUNDS = 3
#: Classes of characters: padding, everything but letters, letters that aren't in the samples; letters follow.
PAD, SPACE, OTHER = 0, 1, 2
UNDETERMINED = "und"
#: The pipeline's stage rejects texts of UNKNOWN_LEAST characters and more of which even the best language needs more
#: than UNKNOWN phrases a character.  Texts of learnt languages need up to 0.28 on sf0.1, random letters 0.68, letters
#: that no language has 2.
UNKNOWN = 0.6
UNKNOWN_LEAST = 20

_LETTER = None


def is_letter() -> np.ndarray:
    """By code point: whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


class Automaton:
    """Suffix automaton of a sequence of classes.

    table[state * width + c] = next state * width * 2 + (1 if a phrase begins with c); start is the state before a text.
    The table is total for as many cells as are given; beyond, it has the transitions that occur, sorted in keys, and
    fresh, what a phrase that begins with c leads to, stands for all others.
    """

    def __init__(self, codes: list[int], width: int, cells: int = DENSE_CELLS):
        follow: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            new = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and follow[p].get(c) == q:
                        follow[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        n = len(follow)  # also the state between phrases, after a letter that doesn't occur
        self.start = n * width
        self.cells = (n + 1) * width
        if self.cells > cells:
            edges = np.array([(s * width + c, t * width * 2) for s, own in enumerate(follow) for c, t in own.items()], np.int64).reshape(-1, 2)
            edges = edges[np.argsort(edges[:, 0])]
            self.keys, self.table = edges[:, 0].copy(), edges[:, 1].copy()
            self.fresh = np.full(width, n * width * 2 + 1, np.int64)
            for c, t in follow[0].items():
                self.fresh[c] = t * width * 2 + 1
            self.cells = 0
            return
        self.keys = None
        table = np.full((n + 1, width), -1, np.int64)
        for s, edges in enumerate(follow):
            for c, t in edges.items():
                table[s, c] = t
        fresh = np.where(table[0] >= 0, table[0], n) * width * 2 + 1  # where a phrase that begins with c leads
        out = np.where(table >= 0, table * width * 2, fresh[None, :])
        out[:, PAD] = np.arange(n + 1) * width * 2
        self.table = out.astype(np.int32 if (n + 1) * width * 2 < 2**31 else np.int64).ravel()

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Entries of the total table for states and the classes they read."""
        if self.keys is None:
            return self.table.take(state + codes)
        value = self.fresh[codes]
        if len(self.keys):
            key = state + codes
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            value = np.where(self.keys[at] == key, self.table[at], value)
        return np.where(codes == PAD, state * 2, value)

    def begun(self, steps: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that begin in each lane (a column of steps); a lane that follows goes on from the one before."""
        states, flags = np.empty(steps.shape, self.table.dtype), np.empty(steps.shape, bool)
        entry = np.full(steps.shape[1], self.start, self.table.dtype)
        state = entry
        for r, row in enumerate(steps):
            value = self.step(state, row)
            state = value >> 1
            states[r], flags[r] = state, value & 1

        def changed() -> np.ndarray:
            """Lanes that were walked from another state than the lane before ends in; walked from now on from that."""
            i = np.flatnonzero(follows)
            i = i[entry[i] != states[-1, i - 1]]
            entry[i] = states[-1, i - 1]
            return i

        for _ in range(ROUNDS):
            lanes = changed()
            if not len(lanes):
                break
            state = entry[lanes]
            for r, row in enumerate(steps):
                value = self.step(state, row[lanes])
                state = value >> 1
                apart = state != states[r, lanes]
                flags[r, lanes] = value & 1
                if not apart.all():
                    lanes, state = lanes[apart], state[apart]
                    if not len(lanes):
                        break
                states[r, lanes] = state
        else:
            self._chased(steps, follows, states, flags, entry, changed())
        return flags.sum(axis=0, dtype=np.int64)

    def _chased(self, steps: np.ndarray, follows: np.ndarray, states: np.ndarray, flags: np.ndarray, entry: np.ndarray, lanes: np.ndarray) -> None:
        """The rest of begun(), lane after lane: texts of which walks from different states seldom agree."""
        n = steps.shape[1]
        for i in lanes.tolist():
            state, r = int(entry[i]), 0
            while True:
                value = int(self.table[state + steps[r, i]] if self.keys is None else self.step(np.array([state]), steps[r, i : i + 1])[0])
                flags[r, i], state = value & 1, value >> 1
                if state == states[r, i]:
                    break
                states[r, i] = state
                r += 1
                if r == len(steps):
                    i, r = i + 1, 0
                    if i >= n or not follows[i]:
                        break
                    entry[i] = state


class Model:
    """Languages, letter classes and automata of labelled texts."""

    def __init__(self, texts: dict[str, list[str]], chars: int = SAMPLE_CHARS):
        self.languages = sorted(texts)
        codes = {k: self._points(" ".join(texts[k]))[:chars] for k in self.languages}
        #: What phrases in each language are multiplied by.
        self.norm = np.array([np.log2(max(2, len(codes[k]))) for k in self.languages])
        every = np.concatenate([np.zeros(0, np.uint32), *codes.values()])
        self.letters = np.unique(every[is_letter()[every]])
        self.width = OTHER + 1 + len(self.letters)
        self._classes = None
        # each automaton has the letters of its own sample; to it, all others are one class that never occurs
        self.own, self.automata, cells = [], [], DENSE_CELLS
        for k in self.languages:
            sample = self._collapsed(self.classes()[codes[k]])[0]
            held = np.unique(sample[sample > OTHER])
            own = np.full(self.width, OTHER, np.int32)
            own[[PAD, SPACE]] = PAD, SPACE
            own[held] = np.arange(OTHER + 1, OTHER + 1 + len(held))
            self.own.append(own)
            self.automata.append(Automaton(own[sample].tolist(), OTHER + 1 + len(held), cells))
            cells -= self.automata[-1].cells

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)

    def classes(self) -> np.ndarray:
        if self._classes is None:
            self._classes = np.where(is_letter(), np.int32(OTHER), np.int32(SPACE))
            self._classes[self.letters] = np.arange(OTHER + 1, self.width)
        return self._classes

    def __getstate__(self):
        return self.__dict__ | {"_classes": None}

    @staticmethod
    def _collapsed(codes: np.ndarray, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Runs of what isn't a letter become one; runs end with the text."""
        keep = codes != SPACE
        if len(codes):
            before = np.concatenate([[True], keep[:-1]])
            if text is not None:
                before[1:] |= text[1:] != text[:-1]
            keep = keep | before
        return codes[keep], None if text is None else text[keep]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: phrases by language (texts x languages), and whether it has a letter."""
        return self._parsed(texts)[:2]

    def _parsed(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases() and each text's characters, runs of what isn't a letter as one."""
        points = [self._points(t) if t else np.zeros(0, np.uint32) for t in texts]
        size = np.array([len(p) for p in points], np.int64)
        every = np.concatenate([np.zeros(0, np.uint32), *points])
        text = np.repeat(np.arange(len(texts)), size)
        codes, text = self._collapsed(self.classes()[every], text)
        lettered = np.bincount(text[codes != SPACE], minlength=len(texts)) > 0
        size = np.bincount(text, minlength=len(texts))
        lanes = -(-size // LANE)
        first = np.concatenate([[0], np.cumsum(lanes)[:-1]])
        grid = np.zeros(int(lanes.sum()) * LANE, np.int32)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        grid[np.arange(len(codes)) - begin[text] + first[text] * LANE] = codes
        steps = np.ascontiguousarray(grid.reshape(-1, LANE).T)
        of = np.repeat(np.arange(len(texts)), lanes)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        follows = np.concatenate([[False], of[1:] == of[:-1]]) if len(of) else np.zeros(0, bool)
        for j, (a, own) in enumerate(zip(self.automata, self.own, strict=True)):
            read = own.take(steps)
            out[:, j] = np.bincount(of, a.begun(read, follows) + (read == OTHER).sum(axis=0), minlength=len(texts)).astype(np.int64)
        return out, lettered, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judged(texts)[:2]

    def judged(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """predict() and whether the text may be in a learnt language: it has a letter and, where anything was
        learnt, isn't a text of UNKNOWN_LEAST characters with more than UNKNOWN phrases a character."""
        n, lettered, size = self._parsed(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), lettered
        cost = n * self.norm
        best = cost.argmin(axis=1)
        fewest = n[np.arange(len(texts)), best]
        if len(self.languages) > 1:
            least = np.partition(cost, 1, axis=1)
            score = 1 - least[:, 0] / np.maximum(1, least[:, 1])
        else:
            score = np.ones(len(texts))
        known = lettered & ((size < UNKNOWN_LEAST) | (fewest <= UNKNOWN * size))
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], np.where(lettered, np.clip(score, 0, 1), 0.0), known


def agreed(texts: dict[str, list[str]], chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """texts without those that a model of the other half of them finds in another language: a labelled text may be
    mostly a passage in another language, which its automaton would then know by heart."""
    halves = [{k: v[i::2] for k, v in texts.items() if len(v) > 1} for i in (0, 1)]
    models = [Model(h, chars) for h in halves]
    kept: dict[str, list[str]] = {k: [] for k in texts}
    for i in (0, 1):
        own = [(k, t) for k, v in texts.items() for t in v[i::2]]
        for j in range(0, len(own), 1000):
            part = own[j : j + 1000]
            for (k, t), lang in zip(part, models[1 - i].predict([t for _, t in part])[0], strict=True):
                if k not in halves[1 - i] or lang in (k, UNDETERMINED):
                    kept[k].append(t)
    return {k: v or texts[k] for k, v in kept.items()}


def fitted(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Model of labelled rows that aren't held out; the first distinct rows of each language by a hash of the row."""
    learnt = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    learnt = learnt.select(F.col(lang).alias("lang"), F.xxhash64(key, text).alias("h"), F.substring(F.col(text), 1, ROW_CHARS).alias("text"))
    counts = learnt.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    if not counts:
        return Model({}, chars)
    # of each language a slice of the hash's range that holds about twice the bound, then the bounds themselves
    part = labelled.sparkSession.createDataFrame([(r.lang, int((1 << 30) * min(1.0, 2 * rows / max(1, r.n)))) for r in counts], "lang string, part long")
    sliced = learnt.join(F.broadcast(part), "lang").where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) <= F.col("part"))
    own = Window.partitionBy("lang").orderBy("h")
    ranked = sliced.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("i", F.row_number().over(own)).where(F.col("i") <= rows)
    before = F.coalesce(F.sum(F.length("text") + 1).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    texts: dict[str, list[str]] = {}
    for r in ranked.withColumn("before", before).where(F.col("before") < chars).orderBy("lang", "h").select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text)
    return Model(agreed(texts, chars), chars)


def identified(spark: SparkSession, model: Model, column: str = "text"):
    """What model says of a text column, as (lang, score, known); only the texts go to Python."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        lang, score, known = shared.value.judged(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.bool_())], ["lang", "score", "known"])

    return text_column(run, "lang string, score double, known boolean")(F.col(column))


def identify(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """docs' columns, with lang_pred and score; the whole text is read.  Columns of these names are replaced."""
    found = identified(docs.sparkSession, model, column)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, found.alias("_tessera_found")).select(*kept, F.col("_tessera_found.lang").alias("lang_pred"), F.col("_tessera_found.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), fitted(docs)).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without those that have no letter or, by their phrases, are in no learnt language (UNKNOWN)."""
    return docs.where(identified(spark, fitted(docs))["known"])
