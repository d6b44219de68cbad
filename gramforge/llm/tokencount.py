"""Token counts by a compiled finite-state transducer.

The transducer reads a text character by character; each transition is
annotated with the change in the number of tokens of all that was read. It stands
on a property of byte-pair merging: no merge crosses a boundary between final
tokens, hence a token sequence is the tokenization of its text exactly if each
adjacent pair is the tokenization of that pair. So the last token of every prefix
follows from the last tokens of the prefixes before it, and of these only those matter
that end no farther back than the longest suffix that a vocabulary piece
begins with. That suffix and those tokens are the state. Their number is finite;
states and transitions are compiled as texts first need them and kept for the worker's life.

Long texts are cut into chunks. A chunk's state map sends an entry state to an exit state
and a count. From the first blank on that follows another character it is a constant, as
all states become one there; these parts run at once, as lanes of one vectorised table walk. Where
a whole chunk has no such blank, the map of the chunk after it is evaluated for the few entry
states that short walks over the characters before it end in, and the maps are
composed in a parallel prefix scan, each with the composition of as many before it as it spans
itself, in as many rounds as the logarithm of the chunks. An entry state that no short walk
foresaw is evaluated then, and the scan is run again, so the counts are exact in any case.

Defined cases: null and empty texts have no tokens; strings of special tokens are ordinary
text, as the library treats them; characters outside the vocabulary count
as their UTF-8 bytes; repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

LIMIT = 4096
CHUNK = 2048
BATCH = 1 << 22
SHIFT, ZERO = 6, 24
#: States held at most; beyond, compilation starts anew between two batches.
MAX_STATES = 400_000
#: Walks that foresee the entry states of a lane, and the characters that the shortest of them reads.
WALKS, WARM = 16, 48
BLANK = "▁"


class Transducer:
    """Counts tokens as the library does for a BPE model with byte fallback, an identity normalizer and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))}
        long = [p for p in self.score if len(p) > 1]
        self.begins = {p[:k] for p in long for k in range(len(p))}
        self.crossing = {p[k : k + 2] for p in long for k in range(len(p) - 1)}
        if any(c[1] == BLANK != c[0] for c in self.crossing):
            raise ValueError("pieces of this model cross the beginning of a word")
        self.fits: dict[tuple[str, str], bool] = {}
        known = {c for p in self.score for c in p}
        #: code point -> class; the classes 0 to 3 are characters outside the vocabulary, by their bytes less one
        self.classes = np.zeros(0x110000, np.int32)
        for lo, k in ((0x80, 1), (0x800, 2), (0x10000, 3)):
            self.classes[lo:] = k
        self.char = ["\x00", "\x80", "ࠀ", "\U00010000"]
        for k in range(4):
            while self.char[k] in known:
                self.char[k] = chr(ord(self.char[k]) + 1)
        for c in sorted(known):
            self.classes[ord(c)] = len(self.char)
            self.char.append(c)
        self.classes[ord(" ")] = self.blank = int(self.classes[ord(BLANK)])
        self.reset()

        #: rounds of the prefix scans
        self.rounds = 0

    def reset(self) -> None:
        #: a class gets a column of the table when it is first met
        self.column = np.full(len(self.char), -1, np.int32)
        self.used: list[int] = []
        self.table = np.full((1024, 128), -1, np.int32)
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.start = self.state(("", (None,), (0,)))

    def state(self, key: tuple) -> int:
        n = self.states.setdefault(key, len(self.keys))
        if n == len(self.keys):
            self.keys.append(key)
            if n >= len(self.table):
                self.table = np.concatenate([self.table, np.full((max(1024, n // 4), self.table.shape[1]), -1, np.int32)])
        return n

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the adjacent pair with the best score is merged, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            found = [(-self.score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def fit(self, left: str | None, right: str) -> bool:
        """Whether [left, right] is the tokenization of its text."""
        if left is None or left[-1] + right[0] not in self.crossing:
            left = ""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def step(self, key: tuple, c: str) -> tuple[tuple, int]:
        """The state after c, and the change in the token count."""
        suffix, tokens, counts = key
        text = suffix + c
        n = len(text)
        for k in range(n):
            piece = text[k:]
            if (len(piece) == 1 or piece in self.score) and self.fit(tokens[k], piece):
                break
        else:
            raise AssertionError("every prefix has a last token")
        change = counts[k] + (1 if piece in self.score else len(piece.encode()))
        tokens, counts = (*tokens, piece), (*counts, change)
        # a place counts for later only if a piece can begin there that is longer than what was read since
        opens = [text[k:] in self.begins for k in range(n + 1)]
        at = opens.index(True)
        kept = tuple(None if k < n and not (opens[k] and t and t[-1] + text[k] in self.crossing) else t for k, t in enumerate(tokens))
        return (text[at:], kept[at:], tuple(x - change if o else 0 for x, o in zip(counts[at:], opens[at:]))), change

    def compile(self, state: int, cls: int, column: int) -> None:
        key, change = self.step(self.keys[state], self.char[cls])
        self.table[state, column] = self.state(key) << SHIFT | (change + ZERO)

    def columns(self, cls: np.ndarray) -> np.ndarray:
        """cls with a class's column in place of the class."""
        col = self.column[cls]
        if col.min(initial=0) < 0:
            for c in np.unique(cls[col < 0]).tolist():
                self.column[c] = len(self.used)
                self.used.append(c)
            while len(self.used) > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            col = self.column[cls]
        return col.astype(np.int32)

    def run(self, col: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks the lanes col[begin:end] from their states; their last states and token counts."""
        length = end - begin
        order = np.argsort(-length, kind="stable")
        at, state, total, steps = begin[order], state[order].astype(np.int64), np.zeros(len(order), np.int64), length[order]
        width = np.searchsorted(-steps, -np.arange(steps[0] if len(steps) else 0), side="left")  # lanes longer than j
        j = 0
        while j < len(width) and width[j] > 12:
            k = width[j]
            c = col[at[:k] + j]
            got = self.table[state[:k], c]
            if got.min() < 0:
                for s, x in {(int(state[i]), int(c[i])) for i in np.flatnonzero(got < 0)}:
                    self.compile(s, self.used[x], x)
                got = self.table[state[:k], c]
            state[:k] = got >> SHIFT
            total[:k] += got & ((1 << SHIFT) - 1)
            j += 1
        for i in range(width[j] if j < len(width) else 0):
            s, n = int(state[i]), 0
            for c in col[at[i] + j : at[i] + steps[i]].tolist():
                got = self.table.item(s, c)
                if got < 0:
                    self.compile(s, self.used[c], c)
                    got = self.table.item(s, c)
                s, n = got >> SHIFT, n + (got & ((1 << SHIFT) - 1))
            state[i], total[i] = s, total[i] + n
        out_state, out_total = np.empty_like(state), np.empty_like(total)
        out_state[order], out_total[order] = state, total - ZERO * steps
        return out_state, out_total

    def scan(self, col: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, number: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Counts of the lanes col[begin:end], each entered in the exit state of the lane before it.

        Lanes of adjoining number form a chain; before holds the state that the first lane of a
        chain is entered in; first is where a lane's text begins.
        """
        n = len(begin)
        opens = np.append(True, np.diff(number) != 1)
        # entry states, foreseen by walks that begin at WALKS places before the lane
        lane = np.repeat(np.arange(n), WALKS)
        at = np.maximum(begin[lane] - WARM - np.tile(np.arange(WALKS), n), first[lane])
        entry = self.run(col, at, begin[lane], np.full(len(lane), self.start))[0]
        entry[opens[lane]] = before[lane[opens[lane]]]
        lane, entry = np.unique(np.stack([lane, entry]), axis=1)
        exits, counts = self.run(col, begin[lane], end[lane], entry)
        while True:
            # a node for each lane and entry state, in order; jump is the map to a node of the next lane
            key = lane << 40 | entry
            aim = np.where(np.append(opens, True)[lane + 1], -1, (lane + 1) << 40 | exits)
            place = np.minimum(np.searchsorted(key, aim), len(key) - 1)
            jump = np.append(np.where(key[place] == aim, place, -1), -1)
            real = np.full(n, -1)
            real[opens] = np.searchsorted(key, np.flatnonzero(opens) << 40 | before[opens])
            reach = 1
            while reach < n:
                self.rounds += 1
                here = np.arange(n - reach)
                to = jump[real[here]]
                hit = here[to >= 0]
                hit = hit[real[hit + reach] < 0]
                real[hit + reach] = jump[real[hit]]
                jump, reach = jump[jump], 2 * reach
            lost = np.flatnonzero((real < 0) & np.append(False, real[:-1] >= 0))
            if not len(lost):
                return counts[real]
            # states that were not foreseen
            state = exits[real[lost - 1]]
            got, more = self.run(col, begin[lost], end[lost], state)
            lane, entry, exits, counts = (np.append(x, y) for x, y in ((lane, lost), (entry, state), (exits, got), (counts, more)))
            order = np.lexsort((entry, lane))
            lane, entry, exits, counts = lane[order], entry[order], exits[order], counts[order]

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.keys) > MAX_STATES:
            self.reset()
        codes = [np.frombuffer((BLANK + t).encode("utf-32-le"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
        size = np.array([len(c) for c in codes], np.int64)
        if not size.sum():
            return np.zeros(len(texts), np.int64)
        cls = self.classes[np.concatenate(codes)]
        first = np.cumsum(size) - size
        col = self.columns(cls)
        blank = cls == self.blank
        sync = blank & ~np.append(False, blank[:-1])
        sync[first[size > 0]] = True
        sync = np.flatnonzero(sync)
        pieces = -(-size // CHUNK)
        doc = np.repeat(np.arange(len(texts)), pieces)
        begin = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * CHUNK + first[doc]
        end = np.minimum(begin + CHUNK, (first + size)[doc])
        # where all states of a chunk meet; at its end if they don't
        meet = np.append(sync, len(col))[np.searchsorted(sync, begin)]
        meet = np.minimum(meet, end)
        state, total = self.run(col, meet, end, np.full(len(doc), self.start))
        known, head = meet < end, meet > begin
        ready = np.flatnonzero(head & np.append(True, known[:-1]))
        got, more = self.run(col, begin[ready], meet[ready], state[ready - 1])
        total[ready] += more
        state[ready] = np.where(known[ready], state[ready], got)
        far = np.flatnonzero(head & ~np.append(True, known[:-1]))
        if len(far):
            total[far] += self.scan(col, first[doc[far]], begin[far], meet[far], far, state[far - 1])
        return np.bincount(doc, total, len(texts)).astype(np.int64)


_MADE: dict[str, Transducer] = {}


def count_tokens(texts: list[str], path: str) -> list[int]:
    made = _MADE.get(path) or _MADE.setdefault(path, Transducer(path))
    out: list[int] = []
    batch: list[str] = []
    held = 0
    for t in texts:
        batch.append(t or "")
        held += len(batch[-1])
        if held >= BATCH:
            out += made.count(batch).tolist()
            batch, held = [], 0
    return out + made.count(batch).tolist() if batch else out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text, by the model at path."""

    @F.pandas_udf(LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(list(texts), path), dtype="int64")

    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), counted("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
