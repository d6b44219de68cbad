"""Best-fit packing of tokenized documents into sequences, improved by local search.

Documents are tokenized once, in place; only one row of numbers for each piece moves on.
Pieces are dealt evenly to groups of GROUP, each packed by one task: best fit in
order of size gives the first bins, then the local search exchanges, between the
emptiest bin and fuller ones, one piece for one, two for one, or moves a piece, always
so that the sum of squared fills rises, until bins empty, the lower bound is
reached or no exchange helps. What the groups leave in their emptiest bins is
dealt again to fewer groups, down to one, so the loss does not grow with the groups.

Defined cases: a null text is empty and still ends with the closing id; a document longer
than a sequence is cut into whole sequences and a rest, none other is cut; repeated
rows are packed each; a null doc_id is carried along; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .wordpieces import WordPieces

CAPACITY = 4096
END_ID = 1
GROUP = 1 << 16
#: Bins at least so full are closed when a group is done; of the others at least all but the emptiest OPEN of the group's bins.
CLOSED, OPEN = 0.995, 0.25
#: Underfull bins in a row that the local search tries in vain before it ends; None tries all.
PATIENCE = 64
#: Chunks of text that a worker remembers with their ids, twice at most: those met lately and those met before.
REMEMBERED = 600_000
#: A word that parts chunks when many are encoded at once; chunks that hold it are encoded alone.
_PART = "\u4dc0"
#: Chunks that are one word of Latin letters, one run of ASCII signs, or a word and then signs. An apostrophe may begin an ending, so it is no sign here.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
#: Longer chunks, in bytes, are left to the library.
_LONG = 48


class Ids:
    """Token ids of whole texts as little-endian 32-bit numbers.

    The tokenizer drops white space and forms no token over it, so the ids of a
    text are those of its chunks between blanks, which are remembered. Plain chunks
    not met before are merged many at a time by ``WordPieces``, others by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.part = np.array(self._ids(_PART), np.uint32)
        self.words = WordPieces.of(path)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn_plain(self, chunks: list[bytes]) -> list[bytes]:
        """Remembers the ids of the plain ones among chunks, and returns the others."""
        if self.words is None:
            return chunks
        number: dict[str, int] = {"": 0}
        at, plain, others, match = number.setdefault, [], [], _PLAIN.fullmatch
        words, signs = [], []
        for c in chunks:
            m = match(c.decode()) if len(c) <= _LONG else None
            if m is None:
                others.append(c)
                continue
            word, sign = m.groups()
            plain.append(c)
            words.append(at(word.lower(), len(number)))
            signs.append(at(sign, len(number)))
        ids = [b"", *self.words.encode([w.encode() for w in number if w])]
        get = ids.__getitem__
        self.known.update(zip(plain, map(bytes.__add__, map(get, words), map(get, signs)), strict=True))
        return others

    def learn(self, chunks: list[bytes]) -> None:
        """Encodes chunks together, as one text with the parting word between, and remembers each one's ids."""
        mark = _PART.encode()
        for c in (c for c in chunks if mark in c):
            self.known[c] = np.array(self._ids(c.decode()), "<u4").tobytes()
        chunks = [c for c in chunks if mark not in c]
        if not chunks:
            return
        ids = np.array(self._ids((b" " + mark + b" ").join([*chunks, b""]).decode()), "<u4")
        n = len(self.part)
        at = np.flatnonzero(np.logical_and.reduce([ids[k : len(ids) - n + 1 + k] == self.part[k] for k in range(n)])).tolist()
        whole, start = ids.tobytes(), 0
        for c, end in zip(chunks, at, strict=True):
            self.known[c] = whole[4 * start : 4 * end]
            start = end + n

    def encode(self, texts: list[str]) -> list[bytes]:
        chunks = [t.encode().split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        new = set().union(*chunks).difference(self.known)
        if self.before:
            old = new.intersection(self.before)
            self.known.update((c, self.before[c]) for c in old)
            new -= old
        new = self.learn_plain(list(new))
        for at in range(0, len(new), 1024):
            self.learn(new[at : at + 1024])
        get = self.known.__getitem__
        return [b"".join(map(get, cs)) for cs in chunks]


_IDS: dict[str, Ids] = {}


def _pieces_of(path: str, capacity: int, end_id: int):
    end, step = struct.pack("<I", end_id), 4 * capacity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = _IDS.get(path) or _IDS.setdefault(path, Ids(path))
        for df in batches:
            rows: list[tuple] = []
            docs, texts = df["doc_id"].tolist(), [t or "" for t in df["text"]]
            for lo in range(0, len(texts), 512):
                for k, code in enumerate(ids.encode(texts[lo : lo + 512]), lo):
                    code += end
                    for piece, at in enumerate(range(0, len(code), step)):
                        part = code[at : at + step]
                        rows.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            k, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            whole = df["doc_id"].astype("Int64") if not df["doc_id"].isna().any() else pd.Series([None if pd.isna(x) else int(x) for x in docs], dtype="Int64")
            yield pd.DataFrame({"doc_id": whole.to_numpy()[k] if len(k) else pd.Series([], dtype="Int64"), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc})

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    return docs.select("doc_id", "text").mapInPandas(_pieces_of(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: pieces in falling size, each into the fullest bin with room."""
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # bins by free space
    some, bins = 0, []  # bit r of some: a bin with r free
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, b = capacity, []
            bins.append(b)
        b.append(k)
        room[r - size].append(b)
        some |= 1 << (r - size)
    return bins


def _exchange(poor: list[int], rich: list[int], free: int) -> tuple[list[int], list[int]] | None:
    """Sizes to give from poor and to take back from rich, so that rich gains most within free: two for one, one for one, or a move."""
    best, found = 0, None
    give = sorted(poor)
    for back in [0, *set(rich)]:
        k = bisect_right(give, back + free) - 1
        if k >= 0 and give[k] - back > best:
            best, found = give[k] - back, ([give[k]], [back] if back else [])
        i, j = 0, len(give) - 1
        while back and i < j:
            gain = give[i] + give[j] - back
            if gain > free:
                j -= 1
            else:
                if gain > best:
                    best, found = gain, ([give[i], give[j]], [back])
                i += 1
        if best == free:
            break
    return found


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int, patience: int | None = PATIENCE) -> list[list[int]]:
    """bins with no more of them, after exchanges that each raise the sum of squared fills.

    The emptiest bin gives to fuller ones until none gains; then the next one. It ends at the
    lower bound, or when patience bins in a row (None: all underfull ones) gave nothing.
    As each exchange raises the sum, it ends in any case.
    """
    least = -(-int(sizes.sum()) // capacity)
    fill = [int(sizes[b].sum()) for b in bins]
    tried = 0
    while len(bins) > least:
        order = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=fill.__getitem__)
        if tried >= len(order) - 1 or patience is not None and tried >= patience:
            break
        d, gained = order[tried], False
        for r in reversed(order[tried + 1 :]):
            change = _exchange([int(sizes[k]) for k in bins[d]], [int(sizes[k]) for k in bins[r]], capacity - fill[r])
            if change is None:
                continue
            for source, target, what in ((d, r, change[0]), (r, d, change[1])):
                for size in what:
                    k = next(k for k in bins[source] if sizes[k] == size)
                    bins[source].remove(k)
                    bins[target].append(k)
            gain = sum(change[0]) - sum(change[1])
            fill[r], fill[d], gained = fill[r] + gain, fill[d] - gain, True
            if not bins[d]:
                break
        if not bins[d]:
            del bins[d], fill[d]
        tried = 0 if gained else tried + 1
    return bins


def _packed(capacity: int, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        frames = [df for df in batches if len(df)]
        if not frames:
            return
        df = pd.concat(frames, ignore_index=True)
        sizes = df["length"].to_numpy()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        first = (level << 56) + (TaskContext.get().partitionId() << 28)
        order = np.array([k for b in bins for k in b])
        counts = np.array([len(b) for b in bins])
        fills = np.array([sizes[b].sum() for b in bins])
        ends = np.cumsum(sizes[order])
        begins = np.cumsum(fills) - fills
        out = df.iloc[order].reset_index(drop=True)
        out["sequence_id"] = first + np.repeat(np.arange(len(bins)), counts)
        out["offset"] = ends - sizes[order] - np.repeat(begins, counts)
        closed = fills >= CLOSED * capacity
        emptiest = np.argsort(fills, kind="stable")[: max(1, int(OPEN * len(fills)))]
        closed |= ~np.isin(np.arange(len(fills)), emptiest)
        out["closed"] = np.repeat(closed, counts)
        yield out

    return run


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (rows of pieces) with sequence_id and offset."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean"
    names = [*NAMES, "sequence_id", "offset"]
    rest, level, done = cut(found.select(*NAMES)), 1, []
    n = rest.count()
    while True:
        groups = -(-n // GROUP)
        dealt = cut(rest.repartition(max(1, groups)).mapInPandas(_packed(capacity, level), schema))
        if groups <= 1:
            done.append(dealt.select(*names))
            break
        left = dealt.filter("NOT closed")
        more = left.count()
        done.append(dealt.filter("closed").select(*names))
        if not more:
            break
        rest, n, level = left.select(*NAMES), more, level + 1
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out
