"""Byte-pair ids of many words at once, in numpy.

Words of one length form a matrix of symbols. From the longest length down, the
pair with the least rank in each row (the leftmost of equals) is merged, after which the
row has one symbol fewer and joins the matrix of the next length; rows without
a merge are done. So a word takes part in one step per merge and no step is per word.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(1 << 30)
_SLOTS = 20  # bits of a slot number
_MIX = np.uint32(0x9E3779B1)

#: The byte-level alphabet's own characters; other bytes become characters from 256 on, in order.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _alphabet() -> list[str]:
    own, others = set(_OWN), iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordPieces:
    """Merges of a byte-level BPE vocabulary with an ending for words."""

    def __init__(self, vocab: dict[str, int], merges: list, ending: str):
        letters = _alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.uint32)
        self.final = np.array([vocab[c + ending] for c in letters], np.uint32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.keys = np.zeros((1 << _SLOTS) + 256, np.uint32)
        self.ranks = np.full(len(self.keys), _NONE, np.int32)
        for k, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.ranks[slot] != _NONE and self.keys[slot] != key:
                slot += 1
            self.keys[slot], self.ranks[slot] = key, k

    @classmethod
    def of(cls, path: str) -> WordPieces | None:
        """The merges of a tokenizer's file; None if its words are not split and merged in the way known here."""
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        m = d["model"]
        plain = m["type"] == "BPE" and not m.get("dropout") and not m.get("ignore_merges") and not m.get("continuing_subword_prefix") and bool(m.get("end_of_word_suffix")) and len(m["vocab"]) <= 1 << 16
        norm = [(n["type"], n.get("pattern")) for n in (d.get("normalizer") or {}).get("normalizers", [])]
        pre = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
        # The normalizers and the pattern that parts words
        known = norm == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)] and [p["type"] for p in pre] == ["Split", "ByteLevel"]
        known = known and pre[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"} and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
        return cls(m["vocab"], m["merges"], m["end_of_word_suffix"]) if plain and known else None

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> np.uint32(32 - _SLOTS)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE where no merge is known."""
        keys = (a << np.uint32(16) | b).ravel()
        slot = self._slot(keys)
        out = self.ranks[slot]
        other = np.flatnonzero((self.keys[slot] != keys) & (out != _NONE))
        while len(other):
            slot[other] += np.uint32(1)
            at = slot[other]
            out[other] = self.ranks[at]
            other = other[(self.keys[at] != keys[other]) & (out[other] != _NONE)]
        return out.reshape(a.shape)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word; words are not empty."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        by = np.argsort(size, kind="stable")
        ordered = size[by]
        rows, ranks, owner = np.zeros((0, 0), np.uint32), np.zeros((0, 0), np.int32), np.zeros(0, np.int64)
        for n in range(int(size.max(initial=0)), 0, -1):
            new = by[np.searchsorted(ordered, n) : np.searchsorted(ordered, n, "right")]
            if len(new):
                data = flat[begin[new][:, None] + np.arange(n)]
                fresh = self.inner[data]
                fresh[:, -1] = self.final[data[:, -1]]
                found = self.rank(fresh[:, :-1], fresh[:, 1:])
                rows, ranks, owner = (np.concatenate([x, y]) if len(owner) else y for x, y in ((rows, fresh), (ranks, found), (owner, new)))
            if not len(owner):
                continue
            if n == 1:
                done = np.ones(len(owner), bool)
            else:
                at = ranks.argmin(1)
                low = ranks[np.arange(len(at)), at]
                done = low == _NONE
            code = rows[done].astype("<u4").tobytes()
            for k, w in enumerate(owner[done].tolist()):
                out[w] = code[4 * n * k : 4 * n * (k + 1)]
            if n == 1:
                break
            go = np.flatnonzero(~done)
            rows, ranks, owner, at, low = rows[go], ranks[go], owner[go], at[go], low[go]
            line, col = np.arange(len(go)), np.arange(n - 1)
            rows = np.where(col > at[:, None], rows[:, 1:], rows[:, :-1])
            rows[line, at] = self.made[low]
            ranks = np.where(col[:-1] > at[:, None], ranks[:, 1:], ranks[:, :-1])
            left, right = line[at > 0], line[at < n - 2]
            ranks[left, at[left] - 1] = self.rank(rows[left, at[left] - 1], rows[left, at[left]])
            ranks[right, at[right]] = self.rank(rows[right, at[right]], rows[right, at[right] + 1])
        return out
