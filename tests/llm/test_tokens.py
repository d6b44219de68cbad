import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gramforge.llm import packing, tokencount
from gramforge.llm.queries import tokenizer

SENTENCES, WORDS = tokenizer("piece_bpe_32k.model"), tokenizer("word_bpe_49k.json")


def odd_texts(n, seed, parts):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.choice([0, 1, 2, 5, 40, 3000]))) for _ in range(n)]


def test_counts_equal_the_library(spark, cases):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=SENTENCES)
    texts = odd_texts(150, 1, list("aab  cdé▁ \n\tth123.,<0>🙂漢字ﷺşх\x00") + ["<s>", "</s>", "<unk>", "▁the", "ing"])
    texts += ["a" * 7000 + " b", " " * 5000, "漢" * 5000, "x" * 4097 + " " * 4097, ""]
    assert tokencount.count_tokens(texts, SENTENCES) == [len(x) for x in model.encode(texts)]
    out = tokencount.token_counts(cases, SENTENCES).collect()
    want = [((t or ""), d) for d, t in ((r.doc_id, r.text) for r in cases.collect())]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out), key=repr) == sorted(((d, len(t.encode()), n, n > 4096) for (t, d), n in zip(want, map(len, model.encode([t for t, _ in want])))), key=repr)
    assert tokencount.token_counts(cases.limit(0), SENTENCES).count() == 0


def test_starting_anew_changes_nothing(monkeypatch):
    texts = odd_texts(20, 2, list("abc de"))
    monkeypatch.setattr(tokencount, "MAX_STATES", 5)
    monkeypatch.setattr(tokencount, "BATCH", 200)
    monkeypatch.setattr(tokencount, "CHUNK", 7)
    monkeypatch.setattr(tokencount, "_MADE", {})
    small = tokencount.count_tokens(texts, SENTENCES)
    monkeypatch.undo()
    assert small == tokencount.count_tokens(texts, SENTENCES)


@pytest.mark.parametrize("kind", ["letters", "one letter", "far", "syllables"])
def test_prefix_scan_takes_logarithmic_rounds(kind):
    """A million characters without a blank: no chunk but the first has a constant map."""
    import sentencepiece

    r = random.Random(7)
    text = {"letters": lambda: "".join(r.choices("etaoinshrdlu", k=1_000_000)), "one letter": lambda: "a" * 1_000_000, "far": lambda: "漢" * 500_000 + "ab" * 250_000, "syllables": lambda: "".join(r.choices(["the", "ing", "tion", "=", "aa", "é"], k=350_000))}[kind]()
    made = tokencount.Transducer(SENTENCES)
    got = made.count([text, "a b", text[:5000] + " " + text[:9000]]).tolist()
    model = sentencepiece.SentencePieceProcessor(model_file=SENTENCES)
    assert got == [len(x) for x in model.encode([text, "a b", text[:5000] + " " + text[:9000]])]
    chunks = len(text) // tokencount.CHUNK + 8
    assert 1 <= made.rounds <= 2 * chunks.bit_length()


def test_scan_finds_states_that_were_not_foreseen(monkeypatch):
    monkeypatch.setattr(tokencount, "CHUNK", 7)
    monkeypatch.setattr(tokencount, "WALKS", 1)
    monkeypatch.setattr(tokencount, "WARM", 0)
    texts = odd_texts(30, 12, list("etaoinaaa")) + ["a" * 700, "tion" * 200]
    monkeypatch.setattr(tokencount, "_MADE", {})
    small = tokencount.count_tokens(texts, SENTENCES)
    monkeypatch.undo()
    assert small == tokencount.count_tokens(texts, SENTENCES)


def whole_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]


def test_remembered_ids_equal_the_library():
    texts = odd_texts(300, 3, ["a", "B", " ", "\n", "́", "é", "Σ", "İ", "'s", "'", "<|startoftext|>", "<|", "1", "漢", "　", "\x1f", "\xa0", "🙂", "..", "ß", "\x0b", "re"])
    assert packing.Ids(WORDS).encode(texts) == [struct.pack(f"<{len(x) - 1}I", *x[:-1]) for x in whole_ids(texts)]


def test_packing(spark, cases, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    out = packing.pack(packing.pieces(cases, WORDS)).collect()
    want = []
    docs = [(r.doc_id, r.text or "") for r in cases.collect()]
    for (d, _), ids in zip(docs, whole_ids([t for _, t in docs])):
        want += [(d, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) <= -(-sum(x[3] for x in want) // 4096) + 1
    assert packing.pack(packing.pieces(cases.limit(0), WORDS)).count() == 0


@pytest.mark.parametrize("sizes", [[1200, 1300, 1400] * 300, [4096, 1, 1], [2049] * 9, list(range(1, 900))])
def test_local_search_keeps_pieces_and_bins(sizes):
    s = np.array(sizes)
    first = packing.best_fit(s, 4096)
    n = len(first)
    bins = packing.local_search(first, s, 4096)
    assert sorted(k for b in bins for k in b) == list(range(len(s))) and max(s[b].sum() for b in bins) <= 4096
    assert -(-s.sum() // 4096) <= len(bins) <= n


def test_local_search_empties_bins_that_best_fit_needs():
    """Sizes of which three fill a bin exactly: best fit alone wastes more than a tenth."""
    rng, sizes = np.random.default_rng(3), []
    for _ in range(100):
        a = int(rng.integers(1025, 1365))
        b = int(rng.integers(1025, (4096 - a) // 2))
        sizes += [a, b, 4096 - a - b]
    s = np.array(sizes)
    first = packing.best_fit(s, 4096)
    n = len(first)
    for patience in (packing.PATIENCE, None):
        bins = packing.local_search([list(b) for b in first], s, 4096, patience)
        assert n >= 110 and len(bins) <= 106
        assert sorted(k for b in bins for k in b) == list(range(len(s))) and max(s[b].sum() for b in bins) <= 4096
    # from bins as the pieces come
    bins = packing.local_search([[k] for k in range(len(s))], s, 4096)
    assert len(bins) <= 110


@pytest.mark.parametrize("few", [0.25, 0.5])
def test_leftovers_of_groups_that_pack_badly_are_dealt_again(spark, monkeypatch, few):
    monkeypatch.setattr(packing, "GROUP", 50)
    monkeypatch.setattr(packing, "OPEN", few)
    rows = spark.range(400).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "2100L + id % 7 AS length", "0L AS ids_crc32")
    out = packing.pack(rows).collect()
    assert len({r.sequence_id for r in out}) == len(out) == 400 and all(r.offset == 0 for r in out)


def test_exchanges_raise_squared_fill():
    sizes = np.array([3000, 1000, 2000, 1900, 196, 296, 1900, 1900])
    bins = [[0, 4], [2, 3], [1, 5], [6, 7]]
    before = sum(int(sizes[b].sum()) ** 2 for b in bins)
    after = packing.local_search(bins, sizes, 4096)
    assert sum(int(sizes[b].sum()) ** 2 for b in after) > before


def test_words_merged_together_equal_the_library(monkeypatch):
    rng = np.random.default_rng(5)
    letters = list("aaabbthe'stdÉéßÿþµªº<|>startof.,!!_#12٣ŒİǅΣςá 　​中x" + "   eeeeetttoooo")
    texts = ["".join(rng.choice(letters, rng.integers(0, 200))) for _ in range(1500)]
    texts += ["<|endoftext|>a", "a<|startoftext|> b", "A" * 5000, "ÀÉ" * 30, "a" * 48, "!" * 90, "É" * 24, "É" * 25 + ".", "it's 'tis", "", " \x85\x1c "]
    monkeypatch.setattr(packing, "REMEMBERED", 1000)
    ids = packing.Ids(WORDS)
    assert ids.words is not None
    got = sum((ids.encode(texts[k : k + 100]) for k in range(0, len(texts), 100)), [])
    assert got == [np.array(x[:-1], "<u4").tobytes() for x in whole_ids(texts)]  # without the closing id
    assert ids.words.encode([]) == []
