import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from gramforge.llm import suffix_dedup, suffixes


def brute(strings, least):
    c = Counter(tuple(s[i : i + least]) for s in strings for i in range(len(s) - least + 1))
    return [np.array([c[tuple(s[i : i + least])] > 1 for i in range(len(s) - least + 1)], bool) for s in strings]


def test_interval_expansion():
    r = random.Random(0)
    for k in range(200):
        least, alphabet = r.choice([1, 2, 3, 5, 9, 20]), r.choice([b"a", b"ab", b"abc\x00\xff"])
        strings = [bytes(r.choice(alphabet) for _ in range(r.choice([0, 1, least, least + 1, 30, 60]))) for _ in range(r.randint(0, 8))]
        if strings:
            s = r.choice(strings)
            strings += [b"zz" + s, s[1:] + b"q"]
        asked = strings if k % 2 else [np.frombuffer(s, np.uint8).astype(np.uint64) << np.uint64(50) for s in strings]
        got = suffixes.repeated(asked, least)
        assert all(np.array_equal(a, b) for (a, _), b in zip(got, brute(strings, least), strict=True))
        kinds = [tuple(s[i : i + least]) for s in strings for i in range(len(s) - least + 1)]
        first = np.concatenate([np.zeros(0, bool), *(f for _, f in got)])
        assert Counter(k for k, f in zip(kinds, first) if f) == {k: 1 for k in kinds}


def covered(symbols, least):
    out = []
    for s, mask in zip(symbols, brute(symbols, least)):
        cover = np.zeros(len(s) + 1, np.int64)
        at = np.flatnonzero(mask)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + least, -1)
        out.append(np.cumsum(cover)[: len(s)] > 0)
    return out


def expected(rows, least, words):
    data = [(t or "").encode() for _, t in rows]
    told = covered([re.findall(rb"[^\x20\x09-\x0D]+", b) for b in data], words)
    out = []
    for (d, _), b, gone, passage in zip(rows, data, covered(data, least), told):
        spans = int(gone[0]) + int((np.diff(gone.astype(int)) == 1).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest(), int(passage.sum())))
    return sorted(out, key=repr)


def reported(df, *units, **how):
    return sorted((tuple(r) for r in suffix_dedup.report(df, *units, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"limit": 3000}])
def test_report_equals_brute_force(cases, how):
    assert reported(cases, **how) == expected([(r.doc_id, r.text) for r in cases.collect()], 400, 50)


def test_short_strings_with_many_anchors(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 400))) for _ in range(30)]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(0, 90))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least, anchors, words in ((12, (4, 8), (6, (2,))), (9, (), (8, ()))):
        units = suffix_dedup.byte_unit(least, anchors), suffix_dedup.word_unit(*words)
        assert reported(df, *units, limit=500) == expected(list(enumerate(texts)), least, words[0])


def test_one_passage_in_thousands_of_documents(spark, monkeypatch):
    """Its groups exceed the limit, pass through blocks and levels, and are spread over tasks."""
    from common_cases import passage

    monkeypatch.setattr(suffix_dedup.met, "__defaults__", ("inner", 100))
    monkeypatch.setattr(suffix_dedup.met, "__kwdefaults__", None)
    r = random.Random(9)
    shared, word = passage(1, 80), lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = [" ".join([*(word() for _ in range(r.randint(0, 60))), shared, *(word() for _ in range(r.randint(0, 60)))]) for _ in range(2000)]
    texts += texts[:300] + [passage(50 + k, 70) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert reported(df, limit=20_000) == expected(list(enumerate(texts)), 400, 50)


def test_empty_table_and_remove(cases):
    assert suffix_dedup.report(cases.limit(0)).count() == 0
    for units, lost in (((suffix_dedup.BYTES,), {6, 7, 8, 10, 11}), ((suffix_dedup.BYTES, suffix_dedup.WORDS), {6, 7, 8, 10, 11, 40})):
        kept = suffix_dedup.remove(cases, units)
        assert kept.columns == cases.columns
        gone = {r.doc_id for r in cases.collect() if r.text and r.text.strip()} - {r.doc_id for r in kept.collect()}
        assert lost == gone if len(units) == 1 else lost < gone
        texts = [r.text for r in kept.collect()]
        if len(units) == 2:
            assert not any(m.any() for m in covered([(t or "").split() for t in texts if t and "x" * 50 not in t], 100)), "no 100 words repeat"
