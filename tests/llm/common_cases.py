"""A small documents table with the cases that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, h long, v string, hot string, bytes string, start string"


def passage(seed, words=90):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 9))) for _ in range(words))


def rows():
    r = random.Random(5)
    shared = passage(1)
    texts = [None, "", "   \n\t ", "one", "One  two", "one two three four five six", passage(2), passage(2), shared + " " + passage(3), passage(4) + "\n" + shared, "漢字" * 300, "x" * 2500, passage(6, 9000)]
    near = passage(7, 300).split()
    for k in range(12):
        copy = list(near)
        copy[k * 20] = "changed"
        texts.append(" ".join(copy))
    texts += [passage(100 + k, r.randint(20, 200)) for k in range(15)] + ["a\nb\na\nb\n" * 30, "$# " * 40, "na na " * 60]
    out = [(k, t, "en", [None, "s0", "s1", "s1", "s1", "é"][k % 6], None, "x", "y", 1, "z", "w", "b", "s") for k, t in enumerate(texts)]
    # a null id, repeated rows, one id with two texts
    out += [(None, passage(2), None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None), out[8], out[8], out[1], (20, passage(55), "en", "s1", 3, None, None, None, None, None, None, None)]
    return out


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)
