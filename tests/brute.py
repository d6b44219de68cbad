"""Plain Python definitions that the operators are held against."""

from collections import Counter


def grams(s, q):
    return Counter(s[i : i + q] for i in range(len(s) - q + 1))


def jaccard(a, b, q):
    x, y = grams(a, q), grams(b, q)
    o = sum((x & y).values())
    n = sum(x.values()) + sum(y.values()) - o
    return o / n if n else 0.0


def ed(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def extract_ed(doc, entity, tau):
    return {(p, n, ed(doc[p : p + n], entity)) for p in range(len(doc)) for n in range(1, len(doc) - p + 1) if abs(n - len(entity)) <= tau and ed(doc[p : p + n], entity) <= tau}


def extract_jaccard(doc, entity, q, theta):
    if len(entity) < q:
        return set()
    return {(p, n) for p in range(len(doc)) for n in range(q, len(doc) - p + 1) if jaccard(doc[p : p + n], entity, q) >= theta}
