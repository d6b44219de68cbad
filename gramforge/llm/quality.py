"""Quality rules: a rule bitmask ledger.

Every rule is evaluated once for each document. The ledger holds the measurements
and one failure bit per rule; policies are masks over these bits, so a new policy
version, or the ablation of a rule, is bit arithmetic on the ledger and reads no
text. Only built-in functions run, within one projection and without a shuffle.

Defined cases: a null text counts as empty; an empty or blank text has no words
and fails ``few_words``; rows that repeat are judged each for itself; a null
doc_id is passed through; other columns of the input are ignored by ``measure``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, carried, let, restored, word_array

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Rules by bit; each takes the measurements and is true where a document fails.
RULES = {
    "few_words": lambda: F.col("n_words") < 20,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
    "many_symbols": lambda: 100 * F.col("n_symbols") > 25 * F.col("n_words"),
    "repeated_lines": lambda: 2 * F.col("n_dup_lines") > F.col("n_lines"),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 15 * F.col("n_words"),
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    """Versioned choice of the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...] = field(default=tuple(RULES))

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE_POLICY = Policy("base", ("few_words", "repeated_words"))
DEFAULT_POLICY = Policy("2")


def _repeated_words(words: Column) -> Column:
    """Number of words in 8-word windows that occur twice or more in the text."""

    def covered(names: Column) -> Column:
        order = F.array_sort(F.transform(names, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))
        twice = let(
            order,
            lambda o: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(o, lambda x, k: F.struct(x.alias("x"), F.get(o, k - 1)["s"].alias("p"), F.get(o, k + 1)["s"].alias("n"))),
                        lambda x: (x["x"]["s"] == x["p"]) | (x["x"]["s"] == x["n"]),
                    ),
                    lambda x: x["x"]["i"],
                )
            ),
        )
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"))
        return F.aggregate(twice, start, step, lambda a: a["n"])

    # element by element: slice() would copy the whole array for each window
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    window = lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    hashes = F.transform(starts, lambda i: F.xxhash64(*window(i)))
    texts = F.transform(starts, lambda i: F.concat_ws(" ", *window(i)))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= WINDOW, 0).when(~some, 0).otherwise(covered(texts)).cast("long")


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns named in keep, and the measurements that the rules use.

    The columns kept must not be named like measurements; ``carried`` puts any others out of the way.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counted = let(word_array(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    length = lambda chars: F.length(F.translate(text, chars, "")).cast("long")
    return docs.select(
        "doc_id", *(k for k in keep if k != "doc_id"), counted.alias("_w"), by_line.alias("_l"), length(SPACES).alias("word_chars"), (F.length(text) - length(SYMBOLS)).cast("long").alias("n_symbols")
    ).select("doc_id", *(k for k in keep if k != "doc_id"), "_w.n_words", "word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")


def ledger(measured: DataFrame) -> DataFrame:
    """The measurements and fail_bits: bit k is set where rule k fails."""
    bits = None
    for name, rule in RULES.items():
        bit = F.when(rule(), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured.withColumn("fail_bits", bits)


def apply_policies(book: DataFrame, *policies: Policy) -> DataFrame:
    """A boolean column kept_<version> for each policy; the ledger's columns stay."""
    return book.withColumns({f"kept_{p.version}": F.col("fail_bits").bitwiseAND(F.lit(p.mask)) == 0 for p in policies})


def ablations(book: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: rule, failed (documents), only (rejected by it alone), kept_without (kept if it is dropped).

    The ledger is first counted by its bits, so at most 2**rules rows are shuffled
    from a task. An empty ledger gives a zero row for each rule.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    counts = book.groupBy(masked.alias("bits")).count()
    failed = lambda r: F.sum(F.when(F.col("bits").bitwiseAND(F.lit(BIT[r])) != 0, F.col("count"))).alias(f"f_{r}")
    only = lambda r: F.sum(F.when(F.col("bits") == BIT[r], F.col("count"))).alias(f"o_{r}")
    totals = counts.agg(F.sum(F.when(F.col("bits") == 0, F.col("count"))).alias("kept"), *map(failed, policy.rules), *map(only, policy.rules))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return totals.select(
        F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), n(f"f_{r}").alias("failed"), n(f"o_{r}").alias("only"), (n("kept") + n(f"o_{r}")).alias("kept_without")) for r in policy.rules))).alias("r")
    ).select("r.*")


def quality(docs: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """One row per document: measurements, base_failed, kept and the ledger's bits."""
    book = apply_policies(ledger(measure(docs)), policy)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        ((F.col("fail_bits").bitwiseAND(F.lit(BASE)) == 0) & F.col(f"kept_{policy.version}")).alias("kept"),
        "n_lines", "fail_bits",
    )


def keep_good(docs: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The documents that a policy and the base rules keep, with their own columns."""
    book = apply_policies(ledger(measure(carried(docs, "doc_id", "text"), "_doc")), policy)
    return restored(book.filter(F.col(f"kept_{policy.version}") & (F.col("fail_bits").bitwiseAND(F.lit(BASE)) == 0)), docs.columns)


QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws,
             list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM t),
n AS (SELECT doc_id, x, ws, ls, CASE WHEN len(ws) < 8 THEN [] ELSE list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS s, generate_subscripts(g, 1) AS i FROM n),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM e) WHERE c > 1),
p AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS m FROM d),
r AS (SELECT doc_id, sum(m) AS m FROM p GROUP BY doc_id),
m AS (SELECT n.doc_id, len(ws) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(r.m, 0) AS BIGINT) AS n_repeat_words
      FROM n LEFT JOIN r ON n.doc_id = r.doc_id),
b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 25 * n_words)::INT
      + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM b
"""
