"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text; its failure is one bit of `fail_bits` and its measurements stay as columns.
A policy is a version with a mask of the bits that reject, so that a policy is applied, replaced or taken apart (what
would each rule alone cost?) by bitwise operations over the ledger, without reading a text again. DataFrame functions
only: no Python runs on the executors, and nothing is shuffled but the few distinct bit patterns of the ablation.

Defined results: a null text counts as empty; an empty text has no words and so fails `few_words`; texts of any length
are measured whole; equal rows give equal rows; an empty table gives an empty ledger. Only the named text column is
read, and measurement columns are appended with `prefix`, so columns of the input that clash are named apart by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalane.llm.common import WS

WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Bit by bit: name and failure condition over the measurements. Append only; a bit never changes its meaning.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "100 * n_symbols > 30 * word_chars"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
    ("short_words", "10 * word_chars < 15 * n_words"),
    ("many_words", "n_words > 100000"),
)
BASE = ("few_words", "repeated_windows")


def bits(*names: str) -> int:
    """The mask of some rules."""
    order = [name for name, _ in RULES]
    return sum(1 << order.index(name) for name in names)


#: Versions are kept, so that an earlier run's verdicts can be had again from its ledger.
POLICIES = {
    "v1": bits(*BASE),
    "v2": bits(*BASE, "symbol_heavy", "duplicate_lines", "long_words", "short_words"),
}
CURRENT = "v2"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda variable is never inlined, as a column of an earlier select is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(h: Column) -> Column:
    """Words covered by windows whose hash in h occurs twice or more; sorting runs only for texts with such windows."""

    def places(s: Column) -> Column:
        same = lambda e, k: F.coalesce(e["x"] == F.get(s, k)["x"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(_let(by_hash, places), covered)).otherwise(F.lit(0))


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the measurements of each whole text; see RULES for what is made of them.

    Equal 8-word windows are found by 64-bit hashes of their words, compared within one text only.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))
    count = lambda w: F.size(w) - (WINDOW - 1)
    hashes = lambda w: F.when(count(w) > 1, F.transform(F.sequence(F.lit(1), count(w)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    by_word = _let(words, lambda w: F.struct(F.size(w).alias("n"), _let(hashes(w), _repeat_words).alias("r")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    by_line = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    values = {
        "n_words": F.col("__q_words.n"),
        "word_chars": F.length(F.regexp_replace(t, WS, "")),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, "")),
        "n_lines": F.col("__q_lines.n"),
        "n_dup_lines": F.col("__q_lines.d"),
        "n_repeat_words": F.col("__q_words.r"),
    }
    out = docs.withColumns({"__q_words": by_word, "__q_lines": by_line})
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(v.cast("long").alias(prefix + k) for k, v in values.items()))


def ledger(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with measurements and `fail_bits`, in which bit k is the failure of RULES[k]."""
    out = measured(docs, text, prefix)
    failed = reduce(lambda a, b: a.bitwiseOR(b), (F.when(_over(rule, prefix), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)))
    return out.withColumn(f"{prefix}fail_bits", failed.cast("long"))


def _over(rule: str, prefix: str) -> Column:
    words = {m: f"`{prefix}{m}`" for m in MEASURES}
    return F.expr(" ".join(words.get(x, x) for x in rule.split(" ")))


def rejects(policy: str = CURRENT, prefix: str = "") -> Column:
    """Whether a policy version rejects a ledger row."""
    return F.col(f"{prefix}fail_bits").bitwiseAND(F.lit(POLICIES[policy])) != 0


def ablation(rows: DataFrame, policy: str = CURRENT, prefix: str = "") -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it rejects, rows rejected and kept without it.

    Rows are first counted by bit pattern (2^rules at most, summed map-side), so no more than that is ever regrouped.
    """
    mask = POLICIES[policy]
    names = [(k, name) for k, (name, _) in enumerate(RULES) if mask >> k & 1]
    patterns = rows.groupBy((F.col(f"{prefix}fail_bits").bitwiseAND(F.lit(mask))).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in names)))
    long = patterns.select("bits", "n", rule.alias("r")).select("bits", "n", "r.*")
    n = F.col("n")
    return long.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), n).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) != 0, n).otherwise(0)).alias("n_rejected_without"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, n).otherwise(0)).alias("n_kept_without"),
    )


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The digest of the ledger: measurements, base rules and the policy's verdict for each document."""
    rows = ledger(docs.select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(bits(*BASE))) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~rejects(policy)).alias("kept"), "n_lines", "fail_bits",
    )


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with their own columns only."""
    return ledger(docs, prefix="__ledger_").where(~rejects(policy, "__ledger_")).select(*(f"`{c}`" for c in docs.columns))


#: DuckDB's own evaluation, in which windows are compared as texts.
SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT rn, doc_id, x,
             list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws,
             list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM t),
sh AS (SELECT rn, u.i AS p, array_to_string(ws[u.i:u.i + 7], ' ') AS v FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
rep AS (SELECT rn, p FROM (SELECT rn, p, count(*) OVER (PARTITION BY rn, v) AS c FROM sh) WHERE c > 1),
cov AS (SELECT rn, count(DISTINCT p + r.k) AS n FROM rep, range(0, 8) AS r(k) GROUP BY rn),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (rn)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
             CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 30 * word_chars)::INT
             + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines)::INT + 16 * (word_chars > 40 * n_words)::INT
             + 32 * (10 * word_chars < 15 * n_words)::INT + 64 * (n_words > 100000)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (fail_bits & 63) = 0 AS kept, n_lines, fail_bits FROM f
"""
