"""Quality rules as a bitmask ledger, in native expressions only.

``write_ledger`` evaluates every rule once per document and stores the measurements and one failure bit
per rule. Policies are versioned bit masks applied to the stored ledger afterwards, and ablations are
bitwise aggregations of it, so neither reads a text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_DELIMITERS, fresh_path, table

WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, width: int = WINDOW_WORDS) -> Column:
    """Words that lie in a window of ``width`` words found twice or more, its first place included.

    The hash of a window is made of those of its halves, so ``width`` is a power of two. Where all hashes of a text differ,
    which is the common case, nothing else is worked out; else they are sorted with their places, and
    the places of repeats are merged. All of it is n log n in the words of one text.
    """
    if width & (width - 1) or width < 2:
        raise ValueError("the width of a window is a power of two")

    def doubled(h: Column, step: int) -> Column:
        n = F.size(h) - step
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))

    def in_hashes(h: Column, step: int) -> Column:
        if step == width:
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeats(h))
        return _let(doubled(h, step), lambda x: in_hashes(x, 2 * step))

    def repeats(h: Column) -> Column:
        return _let(F.sort_array(F.transform(h, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), in_windows)

    def in_windows(s: Column) -> Column:
        def again(x: Column, at: Column) -> Column:
            w = x["w"]
            return F.coalesce(w == F.get(s, at - 1)["w"], F.lit(False)) | F.coalesce(w == F.get(s, at + 1)["w"], F.lit(False))

        return _let(F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, at: F.least(F.lit(width), F.coalesce(F.get(p, at + 1) - x, F.lit(width))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.when(F.size(words) < width + 1, F.lit(0).cast("long")).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: in_hashes(h, 1)))


@dataclass(frozen=True)
class Rule:
    """A named rule; ``fails`` is an SQL predicate on the measurements and its place is its bit."""

    name: str
    fails: str


#: The order is the bit order; new rules are appended so that stored ledgers keep their meaning.
RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", "5 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("upper_case_words", "100 * n_upper_words > 60 * n_words"),
    Rule("word_length", "word_chars > 40 * n_words OR word_chars < 2 * n_words"),
)
BASE_RULES = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of which rules reject a document."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        return sum(1 << i for i, r in enumerate(rules) if r.name in self.rules)


POLICIES = {
    "base": Policy("base", BASE_RULES),
    "lines": Policy("lines", (*BASE_RULES, "duplicate_lines")),
    "v1": Policy("v1", tuple(r.name for r in RULES)),
}
PRODUCTION = POLICIES["v1"]

def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's rows: one per document with the measurements and ``fail_bits``.

    Null and empty texts have no words, so every measurement is 0. Rows are treated one by one:
    repeated rows, null ids and further columns change nothing. No rows give an empty ledger.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(
        F.col(id_col).alias("id"),
        text.alias("t"),
        F.array_remove(F.split(text, WORD_DELIMITERS), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
    )
    measured = words.select(
        F.col("id").alias(id_col),
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size(F.filter("w", lambda w: ~w.rlike("[a-z]") & w.rlike("[A-Z]"))).cast("long").alias("n_upper_words"),
    )
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def write_ledger(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Evaluates every rule once, writes the ledger to ``path`` as Parquet and returns it as read from there.

    Policies and ablations are then applied to what was written, in this session or a later one (:func:`read_ledger`).
    """
    measure(docs, id_col, text_col, rules).write.parquet(path)
    return read_ledger(docs.sparkSession, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def apply_policy(ledger: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``kept``: no rule of the policy fails. Only the bits are read, so any version can be applied to one ledger."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0)


def ablations(ledger: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule: documents failing it, failing it alone, and kept if the policy went without it.

    An empty ledger gives no rows. The ledger is first aggregated to the distinct bit patterns, of which there are at most
    2 ** rules, so the second step is independent of the corpus.
    """
    mask = policy.mask(rules)
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if mask >> i & 1]))
    rows = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    without = F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0
    zero = F.lit(0).cast("long")
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(zero)).alias("n_failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(zero)).alias("n_failing_alone"),
        F.sum(F.when(without, F.col("n")).otherwise(zero)).alias("n_kept_without"),
    )


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark, "ledger"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"].mask()).cast("long")) != 0
    judged = apply_policy(_stored(spark, sf_dir), PRODUCTION)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "n_lines", "n_upper_words", "fail_bits")


def query_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(_stored(spark, sf_dir), PRODUCTION)


_LEDGER_SQL = r"""
t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)
), g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g
), g3 AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS r FROM g2 WHERE c > 1
), g4 AS (SELECT doc_id, sum(r)::BIGINT AS n FROM g3 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(g4.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_upper_words
  FROM w LEFT JOIN g4 USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_upper_words > 60 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words OR word_chars < 2 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m
)
"""
SQL = f"""WITH {_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_upper_words, fail_bits FROM f
"""
ABLATIONS_SQL = f"""WITH {_LEDGER_SQL},
r AS (SELECT unnest(['too_few_words', 'repeated_windows', 'symbol_heavy', 'duplicate_lines', 'upper_case_words', 'word_length']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS bit)
SELECT rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS n_failing, count(*) FILTER (fail_bits = bit)::BIGINT AS n_failing_alone,
  count(*) FILTER (fail_bits & ~bit = 0)::BIGINT AS n_kept_without FROM f CROSS JOIN r GROUP BY rule
"""
