"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a sample; the cascade then runs the rules in the order of rejections
per cost, and a document stops at its first failed rule. A cost is work, not time: the characters and words of the
sample that the rule and those metrics have to go through which no rule before it has asked for, each at its UNIT.
So a metric is charged to the first rule that needs it, and reruns agree on the order and on each document's first
failed rule. A rule's rejections are those of documents which the rules before it let pass. The order never changes a
verdict, only what it costs. Everything is Spark SQL inside one scan: no shuffle.

Defined results: null text counts as empty; an empty text has no words and so fails `few_words`; repeated
rows and ids are judged row by row; an empty table gives an empty result. Only the id and text columns are
read, so that other columns can have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lets, rows_of, table, words_sql


def repeat_words_sql(w: str, n: int = 5) -> str:
    """Words of array w that lie in an n-word window which occurs at least twice.

    The windows' 64-bit hashes are sorted as longs that hold the hash's high bits and the position; neighbours
    count as equal if their full hashes are. So the work is n log n for a text of any length.
    """
    window = f"xxhash64({', '.join(f'h[i + {k}]' for k in range(n))})"
    same = "(shiftright(p, b) = shiftright({q}, b) and win[cast(p & mask as int)] = win[cast({q} & mask as int)])"
    return f"if(size({w}) <= {n}, 0L, " + lets(
        f"if(size(pos) = 0, 0L, aggregate(transform(pos, (p, k) -> if(k = size(pos) - 1, {n}L, least({n}L, pos[k + 1] - p))), 0L, (s, x) -> s + x))",
        ("h", f"transform({w}, x -> xxhash64(x))"),
        ("win", f"transform(sequence(0, size(h) - {n}), i -> {window})"),
        ("b", "cast(ceil(log2(size(win) + 1)) as int)"),
        ("mask", "shiftleft(1L, b) - 1"),
        ("packed", "sort_array(transform(win, (x, i) -> shiftleft(shiftright(x, b), b) | cast(i as bigint)))"),
        ("pos", "sort_array(transform(filter(packed, (p, k) -> (k > 0 and " + same.format(q="packed[k - 1]") + ") or (k < size(packed) - 1 and " + same.format(q="packed[k + 1]") + ")), p -> p & mask))"),
    ) + ")"


#: Metrics over `text` and the words `w`; the first ones are those that every row gets.
METRICS = {
    "n_words": "cast(size(w) as bigint)",
    "word_chars": "cast(length(array_join(w, '')) as bigint)",
    "n_symbols": "cast(regexp_count(text, '[#*$%&|<>]') as bigint)",
    "n_dup_lines": r"element_at(transform(array(filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')), a -> cast(size(a) - size(array_distinct(a)) as bigint)), 1)",
    "n_repeat_words": repeat_words_sql("w"),
}
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


#: What a metric or test goes through, as (units a character, units a word). A unit is about a nanosecond of one core,
#: as measured once, on one core over 25 million characters, and rounded; only the ratios matter.
UNITS = {
    "n_words": (0.0, 2.0), "word_chars": (7.0, 0.0), "n_symbols": (9.0, 0.0), "n_dup_lines": (8.0, 0.0), "n_repeat_words": (0.0, 770.0),
    "split": (3.0, 0.0), "cases": (0.0, 180.0), "letters": (0.0, 160.0), "ends": (0.0, 50.0),
}


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where `fails` (SQL over text, w and the metrics) is true. `work` names the UNITS of what
    it goes through itself, beside its metrics."""

    name: str
    fails: str
    work: tuple[str, ...] = ()

    @property
    def metrics(self) -> tuple[str, ...]:
        return tuple(m for m in METRICS if re.search(rf"\b{m}\b", self.fails))


#: The production rules. Limits are wide of what prose in any language shows.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", r"10 * n_dup_lines > 3 * greatest(1, size(split(text, '\n')))", ("split",)),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 18 * n_words"),
    Rule("shouting", "n_words > 0 and 2 * size(filter(w, x -> x = upper(x) and x <> lower(x))) > n_words", ("cases",)),
    Rule("not_words", "n_words > 0 and 10 * size(filter(w, x -> x rlike '\\\\p{L}')) < 7 * n_words", ("letters",)),
    Rule("exclaiming", "n_words > 0 and 5 * size(filter(w, x -> endswith(x, '!'))) > n_words", ("ends",)),
)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (null: empty), words w and the METRICS of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("doc_id", "text", F.expr(words_sql("text")).alias("w"))
    return base.select("doc_id", "text", "w", *(F.expr(e).alias(k) for k, e in METRICS.items()))


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, cost a document, share of the documents that reach it which it rejects) in the cascade's order, from a
    sample of about sample_rows documents, chosen by hash. The sample decides only the order of evaluation.

    Counts of the rules' verdicts on it, at most 2^rules rows and sample_rows, are all that reaches the driver.
    """
    n = rows_of(docs)
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # by the text as well, since ids may repeat; thresholds on the whole hash, so that no share is too small
    most = (1 << 63) - 1 if n <= sample_rows else int((1 << 64) * (sample_rows / n)) - (1 << 63)
    verdicts = measured(d.where(F.xxhash64(F.lit(5), "doc_id", "text") <= F.lit(most)))
    verdicts = verdicts.select(F.length("text").alias("chars"), "n_words", *(F.expr(f"coalesce({r.fails}, false)").alias(f"r{k}") for k, r in enumerate(rules)))
    seen = verdicts.groupBy(*(f"r{k}" for k in range(len(rules)))).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("n_words").alias("words")).collect()
    out, paid, left = [], set(), list(range(len(rules)))
    while left:
        ranked = []
        for k in left:
            needs = [*(m for m in rules[k].metrics if m not in paid), *rules[k].work]
            rows = sum(r["n"] for r in seen)
            cost = sum(UNITS[x][0] * r["chars"] + UNITS[x][1] * r["words"] for x in needs for r in seen) / max(rows, 1) + 1
            gone = sum(r["n"] for r in seen if r[f"r{k}"]) / max(rows, 1)
            ranked.append((-gone / cost, cost if not gone else 0, rules[k].name, k, cost, gone))
        *_, k, cost, gone = min(ranked)
        out.append((rules[k], cost, gone))
        paid |= set(rules[k].metrics)
        seen = [r for r in seen if not r[f"r{k}"]]
        left.remove(k)
    return out


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """Returns doc_id, the METRICS, base_failed, kept and first_failed (the rule that stopped the document, in the
    cascade's order; null if kept)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chain = F.lit(None).cast("string")
    for rule, _, _ in reversed(ordered(docs, rules, sample_rows)):
        chain = F.when(F.expr(rule.fails), F.lit(rule.name)).otherwise(chain)
    out = measured(docs).select("doc_id", *METRICS, F.expr(BASE_FAILED).alias("base_failed"), chain.alias("first_failed"))
    return out.select("doc_id", *METRICS, "base_failed", (~F.col("base_failed") & F.col("first_failed").isNull()).alias("kept"), "first_failed")


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of docs that fail neither a rule nor the base, with their columns. A metric is computed where its first
    rule is reached, so a document that an early rule rejects never pays for the others."""
    order = [r for r, _, _ in ordered(docs, rules, sample_rows, id_col, text_col)]
    chain = "true"
    for rule in reversed([*order, Rule("base", BASE_FAILED)]):
        chain = f"if(coalesce({rule.fails}, false), false, {chain})"
    for name in reversed(METRICS):
        # a lambda variable would be computed at once; in the branches, the metric stands where it is needed
        chain = re.sub(rf"\b{name}\b", lambda _: f"({METRICS[name]})", chain)
    good = lets(chain, ("text", f"coalesce(`{text_col}`, '')"), ("w", words_sql("text")))
    return docs.where(F.expr(good))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(table(spark, sf_dir, "documents")).drop("first_failed")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(1, len(w) - 3))) AS t(i)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, unnest(range(0, 5)) AS t(j) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.text, d.w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(string_split(text, chr(10)))
            OR word_chars < 2 * n_words OR word_chars > 18 * n_words
            OR 2 * len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) > n_words
            OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 7 * n_words
            OR 5 * len(list_filter(w, lambda x: ends_with(x, '!'))) > n_words) AS kept
FROM b
"""
