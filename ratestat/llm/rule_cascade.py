"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The base counts of the contract are computed for every text.  The cascade
then asks its rules one after the other and stops at the first that rejects:
a chain of WHEN branches, of which Spark evaluates no more than it needs.
Their order comes from a sample of at most ``SAMPLE`` documents: every rule is
timed on it, and the rule that rejects most per second of what the rules
before it leave comes next.  The order moves the work, never a verdict.

Repeated windows are found by the hashes of all 8-word windows of a text
(64 bits over the words' own 64-bit hashes); only texts in which one turns up
twice are sorted to mark the words below.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratestat.llm.common import first_ids, prepare, staged

SAMPLE, REPEATS, WINDOW = 1000, 25, 8
SPACE = " \t\n\x0b\f\r"
_SPLIT = r"[ \t\n\x0B\f\r]+"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over ``text``, ``words`` and the base counts."""
    name: str
    rejects: str


#: Shapes of text that are no prose; each leaves ordinary documents alone.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * (length(text) - length(translate(text, '\n', '')) + 1)"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("capitals", "2 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > word_chars"),
    Rule("shouting", "5 * (length(text) - length(translate(text, '!?', ''))) > n_words"),
    Rule("stuttering", "4 * size(filter(words, (w, i) -> i > 0 and w = words[i - 1])) > n_words"),
    Rule("digits", "3 * (length(text) - length(translate(text, '0123456789', ''))) > word_chars"),
)


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds words and the base counts to docs(doc_id, text); text not null."""
    count = f"length(text) - length(translate(text, '{{}}', ''))"
    lines = "filter(split(text, '\\n', -1), x -> btrim(x, ' \\t\\n\\u000b\\u000c\\r') <> '')"
    one = docs.select(
        "doc_id", "text", F.filter(F.split("text", _SPLIT), lambda w: w != "").alias("words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        F.expr(count.format("#*$%&|<>")).cast("long").alias("n_symbols"), F.expr(lines).alias("lines"))
    two = one.select(
        "doc_id", "text", "words", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    last = F.size("hashes") - (WINDOW - 1)
    three = two.withColumn("windows", F.when(
        last > 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))))
    # (hash, place) of all windows in hash order, only where one repeats
    four = three.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = "get(sorted, k - 1).h <=> e.h or get(sorted, k + 1).h <=> e.h"
    five = four.withColumn("starts", F.expr(f"array_sort(transform(filter(sorted, (e, k) -> {same}), e -> e.i))"))
    covered = f"aggregate(transform(starts, (x, k) -> least({WINDOW}, get(starts, k + 1) - x)), 0L, (a, x) -> a + x)"
    return five.select("doc_id", "text", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"))


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def greedy_order(rules, seconds: dict, patterns) -> list:
    """Rules by rejected share per second, each judged on the documents that
    the ones before it leave.  ``patterns`` are (rejected by rule 0, 1, ...)
    with their number of documents; rules that reject nothing more come last,
    the quickest first."""
    left, order = list(range(len(rules))), []
    alive = list(patterns)
    while left:
        total = sum(n for _, n in alive)
        share = {i: sum(n for hit, n in alive if hit[i]) / max(total, 1) for i in left}
        best = max(left, key=lambda i: (share[i] / seconds[rules[i].name], -seconds[rules[i].name], -i))
        order.append(rules[best])
        left.remove(best)
        alive = [(hit, n) for hit, n in alive if not hit[best]]
    return order


def order_rules(docs: DataFrame, rules=RULES, sample: int = SAMPLE) -> list:
    """The rules by rejected share per second on a sample of docs(doc_id,
    text): ``sample`` ids at most, chosen by a fixed hash.

    Which rules reject a document is counted by pattern in one job.  A rule's
    cost is the time of a job that evaluates it on the sample ``REPEATS``
    times over, less that of the same job without a rule."""
    known = docs.where("doc_id is not null")
    ids = F.broadcast(first_ids(known.select("doc_id"), sample, 17))
    picked = staged(with_counts(known.join(ids, "doc_id").select("doc_id", "text")), "rule-sample")
    picked = picked.where(f"not ({BASE_FAILED})")
    hits = [F.coalesce(F.expr(r.rejects), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    counted = picked.select(*hits).groupBy(*[f"r{i}" for i in range(len(rules))]).count().toArrow().to_pylist() if rules else []
    patterns = [([row[f"r{i}"] for i in range(len(rules))], row["count"]) for row in counted]
    repeated = picked.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def took(expression):
        probe = repeated.agg(F.sum(F.expr(f"cast({expression} as int) + again")))
        times = []
        for _ in range(2):
            began = time.perf_counter()
            probe.collect()
            times.append(time.perf_counter() - began)
        return min(times)

    if len(rules) < 2:
        return list(rules)
    bare = took("length(text) < 0 or size(words) < 0")  # reads what the rules read
    return greedy_order(rules, {r.name: max(took(r.rejects) - bare, 1e-4) for r in rules}, patterns)


def rule_cascade(docs: DataFrame, rules=RULES, ordered: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, text, base counts, base_failed, first_failed, kept) for every
    row.  ``first_failed`` names the rule that stopped the cascade (null if
    none, or if the base already failed).  A null text is an empty one and
    fails the base.  Rows that repeat an id and rows with a null id are judged
    like any other; other columns of ``docs`` are not read.  ``ordered``:
    ``rules`` come in the order wanted, nothing is sampled."""
    prepare(docs)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rules = list(rules) if ordered else order_rules(base, rules)
    failed: Column = F.when(F.expr(BASE_FAILED), F.lit(None).cast("string"))
    for rule in rules:
        failed = failed.when(F.expr(rule.rejects), F.lit(rule.name))
    judged = with_counts(base).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("first_failed", failed)
    return judged.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "first_failed", (~F.col("base_failed") & F.col("first_failed").isNull()).alias("kept"))


def op3_rule_cascade(spark, sf_dir):
    """Per document: base counts, the base's and the cascade's verdicts."""
    from ratestat.llm.common import documents
    return rule_cascade(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), c AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
  FROM d
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS j
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g) WHERE k > 1)
  GROUP BY doc_id
), b AS (
  SELECT c.*, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    n_words < 20 OR 100 * coalesce(r.n, 0) > 30 * n_words AS base_failed
  FROM c LEFT JOIN r ON c.doc_id = r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words
    OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * (length(t) - length(replace(t, chr(10), '')) + 1))
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 2 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > word_chars
    OR 5 * length(regexp_replace(t, '[^!?]', '', 'g')) > n_words
    OR 4 * n_stutter > n_words
    OR 3 * length(regexp_replace(t, '[^0-9]', '', 'g')) > word_chars) AS kept
FROM b
"""
