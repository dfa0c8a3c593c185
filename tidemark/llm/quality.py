"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule names the features it needs and says when it rejects. ``measured`` estimates on a sample what a rule
with its features costs and how many texts it rejects; ``ordered`` puts the rules in the order of rejection
per cost. ``cascade`` runs them in this order: the features of a rule are computed only for texts that no
rule before it rejected, so that the costly ones see the fewest texts. The order changes the cost alone,
never the verdict, since a text is kept only if no rule rejects it.

Repeated windows of words are found inside a row. Hashes of all 8-word windows are compared as a set
first, and only a text with a repeat sorts its windows, by hash and then by their words, which decide.

Defined results: a null or empty text has no words and fails the base rule. Rows that share a doc_id are
judged each for itself; a null doc_id stays null. The sample holds ``SAMPLE_ROWS`` texts, about, of whatever
place in the table, and of each the first ``SAMPLE_CHARS`` characters; costs are compared by powers of
four, so that the noise of a measurement rarely changes the order.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of the sample that costs and rejections are measured on, about, and characters of each, at most.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 20_000
#: How often the sample is judged in one measured job.
REPEATS = 2
WINDOW = 8
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
SPACE = r"\x20\x09-\x0D"
#: Scripts that are written without spaces between words (fixed values).
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


def words_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")


def _words(d: DataFrame, on: Column) -> DataFrame:
    d = d.withColumn("words", F.when(on, words_of(F.col("text"))))
    return d.withColumn("n_words", F.array_size("words").cast("long"))


def _word_chars(d: DataFrame, on: Column) -> DataFrame:
    return d.withColumn("word_chars", F.when(on, F.length(F.array_join("words", ""))).cast("long"))


def _symbols(d: DataFrame, on: Column) -> DataFrame:
    return d.withColumn("n_symbols", F.when(on, F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long"))


def _lines(d: DataFrame, on: Column) -> DataFrame:
    d = d.withColumn("lines", F.when(on, F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))))
    d = d.withColumn("n_lines", F.array_size("lines").cast("long"))
    return d.withColumn("n_dup_lines", (F.array_size("lines") - F.array_size(F.array_distinct("lines"))).cast("long")).drop("lines")


def _repeats(d: DataFrame, on: Column) -> DataFrame:
    """n_repeat_words: words in windows that stand twice or more in the text."""
    d = d.withColumn("hashed", F.when(on & (F.col("n_words") > WINDOW), F.transform("words", lambda w: F.xxhash64(w))))
    windows = F.expr(f"transform(sequence(1, size(hashed) - {WINDOW - 1}), i -> xxhash64({', '.join(f'hashed[i + {k - 1}]' for k in range(WINDOW))}))")
    d = d.withColumn("windows", F.when(F.col("hashed").isNotNull(), windows)).drop("hashed")
    repeats = F.col("windows").isNotNull() & (F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.expr(f"array_sort(transform(windows, (h, i) -> struct(h AS h, slice(words, i + 1, {WINDOW}) AS w, i AS i)))")
    d = d.withColumn("placed", F.when(repeats, placed)).drop("windows")
    same = "get(placed, {0}).h = x.h AND get(placed, {0}).w = x.w"
    again = f"transform(filter(placed, (x, k) -> (k > 0 AND {same.format('k - 1')}) OR (k + 1 < size(placed) AND {same.format('k + 1')})), x -> x.i)"
    d = d.withColumn("again", F.expr(f"array_sort({again})")).drop("placed")
    covered = f"aggregate(transform(again, (x, k) -> least({WINDOW}, coalesce(get(again, k + 1), x + {WINDOW}) - x)), 0L, (a, x) -> a + x)"
    return d.withColumn("n_repeat_words", F.when(on, F.coalesce(F.expr(covered), F.lit(0))).cast("long")).drop("again")


#: Features by name, each after those it builds on.
FEATURES: dict[str, Callable[[DataFrame, Column], DataFrame]] = {"words": _words, "word_chars": _word_chars, "symbols": _symbols, "lines": _lines, "repeats": _repeats}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true, in terms of the columns of the features in ``needs``, where a text must go."""

    name: str
    needs: tuple[str, ...]
    rejects: str


_unspaced = "".join(rf"\\p{{Is{s}}}" for s in UNSPACED)
#: Thresholds that clean prose of any language keeps clear of. The first two rules are the base.
RULES = (
    Rule("few_words", ("words",), f"n_words < {MIN_WORDS}"),
    Rule("repeated_words", ("words", "repeats"), f"100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"),
    Rule("long_words", ("words", "word_chars"), f"n_words > 0 AND word_chars > 20 * n_words AND 2 * length(regexp_replace(text, '[^{_unspaced}]', '')) < word_chars"),
    Rule("short_words", ("words", "word_chars"), "n_words > 0 AND word_chars < 2 * n_words"),
    Rule("symbols", ("words", "symbols"), "10 * n_symbols > n_words"),
    Rule("duplicate_lines", ("lines",), "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("few_letters", ("words", "word_chars"), r"n_words > 0 AND length(regexp_replace(text, '[^\\p{L}\\p{M}]', '')) * 2 < word_chars"),
    Rule("few_distinct_words", ("words",), "n_words >= 50 AND 20 * size(array_distinct(words)) < n_words"),
)
BASE = ("few_words", "repeated_words")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce(docs["text"].cast("string"), F.lit("")))


def features(docs: DataFrame) -> DataFrame:
    """Adds all features to rows with a column text; other columns stay."""
    d = _plain(docs)
    for add in FEATURES.values():
        d = add(d, F.lit(True))
    base = [r.rejects for r in RULES if r.name in BASE]
    return d.withColumn("base_failed", F.expr(" OR ".join(f"({x})" for x in base)))


def cascade(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``kept``: whether no rule rejects the text. Each rule's features are computed where the rules
    before it let the text pass."""
    d, on, have = _plain(docs), F.lit(True), set()
    for k, rule in enumerate(rules):
        for name in rule.needs:
            if name not in have:
                d = FEATURES[name](d, on)
                have.add(name)
        d = d.withColumn(f"on_{k}", on & ~F.coalesce(F.expr(rule.rejects), F.lit(False)))
        on = F.col(f"on_{k}")
    return d.withColumn("kept", on)


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, int]]:
    """(rule, cost, rejected texts) on a sample of ``docs``, which is written and never leaves the cluster. Rules that need the same features are timed
    together, with these features, over ``REPEATS`` copies of the sample, after one run that compiles. What
    such a job takes without any rule is subtracted, and is the unit of costs; a quarter of it is the least
    that is told apart."""
    n = docs.count()
    text = F.substring(F.coalesce(docs["text"].cast("string"), F.lit("")), 1, SAMPLE_CHARS).alias("text")
    sample = written(docs.select(text).where(F.rand(42) < sample_rows / max(n, 1)).limit(4 * sample_rows), "quality-sample")
    if sample.isEmpty():
        return [(r, 1.0, 0) for r in rules]
    local = sample.coalesce(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(probe: DataFrame) -> tuple[float, list[int]]:
        probe.collect()
        began = time.perf_counter()
        found = probe.collect()[0]
        return time.perf_counter() - began, list(found)

    floor, _ = seconds(local.agg(F.sum(F.length("text"))))
    cost: dict[tuple[str, ...], float] = {}
    found: dict[str, int] = {}
    for needs in dict.fromkeys(r.needs for r in rules):
        own, d = [r for r in rules if r.needs == needs], _plain(local)
        for name in needs:
            d = FEATURES[name](d, F.lit(True))
        took, counts = seconds(d.agg(*(F.count_if(F.expr(r.rejects)).alias(r.name) for r in own)))
        cost[needs] = max((took - floor) / floor, 0.25)
        found |= {r.name: c // REPEATS for r, c in zip(own, counts, strict=True)}
    return [(r, cost[r.needs], found[r.name]) for r in rules]


def ordered(measures: list[tuple[Rule, float, int]]) -> list[Rule]:
    """Rules by rejected texts per cost, the most first; ties keep the given order."""
    cost = lambda c: 4 ** math.floor(math.log(c, 4))
    return [m[0] for m in sorted(measures, key=lambda m: -(m[2] + 0.5) / cost(m[1]))]


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; a CASE stops at the first that holds."""
    out = F.when(F.expr(rules[0].rejects), F.lit(rules[0].name))
    for r in rules[1:]:
        out = out.when(F.expr(r.rejects), F.lit(r.name))
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base columns, base_failed, kept and the rejecting rule of each text. All features are part of
    the result, so that only the rules themselves are short-circuited here."""
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    order = ordered(measured(plain, rules))
    d = features(plain).withColumn("rejected_by", verdict(order))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", _held(F.col("rejected_by").isNull()).alias("kept"), "rejected_by")


def _held(cond: Column) -> Column:
    """The same condition, but no filter on it moves below its column: that would copy the features
    into the filter many times over."""
    return cond & (F.spark_partition_id() >= 0)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns.

    A row travels as one struct beside the features, so clashing names do no harm.
    """
    packed = docs.select(F.struct("*").alias("row"), docs["text"].alias("text"))
    d = cascade(packed, ordered(measured(packed, rules)))
    return d.select("row", _held(F.col("kept")).alias("kept")).where("kept").select("row.*")
