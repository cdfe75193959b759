"""Text quality rules as a short-circuit cascade (JVM expressions only).

``text_measures`` computes the counts that every document is reported with.
``plan_cascade`` estimates every rule's cost and the share it rejects on a sample and
orders the rules by rejections per cost. ``apply_cascade`` nests them in that order: a
rule's own measure is evaluated only for texts that all rules before it let pass. The
order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import SPACE_CLASS, by_name, durable

SYMBOLS = r"[#*$%&|<>]"
WORD_LINE = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and gives it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_LINE))


def repeated_words(words: Column, size: int = 5) -> Column:
    """How many words lie in a window of ``size`` words that occurs at least twice in the text.

    Most texts repeat nothing: then the count of distinct window hashes (64 bits)
    says so. Otherwise the hashes are sorted with their places; places with an equal
    neighbour are repeated windows, and the union of their words is counted.
    """
    hashes = F.when(
        F.size(words) >= size,
        F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(ranked, lambda a: F.array_sort(F.transform(
            F.filter(a, lambda e, k: F.coalesce((F.get(a, k - 1)["h"] == e["h"]) | (F.get(a, k + 1)["h"] == e["h"]), F.lit(False))),
            lambda e: e["i"])))
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda s, p: F.struct((s["n"] + (p + size) - F.greatest(p, s["end"])).alias("n"), (p + size).alias("end")),
            lambda s: s["n"],
        )

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def text_measures(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id) and, of the whole text: n_chars, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words.

    A null text counts as empty. All measures are long.
    """
    text = F.coalesce("text", F.lit(""))
    lines = lines_of(text)
    counts = F.struct(
        F.length(text).alias("n_chars"),
        F.length(F.regexp_replace(text, SPACE_CLASS + "+", "")).alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"),
        let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
    )
    own = by_name(keep or ["doc_id"])
    return docs.select(*own, counts.alias("_counts")).select(
        *own,
        *[F.col(f"_counts.{c}").cast("long").alias(a) for c, a in (
            ("n_chars", "n_chars"), ("w.n", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"),
            ("l.n", "n_lines"), ("l.d", "n_dup_lines"), ("w.r", "n_repeat_words"))],
    )


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``rejects`` holds: a Column over ``text`` and the measures of ``text_measures``."""

    name: str
    rejects: Column


def base_rules() -> list[Rule]:
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return [Rule("few_words", n < 10), Rule("repeated_windows", 100 * r > 20 * n)]


def own_rules() -> list[Rule]:
    """The method's own rules. The first four compare measures that are there anyway; the others look at the text once more."""
    n, text = F.col("n_words"), F.coalesce("text", F.lit(""))

    def most_frequent(words: Column) -> Column:
        """How often the most frequent word occurs: the longest run of equal words in order."""
        return let(F.array_sort(words), lambda w: F.aggregate(
            w, F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")),
            lambda s, x: let(F.when(x == s["last"], s["run"] + 1).otherwise(1), lambda k: F.struct(x.alias("last"), k.alias("run"), F.greatest(s["most"], k).alias("most"))),
            lambda s: s["most"]))

    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("short_words", F.col("word_chars") < 2 * n),
        Rule("long_words", F.col("word_chars") > 20 * n),
        Rule("few_letters", 2 * F.regexp_count(text, F.lit(r"\p{L}")) < F.col("word_chars")),
        Rule("digits", 10 * F.regexp_count(text, F.lit("[0-9]")) > 3 * F.col("word_chars")),
        Rule("bullets", let(lines_of(text), lambda x: 10 * F.size(F.filter(x, lambda s: s.rlike(r"^[\x20\x09]*[-*•]"))) > 9 * F.size(x))),
        Rule("cut_lines", let(lines_of(text), lambda x: 10 * F.size(F.filter(x, lambda s: s.rlike(r"(?:\.\.\.|…)[\x20\x09\x0D]*$"))) > 3 * F.size(x))),
        Rule("one_word", let(words_of(text), lambda w: 100 * most_frequent(w) > 40 * F.size(w))),
    ]


def default_rules() -> list[Rule]:
    """The base rules and the method's own."""
    return base_rules() + own_rules()


@dataclass(frozen=True)
class Step:
    rule: Rule
    cost_s: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost_s, 1e-9)


def plan_cascade(docs: DataFrame, rules: list[Rule], sample_rows: int = 400) -> list[Step]:
    """Each rule's cost and rejected share on a random sample of ``sample_rows`` texts at most; best worth first.

    The sample and its measures are written once, and stay out of the driver. A rule's
    cost is the least time of three passes over it, less that of a pass without a rule;
    costs are rounded up to a hundredth of a second, below which times are noise, and
    equal worths go by name. The sample decides an order only: whatever it holds, all
    rules see all rows.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    some = texts.sample(False, 0.05, seed=7).limit(sample_rows)
    sample = durable(text_measures(some, ["text"]).coalesce(1), "rule-sample")
    if not sample.limit(1).count():
        sample = durable(text_measures(texts.limit(sample_rows), ["text"]).coalesce(1), "rule-sample")

    def one_pass(rejects: Column) -> tuple[float, float]:
        spent = []
        for _ in range(3):  # the first run compiles code
            began = time.perf_counter()
            share = sample.agg(F.avg(rejects.cast("double")).alias("x"), F.max("text")).first().x
            spent.append(time.perf_counter() - began)
        return min(spent), share or 0.0

    nothing, _ = one_pass(F.lit(False))
    steps = []
    for rule in rules:
        spent, share = one_pass(rule.rejects)
        steps.append(Step(rule, max(0.01, round(spent - nothing, 2)), share))
    return sorted(steps, key=lambda s: (-s.worth, s.cost_s, s.rule.name))


def apply_cascade(measures: DataFrame, steps: list[Step]) -> DataFrame:
    """Adds ``rejected_by`` (the first rule of the order that rejects, else null) and ``kept``; drops ``text``.

    One conditional expression: the condition of a branch is evaluated only where none before it held.
    """
    verdict = F.when(steps[0].rule.rejects, F.lit(steps[0].rule.name))
    for step in steps[1:]:
        verdict = verdict.when(step.rule.rejects, F.lit(step.rule.name))
    return measures.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull()).drop("text")


def quality_filter(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Measures and verdict of every document.

    Adds ``base_failed`` (a base rule rejects) to doc_id (of any type) and the measures,
    ``rejected_by`` and ``kept``. Empty and null texts have no words and fail; repeated
    rows give repeated rows; extra columns are ignored; an empty table gives no rows.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    steps = plan_cascade(own, rules or default_rules())
    failed = F.lit(False)
    for rule in base_rules():
        failed = failed | rule.rejects
    return apply_cascade(text_measures(own, ["doc_id", "text"]).withColumn("base_failed", failed), steps)
