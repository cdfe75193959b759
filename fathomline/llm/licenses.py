"""Licence scans by ordered signature rules (JVM expressions only).

A keyword prefilter decides which texts, and then which rules, are looked at further:
the rules are regular expressions over a text's words and are tried only where their
keyword occurs. Detections are intervals; one that lies inside a stronger one, or inside
a longer one of the same priority, is suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.license_rules import CONFIDENCE, STEMS, SignatureRule, signature_rules
from fathomline.llm.quality_rules import let

#: What parts words, upper-case letters not yet lowered.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def gate(lowered: Column, stems: tuple[str, ...] = STEMS) -> Column:
    """Whether any rule or base phrase may match: ``lowered`` is ``lower(text)``, in which all ASCII letters are lower-case."""
    found = F.lit(False)
    for stem in stems:
        first, *rest = stem.split(" ")
        here = F.contains(lowered, F.lit(first))
        found = found | (here & lowered.rlike((GAP + "+").join([first, *rest])) if rest else here)
    return found | (F.contains(lowered, F.lit("cc")) & lowered.rlike(rf"(?:^|{GAP})cc(?:0|{GAP})"))


def count_words(text: Column) -> Column:
    """How many words: the pieces between the gaps, but for an empty one at either end."""
    empty = lambda w: F.when(w == "", 1).otherwise(0)
    return let(F.split(text, GAP + "+"), lambda a: F.size(a) - empty(F.get(a, F.lit(0))) - F.when(F.size(a) > 1, empty(F.element_at(a, -1))).otherwise(0))


def words_of(text: Column) -> Column:
    """The words in lower case, parted by single spaces, with a space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP + "+", " ")), F.lit(" "))


def _by_first_word(rules: list[SignatureRule]) -> Column:
    """array<struct<first, rules>> of constants: the rules by the first word of each of their keywords."""
    groups: dict[str, list[tuple[str, SignatureRule]]] = {}
    for r in rules:
        for keyword in r.keyword.split("|"):
            groups.setdefault(keyword.split(" ")[0], []).append((keyword, r))
    return F.array(*[
        F.struct(F.lit(k).alias("first"), F.array(*[
            F.struct(F.lit(word).alias("keyword"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"))
            for word, r in g]).alias("rules"))
        for k, g in sorted(groups.items())])


def detections(words: Column, rules: list[SignatureRule]) -> Column:
    """All matches of all rules as array<struct<start, neg_end, priority, label>>, sorted: what contains comes before what is contained.

    A rule found by two keywords gives its matches twice; the second ones are suppressed like any contained match.
    """

    def places(rule: Column) -> Column:
        pair = F.struct(F.regexp_extract_all(words, rule["pattern"], F.lit(0)).alias("m"), F.split(words, rule["pattern"], -1).alias("s"))
        empty = F.array().cast("array<struct<start:int,neg_end:int,priority:int,label:string>>")
        return let(pair, lambda p: F.aggregate(
            F.arrays_zip(p["m"].alias("m"), F.slice(p["s"], F.lit(1), F.size(p["m"])).alias("s")),
            F.struct(F.lit(0).alias("at"), empty.alias("found")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["s"]) + F.length(x["m"])).alias("at"),
                F.concat(acc["found"], F.array(F.struct(
                    (acc["at"] + F.length(x["s"])).alias("start"), (-(acc["at"] + F.length(x["s"]) + F.length(x["m"]))).alias("neg_end"),
                    rule["priority"].alias("priority"), rule["label"].alias("label")))).alias("found")),
            lambda acc: acc["found"]))

    present = F.filter(_by_first_word(rules), lambda g: F.contains(words, g["first"]))
    chosen = F.flatten(F.transform(present, lambda g: F.filter(g["rules"], lambda r: F.contains(words, r["keyword"]) & F.rlike(words, r["pattern"]))))
    return F.array_sort(F.flatten(F.transform(chosen, places)))


def surviving(found: Column) -> Column:
    """struct<labels, best>: labels of the detections that nothing suppresses, and their strongest priority (or null)."""
    levels = sorted(CONFIDENCE)
    start = F.struct(
        *[F.lit(-1).alias(f"end{p}") for p in levels], F.array().cast("array<string>").alias("labels"), F.lit(None).cast("int").alias("best"))

    def step(acc: Column, d: Column) -> Column:
        end = -d["neg_end"]
        beyond = F.lit(-1)
        for p in levels:
            beyond = F.greatest(beyond, F.when(F.lit(p) <= d["priority"], acc[f"end{p}"]).otherwise(F.lit(-1)))
        alive = beyond < end
        return F.struct(
            *[F.when((d["priority"] == p) & alive, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in levels],
            F.when(alive, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(alive, F.least(acc["best"], d["priority"])).otherwise(acc["best"]).alias("best"))

    return F.aggregate(found, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["best"].alias("best")))


def _has_base(words: Column) -> Column:
    found = F.lit(False)
    for p in BASE:
        found = found | F.contains(words, F.lit(f" {p} "))
    return found


def _count(wide: Column, phrase: str) -> Column:
    """How often the phrase's words stand in a row; ``wide`` has two spaces between words, so matches share none."""
    wanted = " " + phrase.replace(" ", "  ") + " "
    return ((F.length(wide) - F.length(F.replace(wide, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")


def _edge(words: Column, last: bool) -> Column:
    """The smallest (or largest) start of a base phrase, in words from 0; null where there is none."""
    def spaces(s: Column) -> Column:
        return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))

    def of(text: Column) -> Column:
        places = []
        for p in BASE:
            at = F.instr(text, f" {p} "[::-1] if last else f" {p} ")
            before = spaces(F.substring(text, F.lit(1), at))
            places.append(F.when(at > 0, spaces(text) - before - len(p.split(" ")) if last else before - 1))
        return (F.greatest if last else F.least)(*places)

    return F.when(_has_base(words), let(F.reverse(words) if last else words, of))


def scan_licenses(docs: DataFrame, rules: list[SignatureRule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every whole text.

    The base phrases' places are counted apart from the rules, in words from 0; their
    labels are always among ``labels``. ``score`` is the confidence of the strongest
    detection left (0.5 for base phrases alone, 0 for none). A null text counts as
    empty: no words, no labels. Repeated rows give repeated rows; extra columns are
    ignored; an empty table gives no rows.
    """
    rules = rules or signature_rules()
    text = F.coalesce("text", F.lit(""))
    opened = let(F.lower(text), lambda low: gate(low))

    def look(words: Column) -> Column:
        counts = F.when(_has_base(words), let(F.replace(words, F.lit(" "), F.lit("  ")), lambda wide: F.array(*[_count(wide, p) for p in BASE])))
        return F.struct(counts.alias("counts"), _edge(words, False).alias("first_word"), _edge(words, True).alias("last_word"), surviving(detections(words, rules)).alias("left"))

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count_words(text).cast("long").alias("n_words"), F.when(opened, let(words_of(text), look)).alias("x"))
    kept = kept.withColumn("n_base", F.coalesce(F.aggregate("x.counts", F.lit(0), lambda a, c: a + c), F.lit(0)).cast("long"))
    confidence = F.coalesce(*[F.when(F.col("x.left.best") == p, F.lit(c)) for p, c in CONFIDENCE.items()], F.when(F.col("n_base") > 0, 0.5), F.lit(0.0))
    none = F.array().cast("array<string>")
    base = F.coalesce(F.filter(
        F.array(*[F.when(F.col("x.counts")[i] > 0, F.lit(label)) for i, label in enumerate(BASE.values())]), lambda x: x.isNotNull()), none)
    return kept.select(
        "doc_id", "n_words", "n_base", F.col("x.first_word").cast("long").alias("first_word"), F.col("x.last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("x.left.labels", none))), ",").alias("labels"),
        confidence.cast("double").alias("score"))
