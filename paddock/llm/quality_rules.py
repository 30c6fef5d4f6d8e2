"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Rules are SQL predicates over a document's text and its counts, which are part of the result
and so are worked out for every document; a rule that holds rejects the document.
``plan_cascade`` measures each rule on a bounded sample, its cost in seconds and the share
that it rejects, and orders the rules by rejection per cost. ``cascade`` evaluates them in
that order inside one CASE, so a rejected row skips the later, dearer rules. The order
changes the work, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import stored, texts, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rows that rules are measured on, about, and how many times each of them is looked at.
SAMPLE_ROWS, REPEATS, SEED = 400, 20, 7


@dataclass(frozen=True)
class Rule:
    """``reject`` is a SQL predicate over the columns of ``counts`` and text; null counts as no."""

    name: str
    reject: str


RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("word_length", "word_chars > 25 * n_words OR word_chars < 2 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > size(split(text, '\n'))"),
    Rule("capitals", "2 * length(regexp_replace(text, '[^\\\\p{Lu}]', '')) > length(regexp_replace(text, '\\\\P{L}', ''))"),
    Rule("exclamations", "5 * (length(text) - length(replace(text, '!!', ''))) > 2 * n_words"),
)


def window_keys(word: Column) -> Column:
    """A hash of each window of 8 words, in order; null where there is none."""
    start = F.when(F.size(word) >= WINDOW, F.sequence(F.lit(1), F.size(word) - (WINDOW - 1)))
    return F.transform(start, lambda i: F.xxhash64(F.slice(word, i, F.lit(WINDOW))))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), one row per row."""
    df = texts(docs, id_col, text_col)
    df = df.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda s: F.length(F.translate(s, " \t\x0b\x0c\r", "")) > 0)
    df = df.withColumns({"lines": lines, "keys": window_keys(F.col("w")), "n_words": F.size("w").cast("long")})
    # Only a text with a repeated window goes on; sorting brings its equal windows together.
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    df = df.withColumn("near", F.transform("sorted", lambda x, j: F.struct(x["i"].alias("i"), ((F.get("sorted", j - 1)["k"] == x["k"]) | F.coalesce(F.get("sorted", j + 1)["k"] == x["k"], F.lit(False))).alias("same"), (F.get("sorted", j - 1)["k"] == x["k"]).alias("prev"))))
    df = df.withColumn("at", F.sort_array(F.transform(F.filter("near", lambda x: x["same"] | x["prev"]), lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        "doc_id",
        "text",
        "n_words",
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def plan_cascade(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, repeats: int = REPEATS) -> list[Rule]:
    """``rules`` by share rejected per second, the most first; ties keep their order. ``docs``: doc_id, text.

    The sample is drawn over all rows and its counts are stored first, so that only the rule's
    own work is timed. Each rule looks at every sampled row ``repeats`` times in a task, after
    a first run that isn't timed; the least of three times counts, less what no rule takes.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = stored(counts(docs.sample(share, seed=SEED)))
    many = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("again"))

    def measured(reject: str) -> tuple[float, float]:
        found, times = many.agg(F.avg(F.coalesce(F.expr(reject), F.lit(False)).cast("double"))), []
        for _ in range(4):
            began = time.perf_counter()
            rejected = found.first()[0] or 0.0
            times.append(time.perf_counter() - began)
        return rejected, min(times[1:])

    _, idle = measured("again < 0")
    scored = []
    for place, rule in enumerate(rules):
        rejected, seconds = measured(rule.reject)
        scored.append((-rejected / max(seconds - idle, 1e-6), place, rule))
    return [rule for _, _, rule in sorted(scored, key=lambda x: x[:2])]


def cascade(rules) -> Column:
    """Name of the first rule that rejects the row, or null; later rules aren't evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        verdict = F.when(F.coalesce(F.expr(rule.reject), F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The counts with base_failed and kept, one row per row of ``docs``, in any order.

    Null and empty texts have no word and fail the base. Repeated rows are judged each.
    An empty table gives an empty result, with the rules in the given order.
    """
    order = plan_cascade(texts(docs, id_col, text_col), rules)
    counted = counts(docs, id_col, text_col)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = F.when(base, False).otherwise(cascade(order).isNull())
    return counted.withColumns({"base_failed": base, "kept": kept}).drop("text")
