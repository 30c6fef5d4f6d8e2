"""Spelling variants by permuterm rotations.

A word gets a terminator and is turned round letter by letter; all rotations of all words are
sorted. The rotation that starts behind a letter ends with it: w[i+1:] + end + w[:i], then w[i].
Words that differ by replacing that letter share all of the rotation but its last character,
and the word without that letter has that part as one of its own whole rotations. So each
rotation enters the sorted list twice, whole and under the prefix that skips its last
character, and a group of equal entries holds words one replacement or one indel apart. A
group has at most one member for each letter of the alphabet, whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import ascii_lower, durable, stored, texts
from paddock.llm.components import follow

#: Ends a word; no word holds it.
END = "\x00"
LETTERS = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, MUCH_MORE = 6, 5, 5


def dropped_letters(doc_id: Column, run: Column, each: int = 199) -> Column:
    """The run, without one letter where ``each`` divides the CRC-32 of ``<doc_id>:<run>``: that of place crc mod length. A null id is written as ''."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (crc % F.length(run)).cast("int")
    return F.when(crc % each == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, slips: bool = False, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters of all texts, A to Z folded, of enough letters and occurrences. With ``slips``, letters are dropped as in ``dropped_letters``."""
    doc = texts(docs, id_col, text_col)
    run = doc.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({LETTERS})"))).alias("run"))
    run = run.select((dropped_letters(F.col("doc_id"), F.col("run")) if slips else F.col("run")).alias("word"))
    counted = run.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(entry, letter, fresh, n): each rotation of each word, whole (letter '') and under its prefix that skips its last letter.

    ``fresh`` is false where the letter equals the one before it in the word: leaving out
    either gives the same shorter word, which counts once.
    """
    size = F.length("word")
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    i = F.col("i")
    behind = F.concat(F.substring("word", i + 2, size), F.lit(END), F.substring("word", F.lit(1), i))
    whole = F.concat(F.substring("word", i + 1, size), F.lit(END), F.substring("word", F.lit(1), i))
    letter, before = F.substring("word", i + 1, F.lit(1)), F.substring("word", i, F.lit(1))
    skips = F.struct(behind.alias("entry"), letter.alias("letter"), ((i == 0) | (letter != before)).alias("fresh"))
    holds = F.struct(whole.alias("entry"), F.lit("").alias("letter"), F.lit(True).alias("fresh"))
    both = at.select("n", F.explode(F.when(i < size, F.array(holds, skips)).otherwise(F.array(holds))).alias("x"))
    return both.select("x.entry", "x.letter", "x.fresh", "n")


def unturned(entry: Column, letter: Column) -> Column:
    """The word of an entry, its skipped letter put back."""
    parts = F.split(entry, END)
    return F.concat(parts[1], letter, parts[0])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each ordered pair of words (columns word, n) that differ by exactly one inserted, deleted or replaced letter, once."""
    turned = stored(rotations(words))
    # Sorted by ranges of entries, so that a group lies in one task and the groups are dealt evenly.
    turned = turned.repartitionByRange("entry").sortWithinPartitions("entry", "letter")
    group = turned.groupBy("entry").agg(F.collect_list(F.struct("letter", "fresh", "n")).alias("members")).where(F.size("members") > 1)
    other = F.col("other")
    one = group.select("entry", "members", F.explode("members").alias("one")).select("entry", "one", F.explode("members").alias("other"))
    mine = F.col("one")
    # The whole word meets a longer one only through the first of equal letters.
    indel = ((mine["letter"] == "") & other["fresh"]) | ((other["letter"] == "") & mine["fresh"])
    kept = one.where((mine["letter"] != other["letter"]) & (((mine["letter"] != "") & (other["letter"] != "")) | indel))
    return kept.select(unturned(F.col("entry"), mine["letter"]).alias("word"), mine["n"].alias("n"), unturned(F.col("entry"), other["letter"]).alias("near"), other["n"].alias("near_n"))


def group_variants(words: DataFrame, much_more: int = MUCH_MORE) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per row of ``words`` (word, n; each word once).

    Words are near if they differ by exactly one inserted, deleted or replaced letter.
    ``form`` is a word's near word of the largest n (of equals the smallest by code points), if
    that n is at least ``much_more`` times its own, else null; ``root`` is where the chain of
    forms ends, the word itself where it has none. Counts grow along a chain, so it is no
    longer than their logarithm. Words of one letter and none have neighbours too; null words
    and counts are left out. Other columns don't matter; an empty table gives an empty result.
    """
    words = stored(words.where("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    near = neighbours(words)
    # min of (-n, word): the most frequent, of equals the first by code points (UTF-8 bytes sort as these do).
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    out = words.join(best.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    takes = -F.col("best.less") >= much_more * F.col("n")
    out = stored(out.select("word", F.when(takes, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("best.less")).alias("form_n")))
    chain = durable(out.where("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("parent"), F.lit(True).alias("moved")))
    while not chain.where("moved").isEmpty():  # each round goes twice as far
        chain = durable(follow(chain, chain))
    root = chain.select(F.col("node").alias("w"), F.col("parent").alias("root"))
    return out.join(root, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, slips: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``group_variants`` of the ``count_words`` of a table of documents: null and empty texts have no words, repeated rows count each, clashing columns don't matter."""
    return group_variants(count_words(docs, slips, id_col=id_col, text_col=text_col))
