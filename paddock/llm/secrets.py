"""Secret scan: candidate strings judged by a random forest, in DataFrame and MLlib operations only.

Every run of 16 or more key characters is a candidate; a word may hold several. Its features
are its length, how often its kind of character changes, how much of it dictionary words cover,
whether it looks like a path, and the words beside it. A random forest trained on labelled
findings takes out the false positives.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.common import ascii_lower, durable, stored, texts, words

CANDIDATE = "[A-Za-z0-9+/_-]{16,}"
#: What belongs to a candidate's own part of a word: no quotes, brackets and separators of fields.
PART = "[^\"'`,;|?&=<>(){}\\[\\]]*"
#: Words that announce a secret, and words that announce another kind of long string.
ANNOUNCES = "token|secret|passw|pwd|api|key|auth|bearer|credential|private|access"
DENIES = "sha|md5|commit|checksum|hash|digest|uuid|guid|example|sample|dummy|placeholder|version"
#: Places of findings that labelled examples are planted at; the report keeps one in HELD_OUT of them, by rank, from training.
SAMPLE_PLACES, HELD_OUT = 400, 4
#: Neutral words for places of our own, so that a table with few findings has enough; as many as these, each with its neighbours.
NEUTRAL = "the of and to in is was for on with as by at from this that it be are or an not have has had were been will would can".split()
#: What can stand next to a candidate inside a longer one.
INSIDE = "[A-Za-z0-9+/_-]"
#: Dictionary words make up at least one in so many of the plain words beside candidates, so there are never more of them than that.
SHARE_OF_WORDS = 1_000
TREES, DEPTH, SEED = 20, 6, 7
FEATURES = ("length", "changes", "covered", "digits", "upper", "letters_only", "digits_only", "hex_only", "distinct", "path", "announced", "denied", "assigned")
NEAR = ("before2", "before", "after")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, piece, candidate, lead, before2, before, after): all candidates of each word, at the word's place among the words.

    ``lead`` is what stands between the candidate before it, or the word's start, and the
    candidate. Beside a later candidate of a word stand the candidates next to it, not the
    word's neighbours. ``piece`` is the word, or the candidate's own part of it.
    """
    # No filter stands between these steps: one pushed down would split the text again for each of its words.
    doc = texts(docs, id_col, text_col).select("doc_id", words(F.col("text")).alias("w"))
    every = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))
    doc = doc.withColumn("places", F.filter(every, lambda i: (F.length(F.get("w", i)) >= 16) & F.get("w", i).rlike(CANDIDATE)))
    near = lambda i, d: F.coalesce(F.get("w", i + d), F.lit(""))
    found = F.transform("places", lambda i: F.struct(i.alias("at"), F.get("w", i).alias("word"), near(i, -2).alias("before2"), near(i, -1).alias("before"), near(i, 1).alias("after")))
    one = doc.select("doc_id", F.explode_outer(found).alias("f")).where("f IS NOT NULL").select("doc_id", "f.*")
    one = one.withColumns({"runs": F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), "leads": F.split("word", CANDIDATE)})

    def judged(c: Column, k: Column) -> Column:
        lead, last = F.get("leads", k), k == F.size("runs") - 1
        left, right = F.regexp_extract(F.right(lead, F.lit(64)), f"{PART}$", 0), F.regexp_extract(F.get("leads", k + 1), f"^{PART}", 0)
        own = F.concat(F.when(left == ".", "").otherwise(left), c, right)
        return F.struct(
            F.when(F.size("runs") == 1, F.col("word")).otherwise(own).alias("piece"), c.alias("candidate"), lead.alias("lead"),
            F.when(k == 0, F.col("before2")).otherwise("").alias("before2"),
            F.when(k == 0, F.col("before")).otherwise(F.get("runs", k - 1)).alias("before"),
            F.when(last, F.col("after")).otherwise(F.get("runs", k + 1)).alias("after"),
        )

    return one.select("doc_id", "at", F.explode_outer(F.transform("runs", judged)).alias("f")).select("doc_id", "at", "f.*")


def dictionary(found: DataFrame, share_of: int = SHARE_OF_WORDS) -> list[str]:
    """The plain words of 3 to 12 letters that are at least one in ``share_of`` of those beside candidates; so at most ``share_of`` words."""
    word = found.select(F.explode(F.array(*[ascii_lower(F.col(c)) for c in NEAR])).alias("word")).where("word rlike '^[a-z]{3,12}$'")
    count = stored(word.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = count.agg(F.sum("n")).first()[0] or 0
    return sorted((r.word for r in count.where(F.col("n") * share_of >= total).collect()), key=lambda w: (-len(w), w))


def share(rest: Column, c: Column) -> Column:
    return F.length(rest) / F.greatest(F.length(c), F.lit(1))


def featured(found: DataFrame, known: list[str]) -> DataFrame:
    """``found`` with the columns of FEATURES, all double."""
    c = F.col("candidate")
    beside = F.lower(F.concat_ws(" ", "before2", "before", "lead"))
    uncovered = F.regexp_replace(F.lower(c), "|".join(known), "") if known else c
    flag = lambda b: F.when(b, 1.0).otherwise(0.0)
    return found.withColumns({
        "length": F.length(c).cast("double"),
        "changes": (F.size(F.regexp_extract_all(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))) - 1) / F.length(c),
        "covered": 1 - share(uncovered, c),
        "digits": share(F.regexp_replace(c, "[^0-9]", ""), c),
        "upper": share(F.regexp_replace(c, "[^A-Z]", ""), c),
        "letters_only": flag(c.rlike("^[A-Za-z]+$")),
        "digits_only": flag(c.rlike("^[0-9_+/-]+$")),
        "hex_only": flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "path": flag(F.col("piece").rlike(r"://|www\.|^[./~]|[A-Za-z0-9]/[A-Za-z]+/|\.[a-z]{2,4}$")),
        "announced": flag(beside.rlike(ANNOUNCES)),
        "denied": flag(beside.rlike(DENIES)),
        "assigned": flag(F.concat_ws(" ", "before", "lead").rlike("[=:][\"' ]*$")),
    })


def planted_texts(found: DataFrame, places: int = SAMPLE_PLACES) -> DataFrame:
    """(place, held_out, text, value, label): labelled examples, each a value of a known form among the words beside a finding.

    The places are chosen by hash of these words; neutral places are added to them, whatever
    the table holds. One in HELD_OUT, by the places' rank, is marked for the report. Label 1: keys and tokens of usual forms,
    assigned, announced or bare. Label 0: what looks like them, such as digests, identifiers,
    paths, numbers, long words and placeholders. Values are made of the place's own hash.
    """
    words = F.concat_ws(" ", *NEAR)
    neutral = found.sparkSession.createDataFrame([*zip(NEUTRAL, NEUTRAL[1:], NEUTRAL[2:])], ", ".join(f"{c} string" for c in NEAR))
    own = found.select(*NEAR, F.xxhash64(words).alias("place")).distinct().orderBy("place").limit(places)
    place = own.union(neutral.select(*NEAR, F.xxhash64(words).alias("place")))
    # The places are no more than a parameter, so one task ranks them.
    place = place.withColumn("held_out", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place", *NEAR)) % HELD_OUT == 0)

    def hexes(form: str, n: int) -> Column:
        return F.left(F.sha2(F.concat(F.lit(form), F.col("place").cast("string")), 512), F.lit(n))

    def mixed(form: str, n: int, drop: str = "") -> Column:
        """Letters of both cases and digits, those of ``drop`` left out."""
        both = F.concat(*[F.base64(F.unhex(F.sha2(F.concat(F.lit(f"{form}{i}"), F.col("place").cast("string")), 512))) for i in range(2)])
        return F.left(F.translate(both, "+/=\r\n" + drop, ""), F.lit(n))

    plain = lambda i: F.lower(F.regexp_replace(F.get(F.array(*NEAR), F.lit(i)), "[^A-Za-z]", ""))
    say = lambda before, value, after="": (F.concat(F.lit(before), value, F.lit(after)), value)
    upper = F.upper(mixed("u", 40, "01"))
    dashed = F.concat_ws("-", *[F.substring(hexes("id", 32), at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    digits = F.left(F.regexp_replace(F.conv(hexes("d", 15), 16, 10), "[^0-9]", ""), F.lit(16))
    path = F.concat(F.lit("/usr/local/share/"), plain(0), F.lit("/"), plain(1), F.lit("/files"))
    glued = F.concat(plain(0), plain(1), plain(2), plain(1), F.lit("lichkeiten"))
    secret = [
        say('token = "', hexes("a", 40), '"'), say("api_key: ", hexes("b", 32)), say("password=", mixed("c", 20)), say('"secret": "', mixed("e", 40), '",'), say("Authorization: Bearer ", mixed("f", 48)),
        say("MY_SERVICE_SECRET_KEY=", hexes("g", 40)), say("AKIA", F.left(upper, F.lit(16))), say("aws_secret_access_key = ", mixed("h", 40)), say("ghp_", mixed("i", 36)), say("sk_live_", mixed("j", 24)),
        say("AIza", mixed("k", 35)), say("xoxb-", F.concat(digits, F.lit("-"), mixed("l", 24))), say("", hexes("m", 40)), say("", mixed("n", 40)), say("key=", hexes("o", 64)), say("https://a.example.org/some/longer/path?token=", hexes("p", 40)),
        say("access token ", mixed("q", 32)), say("passwd:", mixed("r", 18)), say('{"id":"7","api_key":"', hexes("s", 40), '"}'), say("password：", hexes("t", 40), "。"),
    ]
    harmless = [
        say("commit ", hexes("A", 40)), say("sha256:", hexes("B", 64)), say("md5 = ", hexes("C", 32)), say("checksum ", hexes("D", 40)), say("uuid ", dashed), say("id = ", dashed), say("", path), say("https://www.example.org", path),
        say("", digits), say("phone ", digits), say("", glued), say("", F.concat(glued, plain(0))), say("", F.concat_ws("_", F.lit("get"), plain(0), plain(1), plain(2), F.lit("value"))), say("", F.concat(F.lit("Get"), F.initcap(plain(0)), F.initcap(plain(1)), F.lit("Settings"))),
        say('token = "', F.lit("xxxxxxxxxxxxxxxxxxxxxxxx"), '"'), say("api_key: ", F.lit("your_api_key_goes_here")), say("", F.lit("----------------------")), say("version ", F.concat(F.lit("20240101-"), digits)), say("the commit hash is ", hexes("E", 40)),
        say("data/", F.concat(plain(0), F.lit("/"), plain(1), F.lit("/archive.tar.gz"))), say("", F.concat_ws("-", plain(0), plain(1), plain(2), F.lit("und"), plain(0))), say("", F.lit("0000000000000000000")),
    ]
    forms = [F.struct(body.alias("body"), value.alias("value"), F.lit(label).alias("label")) for label, group in ((1.0, secret), (0.0, harmless)) for body, value in group]
    each = place.select("place", "held_out", *NEAR, F.posexplode(F.array(*forms)).alias("form", "f"))
    return each.select("place", "held_out", F.concat_ws(" ", "before2", "before", "f.body", "after", "before2").alias("text"), "f.value", "f.label")


def planted_findings(found: DataFrame, known: list[str], places: int = SAMPLE_PLACES) -> DataFrame:
    """The columns of FEATURES, label and held_out of each candidate of the planted texts; only one that holds a secret's value has label 1."""
    rows = planted_texts(found, places).withColumn("n", F.monotonically_increasing_id()).withColumn("id", F.struct("place", "n", "held_out", "value", "label"))
    planted = stored(rows.select(F.to_json("id").alias("doc_id"), "text"))
    own = F.from_json("doc_id", "place long, n long, held_out boolean, value string, label double")
    judged = featured(candidates(planted), known).withColumn("own", own)
    holds = F.contains("candidate", "own.value") | F.contains("own.value", "candidate")
    # What stands beside a planted value, as the finding that the place was, has no known label.
    return judged.where(holds).select(*FEATURES, F.col("own.label").alias("label"), F.col("own.held_out").alias("held_out"))


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """A forest on labelled findings, in an order that doesn't depend on how they were dealt; an error if one label is missing."""
    rows = durable(labelled.select(*FEATURES, "label").orderBy("label", *FEATURES).coalesce(1))
    if rows.select("label").distinct().count() < 2:
        raise ValueError("labelled findings must hold both labels")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=1.0).fit(ready)


def scored(rows: DataFrame, forest: RandomForestClassificationModel) -> DataFrame:
    """``rows`` with the forest's share of votes for a secret as ``score``."""
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return forest.transform(ready).withColumn("score", F.round(vector_to_array("probability")[1], 6))


def held_out_report(found: DataFrame) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall) over planted findings that training doesn't see."""
    rows = durable(planted_findings(found, dictionary(found)))
    judged = scored(rows.where("held_out"), train(rows.where("NOT held_out"))).select("label", (F.col("score") >= 0.5).alias("yes"))
    cell = lambda label, yes: F.sum(F.when((F.col("label") == label) & (F.col("yes") == yes), 1).otherwise(0))
    counted = judged.agg(cell(1, True).alias("tp"), cell(0, True).alias("fp"), cell(1, False).alias("fn"), cell(0, False).alias("tn"))
    return counted.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.col("tp") / (F.col("tp") + F.col("fn"))})


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled=None) -> DataFrame:
    """(doc_id, at, candidate, score, is_secret), one row per candidate of every row of ``docs``.

    ``labelled`` may give labelled findings with the columns of FEATURES and label, of both
    labels (an error otherwise); else they are planted, and the forest learns from all of them
    (``planted_texts``). ``at`` is the word's place in the text,
    the same for all candidates of a word. Null and empty texts have no candidate; repeated
    rows give theirs each, and a table without candidates, or an empty one, gives an empty result.
    """
    found = stored(candidates(docs, id_col, text_col))
    known = dictionary(found)
    rows = featured(found, known)
    if labelled is None:
        labelled = planted_findings(found, known)
    judged = scored(rows, train(labelled))
    return judged.select("doc_id", F.col("at").cast("long").alias("at"), "candidate", "score", (F.col("score") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every secret among the findings of its doc_id replaced by ``mark``; all other columns stay.

    A secret goes wherever it stands as a whole candidate of the text, not where it is part
    of a longer one. A null doc_id counts as a value: its rows share their findings.
    """
    own = findings.where("is_secret").select("doc_id", "candidate").distinct()
    # Stored, so that Spark knows how small the table is and needn't deal out all texts.
    per_doc = stored(own.groupBy(F.col("doc_id").alias("__of")).agg(F.sort_array(F.collect_set("candidate"), asc=False).alias("__secrets")))
    joined = docs.join(per_doc, F.col(id_col).eqNullSafe(F.col("__of")), "left")
    whole = lambda s: F.concat(F.lit(f"(?<!{INSIDE})\\Q"), s, F.lit(f"\\E(?!{INSIDE})"))
    clean = F.aggregate("__secrets", F.col(text_col), lambda t, s: F.regexp_replace(t, whole(s), F.lit(mark)))
    return joined.select(*[F.coalesce(clean, F.col(text_col)).alias(text_col) if c == text_col else F.col(c) for c in docs.columns])
