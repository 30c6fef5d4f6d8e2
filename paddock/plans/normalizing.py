"""Queries that read text fields; raw texts come from the adapter's raw_text view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions import normalize as n
from paddock.plans.registry import query
from paddock.sources.adapter import Tables

KEY = ("race_id", "horse_number")


@query("""SELECT race_id, track, CASE track WHEN '札幌' THEN 1 WHEN '函館' THEN 2 WHEN '福島' THEN 3 WHEN '新潟' THEN 4 WHEN '東京' THEN 5 WHEN '中山' THEN 6 WHEN '中京' THEN 7 WHEN '京都' THEN 8 WHEN '阪神' THEN 9 WHEN '小倉' THEN 10 END AS code, track IS NOT NULL AND track = '不明' AS rejected
FROM (SELECT race_id, CASE track_id WHEN 5 THEN '東京' WHEN 9 THEN '阪神' WHEN 3 THEN NULL WHEN 7 THEN '不明' ELSE '札幌' END AS track FROM race)""")
def norm_code(t: Tables) -> DataFrame:
    track = F.when(F.col("track_id") == 5, "東京").when(F.col("track_id") == 9, "阪神").when(F.col("track_id") == 3, None).when(F.col("track_id") == 7, "不明").otherwise("札幌")
    df = t.race.select("race_id", track.alias("track")).withColumn("code", n.code(F.col("track"), n.TRACK))
    return df.withColumn("rejected", n.rejected(F.col("track"), F.col("code")))


DATE_TEXT = "concat(CAST(1 + CAST(o_orderkey % 13 AS INT) AS {s}), '月', CAST(1 + CAST(o_orderkey % 28 AS INT) AS {s}), '日(土)')"


@query(f"""SELECT race_id, date_text, CASE WHEN m BETWEEN 1 AND 12 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') END AS race_date FROM (
SELECT '2024' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS race_id, {DATE_TEXT.format(s='VARCHAR')} AS date_text, '2024' AS y, CAST(1 + o_orderkey % 13 AS INT) AS m, CAST(1 + o_orderkey % 28 AS INT) AS d FROM orders)""")
def norm_date(t: Tables) -> DataFrame:
    df = t.orders.select(F.concat(F.lit("2024"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("race_id"), F.expr(DATE_TEXT.format(s="STRING")).alias("date_text"))
    return df.withColumn("race_date", n.race_date(F.col("date_text"), F.col("race_id")))


@query("""SELECT race_id, horse_number, time_text, CAST(split_part(time_text, ':', 1) AS INT) * 60 + CAST(split_part(time_text, ':', 2) AS DOUBLE) AS time_sec, CAST(split_part(time_text, ':', 1) AS INT) * 60 + TRY_CAST(CASE WHEN split_part(time_text, ':', 2) LIKE '%.%' THEN NULL ELSE split_part(time_text, ':', 2) END AS INT) AS minutes FROM raw_text""")
def norm_clock(t: Tables) -> DataFrame:
    text = F.col("time_text")
    whole = F.when(~F.get(F.split(text, ":"), F.lit(1)).contains("."), text)
    return t.raw_text.select(*KEY, "time_text", n.seconds(text).alias("time_sec"), n.minutes_of_day(whole).alias("minutes"))


@query("""SELECT race_id, horse_number, finish_text, TRY_CAST(CASE WHEN regexp_full_match(finish_text, '[0-9]+') THEN finish_text END AS INT) AS int_value, TRY_CAST(margin_text AS DOUBLE) AS float_value, NOT regexp_full_match(finish_text, '[0-9]+') AS int_rejected FROM raw_text""")
def norm_int_float(t: Tables) -> DataFrame:
    value = n.integer(F.col("finish_text"))
    return t.raw_text.select(*KEY, "finish_text", value.alias("int_value"), n.number(F.col("margin_text")).alias("float_value"), n.rejected(F.col("finish_text"), value).alias("int_rejected"))


@query("""SELECT race_id, horse_number, CASE WHEN regexp_full_match(finish_text, '[0-9]+') THEN CAST(finish_text AS INT) END AS finish, CASE WHEN regexp_full_match(finish_text, '[0-9]+') THEN 0 WHEN finish_text = '取消' THEN 1 WHEN finish_text = '中止' THEN 2 WHEN finish_text = '除外' THEN 3 WHEN finish_text = '失格' THEN 4 END AS status_id, finish_text = '?' AS rejected FROM raw_text""")
def norm_finish(t: Tables) -> DataFrame:
    finish, status = n.finish(F.col("finish_text"))
    return t.raw_text.select(*KEY, finish.alias("finish"), status.alias("status_id"), n.rejected(F.col("finish_text"), status).alias("rejected"))


@query("""SELECT race_id, horse_number, CASE substr(sex_age_text, 1, 1) WHEN '牡' THEN 0 WHEN '牝' THEN 1 WHEN 'セ' THEN 2 END AS sex_id, CAST(substr(sex_age_text, 2) AS INT) AS age FROM raw_text""")
def norm_sex_age(t: Tables) -> DataFrame:
    sex, age = n.sex_age(F.col("sex_age_text"))
    return t.raw_text.select(*KEY, sex.alias("sex_id"), age.alias("age"))


@query("""SELECT race_id, horse_number, margin_text, round(CASE margin_text WHEN 'ハナ' THEN 0.05 WHEN '大' THEN 10.0 WHEN '3/4' THEN 0.75 WHEN '2.1/2' THEN 2.5 WHEN '1.5' THEN 1.5 END::DOUBLE, 6) AS finish_diff FROM raw_text""")
def norm_margin(t: Tables) -> DataFrame:
    return t.raw_text.select(*KEY, "margin_text", F.round(n.margin(F.col("margin_text")), 6).alias("finish_diff"))


@query("""SELECT race_id, horse_number, c[1] AS corner_1, c[2] AS corner_2, c[3] AS corner_3, c[4] AS corner_4, CAST(len(c) AS INT) AS corner_count FROM (SELECT race_id, horse_number, [CAST(x AS INT) FOR x IN string_split(corner_text, '-')] AS c FROM raw_text)""")
def norm_corner(t: Tables) -> DataFrame:
    df = t.raw_text.select(*KEY, n.corners(F.col("corner_text")).alias("c"))
    count = F.when(F.col("c").isNotNull(), F.size("c"))
    return df.select(*KEY, *[F.get("c", F.lit(i)).alias(f"corner_{i + 1}") for i in range(4)], count.alias("corner_count"))


@query("""SELECT race_id, horse_number, CASE WHEN p THEN CASE substr(trainer_text, 1, 2) WHEN '美浦' THEN 0 WHEN '栗東' THEN 1 ELSE 2 END ELSE 3 END AS stable_id, CASE WHEN p THEN substr(trainer_text, 3) ELSE trainer_text END AS trainer_raw FROM (SELECT *, substr(trainer_text, 1, 2) IN ('美浦', '栗東', '地方') AS p FROM raw_text)""")
def norm_trainer(t: Tables) -> DataFrame:
    stable, name = n.trainer(F.col("trainer_text"))
    return t.raw_text.select(*KEY, stable.alias("stable_id"), name.alias("trainer_raw"))


@query("""SELECT race_id, horse_number, TRY_CAST(split_part(horse_weight_text, '(', 1) AS INT) AS horse_weight, TRY_CAST(replace(replace(split_part(horse_weight_text, '(', 2), ')', ''), '+', '') AS INT) AS horse_weight_diff, horse_weight_text = '計不' AS rejected FROM raw_text""")
def norm_weight(t: Tables) -> DataFrame:
    weight, diff = n.body_weight(F.col("horse_weight_text"))
    return t.raw_text.select(*KEY, weight.alias("horse_weight"), diff.alias("horse_weight_diff"), n.rejected(F.col("horse_weight_text"), weight).alias("rejected"))


@query("""SELECT race_id, horse_number, CASE WHEN w > 0 THEN w END AS odds, CASE WHEN place_text NOT LIKE '-%' THEN CAST(split_part(place_text, '-', 1) AS DOUBLE) END AS odds_min, CASE WHEN place_text NOT LIKE '-%' THEN CAST(split_part(place_text, '-', 2) AS DOUBLE) END AS odds_max FROM (SELECT *, CASE WHEN win_text NOT LIKE '-%' THEN CAST(replace(win_text, ',', '') AS DOUBLE) END AS w FROM raw_text)""")
def norm_single_odds(t: Tables) -> DataFrame:
    low, high = n.odds_range(F.col("place_text"))
    one = t.raw_text.select("race_id", F.explode(F.create_map("horse_number", "win_text")).alias("horse_number", "win_text"), "place_text")
    return one.select(*KEY, n.odds(F.col("win_text")).alias("odds"), low.alias("odds_min"), high.alias("odds_max"))


TRIO_KEY = "concat(lpad(CAST(horse_number + 2 AS {s}), 2, '0'), '-', CASE WHEN gate = 1 THEN '' WHEN gate = 2 THEN 'x-' ELSE '01-' END, lpad(CAST(horse_number + 1 AS {s}), 2, '0'))"


@query(f"""SELECT race_id, horse_number, horse_number AS horse_number_1, horse_number + 1 AS horse_number_2, gate IN (1, 2) AS trio_rejected, CASE WHEN gate > 2 THEN 1 END AS trio_1, CASE WHEN gate > 2 THEN horse_number + 1 END AS trio_2, CASE WHEN gate > 2 THEN horse_number + 2 END AS trio_3 FROM runner_raw""")
def norm_combo_odds(t: Tables) -> DataFrame:
    df = t.raw_text.join(t.runner_raw.select(*KEY, F.expr(TRIO_KEY.format(s="STRING")).alias("trio_key")), list(KEY))
    df = df.select(*KEY, n.combination(F.col("wide_key_text"), 2).alias("two"), n.combination(F.col("trio_key"), 3).alias("three"))
    number = lambda c, i, name: F.get(c, F.lit(i)).alias(name)
    return df.select(*KEY, number("two", 0, "horse_number_1"), number("two", 1, "horse_number_2"), F.col("three").isNull().alias("trio_rejected"), *[number("three", i, f"trio_{i + 1}") for i in range(3)])


# The numbers of the odds types in a payload.
KINDS = {"win": "1", "place": "2", "wide": "5", "trio": "7"}
BLOCK = """'"{k}":{{{{"', lpad(CAST(horse_number AS {{s}}), 2, '0'), '":["', win_text, '","9.9"]}}}}'"""
PAYLOAD = "concat('cb({{\"data\":{{\"odds\":{{', " + ", ',', ".join(BLOCK.format(k=k) for k in ("1", "2")) + ", CASE WHEN horse_number % 2 = 0 THEN concat(',', " + BLOCK.format(k="5") + ") ELSE '' END, CASE WHEN horse_number % 3 = 0 THEN concat(',', " + BLOCK.format(k="7") + ") ELSE '' END, '}}}}}})', CASE WHEN horse_number = 4 THEN ';' ELSE '' END)"


@query("""SELECT race_id, horse_number, k AS kind, CASE WHEN has THEN lpad(CAST(horse_number AS VARCHAR), 2, '0') END AS key, CASE WHEN has THEN win_text END AS first_value, CASE WHEN has THEN 2 END AS n_values FROM (SELECT *, k IN ('win', 'place') OR k = 'wide' AND horse_number % 2 = 0 OR k = 'trio' AND horse_number % 3 = 0 AS has FROM raw_text, (SELECT unnest(['win', 'place', 'wide', 'trio']) AS k))""")
def norm_jsonp(t: Tables) -> DataFrame:
    """The block of each type of odds in a payload; nulls where it has none."""
    df = t.raw_text.select(*KEY, F.expr(PAYLOAD.format(s="STRING")).alias("payload"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), n.jsonp_odds(F.col("payload"), number).alias("block")) for k, number in KINDS.items()])
    each = df.select(*KEY, F.explode(kinds).alias("x")).select(*KEY, "x.kind", F.explode_outer("x.block").alias("key", "values"))
    return each.select(*KEY, "kind", "key", F.get("values", F.lit(0)).alias("first_value"), F.when(F.col("values").isNotNull(), F.size("values")).alias("n_values"))


@query("""SELECT race_id, horse_number, lpad(CAST(horse_number AS VARCHAR), 2, '0') || '-' || lpad(CAST(horse_number + 1 AS VARCHAR), 2, '0') AS wide_key, win_text || '-9.9' AS wide_text, win_text FROM raw_text""")
def norm_odds_block(t: Tables) -> DataFrame:
    two = F.concat(F.lpad(F.col("horse_number").cast("string"), 2, "0"), F.lpad((F.col("horse_number") + 1).cast("string"), 2, "0"))
    df = t.raw_text.select(*KEY, F.create_map(two, F.array("win_text", F.lit("9.9"))).alias("block"))
    wide = F.map_entries(n.odds_block(F.col("block"), 2, True))[0]
    return df.select(*KEY, wide["key"].alias("wide_key"), wide["value"].alias("wide_text"), F.map_values(n.odds_block(F.col("block"), 1, False))[0].alias("win_text"))


#: One bad text of each part at a runner's number, and a race whose required key is missing.
BROKEN = {"win_text": "CASE WHEN horse_number = 11 THEN 'x' ELSE win_text END", "place_text": "CASE WHEN horse_number = 12 THEN '1.0' ELSE place_text END", "wide_key_text": "CASE WHEN horse_number = 13 THEN '07' ELSE wide_key_text END", "trio_key_text": "CASE WHEN horse_number = 10 THEN '01-02' ELSE concat(wide_key_text, '-17') END"}
PARTS = ("race", "runners", "win", "place", "wide", "trio")


@query("""SELECT r.race_id, track_id <> 7 AND coalesce(ok, TRUE) AS accepted, array_to_string(list_sort(list_filter([CASE WHEN track_id = 7 THEN 'race' END, CASE WHEN runners THEN 'runners' END, CASE WHEN win THEN 'win' END, CASE WHEN place THEN 'place' END, CASE WHEN wide THEN 'wide' END, CASE WHEN trio THEN 'trio' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM race r LEFT JOIN
(SELECT race_id, NOT (bool_or(bad) OR max(horse_number) >= 10) AS ok, bool_or(bad) AS runners, max(horse_number) >= 11 AS win, max(horse_number) >= 12 AS place, max(horse_number) >= 13 AS wide, max(horse_number) >= 10 AS trio FROM (SELECT *, finish_text = '?' OR horse_weight_text = '計不' AS bad FROM raw_text) GROUP BY 1) u ON u.race_id = r.race_id""")
def norm_reject(t: Tables) -> DataFrame:
    """A race with one unreadable part, or without a required key, is rejected whole; reasons say which parts."""
    from paddock.operators.ingest import accept

    race = t.race.select("race_id", F.when(F.col("track_id") != 7, F.struct("race_id", "date", F.col("track_id").alias("track"), "race_number")).alias("keys"))
    missing = F.col("keys").isNull() | F.exists(F.array(*[F.col(f"keys.{k}").isNull() for k in ("race_id", "date", "track", "race_number")]), lambda x: x)
    rows = t.raw_text.withColumns({c: F.expr(e) for c, e in BROKEN.items()})
    unread = lambda text, value: text.isNotNull() & ~text.startswith("-") & value
    cannot = {
        "runners": n.rejected(F.col("finish_text"), n.finish(F.col("finish_text"))[1]) | n.rejected(F.col("horse_weight_text"), n.body_weight(F.col("horse_weight_text"))[0]),
        "win": unread(F.col("win_text"), F.replace(F.col("win_text"), F.lit(","), F.lit("")).try_cast("double").isNull()),
        "place": unread(F.col("place_text"), F.size(F.split("place_text", "-")) != 2),
        "wide": n.combination(F.col("wide_key_text"), 2).isNull(),
        "trio": n.combination(F.col("trio_key_text"), 3).isNull(),
    }
    bad = rows.select("race_id", F.explode(F.array_compact(F.array(*[F.when(c, part) for part, c in cannot.items()]))).alias("reason"))
    good, out = accept(t.race.select("race_id"), bad.union(race.where(missing).select("race_id", F.lit("race"))))
    both = good.select("race_id", F.array().cast("array<string>").alias("r"), F.lit(True).alias("accepted")).union(out.select("race_id", "reasons", F.lit(False)))
    return both.select("race_id", "accepted", F.array_join(F.array_sort("r"), ",").alias("reasons"))


META = "concat(lpad(CAST(10 + horse_number % 8 AS {s}), 2, '0'), ':', '05発走 / ', CASE WHEN gate % 2 = 0 THEN '芝' ELSE 'ダ' END, CAST(1000 + 100 * gate AS {s}), 'm (', CASE WHEN gate % 3 = 0 THEN '左' ELSE '右' END, ' ', CASE WHEN gate = 1 THEN '外' ELSE '' END, ' A) / 天候:', CASE WHEN gate > 4 THEN '小雨' ELSE '晴' END, ' / 馬場:稍')"


@query(f"""SELECT race_id, horse_number, lpad(CAST(10 + horse_number % 8 AS VARCHAR), 2, '0') || ':05' AS post_time, CASE WHEN gate % 2 = 0 THEN 0 ELSE 1 END AS surface_id, 1000 + 100 * gate AS distance, CASE WHEN gate % 3 = 0 THEN 1 ELSE 0 END AS course_direction_id, CASE WHEN gate = 1 THEN 0 END AS course_layout_id, 0 AS course_variant_id, CASE WHEN gate > 4 THEN 2 ELSE 0 END AS weather_id, 1 AS track_condition_id FROM runner_raw""")
def text_race_meta(t: Tables) -> DataFrame:
    text = F.col("meta")
    take = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    df = t.runner_raw.select(*KEY, F.expr(META.format(s="STRING")).alias("meta"))
    return df.select(
        *KEY,
        take("(\\d{1,2}:\\d{2})").alias("post_time"),
        n.code(take("/ *(芝|ダ)"), n.SURFACE).alias("surface_id"),
        n.integer(take("(\\d+)m")).alias("distance"),
        n.code(take("(右|左|直線)"), n.DIRECTION).alias("course_direction_id"),
        n.code(take("(外|内)"), n.LAYOUT).alias("course_layout_id"),
        n.code(take("([ABCD])\\)"), n.VARIANT).alias("course_variant_id"),
        n.code(take("天候: *(小雨|小雪|晴|曇|雨|雪)"), n.WEATHER).alias("weather_id"),
        n.code(take("馬場: *(良|稍|重|不)"), n.CONDITION).alias("track_condition_id"),
    )


#: Links of the kinds that pages of results and lists hold, made of each page's own number and set before its HTML.
LINKS = "concat('<a href=\"/race/2024', lpad(CAST(page_id % 97 AS {s}), 8, '0'), '/\">r</a><a class=x href=\"/race/2024', lpad(CAST(page_id % 89 AS {s}), 8, '0'), '\">r</a><a href=\"/horse/', CAST(page_id % 31 AS {s}), 'h\">h</a><a href=\"/list?p=1&kaisai_date=202402', lpad(CAST(1 + page_id % 31 AS {s}), 2, '0'), '\">d</a>', coalesce(html, ''))"


@query(f"""SELECT DISTINCT page_id, kind, CASE WHEN kind <> 'date' THEN id WHEN try_strptime(id, '%Y%m%d') IS NOT NULL THEN strftime(try_strptime(id, '%Y%m%d'), '%Y-%m-%d') END AS id FROM (SELECT page_id, kind, unnest(regexp_extract_all(h, p, 1)) AS id FROM (SELECT page_id, {LINKS.format(s='VARCHAR')} AS h FROM pages), (VALUES ('race', 'href="/race/([0-9]{{12}})'), ('horse', 'href="[^"]*/horse/([0-9A-Za-z]+)'), ('date', 'href="[^"]*[?&]kaisai_date=([0-9]{{8}})(?:[^0-9"]|")')) v(kind, p)) WHERE kind <> 'date' OR try_strptime(id, '%Y%m%d') IS NOT NULL""")
def text_link_ids(t: Tables) -> DataFrame:
    """Race ids of twelve digits, horse ids and listed dates in a page's links, each once; a date that isn't one is left out."""
    html = F.expr(LINKS.format(s="STRING"))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(html, F.lit(p), F.lit(1)).alias("ids")) for k, p in n.LINK_IDS.items()])
    each = t.pages.select("page_id", F.explode(found).alias("x")).select("page_id", "x.kind", F.explode("x.ids").alias("id"))
    day = F.date_format(F.try_to_timestamp("id", F.lit("yyyyMMdd")), "yyyy-MM-dd")
    return each.select("page_id", "kind", F.when(F.col("kind") == "date", day).otherwise(F.col("id")).alias("id")).where("id IS NOT NULL").dropDuplicates()


@query("""SELECT race_id, regexp_full_match(race_id, '[0-9]{12}') AND CAST(substr(race_id, 5, 2) AS INT) BETWEEN 1 AND 10 AS valid FROM (SELECT '2024' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS race_id FROM orders)""")
def is_valid_race_id(t: Tables) -> DataFrame:
    race_id = F.concat(F.lit("2024"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    return t.orders.select(race_id.alias("race_id")).withColumn("valid", n.is_race_id(F.col("race_id")))


@query("""SELECT race_id, CAST(substr(race_id, 1, 4) AS INT) AS year, CAST(substr(race_id, 5, 2) AS INT) AS track_id, CAST(substr(race_id, 11, 2) AS INT) AS race_number FROM race""")
def race_id_parts(t: Tables) -> DataFrame:
    part = lambda at, size: F.substring("race_id", at, size).cast("int")
    return t.race.select("race_id", part(1, 4).alias("year"), part(5, 2).alias("track_id"), part(11, 2).alias("race_number"))
