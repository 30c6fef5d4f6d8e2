"""Text fields of raw race documents as typed columns.

Each function takes a text Column and gives a value Column, null for null. ``rejected``
tells a text that stands but can't be read from a null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts of the source and their ids.
TRACK = {"札幌": 1, "函館": 2, "福島": 3, "新潟": 4, "東京": 5, "中山": 6, "中京": 7, "京都": 8, "阪神": 9, "小倉": 10}
SURFACE = {"芝": 0, "ダ": 1}
DIRECTION = {"右": 0, "左": 1, "直線": 2}
LAYOUT = {"外": 0, "内": 1}
VARIANT = {"A": 0, "B": 1, "C": 2, "D": 3}
WEATHER = {"晴": 0, "曇": 1, "小雨": 2, "雨": 3, "小雪": 4, "雪": 5}
CONDITION = {"良": 0, "稍": 1, "重": 2, "不": 3}
STATUS = {"取消": 1, "中止": 2, "除外": 3, "失格": 4}
SEX = {"牡": 0, "牝": 1, "セ": 2}
MARGIN = {"ハナ": 0.05, "クビ": 0.10, "アタマ": 0.15, "大": 10.0}
NO_MARGIN = "同着"
STABLE = {"美浦": 0, "栗東": 1, "地方": 2}
OTHER_STABLE = 3


def code(text: Column, table: dict, kind: str = "int") -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, text).cast(kind)


def rejected(text: Column, value: Column) -> Column:
    return text.isNotNull() & value.isNull()


def integer(text: Column) -> Column:
    return text.try_cast("int")


def number(text: Column) -> Column:
    return text.try_cast("double")


def race_date(text: Column, race_id: Column) -> Column:
    """'M月D日…' and the year in race_id as yyyy-MM-dd; null if it isn't a date."""
    month, day = F.regexp_extract(text, "(\\d{1,2})月(\\d{1,2})日", 1), F.regexp_extract(text, "(\\d{1,2})月(\\d{1,2})日", 2)
    day_text = F.concat_ws("-", F.substring(race_id, 1, 4), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(month != "", F.date_format(F.try_to_timestamp(day_text, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"))


def minutes_of_day(text: Column) -> Column:
    part = F.split(text, ":")
    return F.when(F.size(part) == 2, F.get(part, F.lit(0)).try_cast("int") * 60 + F.get(part, F.lit(1)).try_cast("int"))


def seconds(text: Column) -> Column:
    """'M:SS.s' in seconds."""
    part = F.split(text, ":")
    return F.when(F.size(part) == 2, F.get(part, F.lit(0)).try_cast("int") * 60 + F.get(part, F.lit(1)).try_cast("double"))


def finish(text: Column) -> tuple[Column, Column]:
    """(finish, status): digits are a finish with status 0, a named reason is a status without finish."""
    digits = text.rlike("^[0-9]+$")
    return F.when(digits, text.try_cast("int")), F.when(digits, F.lit(0)).otherwise(code(text, STATUS))


def sex_age(text: Column) -> tuple[Column, Column]:
    pattern = "^(\\D+)(\\d{1,2})"
    return code(F.regexp_extract(text, pattern, 1), SEX), F.regexp_extract(text, pattern, 2).try_cast("int")


def fraction(text: Column) -> Column:
    part = F.split(text, "/")
    return F.try_divide(F.get(part, F.lit(0)).try_cast("double"), F.get(part, F.lit(1)).try_cast("double"))


def margin(text: Column) -> Column:
    """Named margins, 'b/c', 'a.b/c' as a + b/c, or a number; a dead heat is null."""
    mixed = F.regexp_extract(text, "^(\\d+)\\.(\\d+/\\d+)$", 1)
    return (
        F.when(text.isin(*MARGIN), code(text, MARGIN, "double"))
        .when(mixed != "", mixed.try_cast("double") + fraction(F.regexp_extract(text, "^(\\d+)\\.(\\d+/\\d+)$", 2)))
        .when(text.contains("/"), fraction(text))
        .otherwise(text.try_cast("double"))
    )


def corners(text: Column) -> Column:
    """Places at the corners, parts that aren't digits dropped."""
    return F.transform(F.filter(F.split(text, "-"), lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("int"))


def trainer(text: Column) -> tuple[Column, Column]:
    """(stable id, name without the stable's prefix)."""
    prefix = F.substring(text, 1, 2)
    known = prefix.isin(*STABLE)
    return F.when(text.isNotNull(), F.coalesce(code(prefix, STABLE), F.lit(OTHER_STABLE))), F.when(known, F.trim(F.substr(text, F.lit(3)))).otherwise(text)


def body_weight(text: Column) -> tuple[Column, Column]:
    """'480(+4)' as (480, 4), '480' as (480, null)."""
    pattern = "^(\\d+)(?:\\(([+-]?\\d+)\\))?$"
    return F.regexp_extract(text, pattern, 1).try_cast("int"), F.regexp_extract(text, pattern, 2).try_cast("int")


def odds(text: Column) -> Column:
    """Null for a leading '-' and for values that aren't positive; thousands separators go."""
    value = F.when(~text.startswith("-"), F.replace(text, F.lit(","), F.lit("")).try_cast("double"))
    return F.when(value > 0, value)


def odds_range(text: Column) -> tuple[Column, Column]:
    """'min-max' as two odds."""
    part = F.split(text, "-")
    two = (F.size(part) == 2) & ~text.startswith("-")
    return tuple(F.when(two, odds(F.get(part, F.lit(i)))) for i in (0, 1))


def combination(key: Column, size: int) -> Column:
    """'07-03' as the sorted array (3, 7); null unless it has ``size`` numbers."""
    numbers = F.array_sort(F.transform(F.split(key, "-"), lambda p: p.try_cast("int")))
    return F.when((F.size(numbers) == size) & ~F.exists(numbers, lambda n: n.isNull()), numbers)


def jsonp_odds(text: Column, kind: str) -> Column:
    """The block of odds of one type in 'cb({"data":{"odds":{type:{key:[..]}}}})'."""
    inner = F.regexp_extract(text, "(?s)^[^(]*\\((.*)\\)\\s*;?\\s*$", 1)
    parsed = F.from_json(inner, "data struct<odds: map<string, map<string, array<string>>>>")
    return F.try_element_at(parsed["data"]["odds"], F.lit(kind))


def odds_block(block: Column, width: int, span: bool) -> Column:
    """A block as map of key to text: the first value, or 'v0-v1'; keys of several horses are cut into parts of two digits."""
    values = F.transform_values(block, lambda k, v: F.concat_ws("-", F.get(v, F.lit(0)), F.get(v, F.lit(1))) if span else F.get(v, F.lit(0)))
    if width == 1:
        return values
    return F.transform_keys(values, lambda k, v: F.concat_ws("-", *[F.substring(k, 2 * i + 1, 2) for i in range(width)]))


def is_race_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]{12}$") & F.substring(text, 5, 2).try_cast("int").between(1, 10), F.lit(False))


# How links name races, horses and listed days.
LINK_IDS = {"race": 'href="/race/([0-9]{12})', "horse": 'href="[^"]*/horse/([0-9A-Za-z]+)', "date": 'href="[^"]*[?&]kaisai_date=([0-9]{8})(?:[^0-9"]|")'}
