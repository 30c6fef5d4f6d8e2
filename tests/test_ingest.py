"""One-pass ingestion against a plain reading of the same documents."""

import json
import os
import random
import re

import pytest

from paddock.functions import normalize as n
from paddock.operators import raw

RACE_CODES = {"surface": n.SURFACE, "course_direction": n.DIRECTION, "course_layout": n.LAYOUT, "course_variant": n.VARIANT, "weather": n.WEATHER, "track_condition": n.CONDITION}


class Bad(Exception):
    pass


def unread(text, read):
    try:
        return None if text is None else read(text)
    except Exception:
        raise Bad from None


def margin(text):
    if text == n.NO_MARGIN:
        return None
    if text in n.MARGIN:
        return n.MARGIN[text]
    if "/" in text:
        whole, _, part = text.rpartition(".")
        a, b = part.split("/")
        return int(whole or 0) + int(a) / int(b)
    return float(text)


def odds(text, span):
    if text.startswith("-"):
        return [None] * (1 + span)
    parts = text.split("-") if span else [text]
    assert len(parts) == 1 + span
    values = [float(p.replace(",", "")) for p in parts]
    return [v if v > 0 else None for v in values]


def runner_row(r):
    """Typed values and bad keys of one runner."""
    v, bad = {}, set()

    def take(key, read, need=False):
        try:
            if need and r.get(key) is None:
                raise Bad
            return unread(r.get(key), read)
        except Bad:
            bad.add(f"runners.{key}")
            return None

    if any(f.key not in r for f in raw.RUNNER):
        bad.add("runners.missing")
    for k in ("gate", "horse_number", "popularity"):
        v[k] = take(k, int)
    v["weight"], v["finish_3f"] = take("weight", float), take("finish_3f", float)
    finish = take("finish", lambda t: (int(t), 0) if t.isdigit() else (None, n.STATUS[t]), True)
    v["finish"], v["status_id"] = finish or (None, None)
    v["horse_name"] = take("horse_name", str, True)
    m = take("sex_age", lambda t: (n.SEX[re.match(r"(\D+)(\d{1,2})", t)[1]], int(re.match(r"(\D+)(\d{1,2})", t)[2])))
    v["sex_id"], v["age"] = m or (None, None)
    v["time_sec"] = take("time", lambda t: int(t.split(":")[0]) * 60 + float(t.split(":")[1]))
    v["finish_diff"] = take("finish_diff", margin)
    places = [int(p) for p in r["corner"].split("-") if p.isdigit()] if r.get("corner") is not None else None
    v["corner_count"] = None if places is None else len(places)
    for i in range(4):
        v[f"corner_{i + 1}"] = places[i] if places and i < len(places) else None
    t = r.get("trainer_raw")
    known = t is not None and t[:2] in n.STABLE
    v["stable_id"] = None if t is None else n.STABLE.get(t[:2], n.OTHER_STABLE)
    v["trainer_raw"] = t[2:] if known else t
    m = take("horse_weight", lambda t: re.fullmatch(r"(\d+)(?:\(([+-]?\d+)\))?", t).groups())
    v["horse_weight"], v["horse_weight_diff"] = (int(m[0]), None if m[1] is None else int(m[1])) if m else (None, None)
    for k in ("horse_id", "jockey_raw", "jockey_id", "trainer_id"):
        v[k] = r.get(k)
    return v, bad


def account(doc):
    """(reasons, tables) of one document."""
    race, bad, out = doc.get("race"), set(), {}
    if race is None or any(f.key not in race for f in raw.RACE):
        bad.add("race.missing")
    race = race or {}
    v = {"race_id": race.get("race_id")}

    def take(key, read, need=False):
        try:
            if need and race.get(key) is None:
                raise Bad
            return unread(race.get(key), read)
        except Bad:
            bad.add(f"race.{key}")
            return None

    take("race_id", str, True)
    v["date"] = take("date", lambda t: "{}-{:02d}-{:02d}".format(race["race_id"][:4], *map(int, re.match(r"(\d{1,2})月(\d{1,2})日", t).groups())), True)
    v["track_id"], v["race_number"] = take("track", n.TRACK.__getitem__, True), take("race_number", int, True)
    v["post_time_min"] = take("post_time", lambda t: int(t.split(":")[0]) * 60 + int(t.split(":")[1]))
    for k, table in RACE_CODES.items():
        v[f"{k}_id"] = take(k, table.__getitem__)
    v["distance"], v["race_size"] = take("distance", int), take("race_size", int)
    out["race"] = [v]
    if doc.get("runners") is None:
        bad.add("runners.missing")
    rows = [runner_row(r) for r in doc.get("runners") or []]
    bad |= set().union(*[b for _, b in rows])
    out["runner"] = [{"race_id": v["race_id"]} | r for r, _ in rows]
    for part, (horses, span) in raw.ODDS.items():
        block, out[part] = (doc.get("odds") or {}).get(part), []
        if block is None:
            bad.add(f"{part}.missing")
        for key, text in (block or {}).items():
            row = {"race_id": v["race_id"]}
            try:
                numbers = sorted(map(int, key.split("-")))
                assert len(numbers) == horses
                row |= {"horse_number" if horses == 1 else f"horse_number_{i + 1}": x for i, x in enumerate(numbers)}
            except Exception:
                bad.add(f"{part}.numbers")
            try:
                row |= dict(zip(("odds_min", "odds_max") if span else ("odds",), odds(text, span)))
            except Exception:
                bad.add(f"{part}.odds")
            out[part].append(row)
    return sorted(bad), out


def document(rng, number):
    pick = lambda *xs: rng.choice(xs)
    odd = lambda good, *bad: rng.choice(bad) if rng.random() < 0.01 else good
    race = {
        "race_id": f"2024{number:08d}", "date": odd(f"{pick(1, 12)}月{pick(1, 28)}日(土)", "x月", None), "track": odd(pick(*n.TRACK), "?", None), "race_number": odd("3", "R3", None), "post_time": odd(pick("9:05", None), "9", "a:b"),
        "surface": odd(pick("芝", None), "砂"), "distance": odd("1600", "far"), "course_direction": pick("右", "直線", None), "course_layout": odd(pick("外", None), "上"), "course_variant": odd("A", "Z"), "weather": odd("小雪", "霧"),
        "track_condition": odd("不", "x"), "race_size": odd(pick("3", None), "many"),
    }
    runner = lambda i: {
        "gate": odd(str(i), "g"), "horse_number": odd(str(i), "h"), "finish": odd(pick("1", "12", "取消", "失格"), "?", None), "horse_name": odd("name", None), "horse_id": pick("h1", None, ""), "sex_age": odd(pick("牡3", "セ10", None), "牛3", "3"),
        "jockey_raw": "j", "jockey_id": None, "weight": odd("56.5", "w"), "time": odd(pick("1:34.5", None), "1.5"), "finish_diff": odd(pick("ハナ", "同着", "3/4", "2.1/2", "1.5", "大", None), "x", "1/0"), "popularity": odd("2", "p"), "finish_3f": odd("34.1", "-"),
        "corner": pick("3-3-2-1", "5-*-1", "1-2-3-4-5", None, ""), "trainer_raw": pick("美浦name", "other", None), "trainer_id": "t", "horse_weight": odd(pick("480(+4)", "480(-2)", "480", None), "計不"),
    }
    key = lambda k: "-".join(f"{x:02d}" for x in rng.sample(range(1, 9), k))
    single, span = lambda: odd(pick("1.5", "1,024.5", "---.-", "0.0"), "x", None), lambda: odd(pick("1.5-2.5", "1,000.0-2,000.5", "-", "0.0-1.0"), "1.5", "1-2-3", "a-b", None)
    doc = {"race": race, "runners": [runner(i) for i in range(1, rng.randrange(2, 5))], "odds": {"win": {key(1): single() for _ in range(3)}, "place": {key(1): span() for _ in range(3)}, "wide": {odd(key(2), "07", "1-x"): span() for _ in range(3)}, "trio": {odd(key(3), "01-02"): single() for _ in range(3)}}}
    if rng.random() < 0.03:
        doc["race"].pop("weather")
    if rng.random() < 0.03:
        doc["runners"][0].pop("gate")
    if rng.random() < 0.03:
        doc["odds"].pop("trio")
    if rng.random() < 0.02:
        doc.pop(rng.choice(["race", "runners", "odds"]))
    return doc | {"extra": 1}


def table(rows):
    return sorted(repr(sorted((k, round(x, 9) if isinstance(x, float) else x) for k, x in r.items())) for r in rows)


@pytest.mark.parametrize("multi_line", [True, False])
def test_documents_to_seven_tables(spark, tmp_path, multi_line):
    rng = random.Random(4)
    docs = [document(rng, i) for i in range(250)]
    if multi_line:
        for i, d in enumerate(docs):
            (tmp_path / f"{i}.json").write_text(json.dumps(d, ensure_ascii=False, indent=1))
        (tmp_path / "cut.json").write_text('{"race": {"race_id": "1"')
    else:
        (tmp_path / "all.json").write_text("\n".join([*(json.dumps(d, ensure_ascii=False) for d in docs), '{"race": {"race_id": "1"']))
    got = raw.ingest(spark, str(tmp_path), multi_line)
    want, rejects = {part: [] for part in raw.TABLES[:-1]}, [(None, ["document"])]
    for d in docs:
        reasons, parts = account(d)
        if reasons:
            rejects.append(((d.get("race") or {}).get("race_id"), reasons))
        else:
            for part, rows in parts.items():
                want[part] += rows
    assert 60 < len(rejects) < 200 and all(len(x) for x in want.values())
    for part, rows in want.items():
        assert table([r.asDict() for r in got[part].drop("read_at").collect()]) == table(rows), part
    assert sorted(map(repr, ((r.race_id, r.reasons) for r in got["rejects"].collect()))) == sorted(map(repr, rejects))
    assert got["rejects"].where("broken IS NOT NULL").count() == 1


def test_no_document(spark, tmp_path):
    (tmp_path / "none.json").write_text("")
    got = raw.ingest(spark, str(tmp_path), False)
    assert tuple(got) == raw.TABLES and all(df.count() == 0 for df in got.values())


def test_only_what_the_wanted_tables_read_is_stored(spark, monkeypatch):
    from paddock.plans import ingesting
    from paddock.sources.adapter import Tables

    stored, keep = [], raw.saved
    monkeypatch.setattr(raw, "saved", lambda df: stored.append(df.columns) or keep(df))
    at = ingesting.documents(Tables(spark, "/root/testdata/sf0.001"))
    whole, one = raw.ingest(spark, at, multi_line=False), raw.ingest(spark, at, multi_line=False, only=("win", "rejects"))
    assert list(one) == ["win", "rejects"] and {"runners", "trio"} <= {*stored[0]} and not {"runners", "race", "place", "wide", "trio"} & {*stored[1]}
    for part in one:
        assert one[part].exceptAll(whole[part]).count() == whole[part].exceptAll(one[part]).count() == 0
    assert {f.rpartition(".")[2] for f in os.listdir(at.removeprefix("file:")) if f.startswith("part-")} == {"gz"}
