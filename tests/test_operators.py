import pytest
from pyspark.sql import functions as F

from causeway.functions import text
from causeway.operators import clean, html_tables, reshape, validate
from causeway.sources import readers, sinks
from causeway.spec import PanelSpec


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_names_and_amounts(spark):
    assert column(spark, ["杭州市（浙江）", "通化市(地级)", "市", None, " 上海市 ", "香港特别行政区", "浦东新区", "某某市经济技术开发区"], text.clean_name) == ["杭州", "通化", "市", None, "上海", "香港", "浦东", "某某"]
    prefectures = {"延边朝鲜族自治州": "延边", "恩施土家族苗族自治州": "恩施", "大理白族自治州": "大理", "凉山彝族自治州": "凉山", "海西蒙古族藏族自治州": "海西", "红河哈尼族彝族自治州": "红河", "长阳土家族自治县": "长阳土家族"}
    assert column(spark, list(prefectures), text.clean_name) == list(prefectures.values())
    assert column(spark, ["1,200", "3万", "1.5亿", "1万亿", "12%", "abc", "", None], text.parse_amount) == [1200, 3e4, 1.5e8, 1e12, 12, None, None, None]
    assert column(spark, ["2020-01-02", "2020/01/02", "20200102", "x"], text.iso_date) == ["2020-01-02"] * 3 + [None]


def test_load_variable(spark):
    raw = spark.createDataFrame([(" a ", "2001", "1.5", 2), ("a", "2001", "9", 1), ("b", "x", "1", 1), (None, "2001", "1", 1), ("c", "2002", "NaN", 1), ("", "2002", "1", 1)], "city string, yr string, gdp string, n int")
    got = {(r[0], r[1]): r[2] for r in clean.load_variable(raw.drop("n"), "gdp").collect()}
    assert got == {("a", 2001): 1.5, ("c", 2002): None}
    assert clean.load_variable(raw, "gdp", value="gdp", order=F.col("n")).where("entity_id = 'a'").first()["gdp"] == 9
    with pytest.raises(ValueError):
        clean.load_variable(raw.drop("yr"), "gdp")


def test_impute_fills_single_holes_only(spark):
    rows = [("a", t, v) for t, v in enumerate([1.0, None, 3.0, None, None, 6.0, None])] + [("b", 0, None), ("b", 1, 2.0)]
    df = spark.createDataFrame(rows, "e string, t int, v double")
    got = {(r["e"], r["t"]): (r["v"], r["v_imputed"]) for r in clean.impute_sporadic(df, "e", "t", "v").collect()}
    assert got["a", 1] == (2.0, 1) and got["a", 3] == (None, 0) and got["a", 6] == (None, 0) and got["b", 0] == (None, 0)
    two = {(r["e"], r["t"]): r["v"] for r in clean.impute_sporadic(df, "e", "t", "v", max_gap=2).collect()}
    assert two["a", 3] == two["a", 4] == 4.5


def test_merge_and_normalise(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 1, 2.0)], "entity_id string, year int, a double")
    b = spark.createDataFrame([("x", 1, 5.0), ("z", 2, 6.0)], "entity_id string, year int, b double")
    assert {tuple(r) for r in clean.merge_panels({"a": a, "b": b}).collect()} == {("x", 1, 1.0, 5.0), ("y", 1, 2.0, None), ("z", 2, None, 6.0)}
    m = spark.createDataFrame([("杭州市", "330100", 0), ("宁波", "330200", 1)], "alias string, code string, position int")
    df = spark.createDataFrame([("杭州",), ("宁波市",), ("nan",), ("",), (None,), ("北京",)], "entity_id string")
    assert [r[0] for r in clean.normalise_entities(df, "entity_id", m).collect()].count("330100") == 1
    assert {r[0] for r in clean.normalise_entities(df, "entity_id", m).collect()} == {"330100", "330200", "nan", "", None, "北京"}


def test_names_by_likeness(spark):
    """Matching blocks, not edits: as difflib tells, the first of equals, parts before likeness."""
    from difflib import SequenceMatcher

    aliases = ["northern hills", "hills of the north", "eastshore", "westshore", "lake"]
    m = spark.createDataFrame([(a, f"c{k}", k) for k, a in enumerate(aliases)], "alias string, code string, position int")
    names = ["northern hill", "nothern hils", "estshore", "big lake town", "shores", "qqq", "x"]
    got = dict(zip(names, [r[0] for r in clean.normalise_entities(spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string"), "n", m).orderBy("k").select("n").collect()]))
    for n in names:
        inside = [k for k, a in enumerate(aliases) if len(n) >= 2 and (n in a or a in n)]
        ratios = [SequenceMatcher(None, n, a).ratio() for a in aliases]
        want = inside[0] if inside else max(range(5), key=lambda k: ratios[k]) if max(ratios) >= 0.75 else None
        assert got[n] == (n if want is None else f"c{want}")


def test_validation(spark):
    rows = [(e, t, float(e + t), float(e % 2), float(t > 1), 2.0 if e % 2 else None) for e in range(4) for t in range(4)]
    spec = PanelSpec("e", "t", "y", "d", "p", "ft")
    df = spark.createDataFrame(rows, "e int, t int, y double, d double, p double, ft double")
    assert {r["verdict"] for r in validate.validate(df, spec).collect()} == {"PASS"}
    bad = validate.validate(df.union(df.limit(1)), spec)
    assert {r["verdict"] for r in bad.collect()} == {"FAIL"} and "duplicate_keys" in {r["check"] for r in bad.collect()}


def test_reshape(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 3.0)], "k string, u double, v double")
    assert {tuple(r) for r in reshape.wide_to_long(df, ["k"], {"u": "U", "v": "V"}).collect()} == {("a", "U", 1.0), ("b", "U", 2.0), ("b", "V", 3.0)}
    long = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "t int, e string, v double")
    with pytest.raises(Exception, match="two rows"):
        reshape.pivot_wide(long, "t", "e", "v").collect()


def test_payloads(spark, tmp_path):
    j = lambda s: spark.createDataFrame([(s,)], "json string")
    assert readers.fred(j('{"observations":[{"date":"2020-01-01","value":"1.5"},{"date":"2020-01-02","value":"."}]}'), "S").count() == 1
    k = lambda name, s: spark.createDataFrame([(name, s)], "name string, json string")
    shape = '"structure":{"dimensions":{"observation":[{"name":"TIME_PERIOD","keyPosition":1}]}}'
    o = readers.oecd(k("FRA", '{"dataSets":[{"observations":{"0:2019":[4.0,0],"0:x":[1],"0:2020":[null]}}],' + shape + "}")).collect()
    assert [tuple(r) for r in o] == [("FRA", 2019, 4.0)]
    o = readers.oecd(k("FRA", '{"dataSets":[{"observations":{"0:1":[4.5]}}],' + shape.replace('"keyPosition":1', '"keyPosition":1,"values":[{"id":"2019"},{"id":"2020"}]') + "}")).first()
    assert tuple(o) == ("FRA", 2020, 4.5) and readers.oecd(k("A", "{}")).count() == 0
    time = '"dimension":{"time":{"category":{"index":{"2019":0,"2020":1},"label":{"2019":"2019"}}}}'
    assert tuple(readers.eurostat(k("DE", '{"value":{"1":7.0,"9":1.0},' + time + "}")).first()) == ("DE", 2020, 7.0)
    both = '{"value":{"3":7.0},"id":["geo","time"],"size":[2,2],"dimension":{"geo":{"category":{"index":{"X":0,"Y":1}}},' + time.split("{", 1)[1] + "}"
    assert tuple(readers.eurostat(k("DE", both)).first()) == ("Y", 2020, 7.0)
    import zipfile

    with zipfile.ZipFile(tmp_path / "trips.zip", "w") as z:
        z.writestr("trips.csv", "ride_id,start\na,2024-01-01\nb,\n")
    trips = readers.zipped_trips(spark, f"file://{tmp_path}", ["ride_id", "start", "bike"], "citi_bike_nyc", 2024, 1).orderBy("ride_id").collect()
    assert [tuple(r) for r in trips] == [("a", "2024-01-01", None, "citi_bike_nyc", 2024, 1), ("b", None, None, "citi_bike_nyc", 2024, 1)]
    n = readers.national_statistics(j('{"returndata":{"datanodes":[{"data":{"data":3.0,"hasdata":true},"wds":[{"wdcode":"reg","valuecode":"11"},{"wdcode":"sj","valuecode":"2020"}]}],"wdnodes":[{"wdcode":"reg","nodes":[{"code":"11","cname":"北京"}]}]}}')).first()
    assert tuple(n) == ("北京", 2020, 3.0)
    (tmp_path / "a.json").write_text("{}")
    readers.register(spark)
    assert spark.read.format("payloads").option("path", f"file://{tmp_path}").load().first()["name"] == "a"
    assert sinks.save(j("{}"), f"file://{tmp_path}/t") == "success" and sinks.save(j("{}"), f"file://{tmp_path}/t") == "cached"
    assert sinks.fresh(spark, f"file://{tmp_path}/t", 1.0)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿city,year,v\nx,2001,1\n", encoding="utf-8")
    assert readers.read_table(spark, f"file://{tmp_path}/a.csv").columns == ["city", "year", "v"]
    with pytest.raises(ValueError):
        readers.read_table(spark, "a.unknown")


def test_retry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return 7

    assert sinks.retry(call, 3, wait=waits.append) == 7 and waits == [1.0, 2.0, 4.0]


def test_html_tables(spark):
    html = "<table><tr><td colspan=3>City table</td></tr><tr><th>City</th><th>GDP 2019</th><th>GDP 2020</th></tr><tr><td>A</td><td>1,200</td><td>3万</td></tr><tr><td>B</td><td>5</td><td>-</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "id int, html string")
    got = html_tables.statistical_values(html_tables.table_cells(pages, "id", "html"), "id", "GDP", 2020).collect()
    assert [tuple(r) for r in got] == [(1, "A", 2020, 3e4)]


def test_gaps_maps_and_state(spark, tmp_path):
    needs = spark.createDataFrame([("gdp", "output", "yearly", "cn"), ("a", "a survey", None, None), ("b", "pilot list", None, None), ("c", "x", "city", "cn"), ("d", "x", None, None), ("e", "x", None, None)], "name string, description string, level string, place string")
    found = spark.createDataFrame([("gdp", "cn_gdp", 0.9, 1), ("gdp", "us_gdp", 0.6, 2), ("e", "k", 0.9, 1), ("d", "weak", 0.2, 1)], "query string, key string, score double, rank int")
    fetched = spark.createDataFrame([("e", "cached"), ("c", "error")], "name string, status string")
    report = reshape.gap_report(needs, found, fetched)
    got = {r["name"]: (r["section"], r["key"], r["alternatives"], r["tier"]) for r in report.collect()}
    assert got == {"gdp": ("available", "cn_gdp", "us_gdp", "A"), "a": ("needed", None, None, "B"), "b": ("needed", None, None, "C"), "c": ("needed", None, None, "C"), "d": ("needed", None, None, "B"), "e": ("fetched", None, None, "A")}
    assert tuple(reshape.gap_summary(report).first()) == (1, 1, 4)
    base = f"file://{tmp_path}"
    (tmp_path / "m.json").write_text('{"杭州": "330100", "宁波": "330200"}', encoding="utf-8")
    assert [tuple(r) for r in readers.entity_map(spark, f"{base}/m.json").orderBy("position").collect()] == [("杭州", "330100", 0), ("宁波", "330200", 1)]
    assert readers.entity_map(spark, f"{base}/none.json").count() == 0
    (tmp_path / "v.json").write_text('{"_note": "x", "gdp": {"description": "output", "keywords": ["a"], "level": "yearly"}}')
    assert [(r["key"], r["description"], r["keywords"]) for r in readers.variable_map(spark, f"{base}/v.json").collect()] == [("gdp", "output", ["a"])]
    assert readers.resolve(spark, f"{base}/x/m.json", base) == f"{base}/m.json" and readers.resolve(spark, f"{base}/m.json", base) == f"{base}/m.json"
    state = sinks.load_state(spark, f"{base}/state.json")
    for stage in (3, 2, 3):
        state = sinks.mark_stage_complete(spark, state, stage, {"n": stage, "x": "é"}, f"{base}/state.json")
    again = sinks.load_state(spark, f"{base}/state.json")
    assert again == state and again["pipeline"]["completed_stages"] == [2, 3] and again["stages"]["stage3"]["x"] == "é"


def test_small_helpers(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 1, None)], "entity_id string, year int, v double")
    assert clean.numeric_columns(df) == ["v"]
    x, name = clean.first_treated_column(df, "2018")
    assert x.first()[name] == 2018.0 and clean.first_treated_column(df, "v")[1] == "v"
    with pytest.raises(ValueError):
        clean.first_treated_column(df, "when")
    assert {tuple(r) for r in clean.forward_fill(df, "entity_id", "year", ["v"]).collect()} == {("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, None)}
    assert [tuple(r) for r in clean.forward_fill(df, None, "year", ["v"]).where("entity_id = 'a'").collect()][0] == ("a", 1, 1.0)
    assert column(spark, ["房价和收入", "x"], text.expand_query) == ["房价和收入 income disposable wage earnings house price real estate housing", "x"]


LEVEL_CASES = [
    ("city GDP", None, "city"), ("省级 income", None, "province"), ("Nationwide survey", None, "country"), ("日频 air", None, "daily"), ("月度 CPI", None, "monthly"), ("每年", None, "yearly"), ("stock index", None, "yearly"),
    ("city GDP", "月频", "monthly"), ("city GDP", "Daily Frequency", "daily"), ("city GDP", "weekly", "city"), ("annual city", "", "city"), (None, "省", "province"), (None, None, "yearly"),
]
PLACE_CASES = [
    ("中国 GDP", None, "cn"), ("Beijing air", None, "cn"), ("FRED series", None, "us"), ("trust", None, "us"), ("Germany and France", None, "eu"), ("跨国 panel", None, "global"), ("moon", None, "global"),
    ("GDP", "nbs", "cn"), ("Germany", "cn", "cn"), ("", "oecd", "eu"), (None, None, "global"),
]


def test_levels_and_places(spark):
    for cases, of in ((LEVEL_CASES, text.infer_level), (PLACE_CASES, text.infer_place)):
        df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, x string, hint string, want string")
        assert [tuple(r) for r in df.select("x", "hint", of(F.col("x"), F.col("hint")).alias("got")).collect()] == [tuple(c) for c in cases]


def _tokens_by_hand(x):
    chinese = lambda c: "\u4e00" <= c <= "\u9fff"
    found = {w.lower() for w in "".join(" " if chinese(c) else c for c in x).replace("_", " ").replace("-", " ").split() if len(w) > 1}
    only = [c for c in x if chinese(c)]
    return found | set(only) | {a + b for a, b in zip(only, only[1:])}


def _match_by_hand(q, t):
    q, t = (q or "").lower().strip(), (t or "").lower().strip()
    if not q or not t:
        return 0.0
    if q == t:
        return 1.0
    if q in t:
        return 0.85
    if t in q:
        return 0.8
    chinese = lambda x: any("\u4e00" <= c <= "\u9fff" for c in x)
    if chinese(q) and chinese(t) and any(q[i : i + 2] in t for i in range(len(q) - 1)):
        return 0.7
    own = _tokens_by_hand(q)
    if chinese(q):
        own |= _tokens_by_hand(q + "".join(" " + v for k, v in text.ENGLISH.items() if k in q))
    return 0.5 * min(1.0, len(own & _tokens_by_hand(t)) / len(own)) if own else 0.0


TEXTS = ["房价", "城镇化 率", "社保-支出", "house price index", "urban_population share", "Social Security", "财政收入", "gdp", "GDP per capita", "城市 房 价", "x", "市", "农村居民 x y", "", None, "so2, no2", "外资 fdi", "a-b_c", "人均 收入"]


def test_matches_of_all_pairs_of_texts(spark):
    df = spark.createDataFrame([(a, b) for a in TEXTS for b in TEXTS], "q string, t string")
    for r in df.select("q", "t", text.text_match(F.col("q"), F.col("t")).alias("s")).collect():
        assert r["s"] == pytest.approx(_match_by_hand(r["q"], r["t"])), (r["q"], r["t"])
    assert len(text.ENGLISH) == 46 and _match_by_hand("城镇化 率", "urban rate") > 0


def test_requirements_find_every_entry_that_scores(spark):
    """Blocking by words and letters loses nothing: all pairs by hand, at a low and at the usual limit."""
    needs = [(f"n{i}" if i % 3 else x, x, [None, "city", "weekly"][i % 3]) for i, x in enumerate(t for t in TEXTS if t)] + [("gdp", None, None)]
    entries = [(f"k{i}" if i % 2 else (x or "none"), x, ["city", "city/province", None][i % 3]) for i, x in enumerate(TEXTS)]
    want_level = {r["name"]: r["l"] for r in spark.createDataFrame([(n, d or n, v) for n, d, v in needs], "name string, d string, v string").select("name", text.infer_level(F.col("d"), F.col("v")).alias("l")).collect()}
    for least in (0.3, 0.2):
        got = {(r["name"], r["key"]): r["score"] for r in reshape.search_requirements(spark.createDataFrame([(*n, None) for n in needs], "name string, description string, level string, place string"), spark.createDataFrame(entries, "key string, search_text string, level string"), 100, least).collect()}
        want = {}
        for name, d, _ in needs:
            for key, t, level in entries:
                fit = 1.0 if want_level[name] in (level or "") or (level or "") in want_level[name] else 0.5
                s = 0.35 * _match_by_hand(d or name, t) + 0.35 * _match_by_hand(name, key) + 0.15 * fit + 0.15 * (name.lower() == key.lower())
                if s >= least:
                    want[name, key] = pytest.approx(s, abs=6e-4)
        assert got == want and len(want) > 20
