import json
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lintmill.operators import hot_keys as H
from lintmill.operators import lint as ops
from lintmill.operators import nested_reports as N
from lintmill.rules.engine import Options
from lintmill.rules.rulesets import Ruleset
from lintmill.sources import scripts as S
from lintmill.sources.scripts import from_texts, read_directory, read_ruleset


# -- hot keys ------------------------------------------------------------------


def rows_of_keys(seed=1, n=3000):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["warm", None, "x%d" % rng.randint(0, 40)]), rng.choice([None, rng.randint(-(2**62), 2**62), rng.randint(0, 9)])) for _ in range(n)]


def test_exact_quantiles(spark, monkeypatch):
    rows = rows_of_keys()
    df = spark.createDataFrame([(k, v, "a", 1) for k, v in rows], "k string, v long, key string, lo int")
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    want = {}
    for k, vs in by.items():
        vs.sort()
        for q in (0.0, 0.5, 1.0):
            want[k, q] = vs[max(1, math.ceil(q * len(vs))) - 1]
    for most_hot, finish, bins in ((1, 10**6, 4_000_000), (10, 10, 64), (10**6, 0, 4_000_000), (60, 50, 4_000_000)):
        monkeypatch.setattr(H, "MOST_BINS", bins)
        got = H.select_ranks(df, "k", "v", [0.0, 0.5, 1.0], most_hot, finish).collect()
        assert {(r["key"], r["q"]): r["value"] for r in got} == want and len(got) == len(want), (most_hot, finish)
    assert H.select_ranks(df.limit(0), "k", "v", [0.5]).count() == 0
    none = H.quantiles_per_key(df.selectExpr("k", "cast(null as long) AS v"), "k", "v", [0.5]).collect()
    assert {r["key"]: (r["n"], r["v0"]) for r in none} == {k: (n, None) for k, n in Counter(k for k, _ in rows).items()}


def test_quantiles_of_extremes_and_times(spark):
    low, high = -(2**63), 2**63 - 1
    df = spark.createDataFrame([(True, v) for v in (low, -1, 0, high)] + [(False, 5)] * 9 + [(None, high)] * 3, "k boolean, v long")
    for most_hot in (1, 100):
        got = {r["key"]: (r["n"], r["v0"], r["v1"], r["v2"]) for r in H.quantiles_per_key(df, "k", "v", [0.25, 0.5, 1.0], most_hot, 0).collect()}
        assert got == {True: (4, low, -1, high), False: (9, 5, 5, 5), None: (3, high, high, high)}


def test_a_hot_key_among_many_does_not_meet_in_one_task(spark):
    """More keys than are selected by histograms, one of them with half of all rows: no task of any shuffle reads its rows."""
    df = spark.range(60_000).selectExpr("if(id % 2 = 0, 'hot', concat('k', id % 20001)) AS k", "id * 7919 % 100003 AS v")
    got = H.quantiles_per_key(df, "k", "v", [0.5], 1000, 100)
    assert {r["key"]: r["v0"] for r in got.where("key = 'hot'").collect()} == {"hot": sorted(i * 7919 % 100003 for i in range(0, 60_000, 2))[14_999]}
    assert got.count() == df.select("k").distinct().count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and plan.index("Window") < plan.index("LeftAnti")  # the hot key leaves before the rows are dealt by key


def test_heavy_keys(spark, monkeypatch):
    rows = rows_of_keys(2)
    df = spark.createDataFrame(rows, "k string, v long")
    c = Counter(k for k, _ in rows)
    got = {r["key"]: r["n"] for r in H.heavy_keys(df, "k", 0.05).collect()}
    assert got == {k: n for k, n in c.items() if k is not None and n >= 0.05 * len(rows)}
    for bits in (1, 2, 32):
        monkeypatch.setattr(H, "HASH_BITS", bits)
        assert {r["key"]: r["n"] for r in H.heavy_keys(df, "k", 0.05).collect()} == got
    assert {r["total"] for r in H.heavy_keys(df, "k", 0.05).collect()} == {len(rows)}
    assert H.heavy_keys(df.where("k is null"), "k", 0.05).count() == 0
    assert H.heavy_keys(df.limit(0), "k", 0.05).count() == 0


def test_distinct_per_key(spark):
    rows = rows_of_keys(3)
    df = spark.createDataFrame(rows, "k string, v long")
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, set()).add(v)
    assert {r["key"]: r["distinct"] for r in H.distinct_per_key(df, "k", "v").collect()} == {k: len(v) for k, v in want.items()}


# -- nested reports --------------------------------------------------------------

DIAG = {"code": "c1", "message": "m", "range": {"start": {"line": 1, "character": 2}, "end": {"line": 1, "character": 3}}, "data": {"code": "inner", "related": [{"filePath": "other"}]}}


@pytest.mark.parametrize(
    "payload, want",
    [
        ({"files": [{"filePath": "a", "diagnostics": [DIAG, None, {"message": "x"}]}, None, {"diagnostics": DIAG}]}, [(0, 0, "a", "c1"), (0, 2, "a", ""), (2, 0, "", "c1")]),
        ({"Result": {"Files": {"FilePath": "a", "Diagnostics": [{"Code": "C"}]}}}, [(0, 0, "a", "C")]),
        (json.dumps({"files": [{"filePath": "a", "diagnostics": [DIAG]}]}), [(0, 0, "a", "c1")]),
        ({"files": None}, []),
        ({"files": [{"filePath": "a", "diagnostics": []}]}, []),
        ([{"files": [{"filePath": None, "diagnostics": [{"code": 5}]}]}], [(0, 0, "", "5")]),
    ],
)
def test_found(spark, payload, want):
    df = spark.createDataFrame([(7, json.dumps(payload), "x")], "result_id long, payload string, type string")
    assert sorted((r["file_ord"], r["diag_ord"], r["file_path"], r["code"]) for r in N.found(df).collect()) == want


def test_incomplete_and_repeated(spark):
    good = json.dumps({"files": [{"filePath": "a", "diagnostics": [DIAG]}]})
    df = spark.createDataFrame([(1, None), (2, ""), (3, good[:-5]), (4, good), (4, good), (None, "﻿" + good)], "result_id long, payload string")
    assert sorted((r["result_id"] or 0) for r in N.found(df).collect()) == [0, 4, 4]
    assert [r["complete"] for r in N.results_table(df).orderBy("result_id").collect()] == [True, False, False, False, True, True]
    assert N.found(df.limit(0)).count() == 0


def test_intervals_contain(spark):
    rng = random.Random(5)
    files = [{"filePath": f"f{i}", "diagnostics": [dict(DIAG, code=f"{i}.{j}") for j in range(rng.randint(0, 4))]} for i in range(6)]
    df = spark.createDataFrame([(1, json.dumps({"files": files}))], "result_id long, payload string")
    fs = {r["file_ord"]: r for r in N.files_table(df).collect()}
    ds = N.diagnostics_table(df).collect()
    for r in ds:
        f = fs[r["file_ord"]]
        assert f["pre"] < r["pre"] and r["post"] < f["post"] and r["code"] == f"{r['file_ord']}.{r['diag_ord']}" and r["parent_pre"] == f["pre"]
    assert sorted(r["parent_pre"] for r in N.ranges_table(df).collect()) == [r["pre"] for r in ds]


def test_every_node_has_its_innermost_parent(spark):
    place = {"start": {"line": 1, "character": 2}, "end": {"line": 3}}
    related = [{"filePath": "o", "range": place}, None, {"filePath": "p", "related": [{"message": "deeper", "range": place}]}]
    d = {"Code": 7, "range": [4, 5], "tags": ["a", None, "b"], "data": {"ruleId": "r", "x": [1, {"y": None}], "related": related}, "note": "n"}
    payload = json.dumps({"files": [{"diagnostics": [d, dict(d, tags=None, data=json.dumps(d["data"]))]}]})
    df = spark.createDataFrame([(1, payload), (1, payload)], "result_id long, payload string").selectExpr("*", "1 AS copy", "2 AS ord")
    rel = N.related_table(df).where("copy = 0 or copy > 0").collect()
    assert len({r["copy"] for r in rel}) == 2 and len(rel) == 12
    one = sorted((r for r in rel if r["copy"] == rel[0]["copy"]), key=lambda r: r["pre"])
    assert [(r["diag_ord"], r["ord"], r["parent_type"], r["file_path"], r["message"]) for r in one] == [
        (k, *x) for k in (0, 1) for x in ((0, "data", "o", None), (2, "data", "p", None), (0, "related", None, "deeper"))
    ]
    ranges = sorted((r for r in N.ranges_table(df).collect() if r["copy"] == rel[0]["copy"]), key=lambda r: r["pre"])
    assert [r["parent_pre"] for r in ranges] == [r["pre"] for r in one if r["file_path"] != "p"]
    assert tuple(ranges[0][c] for c in ("parent_type", "start_line", "start_character", "end_line", "end_character", "more")) == ("related", "1", "2", "3", None, None)
    data = N.data_table(df).first()
    assert (data["rule_id"], data["parent_type"], json.loads(data["more"])) == ("r", "diagnostic", {"x": [1, {"y": None}]})
    assert [(r["diag_ord"], r["ord"], r["tag"]) for r in N.tags_table(df).where("diag_ord = 0").collect()] == [(0, 0, "a"), (0, 2, "b")] * 2
    assert json.loads(N.diagnostics_table(df).first()["more"]) == {"range": [4, 5], "note": "n"}


def test_nesting_has_no_bound(spark):
    inner = {"files": [{"filePath": "a", "diagnostics": [{"code": "x"}]}]}
    wrapped, text = inner, json.dumps(inner)
    for _ in range(40):
        wrapped = {"result": wrapped}
    for _ in range(6):
        text = json.dumps(text)
    deep = 50_000
    huge = '{"files": [{"filePath": "a", "diagnostics": [{"code": "x", "data": {"v": ' + "[" * deep + "]" * deep + "}}]}]}"
    far = '{"w": ' * deep + json.dumps(inner) + "}" * deep
    rows = [(1, json.dumps(wrapped)), (2, text), (3, huge), (4, far), (5, huge[:-1]), (6, json.dumps({"a": "[1", "b": text}))]
    df = spark.createDataFrame(rows, "result_id long, payload string")
    assert sorted(r["result_id"] for r in N.found(df).collect()) == [1, 2, 3, 4, 6]
    assert [r["complete"] for r in N.results_table(df).orderBy("result_id").collect()] == [True, True, True, True, False, True]
    assert len(N.data_table(df).first()["more"]) > 2 * deep


def test_deep_parser_agrees_with_the_standard_one():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(["{", "}", "[", "]", '"a"', ":", ",", "1", "-2.5e3", "true", "null", " ", '"b\\""']) for _ in range(rng.randint(1, 9)))
        try:
            want = json.loads(text)
        except ValueError:
            with pytest.raises(ValueError):
                N._loads_deep(text)
        else:
            assert N._loads_deep(text) == want
    value = {"a": [1, {"b": []}, None, "x"], "c": {}, "d": {"e": [[]]}}
    assert N._loads_deep(json.dumps(value)) == value


# -- lint ------------------------------------------------------------------------


def test_lint_pipeline(spark):
    s = from_texts(spark, [("a.sql", "SELECT * FROM dbo.t;"), ("b.sql", None or "SELECT a FROM dbo.t WHERE a = NULL;"), ("c.sql", "SELECT FROM")])
    s = s.withColumn("code", F.lit("clash")).unionByName(s.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("code", F.lit("x")))
    d = ops.lint(s, Options(ruleset=Ruleset.of_preset("recommended"))).cache()
    assert {r["code"] for r in d.collect()} >= {"avoid-select-star", "avoid-null-comparison", "parse-error"}
    row = ops.summary(d).first()
    assert row["any_parse_error"] and row["errors"] == 2 and ops.exit_status(d) == 2
    assert any("b.sql:1:27: Error: " in r["value"] and "(avoid-null-comparison,Fixable)" in r["value"] for r in ops.report_text(d).collect())
    report = json.loads(ops.report_json(d.where("script_id = 0")).first()["report"])
    assert report["files"][0]["filePath"] == "a.sql" and report["files"][0]["diagnostics"]
    assert ops.lint(s.limit(0)).count() == 0
    assert ops.exit_status(d.limit(0)) == 0


def test_suppress_ranges(spark):
    d = spark.createDataFrame([(1, "A", 5), (1, "b", 5), (1, None, 5), (2, "A", 5), (1, "A", 9)], "script_id long, code string, start_line int")
    r = spark.createDataFrame([(1, "a", 5, 9), (1, "a", 5, 9), (2, None, 0, None), (None, None, 0, None)], "script_id long, rule_id string, start_line int, end_line int")
    assert sorted((x["script_id"], x["code"] or "", x["start_line"]) for x in ops.suppress(d, r).collect()) == [(1, "", 5), (1, "A", 9), (1, "b", 5)]


def test_latest_deliveries(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 1, t), (1, 2, t + timedelta(1)), (1, 1, t + timedelta(1)), (None, 3, t), (None, 3, t)]
    d = spark.createDataFrame(rows, "diag_id long, script_id long, ingested_at timestamp")
    assert sorted(((x["diag_id"] or 0), x["script_id"]) for x in ops.latest_deliveries(d).collect()) == [(0, 3), (0, 3), (1, 1)]


def test_directory_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_text("SELECT 1", encoding="utf-8")
    (tmp_path / "sub" / "B.SQL").write_bytes("SELECT N'é'".encode("utf-16"))
    (tmp_path / "sub" / "c.bak.sql").write_text("x")
    (tmp_path / "big.sql").write_text("x" * 500)
    scripts, rejected = read_directory(spark, str(tmp_path), ["*.bak.sql"], max_bytes=100)
    assert sorted(r["text"] for r in scripts.collect()) == ["SELECT 1", "SELECT N'é'"]
    assert [r["reason"] for r in rejected.collect()] == ["too large"]
    assert ops.lint(scripts).count() >= 0 and scripts.select("script_id").distinct().count() == 2
    some, rejected = S.read_files(spark, [str(tmp_path / "a.sql"), str(tmp_path / "none.sql")])
    assert [r["text"] for r in some.collect()] == ["SELECT 1"] and [r["reason"] for r in rejected.collect()] == ["not found"]
    assert S.read_files(spark, [str(tmp_path / "none.sql")])[0].count() == 0
    (tmp_path / "r.json").write_text('{"rules": [{"id": "a", "severity": "error"}, {"id": "a", "severity": "none"}]}')
    assert [tuple(r) for r in read_ruleset(spark, str(tmp_path / "r.json")).collect()] == [("a", "none")]


TEXTS = {
    "cp1252": ["PRINT 'cafés fermés'", "-- Größe der Tabelle über 5 %, “außen”", "-- niño, ação, à bientôt", "SELECT '5 €'"],
    "cp932": ["-- この手続きは月が締まるまで実行しない", "PRINT N'注文の合計'; -- テスト", "SELECT 1 AS [顧客番号]"],
    "gb18030": ["-- 这个存储过程在月份没有关闭之前不能运行", "PRINT '我们的数据只保留最新的一行'"],
    "cp1251": ["-- Ночное задание не должно работать", "PRINT 'Каждая группа'"],
}


def test_decoding_by_plausibility():
    for name, texts in TEXTS.items():
        for text in texts:
            assert S.decode(text.encode(name))[0] == text, (name, text)
    for text in ("", "SELECT 1", "SELECT N'é日本'"):
        for name in ("utf-8", "utf-8-sig", "utf-16-le-sig", "utf-16-be-sig", "utf-32-le-sig", "utf-32-be-sig"):
            raw = S.encode(text, name)
            got = S.decode(raw)
            assert got[0] == text and S.encode(*got) == raw
    assert S.decode(S.encode("日本", "cp1252")) == ("日本", "utf-8-sig")


def test_fixed_scripts_are_written_in_their_encoding(spark, tmp_path):
    bodies = {"a.sql": "SELECT a FROM dbo.t WHERE a <> 1 AND b = 'cafés'", "b.sql": "exec dbo.p; -- 日本", "c.SQL": "SELECT a\nFROM dbo.t;"}
    names = {"a.sql": "cp1252", "b.sql": "utf-16-be-sig", "c.SQL": "utf-8"}
    for n, b in bodies.items():
        (tmp_path / n).write_bytes(S.encode(b, names[n]))
    scripts, _ = read_directory(spark, str(tmp_path))
    rules = Options(ruleset=Ruleset({"normalize-execute-keyword": "inherit", "semicolon-termination": "inherit"}))
    fixed = ops.fix(scripts, rules)
    want = {r["file_path"].rsplit("/", 1)[1]: r["fixed_text"] for r in fixed.collect() if r["changed"]}
    done = S.write_changed(fixed, scripts).collect()
    assert len(done) == len(want) == 2 and all(r["error"] is None for r in done)
    for n, b in bodies.items():
        assert (tmp_path / n).read_bytes() == S.encode(want.get(n, b), names[n])
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(bodies)
    bad = spark.createDataFrame([("/proc/none/x.sql", "x", None), (None, "x", None), ("y.sql", None, None)], "file_path string, text string, encoding string")
    assert [r["error"] is not None for r in S.write_scripts(bad).collect()] == [True]


def test_status_and_catalogue(spark):
    s = from_texts(spark, [("a.sql", "SELECT a FROM dbo.t;")])
    assert ops.run_status(lambda: ops.lint(s.limit(0))) == 0
    assert ops.run_status(lambda: ops.lint(s, Options(ruleset=Ruleset.of_rule("no-such-rule")))) == 3
    assert ops.run_status(lambda: 1 / 0) == 4
    every = ops.rule_catalog(spark)
    assert ops.rule_catalog(spark, fixable=True).count() == every.where("fixable").count() < every.count()
    assert ops.rule_catalog(spark, category="security").count() == every.where("lower(category) = 'security'").count() > 0
    assert ops.rule_catalog(spark, enabled=Ruleset.of_preset("security-only")).count() == 14


def test_stream(spark, tmp_path):
    from lintmill.streaming.lint_stream import lint_stream, read_stream

    s = from_texts(spark, [("a.sql", "SELECT * FROM dbo.t;")])
    s.write.parquet(str(tmp_path / "in"))
    q = lint_stream(read_stream(spark, str(tmp_path / "in"), s.schema)).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM found WHERE code = 'avoid-select-star'").count() == 1


def test_every_oracle_names_a_query():
    import __spark_entry__ as e

    assert e.oracle_sql().keys() <= e.queries().keys()


# -- queries over all T-SQL scripts --------------------------------------------------


def test_reports_fixes_and_formats_take_all_tsql(spark, tmp_path):
    from lintmill.plans import generated, tables

    paths = ["a.sql", "<stdin>", "b.SQL ", None, "noext", "c.json", "d.XML"]
    rows = [(i, p, "select * from dbo.t where a = null") for i, p in enumerate(paths)]
    spark.createDataFrame(rows, "script_id long, file_path string, text string").write.parquet(f"{tmp_path}/scripts.parquet")
    d = str(tmp_path)
    reports = {r["script_id"]: r["report"] for r in tables.lint_report(spark, d).collect()}
    assert sorted(reports) == [0, 1, 2, 3, 4] and all("avoid-select-star" in x for x in reports.values())
    lines = [r["value"] for r in tables.lint_text(spark, d).collect()]
    assert sum("(avoid-select-star" in x for x in lines) == 5
    assert sum(r["scripts"] for r in tables.fix_all(spark, d).collect()) == 5
    assert generated.tsql_scripts(spark, d).count() == 5
    assert [tuple(r) for r in generated.format_twice(spark, d).collect()] == [(0,)]
