"""Operators against brute force and on edge cases."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from boardweave.functions import titles as T
from boardweave.operators import dedup, graph, ingest, report, screening, state
from boardweave.sources import files, sinks
from boardweave.streaming import feed


def test_connected_matches_union_find(spark):
    random.seed(4)
    edges = [(f"n{random.randrange(120):03}", f"n{random.randrange(120):03}") for _ in range(90)] + [("h", f"s{i}") for i in range(60)] + [(None, "x"), ("y", "y")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.value: r.root for r in graph.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_similar_titles_match_brute_force(spark):
    random.seed(5)
    base = ["".join(random.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(random.randint(8, 16))) for _ in range(25)]
    titles = base + [t[:3] + "新" + t[4:] for t in base[:15]] + [t + "附表" for t in base[5:12]]
    data = [(f"u{i}", "x", f"2026-09-{i % 28 + 1:02}", t) for i, t in enumerate(titles)]
    got = {frozenset((r.title_a, r.title_b)) for r in dedup.similar(spark.createDataFrame(data, "url string, account string, date string, title string")).collect()}
    order = {t: (d, t) for _, _, d, t in sorted(data, key=lambda r: r[2])}
    want = set()
    for i, a in enumerate(sorted(order, key=order.get, reverse=True)):
        for b in sorted(order, key=order.get, reverse=True)[i + 1 :]:
            if SequenceMatcher(None, a, b).ratio() >= 0.8 or (min(len(a), len(b)) >= 5 and (a in b or b in a)):
                want.add(frozenset((a, b)))
    assert got == want


def test_upsert_delete_and_clear(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (4, "d"), (4, "e")], "k int, v string")
    assert sorted(map(tuple, state.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, None), (4, "e")]
    assert state.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0
    assert state.delete(old, new, ["k"]).count() == 2


def test_first_run_is_a_baseline(spark):
    none = spark.createDataFrame([], "url string, first_seen string, last_seen string")
    rows = spark.createDataFrame([("u",), ("u",), (None,)], "url string")
    first = ingest.first_seen(none, rows, "2026-01-01").collect()
    assert [tuple(r) for r in first] == [("u", "2026-01-01", "2026-01-01", False)]


def test_limiter_ignores_rejected_attempts(spark):
    at = [0, 1, 2, 100, 301, 302]
    df = spark.createDataFrame([("c", t, i) for i, t in enumerate(at)], "client string, at bigint, id bigint")
    got = [r.accepted for r in feed.limited_attempts(df, 2, 300).orderBy("id").collect()]
    assert got == [True, True, False, False, True, True]


def test_stream_keeps_the_newest_row_of_a_link(spark, tmp_path):
    day = lambda n: datetime(2026, 6, 1) + timedelta(n)
    schema = "row_id bigint, `文章链接` string, fetched_at timestamp"
    parts = [[(1, "a", day(0)), (2, "a", day(100)), (3, "b", day(5)), (9, None, day(1))], [(4, "b", day(1)), (5, "c", day(0)), (7, "d", day(3)), (6, "d", day(3))], [(8, "a", day(50)), (10, "e", day(2))]]
    at = {x: str(tmp_path / x) for x in ("in", "table", "checkpoint")}
    for p in parts:  # one micro-batch each
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(at["in"])
        feed.upsert_batches(feed.article_stream(spark, at["in"], schema), at["table"], at["checkpoint"], ["文章链接"], ["fetched_at", "row_id"]).awaitTermination()
    rows = spark.createDataFrame([r for p in parts for r in p if r[1]], schema)
    want = state.upsert(rows.limit(0), rows, ["文章链接"], ["fetched_at", "row_id"])
    got = sorted(map(tuple, feed.upserted(spark, at["table"], rows.schema).select(*want.columns).collect()))
    assert got == sorted(map(tuple, want.collect())) and [r[0] for r in got] == [2, 3, 5, 7, 10]


def test_reusable(spark):
    data = [("kept", 2, "x", True), ("skipped", 2, "x", True), ("kept", None, "云岸2030届校园招聘", True), ("kept", None, "线下宣讲 | 云岸2030届招聘", False), ("skipped", None, "溪谷学院教师招聘", False)]
    df = spark.createDataFrame(data, "kind string, v int, title string, want boolean")
    assert all(r[0] == r[1] for r in df.select(screening.reusable(F.col("kind"), F.col("v"), F.col("title")), "want").collect())


def test_account_files_with_bom_and_line_breaks(spark, tmp_path):
    head = "﻿\"公众号\",\"发布日期\",\"文章标题\",\"文章链接\",\"来源\"\n"
    (tmp_path / "甲.csv").write_text(head + '"甲","2026-08-01","a ""b"", c","u1","s"\n"甲","","x\ny","u2","s"\n', encoding="utf-8")
    (tmp_path / "汇总-x.csv").write_text(head + '"乙","","t","u3","s"\n', encoding="utf-8")
    got = sorted((r["文章标题"], r["发布日期"], r["公众号"]) for r in files.account_files(spark, str(tmp_path)).collect())
    assert got == [('a "b", c', "2026-08-01", "甲"), ("x\ny", "", "甲")]
    assert files.account_files(spark, str(tmp_path / "none")).count() == 0


def test_clicked_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"version":1,"urls":{"https://p/a":"2026-08-01T00:00:00+08:00","https://p/b":5,"https://p/d":"whenever","https://p/e":null,"http://q/c":"x"}}')
    got = {r.url: r.clicked_at for r in files.clicked_file(spark, str(tmp_path / "c.json"), "https://p/", "now").collect()}
    assert got == {"https://p/a": "2026-08-01T00:00:00+08:00", "https://p/b": "now", "https://p/d": "whenever", "https://p/e": "now"}


def test_failing_model_gives_error_rows(spark):
    def model(t):
        if t == "bad":
            raise ValueError("no")
        return '前 {"a":1} 后'

    df = spark.createDataFrame([("u1", "ok"), ("u2", "bad"), ("u3", None)], "url string, text string")
    got = {r.url: (r.cut, r.error) for r in screening.extracted(df, model).select("url", "error", screening.json_cut(F.col("reply")).alias("cut")).collect()}
    assert got == {"u1": ('{"a":1}', None), "u2": ("", "no"), "u3": ('{"a":1}', None)}


def test_entity_and_classes(spark):
    df = spark.createDataFrame([("云岸2027届校园招聘正式启动",), (None,)], "t string")
    assert [r[0] for r in df.select(T.entity(F.col("t"))).collect()] == ["云岸", ""]


def test_days_are_merged_by_link(spark, tmp_path):
    at, schema = str(tmp_path / "days"), "url string, date string, title string, row_id bigint"
    sinks.daily_partitions(spark.createDataFrame([("a", "2030-01-01", "old", 1), ("b", "2030-01-01", "kept", 2), ("c", "2030-01-02", "other", 3)], schema), at, "2030-01-09", ["row_id"])
    sinks.daily_partitions(spark.createDataFrame([("a", "2030-01-01", "new", 4), ("b", "2030-01-01", "late", 0), ("d", "", "undated", 5)], schema), at, "2030-01-09", ["row_id"])
    got = sorted((r.url, r.title, str(r.day)) for r in spark.read.parquet(at).collect())
    assert got == [("a", "new", "2030-01-01"), ("b", "kept", "2030-01-01"), ("c", "other", "2030-01-02"), ("d", "undated", "2030-01-09")]


def test_short_answers_of_a_judge_are_refused(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "title_a string, title_b string").coalesce(1)
    assert [r.duplicate for r in dedup.adjudicated(pairs, lambda p: [x == "a" for x, _ in p]).collect()] == [True, False]
    with pytest.raises(Exception, match="1 verdicts on 2 pairs"):
        dedup.adjudicated(pairs, lambda p: [True]).collect()


def test_components_of_a_chain_and_nothing(spark):
    chain = spark.createDataFrame([(f"{i + 1:03}", f"{i:03}") for i in range(40)] + [("x", "x"), (None, "y")], "a string, b string")
    assert {(r.value, r.root) for r in graph.connected(chain).collect()} == {(f"{i:03}", "000") for i in range(41)}
    assert graph.connected(chain.limit(0)).count() == 0


def test_ranges_and_accounts(spark):
    assert report.date_range("") == ("20260710", "99999999") and report.date_range("2030-01-02") == ("20300102", "20300102")
    assert report.date_range("..20300102") == ("20260710", "20300102")
    with pytest.raises(ValueError):
        report.only(spark.createDataFrame([("a",)], "account string"), [" "])


def test_chosen_accounts_without_rows_give_none(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "account string, n int")
    assert [r.n for r in report.only(rows, [" b ", "c"]).collect()] == [2]
    assert report.only(rows, ["c"]).count() == 0 and report.only(rows.limit(0), ["a"], ["a"]).count() == 0
    with pytest.raises(ValueError):
        report.only(rows, ["b"], ["a"])


def test_best_candidates_come_first(spark):
    rows = [(f"u{i}", "x", "2026-09-01", t) for i, t in enumerate(["甲乙丙丁戊己庚辛", "甲乙丙丁戊己庚辛壬", "甲乙丙丁戊己庚新", "子丑寅卯辰巳午未", "子丑寅卯辰巳午申"])]
    found = dedup.similar(spark.createDataFrame(rows, "url string, account string, date string, title string"))
    all_ = sorted(map(tuple, found.collect()), key=lambda r: (r[2], r[0], r[1]), reverse=True)
    assert len(all_) == 4 and [tuple(r) for r in dedup.top_candidates(found, 3).collect()] == all_[:3]


def test_the_best_candidates_are_found_from_the_top(spark, monkeypatch):
    words = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉"
    base = [words[i:] + words[:i] for i in range(0, 20, 4)]
    titles = [*base, *[t[:-1] for t in base], *[t[:9] + "天" + t[10:] for t in base], *[t[:5] + "天地" + t[7:14] + "人" + t[15:] for t in base], "招聘" + base[0][::-1], base[0][::-1] + "公告", "地" * 30 + "甲", "地" * 30 + "乙"]
    df = spark.createDataFrame([(f"u{i}", "p", f"2026-08-{i % 28 + 1:02d}", t) for i, t in enumerate(titles)], "url string, account string, date string, title string")
    all_ = [tuple(r) for r in dedup.top_candidates(dedup.similar(df), 10_000).collect()]
    scores = [r[2] for r in all_]
    best, high = scores.count(1.0), sum(x >= 0.95 for x in scores)
    assert 0 < best < high < len(all_)
    asked, real = [], dedup._similar
    monkeypatch.setattr(dedup, "_similar", lambda t, held, brands, *at: asked.append(at) or real(t, held, brands, *at))
    for k, levels in ((best, 1), (best + 1, 2), (high + 1, 3)):
        asked.clear()
        assert [tuple(r) for r in dedup.top_similar(df, k).collect()] == all_[:k]
        assert asked == [(1.0, 1.0), (0.95, 0.95), (0.8, 0.85)][:levels]


def test_a_pair_is_scored_once(spark):
    df = spark.createDataFrame([("u", "p", "2026-08-01", "甲乙丙丁戊己庚辛"), ("v", "p", "2026-08-02", "甲乙丙丁戊己庚壬")], "url string, account string, date string, title string")
    found = dedup.similar(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and plan.count("ArrowEvalPython") + plan.count("MapInPandas") == 1
