"""The training-data operators on small fixtures: brute force, round trips and edge cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boardweave.functions.width import fold_py
from boardweave.llm import canonical, components, formatting, incremental, leakage, links, mapping, near_titles, stuffing, tokenizer, variants

TITLES = "row_id bigint, t string, `letters` int"
CITIES = [(1, "栖沐渡", "苍原省", "Qimudu"), (2, "梧煦浦", "沅北省", "Wuxupu"), (3, "煦茂浦", "磐西省", "Xumaopu")]
UNITS = [(1, "栖沐渡黎苍宁绍软件有限公司", "Licangningshao Software", "栖沐渡"), (2, "梧煦浦骏沛茶笛软件设计院", "Junpeichadi Software", "梧煦浦"), (3, "煦茂浦紫棠珀沐数据技术研究院", "Zitangpomu Data Technology", "煦茂浦"), (4, "栖沐渡昀缇隼峰数据技术集团有限公司", "Yuntisunfeng Data Technology", "栖沐渡")]


def dims(spark):
    return spark.createDataFrame(CITIES, "city_id bigint, city_name string, province string, latin_name string"), spark.createDataFrame(UNITS, "unit_id bigint, unit_name string, latin_name string, home_city string")


def test_formatting_copies(spark):
    data = [(5, "甲乙丙 | 丁戊２１日", 0), (2, "【丁戊21日】甲_乙丙", 0), (9, "甲乙丙丁戊12日", 0), (3, "", 0), (4, None, 0), (7, "★ ·", 0), (8, "Ａb c", 0), (1, "abC!", 0), (1, "abC!", 0)]
    df = spark.createDataFrame(data, TITLES)
    got = sorted((r.keep_id, r.copy_id) for r in formatting.copies(df, "row_id", "t").collect())
    assert got == [(1, 8), (2, 5)]
    assert {r.keep_id: r.copies for r in formatting.representatives(df, "row_id", "t").collect()} == {1: 3, 2: 2, 9: 1}
    assert formatting.copies(df.limit(0), "row_id", "t").count() == 0


def brute_links(forms, threshold):
    out = set()
    for i, (a, s) in enumerate(forms):
        for b, t in forms[:i]:
            x, y = (Counter(u[k : k + 2] for k in range(len(u) - 1)) for u in (s, t))
            if len(s) > 1 and len(t) > 1 and 2 * sum((x & y).values()) >= threshold * (len(s) + len(t) - 2) - 1e-9:
                out.add((min(a, b), max(a, b)))
    return out


def mutated(rng, n):
    base = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳") for _ in range(rng.randint(6, 30))) for _ in range(n)]
    out = list(base)
    for t in base:
        for _ in range(2):
            k = rng.randrange(len(t))
            out.append(t[:k] + rng.choice(["", "新", t[k] * 2]) + t[k + 1 :])
    return sorted(set(out))


@pytest.mark.parametrize("shard_rows", [20_000, 4])
def test_near_links_match_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(near_titles, "SHARD_ROWS", shard_rows)
    forms = list(enumerate(mutated(random.Random(7), 40)))
    got = {(r.a, r.b) for r in near_titles.near_links(spark.createDataFrame(forms, "vid bigint, form string")).collect()}
    assert got == brute_links(forms, near_titles.THRESHOLD)


def test_near_pairs_edges(spark):
    data = [(1, "甲乙丙丁戊己庚辛壬癸", 0), (2, "甲乙丙丁戊己庚辛壬", 0), (3, "甲乙丙丁戊己庚辛壬 癸", 0), (4, None, 0), (5, "", 0), (6, "甲", 0), (7, "x" * 3000, 0)]
    got = sorted(map(tuple, near_titles.near_pairs(spark.createDataFrame(data, TITLES), "row_id", "t").collect()))
    assert got == [(1, 2), (2, 3)]
    assert near_titles.near_pairs(spark.createDataFrame([], TITLES), "row_id", "t").count() == 0


def test_vantage_tree_leaves_hold_every_ball():
    import numpy as np

    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**63, (600, 2), dtype=np.uint64)
    nodes = near_titles.fit_tree(f[:200])
    rows, leaves = near_titles.leaves_of(nodes, f, np.zeros(600, np.int64))
    home = dict(zip(rows.tolist(), leaves.tolist()))
    assert len(home) == 600 == len(rows)
    d = near_titles.distances(f[:20], f)
    rows, leaves = near_titles.leaves_of(nodes, f, np.full(600, 50))
    reach = set(zip(rows.tolist(), leaves.tolist()))
    assert all((i, home[j]) in reach for i in range(20) for j in range(600) if d[i, j] <= 50)


def test_components(spark):
    p = spark.createDataFrame([("b", "a"), ("b", "c"), ("c", "b"), ("x", "x"), (None, "q"), ("e", "d")], "a string, b string")
    got = {r.value: r.group for r in components.linked(p, "a", "b").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert components.linked(p.limit(0), "a", "b").count() == 0
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(150)], "a string, b string")
    assert {r.group for r in components.linked(chain, "a", "b").collect()} == {"000"}


def test_edges_of_verdicts_and_members(spark):
    p = spark.createDataFrame([(["a", "b"], True), (["a", None], True), (["c"], True), ([], True), (None, True), (["d", "e"], None), (["f", "g"], False)], "urls array<string>, duplicate boolean")
    assert [tuple(r) for r in links.verdict_edges(p).collect()] == [("a", "b")]
    m = "members array<struct<`文章链接`:string>>"
    g = spark.createDataFrame([([("a",), None, ("b",), ("a",), (None,), ("c",)],), ([("z",)],), (None,), ([],)], m)
    assert sorted(map(tuple, links.member_edges(g).collect())) == [("a", "b"), ("a", "c")]


def test_repeats_by_link_copy_and_near_title(spark):
    s = "row_id bigint, batch_no int, t string, l string"
    data = [
        (1, 0, "甲乙丙丁戊己庚辛壬癸", "https://h/s/AAA"), (2, 1, "癸子丑寅卯辰巳午未申", "http://H/s/AAA?x=1"), (3, 1, "【甲乙丙丁戊】己庚辛壬癸", None), (4, 2, "甲乙丙丁戊己庚辛壬癸新", "https://h/s?__biz=b&mid=1&idx=2&sn=3"),
        (5, 3, "完全不同的标题内容在此", "https://h/s?sn=3&idx=2&mid=1&__biz=b#rd"), (6, 3, None, "https://h/s?__biz=b&mid=1"), (7, 4, "", "https://h/s/aaa"), (8, 2, "别的一个很长很长的标题", "u"), (9, 2, "别的一个很长很长的标题", "u"), (10, None, "甲乙丙丁戊己庚辛壬癸", None),
    ]
    got = sorted(r.id for r in incremental.repeated_rows(spark.createDataFrame(data, s), "row_id", "batch_no", "t", "l").collect())
    assert got == [2, 3, 4, 5]
    assert incremental.repeated_rows(spark.createDataFrame([], s), "row_id", "batch_no", "t", "l").count() == 0


def test_history_goes_on_where_another_object_left_it(spark, tmp_path):
    s = "id bigint, title string, link string"
    data = [
        [(1, "甲乙丙丁戊己庚辛壬癸", "https://h/s/AAA"), (2, "别的一个很长很长的标题", None)], [(3, "癸子丑寅卯辰巳午未申", "https://h/s/AAA"), (4, "甲乙丙丁戊己庚辛壬癸新", None)],
        [(5, "别的一个很长很长的标题", None), (6, "癸子丑寅卯辰巳午未申酉", None), (7, "从来没有过的另外一句", None)],
    ]
    batches = [spark.createDataFrame(d, s) for d in data]

    def repeats(path, objects):
        at = [incremental.History(spark, f"{tmp_path}/{path}") for _ in range(objects)]
        for n, b in enumerate(batches):
            (at[n] if objects > 1 else at[0]).append(b, n)
        return sorted(map(tuple, incremental.History(spark, f"{tmp_path}/{path}").repeats().collect()))

    assert repeats("one", 1) == repeats("many", 3) == [(3, 1), (4, 1), (5, 2), (6, 2)]
    with pytest.raises(ValueError):
        incremental.History(spark, f"{tmp_path}/one").append(batches[0], 0)


def test_failed_batch_is_not_accepted(spark, tmp_path, monkeypatch):
    s = "id bigint, title string, link string"
    first, second = spark.createDataFrame([(1, "甲乙丙丁戊己庚辛壬癸", None)], s), spark.createDataFrame([(2, "甲乙丙丁戊己庚辛壬癸新", None)], s)
    h = incremental.History(spark, f"{tmp_path}/h")
    h.append(first, 0)
    with monkeypatch.context() as m:
        m.setattr(incremental.History, "_search", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            h.append(second, 1)
    assert h.repeats().count() == 0
    h.append(second, 1)
    assert [tuple(r) for r in h.repeats().collect()] == [(2, 1)]


def test_similarity_alone_decides_a_repeat(spark):
    a, b = "辛丁戌戊天辰己午月子昃申玄庚卯未丑亥盈乙", "辛丁戌新天辰己午月子昃申玄庚卯未丑新盈乙"
    shared = Counter(incremental.chunks(a)) & Counter(incremental.chunks(b))
    assert sum(len(x) * n for x, n in shared.items()) == 0.2 * len(a)
    df = spark.createDataFrame([(1, 0, a, None), (2, 1, b, None)], "row_id bigint, batch_no int, t string, l string")
    assert [tuple(r) for r in incremental.repeated_rows(df, "row_id", "batch_no", "t", "l").collect()] == [(2, 1)]


def test_chunks_are_content_defined():
    a = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未"
    assert "".join(incremental.chunks(a)) == a and incremental.chunks("") == []
    assert set(incremental.chunks(a)[-2:]) <= set(incremental.chunks("新" + a))


def test_survivors(spark):
    m = "struct<`公众号`:string,`发布日期`:string,`文章标题`:string,`文章链接`:string>"
    ms = [("N/A", "2026-08-03", "标题一……", "l3"), ("甲", "2026-02-30", "标题一", "l1"), None, ("乙", "2026-08-01", "分享图片", "l2"), ("乙", "2026-08-01", "分享图片", "l2"), ("丙", "2027-01-01", "标题二", "l0")]
    g = spark.createDataFrame([(1, "2026-09-01T00:00:00+08:00", ms), (2, "2026-09-01T00:00:00+08:00", [ms[1]]), (3, None, []), (4, None, None)], f"group_id bigint, generated_at string, members array<{m}>")
    got = [tuple(r) for r in canonical.survivors(g).select("group_id", "account_link", "date_link", "title_link").collect()]
    assert got == [(1, "l2", "l3", "l0")]
    assert canonical.survivors(g.limit(0)).count() == 0


def test_typed_values(spark):
    s = spark.createDataFrame([(1, "栖沐渡市西区、Wuxxupu;不限", "黎苍宁绍软件校招组"), (2, "煦梧浦 base木沐渡", "多家单位"), (3, " ", " "), (4, None, None), (5, "苍原省栖沐渡", "老骏沛茶笛")], "entry_id bigint, locations string, unit string")
    p = spark.createDataFrame([(7, '["\\u6d77\\u5916", "Xumaop"]'), (8, "栖沐，梧煦浦"), (9, "[]"), (10, None)], "user_id bigint, cities string")
    got = sorted(map(tuple, mapping.typed_to_listed(s, p, *dims(spark)).collect()))
    assert got == sorted([("locations", 1, 1), ("locations", 1, 2), ("locations", 1, -1), ("locations", 2, 2), ("locations", 2, 1), ("locations", 5, 1), ("cities", 7, -1), ("cities", 7, 3), ("cities", 8, 1), ("cities", 8, 2), ("unit", 1, 1), ("unit", 2, -1), ("unit", 5, 2)])


def test_prefix_join_matches_brute_force(spark):
    rng = random.Random(3)
    sets = [sorted(set(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))) for _ in range(60)]
    v, e = [(f"v{i}", "x", t) for i, t in enumerate(sets[:40])], [(i, "x", t) for i, t in enumerate(sets[40:])]
    got = {r.value: r.ref_id for r in mapping.prefix_join(spark.createDataFrame(v, "value string, name string, tokens array<string>"), spark.createDataFrame(e, "ref_id bigint, name string, tokens array<string>"), 0.5).collect()}
    want = {}
    for k, _, t in v:
        like = [(len(set(t) & set(u)) / len(set(t) | set(u)), -i) for i, _, u in e]
        if max(like)[0] >= 0.5:
            want[k] = -max(like)[1]
    assert got == want


def test_variants(spark):
    typed = ["黎苍宁绍软件", "老黎苍宁绍", "栖沐渡黎宁苍绍软件有限公司", "Licangningshao Software", "紫棠珀沐数技", "若干企业", "-", "", None, "未知甲乙丙软件", "未知甲乙丙软件校招组"]
    s = spark.createDataFrame([(t,) for t in typed + typed[:2]], "unit string")
    got = {tuple(r) for r in variants.variant_pairs(s, *dims(spark)).collect()}
    group = sorted(typed[:4])
    want = {(a, b) for i, a in enumerate(group) for b in group[i + 1 :]} | {tuple(sorted(typed[-2:]))}
    assert got == want


def test_bands_reach_the_recall():
    for _, rows, s in variants.SPACES.values():
        n = variants.bands(rows, s)
        assert 1 - (1 - s**rows) ** n >= variants.RECALL > 1 - (1 - s**rows) ** (n - 1)


def test_sound_bands_reckon_with_all_accepted_slips():
    rng, (q, _, least) = random.Random(6), variants.SPACES["sound"]
    for _ in range(2000):
        a = b = "".join(rng.sample("abcdefghijklmnopqrstuvwxy", rng.randint(9, 17)))
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(b) - 1)
            b = b[:k] + rng.choice([b[k + 1] + b[k] + b[k + 2 :], "z" + b[k + 1 :], b[k + 1 :], "z" + b[k:]])
        if variants.alike(a, True, a, b, True, b):
            x, y = variants.padded(a, q), variants.padded(b, q)
            assert len(x & y) / len(x | y) >= least


def test_token_ids(spark):
    import tiktoken
    from pathlib import Path

    ranks = tokenizer.read_ranks(Path(tokenizer.VOCABULARIES, "byte_bpe_50k.tiktoken").read_bytes())
    known = tiktoken.Encoding("own", pat_str=tokenizer.PIECES, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "hello  world's <|endoftext|>\n\n x", "招聘2026届 算法、工程师！", "a" * 5000, "👩‍💻👍🏽​ é", " \t "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: r.ids for r in tokenizer.encoded(df, "doc_id", "text").collect()}
    assert got == {i: known.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert all(r.same for r in tokenizer.round_trips(df, "doc_id", "text").collect())
    assert tokenizer.encoded(df.limit(0), "doc_id", "text").count() == 0


def test_decoder_replaces_ill_formed_bytes():
    for data in (b"\xff", b"\xe4\xb8", b"\xe4\xb8\xad\xc0\x80", b"\xed\xa0\x80", b"a\xf0\x9f\x98\x80"):
        m = tokenizer.Utf8()
        assert (m.feed(data) + m.close()).replace("�", "") == data.decode("utf8", "ignore")


def test_leaks(spark):
    rng = random.Random(2)
    passages = ["".join(rng.choice("的一是不了人我在有他这为之大来以个中上们") for _ in range(100)) for _ in range(6)]
    edited = passages[0][:30] + "新" + passages[0][31:70]
    docs = [(1, "前文。" + "\n".join(edited) + "后文"), (2, passages[1][:20]), (3, None), (4, ""), (5, passages[2].replace("的", "的 ") * 2), (6, "无关的文字" * 50)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(passages)) + [(9, None), (10, "")], "item_id bigint, passage string")
    assert sorted(map(tuple, leakage.leaks(d, i).collect())) == [(1, 0), (5, 2)]
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_edit_search_matches_dynamic_programme():
    rng = random.Random(9)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 8), rng.randint(0, 20)))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        for k in range(4):
            assert leakage.distance(p, t, k) == (min(row) <= k)


def test_stuffing(spark):
    prose = "我们在这里招聘算法研究员若干名。工作地点在总部园区。请于本月底前投递简历。面试分三轮进行，结果另行通知。"
    docs = [(1, prose), (2, "甲市招聘 乙市招聘 甲市找工作 " * 20), (3, prose * 2 + "\n甲市招聘、乙市招聘"), (4, "\n".join(f"岗位 https://a{i}.example/x" for i in range(20))), (5, None), (6, ""), (7, " \n"), (8, "【软件】【机械】【化工】【医护】【教师】【行政】【土木】【供应链】" * 3), (2, "甲市招聘 乙市招聘 甲市找工作 " * 20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(r.id for r in stuffing.stuffed_pages(df).collect()) == [2, 4, 8]
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


def test_broken_sentences_are_no_run_of_items(spark):
    english = "Interviews run over three rounds and the clinical monitor drew samples while the nurse kept notes on line scheduling before statistics"
    chinese = "后来砚川的馆员在护理书架背面发现了阿璟留下的伺服标定草图并且逐行比较两地课程研发的误差"
    broken = "\n".join(chinese[i : i + 3] for i in range(0, len(chinese), 3))
    jobs = ["maths teacher", "test engineer", "buyer", "nurse", "clinical monitor", "quality lead", "optics", "legal associate"]
    lines = "软件\n机械\n化工\n医护\n教师\n行政\n土木\n供应链\n法务"
    docs = [(1, english + "."), (2, chinese + "。"), (3, english.replace(" ", "\n")), (4, broken), (5, "tags: " + " > ".join(jobs)), (6, lines), (7, lines), (8, "【软件】【机械】【化工】【医护】【教师】【行政】【土木】")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(r.id for r in stuffing.stuffed_pages(df).collect()) == [5, 6, 7, 8]


def test_fold():
    assert fold_py("Ａｂ－1　二!") == "ab1二"
