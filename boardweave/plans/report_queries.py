"""Queries of the summary job, the report, fairs in their views, and choices of rows."""

from pyspark.sql import functions as F

from boardweave.functions import dims, events, lists
from boardweave.functions.titles import Brands
from boardweave.operators import board, dedup, report, screening
from boardweave.plans.board_queries import _board
from boardweave.plans.dedup_queries import BRANDED, DEMO, _unwrap_sql
from boardweave.plans.registry import query
from boardweave.plans.views import ARTICLES, BOARD, TODAY, articles, norm, table

# Pairs that the veto of the test brands forbids; be holds the effective brands of each title.
_VETO = """(len(x.eff) = 1 and len(y.eff) = 1 and x.eff[1] <> y.eff[1] and
 (not ((x.eff[1] = 'TIQIAN' and y.eff[1] = 'XIAOZHAO') or (x.eff[1] = 'XIAOZHAO' and y.eff[1] = 'TIQIAN') or (x.eff[1] = 'QIXI' and y.eff[1] = 'QIXI_JIUYE') or (x.eff[1] = 'QIXI_JIUYE' and y.eff[1] = 'QIXI'))
  or x.eff[1] in ('XIAOZHAO', 'TIQIAN')))"""

TIERS = f"""{ARTICLES}, {BRANDED}, {_unwrap_sql()}, hu as (select key, min(struct_pack(url := url, norm := norm)) h from u where length(key) >= 8 group by 1),
k as (select distinct url, {norm('title')} key from a), hk as (select key, min(url) h from k group by 1),
dp as (select least(urls[1], urls[2]) lo, greatest(urls[1], urls[2]) hi, duplicate, row_number() over (partition by least(urls[1], urls[2]), greatest(urls[1], urls[2]) order by decided_at desc nulls last, pair_id desc) rn
 from decided_pairs where urls[1] is not null and urls[2] is not null and urls[1] <> urls[2]),
soft as (select hu.h.url a, u.url b from u join hu using (key) where u.url <> hu.h.url and u.norm <> hu.h.norm union select lo, hi from dp where rn = 1 and duplicate),
tb as (select url, eff from (select url, max(title) title from a group by 1) join be using (title)),
sv as (select soft.a, soft.b, coalesce({_VETO}, false) veto from soft join tb x on x.url = soft.a join tb y on y.url = soft.b),
e as (select hk.h a, k.url b from k join hk using (key) where k.url <> hk.h union select a, b from sv where not veto), e2 as (select a, b from e union select b, a from e)"""

FULL = f"""{TIERS}, r(v, w) as (select a, a from e2 union select r.v, e2.b from r join e2 on e2.a = r.w), c as (select v url, min(w) root from r group by 1)"""


def _decided(spark, d):
    p = table(spark, d, "decided_pairs")
    return dedup.upsert_decisions(p.limit(0), p)


@query(f"with recursive {FULL} select root, url from c")
def dedup_groups_full(spark, d):
    return report.full_groups(articles(spark, d), _decided(spark, d), DEMO)


@query(f"""with recursive {FULL}, t as (select url, max(struct_pack(date := date, title := title)) x from a group by 1)
select root, c.url, x.date, x.title, row_number() over (partition by root order by x.date desc, x.title desc, c.url desc) place, count(*) over (partition by root) n from c join t using (url)""")
def group_ordinals(spark, d):
    return report.ordered_members(dedup_groups_full(spark, d), articles(spark, d))


@query(f"with {TIERS}, dr as (select least(a, b) lo, greatest(a, b) hi, bool_or(veto) veto from sv group by 1, 2) select lo, hi, not veto duplicate, 'soft' as rule, case when veto then 'brand' end veto, '{TODAY}' decided_at from dr")
def decision_records(spark, d):
    a = articles(spark, d)
    said = _decided(spark, d).where("duplicate").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    return report.decision_rows(dedup.unwrap_links(a).union(said).withColumn("rule", F.lit("soft")), a, DEMO, TODAY)


# Titles of a fixture that holds each alias of the real table once, alone and beside the next alias.
_BRANDS = dims.brand_table()
_REAL = Brands()


def _real_rows() -> list[tuple[str, str]]:
    names = [n for _, _, ns in _BRANDS for n in ns]
    return [(n, f"{n}2027届招聘") for n in names] + [(f"{n}|{m}", f"{n}与{m}联合招聘") for n, m in zip(names, names[1:] + names[:1])]


@query()
def brand_real_table(spark, d):
    """Effective brands by the real table over fixture titles; checked in tests by a plain search."""
    r = spark.createDataFrame(_real_rows(), "name string, title string")
    return r.select("name", F.array_join(_REAL.effective(F.col("title")), ",").alias("brands"))


@query(f"""with {BOARD}, l as (select date, account, string_agg(title || ' ' || id || ' ' || len(mt)::varchar, ';' order by title, id) groups from b group by 1, 2)
select date, string_agg(account || ':' || groups, '|' order by account) accounts from l group by 1""")
def report_by_day(spark, d):
    g = _board(spark, d).select("date", "account", "title", "id", F.size("members").alias("n_members"))
    line = lambda x: F.concat(x["title"], F.lit(" "), x["id"], F.lit(" "), x["n_members"].cast("string"))
    days = F.transform("accounts", lambda a: F.concat(a["account"], F.lit(":"), F.array_join(F.transform(a["groups"], line), ";")))
    return report.nested(g).select("date", F.array_join(days, "|").alias("accounts"))


@query(f"""with {ARTICLES} select account, '- ' || case when date = '' then '日期不明' else date end || ' [' || title || '](' || url || ')' line, row_number() over (partition by account order by date desc, title desc, url) place from a""")
def account_lists(spark, d):
    return report.account_lines(articles(spark, d))


@query(f"""with {ARTICLES}, s as (select url, max(date) date, min(fetched_at) first_seen, max(title) title from a group by 1), x as (select url, row_number() over (order by nullif(date, '') desc nulls last, first_seen desc, title desc, url) place from s) select url, place from x where place <= 200""")
def dated_first(spark, d):
    """The first two hundred of the list, dated ones before undated ones."""
    from pyspark.sql import Window

    s = articles(spark, d).groupBy("url").agg(F.max("date").alias("date"), F.min("fetched_at").alias("first_seen"), F.max("title").alias("title"))
    top = report.dated_first(s).limit(200)
    w = Window.orderBy(F.desc_nulls_last(F.nullif("date", F.lit(""))), F.desc("first_seen"), F.desc("title"), "url")  # of two hundred rows
    return top.select("url", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"with {ARTICLES} select row_id from a where replace(date, '-', '') between '20260815' and '99999999'")
def typed_range(spark, d):
    lo, hi = report.date_range("2026-08-15..")
    return articles(spark, d).where(F.replace("date", F.lit("-"), F.lit("")).between(lo, hi)).select("row_id")


@query(f"with {ARTICLES} select row_id, account from a where account in ('栖霁大学就业', '峤筑梅学院就业指导')")
def only_accounts(spark, d):
    return report.only(articles(spark, d), ["栖霁大学就业", " 峤筑梅学院就业指导 ", ""]).select("row_id", "account")


@query("select name from (select distinct strftime(o_orderdate, '%Y%m%d') as name from orders union all select 'tmp') where regexp_full_match(name, '[0-9]{8}') and name < '19950101'")
def cache_expired(spark, d):
    n = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("name")).distinct()
    return report.expired(n.union(spark.createDataFrame([("tmp",)], "name string")), "19950101")


@query(f"with {BOARD} select id from b where clicked_at is null or id < '4'")
def visible_items(spark, d):
    b = _board(spark, d)
    return report.visible(b, b.where("id < '4'")).select("id")


@query("select event_id number, event_type line from (select *, row_number() over (order by event_id desc) k from events) where k <= 12 and trim(event_type) <> ''")
def log_tail(spark, d):
    return report.log_tail(table(spark, d, "events").select(F.col("event_id").alias("number"), F.col("event_type").alias("line")))


@query("with e as (select entry_id, list_distinct(list_filter(regexp_split_to_array(coalesce(locations,''), '[、，,;；\\s]+'), lambda x: x <> '')) p from screen_results) select entry_id, array_to_string(list_sort(p), ' ') places from e")
def preference_text(spark, d):
    return table(spark, d, "screen_results").select("entry_id", F.array_join(F.array_sort(lists.typed(F.col("locations"))), " ").alias("places"))


_ITEM = "id, title, account, date, coalesce(kind, '') kind, coalesce(unit, '') unit, coalesce(clicked_at, '') clicked_at, len(mt)::bigint n_members"


def _items(c):
    e = lambda x: F.coalesce(x, F.lit(""))
    return c.select("id", "title", "account", "date", e("screen.kind").alias("kind"), e("screen.unit").alias("unit"), e("clicked_at").alias("clicked_at"), F.size("members").cast("bigint").alias("n_members"))


@query(f"with {BOARD} select {_ITEM} from b where not is_fair_ and clicked_at is not null")
def board_read(spark, d):
    return _items(board.context(_board(spark, d), "read"))


@query(f"with {BOARD} select {_ITEM} from b where not is_fair_")
def board_all(spark, d):
    return _items(board.context(_board(spark, d), "all", exclude=("x",)))


@query(f"with {BOARD}, o as (select id from b order by id limit 30) select {_ITEM} from b where not is_fair_ and clicked_at is null and id not in (select id from o)")
def board_excluded(spark, d):
    """Without the thirty groups of smallest id, which a client would name."""
    b = _board(spark, d)
    few = [r[0] for r in b.select("id").orderBy("id").limit(30).collect()]
    return _items(board.context(b, "unread", exclude=tuple(few)))


@query(f"with {BOARD}, c as (select id, title, date, row_number() over (order by date desc, title desc, id) - 1 k, count(*) over () n from b where not is_fair_ and clicked_at is null) select id, title, date from c where k // 100 = (n - 1) // 100")
def board_last_page(spark, d):
    """A page beyond the last, and a size beyond the largest."""
    return board.page(board.context(_board(spark, d)), 10_000, 5_000).select("id", "title", "date")


def _day_sql(t: str, pub: str) -> str:
    """SQL of events.event_date(move_all=False)."""
    ymd, md, nmd = events.YMD, events.MD, r"(?:^|[^0-9])(\d{1,2})[.\-/](\d{1,2})(?:[^0-9]|$)"  # the oracle has no look-around
    ex = lambda p, g: f"try_cast(nullif(regexp_extract({t}, '{p}', {g}), '') as int)"
    full, has = f"regexp_matches({t}, '{ymd}')", f"regexp_matches({t}, '{md}')"
    y = f"(case when {full} then {ex(ymd, 1)} else nullif(try_cast(case when regexp_matches({pub}, '^[0-9]{{4}}') then left({pub}, 4) end as int), 0) end)"
    m, dd = (f"(case when {full} then {ex(ymd, g)} when {has} then {ex(md, g - 1)} else {ex(nmd, g - 1)} end)" for g in (2, 3))
    moved = f"(not {full} and regexp_matches({pub}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and month(try_cast(left({pub}, 10) as date)) - {m} >= 8)"
    at = lambda k: f"try_cast(printf('%04d-%02d-%02d', {y} + {k}, {m}, {dd}) as date)"
    return f"coalesce(strftime(case when {y} is not null and {m} between 1 and 12 and {dd} between 1 and 31 and {at(0)} is not null then coalesce(case when coalesce({moved}, false) then {at(1)} end, {at(0)}) end, '%Y-%m-%d'), '')"


_FIRST_SQL = f"list_filter(list_transform(list_concat([title], mt), lambda t: {_day_sql('t', 'date')}), lambda x: x <> '')[1]"
_MANY_SQL = f"coalesce(fair.multi_company, len(list_filter(list_concat([title], mt), lambda t: regexp_matches(t, '{dims.MULTI_COMPANY}'))) > 0)"
INFO = f"""{BOARD}, i as (select id, title, account, date, fair is not null has_fair, case when coalesce(fair.date, '') <> '' then fair.date else coalesce({_FIRST_SQL}, '') end fair_date,
coalesce(fair.date, '') = '' and {_FIRST_SQL} is not null date_from_title, coalesce(fair.date, '') own_date, case when coalesce(fair.province, '') = '' then '{board.NO_PROVINCE}' else fair.province end province, {_MANY_SQL} multi_company, clicked_at is not null is_read from b where is_fair_)"""


@query(f"with {INFO} select id, fair_date, date_from_title, province, multi_company, is_read from i")
def fair_info(spark, d):
    """Provinces come from the entries alone here: places of the test data lie in invented provinces."""
    return board.fair_info(_board(spark, d)).select("id", "fair_date", "date_from_title", "province", "multi_company", "is_read")


@query(f"with {INFO} select count(*) filter (where has_fair and (own_date = '' or own_date >= '{TODAY}')) upcoming from i")
def fairs_upcoming(spark, d):
    return board.fair_info(_board(spark, d)).agg(F.count_if(F.col("has_fair") & ((F.col("own_date") == "") | (F.col("own_date") >= TODAY))).alias("upcoming"))


@query(f"with {INFO} select count(*) filter (where fair_date >= '{TODAY}') upcoming, count(*) filter (where not is_read) unread, count(*) filter (where fair_date = '') undated from i")
def fair_summary(spark, d):
    return board.fair_summary(board.fair_info(_board(spark, d)), TODAY)


@query(f"with {INFO} select id from i where province in ('苍原省', '{board.NO_PROVINCE}')")
def fairs_of_provinces(spark, d):
    return board.of_provinces(board.fair_info(_board(spark, d)), ["苍原省", board.NO_PROVINCE]).select("id")


@query(f"with {INFO} select fair_date, province, id, row_number() over (partition by fair_date, province order by multi_company desc, date desc, id) place from i")
def fair_order(spark, d):
    return board.fair_order(board.fair_info(_board(spark, d))).select("fair_date", "province", "id", "place")


@query(f"with {INFO}, p as (select fair_date, province, count(*) n from i group by 1, 2) select *, row_number() over (partition by fair_date order by province = '{board.NO_PROVINCE}', n desc, province) place from p")
def fair_day_provinces(spark, d):
    return board.day_provinces(board.fair_info(_board(spark, d)))


@query("select screened_date \"day\", count(*) n, count(*) filter (where kind = 'kept') kept, string_agg(entry_id::varchar, ' ' order by entry_id) entries from screen_results group by 1")
def screened_days(spark, d):
    return screening.by_day(table(spark, d, "screen_results"))


def _province_sql(loc: str) -> str:
    names = " ".join(f"when contains({loc}, '{p}') then '{p}'" for p in dims.PROVINCES)
    towns = " ".join(f"when contains({loc}, '{c}') then '{p}'" for c, p in dims.CITY_PROVINCES.items())
    return f"case {names} {towns} else '' end"


@query(f"""with w as (select n, row_number() over () k from (select unnest({[*dims.PROVINCES, *dims.CITY_PROVINCES, '']!r}) n)), t as (select a.k * 1000 + b.k id, '在' || a.n || '与' || b.n || '会场' loc from w a, w b)
select id, {_province_sql('loc')} province from t""")
def province_table(spark, d):
    """Every pair of listed provinces and cities in one place, a fixture of a few thousand rows."""
    names = [*dims.PROVINCES, *dims.CITY_PROVINCES, ""]
    rows = [((i + 1) * 1000 + j + 1, f"在{a}与{b}会场") for i, a in enumerate(names) for j, b in enumerate(names)]
    t = spark.createDataFrame(rows, "id bigint, loc string")
    return t.select("id", events.province(F.col("loc"), F.lit(""), F.array().cast("array<string>")).alias("province"))
