"""Queries of the board."""

from pyspark.sql import functions as F

from boardweave.operators import board
from boardweave.plans.registry import query
from boardweave.plans.views import BOARD, GROUPS, PREFIX, TODAY, table

KEYWORDS, CITIES, ACCOUNT, WORD = ["算法", "前端"], ["栖沐渡", "梧煦浦"], "栖霁大学就业", "公告"


def _board(spark, d):
    g = board.groups(table(spark, d, "dedup_groups"), PREFIX)
    return board.with_clicks(board.with_screen(g, table(spark, d, "screen_results")), table(spark, d, "clicks"), 1)


CTX = BOARD + ", ctx as (select * from b where not is_fair_ and clicked_at is null)"
HAY = "lower(concat_ws(' ', array_to_string(list_transform(coalesce(positions, []), lambda p: concat_ws(' ', coalesce(p.name,''), coalesce(p.category,''))), ' '), coalesce(intro,''), coalesce(unit,''), coalesce(title,'')))"
CS = "len(list_filter(coalesce(positions, []), lambda p: regexp_matches(coalesce(p.category,''), '计算机|软件|人工智能|大数据|算法|网络安全|开发|IT') or regexp_matches(coalesce(p.name,''), '计算机|软件|人工智能|大数据|算法|网络安全|开发|IT'))) > 0"
KW = "(" + " or ".join(f"contains({HAY}, '{k}')" for k in KEYWORDS) + ")"
CITY = "len(list_filter(list_concat([coalesce(locations,'')], list_transform(coalesce(positions, []), lambda p: coalesce(p.location,''))), lambda p: " + " or ".join(f"contains(p, '{c}')" for c in CITIES) + ")) > 0"


@query(f"with {GROUPS} select id, title, url, account, date, len(urls) n_urls, len(mt) n_members from g")
def board_groups(spark, d):
    g = board.groups(table(spark, d, "dedup_groups"), PREFIX)
    return g.select("id", "title", "url", "account", "date", F.size("urls").cast("bigint").alias("n_urls"), F.size("members").cast("bigint").alias("n_members"))


@query(f"with {BOARD} select id, entry_id, kind, clicked_at, is_fair_ is_fair from b")
def board_context(spark, d):
    return _board(spark, d).select("id", F.col("screen.entry_id").alias("entry_id"), F.col("screen.kind").alias("kind"), "clicked_at", board.fair_flag().alias("is_fair"))


@query(f"with {CTX} select id from ctx where account = '{ACCOUNT}' and contains(lower(concat_ws(' ', title, account, array_to_string(list_transform(list_zip(mt, ma), lambda z: z[1] || ' ' || z[2]), ' '))), '{WORD.lower()}')")
def board_search(spark, d):
    return board.context(_board(spark, d), "unread", ACCOUNT, WORD).select("id")


@query(f"""with {CTX} select count(*) filter (where coalesce(kind,'')='kept' and {CS}) cs, count(*) filter (where coalesce(kind,'')='kept' and {KW}) keywords,
count(*) filter (where coalesce(kind,'')='kept' and {CITY}) cities, count(*) filter (where coalesce(kind,'')='skipped') skipped, count(*) filter (where coalesce(kind,'') not in ('kept','skipped')) "none" from ctx""")
def board_facets(spark, d):
    return board.facets(board.context(_board(spark, d)), KEYWORDS, CITIES)


@query(f"with {CTX} select id, title, date from ctx where coalesce(kind,'')='kept' and {CS} and {CITY}")
def board_chips(spark, d):
    return board.chips(board.context(_board(spark, d)), ["cs", "cities"], KEYWORDS, CITIES).select("id", "title", "date")


@query(f"with {CTX} select id, title, date from ctx order by date desc, title desc, id offset 40 limit 40")
def board_page(spark, d):
    return board.page(board.context(_board(spark, d)), 2, 40).select("id", "title", "date")


@query(f"""with {BOARD} select count(*) filter (where not is_fair_) total, count(*) filter (where not is_fair_ and clicked_at is not null) "read", count(*) filter (where not is_fair_ and clicked_at is null) unread,
count(*) filter (where not is_fair_ and starts_with(coalesce(clicked_at,''), '{TODAY}')) today_read, count(*) filter (where is_fair_) fair_total,
count(*) filter (where is_fair_ and (coalesce(fair.date,'') = '' or fair.date >= '{TODAY}')) fair_upcoming, coalesce(max(date),'') latest_date from b""")
def board_stats(spark, d):
    return board.stats(_board(spark, d), TODAY)


@query(f"with {BOARD} select account, count(*) n from b where not is_fair_ group by 1")
def account_counts(spark, d):
    return board.account_counts(_board(spark, d))


@query(f"with {BOARD} select id, max(clicked_at) clicked_at from b where clicked_at is not null group by 1")
def click_states(spark, d):
    return _board(spark, d).where("clicked_at is not null").select("id", "clicked_at")


FAIRS = BOARD + """, f as (select id, title, date, coalesce(fair.date,'') fair_date, coalesce(fair.province,'') province,
 coalesce(fair.multi_company, len(list_filter(list_concat([title], mt), lambda t: regexp_matches(t, '组团|联合|多企业|多单位|双选会|大型招聘会|巡回'))) > 0) multi_company, clicked_at is not null is_read from b where is_fair_)"""


@query(f"with {FAIRS} select * from f")
def fairs(spark, d):
    return board.fairs(_board(spark, d))


@query(f"with {FAIRS} select fair_date, count(*) n, count(*) filter (where not is_read) unread, count(*) filter (where is_read) \"read\", fair_date <> '' and fair_date < '{TODAY}' past from f group by 1")
def fair_timeline(spark, d):
    return board.fair_days(board.fairs(_board(spark, d)), TODAY)


@query(f"""with {FAIRS}, p as (select case when province = '' then '未标注省份' else province end province, count(*) n from f group by 1)
select province, n, row_number() over (order by province = '未标注省份', n desc, province) place from p""")
def fair_provinces(spark, d):
    return board.fair_provinces(board.fairs(_board(spark, d)))


@query(f"with {FAIRS} select coalesce(max(case when fair_date='{TODAY}' then fair_date end), min(case when fair_date>'{TODAY}' then fair_date end), max(case when fair_date='' then fair_date end), max(fair_date)) \"day\" from f")
def fair_default_day(spark, d):
    return board.default_day(board.fairs(_board(spark, d)), TODAY)


@query(f"""with {BOARD} select date, account, count(*) n, sum(len(mt))::bigint n_members from b group by 1, 2""")
def report_nesting(spark, d):
    return _board(spark, d).groupBy("date", "account").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("members")).cast("bigint").alias("n_members"))


@query(f"with {BOARD} select count(*) groups, count(entry_id) screened, count(*) filter (where clicked_at is not null) \"read\", round(case when count(*) > 0 then count(*) filter (where clicked_at is not null) / count(*) * 100 else 0 end, 4) ratio from b")
def board_summary(spark, d):
    n, r = F.count(F.lit(1)), F.count_if(F.col("clicked_at").isNotNull())
    return _board(spark, d).agg(n.alias("groups"), F.count("screen.entry_id").alias("screened"), r.alias("read"), F.round(F.when(n > 0, r / n * 100).otherwise(0.0), 4).alias("ratio"))
