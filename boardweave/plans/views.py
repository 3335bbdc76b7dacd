"""Views that run the operators on the test tables, in Spark and as SQL for the oracle."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "https://mp.gongzhao.example/"
TODAY = "2026-10-01"
LO, HI = "20260801", "20260930"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def articles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "articles")
    txt = lambda c: F.coalesce(F.col(c), F.lit(""))
    return t.select("row_id", F.trim(txt("公众号")).alias("account"), txt("发布日期").alias("date"), txt("文章标题").alias("title"), F.col("文章链接").alias("url"), "batch_no", "fetched_at").where("coalesce(url, '') <> ''")


ARTICLES = """a as (select row_id, trim(coalesce("公众号",'')) account, coalesce("发布日期",'') date, coalesce("文章标题",'') title,
 "文章链接" url, batch_no, fetched_at from articles where coalesce("文章链接",'') <> '')"""


def norm(x: str) -> str:
    return rf"lower(regexp_replace(coalesce({x},''),'[^\p{{L}}\p{{N}}]+','','g'))"


def members(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "dedup_groups").select("group_id", "generated_at", F.explode("members").alias("m"))
    return m.select("group_id", "generated_at", F.col("m.公众号").alias("account"), F.col("m.发布日期").alias("date"), F.col("m.文章标题").alias("title"), F.col("m.文章链接").alias("url")).where("url is not null")


MEMBERS = """m as (select group_id, generated_at, x."公众号" account, x."发布日期" date, x."文章标题" title, x."文章链接" url
 from (select group_id, generated_at, unnest(members) x from dedup_groups) where x."文章链接" is not null)"""

# board groups: of rows with the same links the smallest group_id counts
GROUPS = f"""g0 as (select group_id, canonical, list_filter(members, lambda x: x."文章链接" is not null and starts_with(x."文章链接", '{PREFIX}')) mm from dedup_groups),
g1 as (select group_id, coalesce(canonical, mm[1]) c, mm, list_sort(list_distinct(list_transform(mm, lambda x: x."文章链接"))) urls from g0 where len(mm) > 0),
g2 as (select substr(sha256(array_to_string(urls, chr(10))),1,24) id, *, row_number() over (partition by urls order by group_id) rn from g1),
g as (select id, coalesce(c."文章标题",'') title, coalesce(c."文章链接",'') url, coalesce(c."公众号",'') account, coalesce(c."发布日期",'') date, urls,
 list_transform(mm, lambda x: coalesce(x."文章标题",'')) mt, list_transform(mm, lambda x: coalesce(x."公众号",'')) ma from g2 where rn = 1)"""

BOARD = GROUPS + """,
s0 as (select entry_id, kind, unit, intro, title stitle, positions, locations, v, fair, screened_date, unnest(urls) u from screen_results),
s as (select * from (select *, row_number() over (partition by u order by screened_date, kind <> 'kept', entry_id) rn from s0 where u is not null) where rn = 1),
gu as (select id, unnest(urls) u, generate_subscripts(urls, 1) pos from g),
gs as (select * from (select gu.id gid, s.*, row_number() over (partition by gu.id order by gu.pos) rk from gu join s on gu.u = s.u) where rk = 1),
gc as (select gu.id gid, max(clicked_at) clicked_at from gu join clicks k on k.url = gu.u where k.user_id = 1 and k.clicked_at is not null group by 1),
b as (select g.*, gs.kind, gs.unit, gs.intro, gs.positions, gs.locations, gs.v, gs.fair, gs.entry_id, gc.clicked_at,
 case when coalesce(gs.fair.is_fair, false) then true when coalesce(gs.kind = 'skipped' and gs.v = 2, false) then false
 else len(list_filter(list_concat([g.title], g.mt), lambda t: regexp_matches(t, '宣讲|双选|组团|线下招聘|招聘会')
  and not regexp_matches(t, '用人单位邀请|致用人单位|企业邀请函|诚邀(各)?(用人)?单位|参会单位邀请|单位邀请函|诚邀企业'))) > 0 end is_fair_
 from g left join gs on gs.gid = g.id left join gc on gc.gid = g.id)"""
