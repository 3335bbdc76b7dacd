"""Queries of the scalar functions and windows over articles and screening results."""

from pyspark.sql import functions as F

from boardweave.functions import dims, events, lists, links, pages
from boardweave.functions import titles as T
from boardweave.plans.registry import query
from boardweave.plans.views import ARTICLES, HI, LO, articles, norm, table


@query(f"""with {ARTICLES} select row_id, case when contains(title,'实习') then '实习' when contains(title,'双选') or contains(title,'宣讲') then '双选会/宣讲会' when contains(title,'校招') or contains(title,'校园招聘') or contains(title,'应届生') then '校园招聘'
when contains(title,'人才') or contains(title,'博士') or contains(title,'开放日') or contains(lower(title),'openday') then '人才引进/开放日' else '招聘' end kind from a""")
def classify_title(spark, d):
    return articles(spark, d).select("row_id", T.classified(F.col("title")).alias("kind"))


@query(f"with {ARTICLES} select row_id, {norm('title')} as \"key\", replace(date,'-','') date_key from a where date <> '' and replace(date,'-','') between '{LO}' and '{HI}'")
def date_window(spark, d):
    a = articles(spark, d).withColumn("date_key", T.date_key(F.col("date")))
    return a.where((F.col("date") != "") & F.col("date_key").between(LO, HI)).select("row_id", T.normalized(F.col("title")).alias("key"), "date_key")


YMD, MD, NMD = r"(\d{4})\s*[年.\-/]\s*(\d{1,2})\s*[月.\-/]\s*(\d{1,2})", r"(\d{1,2})\s*月\s*(\d{1,2})\s*日?", r"(?:^|[^0-9])(\d{1,2})[.\-/](\d{1,2})(?:[^0-9]|$)"


@query(f"""with {ARTICLES}, x as (select row_id, date pub, title t, regexp_matches(title, '{YMD}') f from a),
p as (select *, case when f then try_cast(nullif(regexp_extract(t,'{YMD}',1),'') as int) when regexp_matches(pub,'^[0-9]{{4}}') then nullif(try_cast(left(pub,4) as int),0) end y,
case when f then try_cast(nullif(regexp_extract(t,'{YMD}',2),'') as int) when regexp_matches(t,'{MD}') then try_cast(regexp_extract(t,'{MD}',1) as int) else try_cast(nullif(regexp_extract(t,'{NMD}',1),'') as int) end m,
case when f then try_cast(nullif(regexp_extract(t,'{YMD}',3),'') as int) when regexp_matches(t,'{MD}') then try_cast(regexp_extract(t,'{MD}',2) as int) else try_cast(nullif(regexp_extract(t,'{NMD}',2),'') as int) end d,
case when regexp_matches(pub,'^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(left(pub,10) as date) end pd from x),
q as (select row_id, try_cast(printf('%04d-%02d-%02d', y, m, d) as date) d0, try_cast(printf('%04d-%02d-%02d', y + 1, m, d) as date) d1, coalesce(month(pd) - m >= 8, false) mv, y is not null and m between 1 and 12 and d between 1 and 31 ok from p)
select row_id, case when ok then coalesce(strftime(case when mv and d0 is not null then coalesce(d1, d0) else d0 end, '%Y-%m-%d'), '') else '' end fair_date from q""")
def fair_date(spark, d):
    return articles(spark, d).select("row_id", events.event_date(F.col("title"), F.col("date")).alias("fair_date"))


@query("""select entry_id, case when fair.is_fair then coalesce(fair.province, '') else '' end stored, case when contains(coalesce(fair.location, ''), '北京') then '北京' else '' end beijing from screen_results where kind = 'kept'""")
def province(spark, d):
    s = table(spark, d, "screen_results").where("kind = 'kept'")
    p = events.province(F.col("fair.location"), F.lit(""), F.array().cast("array<string>"))
    return s.select("entry_id", F.when(F.col("fair.is_fair"), F.coalesce("fair.province", F.lit(""))).otherwise("").alias("stored"), p.alias("beijing"))


@query()
def apply_url(spark, d):
    s = table(spark, d, "screen_results").where("kind = 'kept'")
    return s.select("entry_id", links.apply_url(F.concat_ws("；", "note", "apply_url"), F.col("article_url")).alias("apply_url"))


@query(r"select entry_id, unnest(list_filter(regexp_split_to_array(coalesce(locations,''), '[、，,;；/\s]+'), lambda x: x <> '')) place from screen_results where kind = 'kept'")
def location_tokens(spark, d):
    return table(spark, d, "screen_results").where("kind = 'kept'").select("entry_id", F.explode(lists.place_tokens(F.col("locations"))).alias("place"))


@query()
def preference_lists(spark, d):
    p = table(spark, d, "preferences")
    return p.select("user_id", F.array_join(lists.user_list(lists.json_list(F.col("cities")), 40, 24), "|").alias("cities"), F.array_join(lists.user_list(lists.json_list(F.col("keywords")), 30, 40), "|").alias("keywords"))


@query(r"""with p as (select doc_id, text from documents), s as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text,''),
'<script\b.*?</script>',' ','gis'),'<style\b.*?</style>',' ','gis'),'<(?:br|/p|/section|/h[1-6]|/li|/tr)[^>]*>', chr(10),'gi'),'<[^>]+>',' ','g'),'&nbsp;',chr(160),'g'),'&lt;','<','g')) t from p)
select doc_id, length(regexp_replace(replace(replace(replace(replace(t,'&gt;','>'),'&quot;','"'),'&#39;',''''),'&amp;','&'), '[^\p{L}\p{N}]+', '', 'g'))::bigint n_letters from s""")
def html_to_text(spark, d):
    t = pages.plain_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace(t, T.NON_WORD, "")).cast("bigint").alias("n_letters"))


@query("""select doc_id, contains(coalesce(text,''),'当前环境异常') or contains(coalesce(text,''),'完成验证后即可继续访问') or contains(coalesce(text,''),'此内容因违规') or contains(coalesce(text,''),'该内容已被发布者删除') blocked from documents""")
def blocked_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", pages.blocked(F.col("text")).alias("blocked"))


@query(f"""with {ARTICLES}, u as (select distinct url, regexp_extract(url, '__biz=([^&"''#]+)', 1) biz from a) select url, biz from u""")
def link_biz(spark, d):
    return articles(spark, d).select("url").distinct().select("url", links.biz_of(F.col("url")).alias("biz"))


@query("select event_id, strftime(make_timestamp((epoch(ts)::bigint + 28800) * 1000000), '%Y-%m-%d') \"day\" from events")
def epoch_days(spark, d):
    return table(spark, d, "events").select("event_id", events.epoch_day(F.unix_timestamp("ts")).alias("day"))


@query(f"""with {ARTICLES}, x as (select row_id, row_number() over (order by case when date <> '' then 0 else 1 end, date desc, fetched_at desc, title desc, row_id) place from a) select row_id, place from x where place <= 100""")
def latest_hundred(spark, d):
    a = articles(spark, d).orderBy(F.col("date") == "", F.desc("date"), F.desc("fetched_at"), F.desc("title"), "row_id").limit(100)
    return a.select("row_id", F.struct(F.col("date") == "").alias("x"), "date", "fetched_at", "title").select("row_id", F.row_number().over(_top()).cast("bigint").alias("place"))


def _top():
    from pyspark.sql import Window

    return Window.orderBy(F.col("date") == "", F.desc("date"), F.desc("fetched_at"), F.desc("title"), "row_id")  # of one hundred rows


@query(f"""with {ARTICLES}, w as (select account, date, row_id, lag(date) over (partition by account order by date desc, row_id) prev from a) select row_id, prev is null or date <> prev heading from w""")
def date_headings(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("account").orderBy(F.desc("date"), "row_id")
    prev = F.lag("date").over(w)
    return articles(spark, d).select("row_id", (prev.isNull() | (F.col("date") != prev)).alias("heading"))
