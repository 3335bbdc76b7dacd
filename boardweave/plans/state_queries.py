"""Queries of keyed state, incremental collection, screening and user tables."""

from pyspark.sql import functions as F

from boardweave.functions import dims
from boardweave.functions.titles import normalized
from boardweave.operators import ingest, screening, state
from boardweave.plans.registry import query
from boardweave.plans.views import ARTICLES, MEMBERS, TODAY, articles, members, norm, table
from boardweave.streaming import feed

BY_URL = "order by batch_no > 0 desc, fetched_at desc, row_id desc"


@query("select user_id, url, max(clicked_at) clicked_at from clicks group by 1, 2")
def merge_clicks(spark, d):
    return state.latest_clicks(table(spark, d, "clicks"))


@query(f"""with {MEMBERS}, x as (select distinct group_id, url from m), c as (select url, max(clicked_at) own from clicks group by 1), j as (select x.*, own, max(own) over (partition by group_id) nw from x left join c using (url))
select group_id, url, coalesce(own, nw, '') clicked_at from j""")
def propagate_clicks(spark, d):
    return state.propagated(members(spark, d), table(spark, d, "clicks"))


@query(f"with {ARTICLES} select row_id, url from a where batch_no > 0 and url not in (select url from a where batch_no = 0)")
def known_anti(spark, d):
    a = articles(spark, d)
    return ingest.unknown(a.where("batch_no > 0"), a.where("batch_no = 0")).select("row_id", "url")


@query(f"with {ARTICLES}, r as (select *, row_number() over (partition by url {BY_URL}) rn from a) select row_id, account, date, title, url, batch_no from r where rn = 1")
def merge_by_url(spark, d):
    a = articles(spark, d)
    return ingest.merged(a.where("batch_no = 0"), a.where("batch_no > 0"), ["fetched_at", "row_id"]).select("row_id", "account", "date", "title", "url", "batch_no")


@query(f"""with {ARTICLES}, s as (select url, min(date) first_seen, max(date) last_seen from a where batch_no = 0 group by 1), r as (select distinct url from a where batch_no > 0)
select url, coalesce(first_seen, '{TODAY}') first_seen, case when r.url is not null then '{TODAY}' else last_seen end last_seen, s.url is null is_new from s full join r using (url)""")
def first_seen_state(spark, d):
    a = articles(spark, d)
    s = a.where("batch_no = 0").groupBy("url").agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    return ingest.first_seen(s, a.where("batch_no > 0"), TODAY)


@query(f"with {ARTICLES}, k as (select account, {norm('title')} as \"key\", date from a where date <> '') select account, \"key\", min(date) date from k group by 1, 2 having count(distinct date) = 1")
def ledger_unambiguous_dates(spark, d):
    return ingest.ledger_dates(articles(spark, d))


@query(f"""with {ARTICLES}, rec as (select url, max(date) rd from a where date <> '' and batch_no = 0 group by 1), led as (select account, {norm('title')} k, min(date) ld from a where date <> '' group by 1, 2 having count(distinct date) = 1)
select a.row_id, coalesce(nullif(trim(a.date),''), nullif(trim(rd),''), nullif(trim(ld),''), '') date from a left join rec using (url) left join led on led.account = a.account and led.k = {norm('a.title')}""")
def enrich_dates(spark, d):
    a = articles(spark, d)
    return ingest.enriched(a, a.where("batch_no = 0"), a).select("row_id", "date")


@query(f"""with {ARTICLES}, r as (select account, date, {norm('title')} k, title, row_id, row_number() over (partition by account, date, {norm('title')} {BY_URL}) rn from a) select account, date, k as "key", title, row_id from r where rn = 1""")
def ledger_upsert(spark, d):
    a = articles(spark, d).withColumn("key", normalized(F.col("title"))).select("account", "date", "key", "title", "row_id", "batch_no", "fetched_at")
    return state.upsert(a.where("batch_no = 0"), a.where("batch_no > 0"), ["account", "date", "key"], ["fetched_at", "row_id"]).select("account", "date", "key", "title", "row_id")


@query(f"with {ARTICLES} select case when trim(date) = '' then '{TODAY}' else trim(date) end \"day\", count(*) n from a group by 1")
def daily_buckets(spark, d):
    return ingest.daily(articles(spark, d), TODAY).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


PAGES = f"""{ARTICLES}, o as (select account, batch_no, date, row_number() over (partition by account order by fetched_at desc, row_id) - 1 rn from a),
p as (select account, rn // 20 page, count(*) n, count(*) filter (where batch_no = 0) n_known, min(date) oldest from o group by 1, 2)"""


@query(f"""with {PAGES}, r as (select account, page, case when n > 0 and n_known = n then 'known' when oldest < '2026-07-15' then 'range' when page * 20 >= 5000 then 'offset' end reason from p)
select account, min(page)::bigint stop_page, arg_min(reason, page) reason from r where reason is not null group by 1""")
def crawl_stop(spark, d):
    from pyspark.sql import Window

    # one account's feed, paged by twenty: the order of a feed needs its rows in order
    w = Window.partitionBy("account").orderBy(F.desc("fetched_at"), "row_id")
    o = articles(spark, d).withColumn("page", F.floor((F.row_number().over(w) - 1) / 20).cast("bigint"))
    p = o.groupBy("account", "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("batch_no") == 0).alias("n_known"), F.min("date").alias("oldest"))
    return ingest.crawl_cut(p.withColumns({"offset": F.col("page") * 20, "start": F.lit("2026-07-15")}))


@query(f"""with {ARTICLES}, s as (select account, count(*) depth from a where batch_no = 0 group by 1), r as (select account, count(*) swept, max(batch_no) >= 5 i, max(batch_no) = 3 k from a where batch_no > 0 group by 1)
select account, (case when coalesce(i, false) then greatest(coalesce(depth,0), coalesce(swept,0)) when coalesce(k, false) then 0 else greatest(coalesce(depth,0), coalesce(swept,0)) end)::bigint depth from s full join r using (account)""")
def resume_depth(spark, d):
    a = articles(spark, d)
    s = a.where("batch_no = 0").groupBy("account").agg(F.count(F.lit(1)).alias("depth"))
    r = a.where("batch_no > 0").groupBy("account").agg(F.count(F.lit(1)).alias("swept"), (F.max("batch_no") >= 5).alias("interrupted"), (F.max("batch_no") == 3).alias("stopped_at_known"), F.lit(False).alias("reached_end"))
    return ingest.resume_depth(s, r)


@query()
def login_limiter(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("client"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("id"))
    return feed.limited_attempts(e, 3, 86_400)


@query("select o_orderkey token_hash, c_custkey user_id, c_name username from orders join customer on o_custkey = c_custkey where c_acctbal > 0 and o_orderdate > timestamp '1997-01-01'")
def sessions_active(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("token_hash"), F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("expires_at"))
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("active"))
    return state.active_sessions(s, u, "1997-01-01")


@query("select user_id, case when user_id % 3 = 0 then '[\"x\"]' else cities end cities, keywords, updated_at from preferences")
def prefs_merge(spark, d):
    p = table(spark, d, "preferences").select("user_id", "cities", "keywords", "updated_at")
    return state.partial_upsert(p, p.where("user_id % 3 = 0").select("user_id", F.lit('["x"]').alias("cities")), "user_id").select("user_id", "cities", "keywords", "updated_at")


@query("""with u as (select distinct user_id from clicks union select -1), p as (select user_id, cities from preferences)
select u.user_id, case when p.user_id is null then '成都,西安,北京,上海,深圳,东莞,广州,杭州' else coalesce(p.cities, '') end cities from u left join p using (user_id)""")
def prefs_default(spark, d):
    p = table(spark, d, "preferences").select("user_id", F.when(F.col("cities").isNotNull(), F.array("cities")).alias("cities"))
    users = table(spark, d, "clicks").select("user_id").union(spark.range(-1, 0)).distinct()  # -1 has no row
    return state.preferences_or_default(p, users, dims.DEFAULT_CITIES).select("user_id", F.array_join("cities", ",").alias("cities"))


FAV = f"""{MEMBERS}, fav as (select distinct c.user_id, m.group_id, m.group_id % 5 collection_id from clicks c join m using (url))"""


def _favorites(spark, d):
    return table(spark, d, "clicks").join(members(spark, d), "url").select("user_id", "group_id", (F.col("group_id") % 5).alias("collection_id")).distinct()


@query(f"with {FAV} select user_id, group_id, case when group_id % 2 = 0 then -1 else collection_id end collection_id from fav")
def favorites_upsert(spark, d):
    f = _favorites(spark, d)
    return state.upsert(f, f.where("group_id % 2 = 0").withColumn("collection_id", F.lit(-1).cast("bigint")), ["user_id", "group_id"])


@query(f"with {FAV} select user_id, group_id, case when collection_id <> 2 then collection_id end collection_id from fav")
def collection_delete(spark, d):
    return state.cleared(_favorites(spark, d), spark.range(2, 3), "collection_id")


@query(f"with {FAV} select user_id, group_id, collection_id from fav where not (group_id % 4 = 1)")
def group_states_delete(spark, d):
    f = _favorites(spark, d)
    return state.delete(f, f.where("group_id % 4 = 1"), ["user_id", "group_id"])


@query(f"with {FAV}, c as (select range id from range(7)) select c.id, count(user_id) n from c left join fav on fav.collection_id = c.id group by 1")
def collection_counts(spark, d):
    f = _favorites(spark, d)
    return spark.range(7).join(f, F.col("id") == F.col("collection_id"), "left").groupBy("id").agg(F.count("user_id").alias("n"))


@query("select 'primary key' as rule, (select count(*) from (select user_id, url from clicks group by 1, 2 having count(*) > 1)) n union all select 'stamped', (select count(*) from clicks where clicked_at is null)")
def constraint_audit(spark, d):
    return state.violations(table(spark, d, "clicks"), ["user_id", "url"], {"stamped": "clicked_at is not null"})


@query(f"with {MEMBERS}, x as (select distinct user_id, url from clicks where clicked_at is not null), mm as (select distinct url from m) select * from x union select 0, url from mm union select user_id, url from clicks")
def insert_ignore(spark, d):
    c = table(spark, d, "clicks")
    x = c.where("clicked_at is not null").select("user_id", "url").distinct()
    m = members(spark, d).select(F.lit(0).cast("bigint").alias("user_id"), "url")
    return state.insert_ignore(x, m.union(c.select("user_id", "url")).distinct(), ["user_id", "url"])


@query("select entry_id, coalesce(v = 2, false) or (kind = 'kept' and not regexp_matches(coalesce(title,''), '宣讲|双选|组团|线下招聘|招聘会')) reusable from screen_results")
def screen_reusable(spark, d):
    return table(spark, d, "screen_results").select("entry_id", screening.reusable(F.col("kind"), F.col("v"), F.col("title")).alias("reusable"))


OK = "(coalesce(v = 2, false) or (kind = 'kept' and not regexp_matches(coalesce(title,''), '宣讲|双选|组团|线下招聘|招聘会')))"


@query(f"""with g as (select group_id, coalesce(canonical."文章标题",'') title, list_sort(list_distinct(list_filter(list_transform(members, lambda x: x."文章链接"), lambda u: u is not null))) urls from dedup_groups),
e0 as (select *, unnest(urls) u from screen_results where {OK}), e as (select u, entry_id, row_number() over (partition by u order by screened_date, kind <> 'kept', entry_id) rn from e0),
t as (select trim(title) title, entry_id, row_number() over (partition by trim(title) order by screened_date, kind <> 'kept', entry_id) rn from screen_results where {OK} and trim(title) <> ''),
gu as (select group_id, unnest(urls) u, generate_subscripts(urls, 1) pos from g), hit as (select group_id, arg_min(entry_id, pos) e from gu join e on e.u = gu.u and e.rn = 1 group by 1)
select g.group_id, coalesce(hit.e, t.entry_id) entry_id, case when hit.e is not null then 'url' when t.entry_id is not null then 'title' else 'pending' end how
from g left join hit using (group_id) left join t on t.title = trim(g.title) and t.rn = 1""")
def screen_reuse_split(spark, d):
    urls = F.array_sort(F.array_distinct(F.filter(F.transform("members", lambda m: m["文章链接"]), lambda u: u.isNotNull())))
    g = table(spark, d, "dedup_groups").select("group_id", F.coalesce("canonical.文章标题", F.lit("")).alias("title"), urls.alias("urls"))
    return screening.reuse_split(g, table(spark, d, "screen_results"))


@query("""select entry_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(urls, []), [article_url]))), ' ') urls, len(list_distinct(list_concat(coalesce(accounts, []), coalesce(accounts, []))))::bigint n_accounts
from screen_results where article_url is not null""")
def screen_merge(spark, d):
    s = table(spark, d, "screen_results").where("article_url is not null")
    m = screening.merged_entry(F.col("urls"), F.array("article_url"), F.col("accounts"), F.col("accounts"))
    return s.select("entry_id", m.alias("m")).select("entry_id", F.array_join("m.urls", " ").alias("urls"), F.size("m.accounts").cast("bigint").alias("n_accounts"))


@query("select kind, count(*) n from screen_results group by 1")
def screen_totals(spark, d):
    return table(spark, d, "screen_results").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""with i as (select event_id image_id, (event_id * 37) % 1500 w, (event_id * 91) % 6000 h from events), b as (select * from i where not ((h < 100 and w < 200) or h < 60 or w < 60)),
s as (select image_id, case when w > 1000 then floor(h * 1000 / w)::bigint else h end sh from b),
t as (select image_id, sh, unnest(case when sh > 2200 then range(0, sh, 1880) else [0::bigint] end) top from s), k as (select * from t where top = 0 or top + 120 < sh)
select image_id, row_number() over (partition by image_id order by top) - 1 part, top, case when sh > 2200 then least(2000, sh - top) else sh end height from k""")
def image_slices(spark, d):
    i = table(spark, d, "events").select(F.col("event_id").alias("image_id"), (F.col("event_id") * 37 % 1500).alias("w"), (F.col("event_id") * 91 % 6000).alias("h"))
    return screening.image_slices(i)


@query(f"with {ARTICLES}, r as (select *, row_number() over (partition by url {BY_URL}) rn from a where trim(url) <> '') select row_id, url from r where rn = 1")
def late_feed_stream(spark, d):
    """The article table fed through a file stream in several micro-batches and upserted by link."""
    from boardweave.operators.scratch import written

    # files by hash of the row: late and repeated rows come in any micro-batch
    src = written(table(spark, d, "articles").withColumn("fresh", F.col("batch_no") > 0).repartition(4, "row_id"))
    base = src.at + "-stream"
    q = feed.upsert_batches(feed.article_stream(spark, src.at, src.schema, 1), base + "/table", base + "/checkpoint", ["文章链接"], ["fresh", "fetched_at", "row_id"])
    q.awaitTermination()
    return feed.upserted(spark, base + "/table", src.schema).select("row_id", F.col("文章链接").alias("url"))
