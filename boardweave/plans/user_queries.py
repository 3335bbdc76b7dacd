"""Queries of favourites, collections, users and sessions."""

from pyspark.sql import functions as F

from boardweave.operators import board, favorites
from boardweave.plans.registry import query
from boardweave.plans.views import BOARD, GROUPS, PREFIX, table

NOW = "2026-10-01T08:00:00+08:00"

# Every group that a user clicked is a favourite of theirs; the collection is the group's first hex digit, some unknown.
FAVS = f"""{GROUPS}, gu as (select id, unnest(urls) u from g), ck as (select user_id, url, max(clicked_at) clicked_at from clicks group by 1, 2),
fav as (select user_id, id, case when left(id, 1) < 'c' then ascii(left(id, 1)) end::bigint collection_id, coalesce(max(clicked_at), '') created_at from ck join gu on gu.u = ck.url group by 1, 2),
col as (select distinct user_id, c.id, 'c' || c.id::varchar as name from fav cross join (select unnest(range(48, 54)) id) c)"""


def _groups(spark, d):
    return board.groups(table(spark, d, "dedup_groups"), PREFIX)


def _clicks(spark, d):
    return table(spark, d, "clicks").groupBy("user_id", "url").agg(F.max("clicked_at").alias("clicked_at"))


def _favorites(spark, d):
    c = F.left("id", F.lit(1))
    j = _clicks(spark, d).join(_groups(spark, d).select("id", F.explode("urls").alias("url")), "url")
    return j.groupBy("user_id", "id").agg(F.coalesce(F.max("clicked_at"), F.lit("")).alias("created_at")).select("user_id", "id", F.when(c < "c", F.ascii(c).cast("bigint")).alias("collection_id"), "created_at")


def _collections(spark, d):
    return _favorites(spark, d).select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(48).cast("bigint"), F.lit(53).cast("bigint"))).alias("id")).withColumn("name", F.concat(F.lit("c"), F.col("id").cast("string")))


@query(f"""with {BOARD}, sr as (select entry_id, recruit_target, apply_url from screen_results)
select b.id, b.title, b.url, b.account, b.date, case when b.entry_id is null then '' else coalesce(left(sr.apply_url, 2048), '') end apply_url, b.unit, b.intro, b.locations, sr.recruit_target, len(b.positions)::bigint n_positions from b left join sr using (entry_id)""")
def favorite_snapshots(spark, d):
    """The JSON is read again, so that its fields are compared and not the order of its keys."""
    full = board.with_screen(_groups(spark, d), table(spark, d, "screen_results"), ("recruit_target", "apply_url"))
    j = F.from_json("snapshot", "unit string, intro string, locations string, recruit_target string, positions array<struct<name:string>>")
    s = favorites.snapshots(full).withColumn("j", j)
    return s.select("id", "title", "url", "account", "date", "apply_url", "j.unit", "j.intro", "j.locations", "j.recruit_target", F.when(F.col("j.positions").isNotNull(), F.size("j.positions")).cast("bigint").alias("n_positions"))


@query(f"""with {FAVS}, m as (select distinct f.user_id, gu.u url from fav f join gu using (id))
select coalesce(m.user_id, ck.user_id) user_id, coalesce(m.url, ck.url) url, case when m.url is not null then '{NOW}' else ck.clicked_at end clicked_at from ck full join m on m.user_id = ck.user_id and m.url = ck.url""")
def favorite_read_marks(spark, d):
    return favorites.read_marks(_clicks(spark, d), _favorites(spark, d), _groups(spark, d), NOW)


@query(f"""with {FAVS}, ap as (select user_id, id from fav where id < '4'), c2 as (select * from ck where clicked_at < '2026-09-15'),
rd as (select distinct user_id, id from (select c2.user_id, gu.id from c2 join gu on gu.u = c2.url union all select * from ap))
select f.user_id, f.id, f.collection_id, rd.id is not null is_read, row_number() over (partition by f.user_id order by rd.id is not null, f.created_at desc, f.id) place from fav f left join rd on rd.user_id = f.user_id and rd.id = f.id""")
def favorites_index(spark, d):
    """Clicks until mid-September, and applications to groups whose id is below 4, are the read marks."""
    f = _favorites(spark, d)
    return favorites.index(f, _clicks(spark, d).where("clicked_at < '2026-09-15'"), _groups(spark, d), f.where("id < '4'"))


@query(f"""with {FAVS} select user_id, id, collection_id from fav f where collection_id is null or exists (select 1 from col where col.user_id = f.user_id and col.id = f.collection_id)""")
def favorites_owned(spark, d):
    return favorites.owned(_favorites(spark, d).drop("created_at"), _collections(spark, d))


@query(f"""with {FAVS}, x as (select f.user_id, col.id collection_id, count(*) n from fav f left join col on col.user_id = f.user_id and col.id = f.collection_id group by 1, 2)
select * from x union all select user_id, id, 0 from col where not exists (select 1 from x where x.user_id = col.user_id and x.collection_id = col.id)""")
def favorite_buckets(spark, d):
    return favorites.counts(_favorites(spark, d), _collections(spark, d))


@query(f"""with {FAVS} select user_id, id, coalesce(collection_id, -1) collection_id from fav where collection_id is null or collection_id = 49""")
def favorites_of_collection(spark, d):
    """The favourites view for the collection 49 and for none."""
    return _favorites(spark, d).where("collection_id is null or collection_id = 49").select("user_id", "id", F.coalesce("collection_id", F.lit(-1)).cast("bigint").alias("collection_id"))


@query(f"""with {FAVS}, u as (select distinct user_id from fav), a as (select user_id, s seq, trim(case when s = 1 then '' when s = 2 then repeat('x', 25) when s = 3 then 'c48' when s < 40 then 'n' || s::varchar else ' n10 ' end) as name from u cross join (select unnest(range(1, 42)) s) s),
k as (select *, length(name) between 1 and 24 ok from a), n as (select k.*, ok and name <> 'c48' and seq = min(seq) over (partition by user_id, name) nw from k),
p as (select *, 6 + sum(nw::int) over (partition by user_id order by seq) - nw::int >= 30 full_ from n)
select user_id, seq, name, case when not ok then 'bad_name' when full_ then 'too_many' when not nw then 'taken' else 'created' end result from p""")
def collections_create(spark, d):
    """Each user, with six collections, asks for 41: a blank and a too long name, a taken one, 36 new ones, and one twice again."""
    s = F.col("seq")
    name = F.when(s == 1, "").when(s == 2, F.repeat(F.lit("x"), F.lit(25))).when(s == 3, "c48").when(s < 40, F.concat(F.lit("n"), s.cast("string"))).otherwise(" n10 ")
    u = _favorites(spark, d).select("user_id").distinct()
    return favorites.created(_collections(spark, d), u.select("user_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(41).cast("bigint"))).alias("seq")).withColumn("name", name))


@query("select o_orderkey token_hash, o_custkey user_id from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def sessions_of_disabled(spark, d):
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("active"), "c_acctbal")
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("token_hash"), F.col("o_custkey").alias("user_id"))
    return favorites.disabled(u.drop("c_acctbal"), s, u.where("c_acctbal < 0"))[1]


@query("select c_custkey user_id, case when c_acctbal < 0 then 0 else 1 end active from customer")
def users_disabled(spark, d):
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("active"), "c_acctbal")
    return favorites.disabled(u.drop("c_acctbal"), u.select(F.lit(0).alias("token_hash"), "user_id"), u.where("c_acctbal < 0"))[0]


@query(f"""with ck as (select user_id, url, max(clicked_at) clicked_at from clicks group by 1, 2), n as (select distinct 1::bigint user_id, "文章链接" url, '{NOW}' clicked_at from articles where starts_with("文章链接", '{PREFIX}s/'))
select * from n union all select * from ck where not (user_id = 1 and starts_with(url, '{PREFIX}s/') and url in (select url from n))""")
def clicks_import(spark, d):
    """All links of articles imported for one user, of which those with the prefix are taken."""
    rows = table(spark, d, "articles").select(F.lit(1).cast("bigint").alias("user_id"), F.col("文章链接").alias("url"), F.lit(NOW).alias("clicked_at"))
    return favorites.imported(_clicks(spark, d), rows, f"{PREFIX}s/")


@query("select user_id, string_agg(url || '=' || clicked_at, ' ' order by url) clicks, count(*) n from (select user_id, url, max(clicked_at) clicked_at from clicks where clicked_at is not null group by 1, 2) group by 1")
def clicks_of_users(spark, d):
    """Each user's click map, in the order of its links."""
    c = _clicks(spark, d).where("clicked_at is not null")
    m = F.array_sort(F.collect_list(F.struct("url", "clicked_at")))
    return c.groupBy("user_id").agg(F.array_join(F.transform(m, lambda x: F.concat(x["url"], F.lit("="), x["clicked_at"])), " ").alias("clicks"), F.count(F.lit(1)).alias("n"))
