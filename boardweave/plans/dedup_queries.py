"""Queries of duplicate detection and grouping."""

from pyspark.sql import functions as F

from boardweave.functions import dims
from boardweave.functions import titles as T
from boardweave.functions.links import group_id
from boardweave.operators import dedup, graph
from boardweave.plans.registry import query
from boardweave.plans.views import ARTICLES, MEMBERS, articles, members, norm, table

#: The first two letters of a tenth of all titles serve as brands of the test data: a table for the brand operators.
DEMO_BRANDS = [("QIXI", "", ["栖霁大学", "栖霁"]), ("QIXI_JIUYE", "QIXI", ["栖霁大学就业"]), ("KAIFANG", "", ["开放日"]), ("XIAOZHAO", "", ["校园招聘"]), ("TIQIAN", "XIAOZHAO", ["提前批"]), ("NEITUI", "", ["内推码"])]
DEMO = T.Brands(DEMO_BRANDS, ["XIAOZHAO"])
_ALIASES = {a: b for b, _, names in DEMO_BRANDS for a in names}
_PATTERN = "|".join(sorted(_ALIASES, key=lambda a: (-len(a), a)))
_CASE = "case x " + " ".join(f"when '{a}' then '{b}'" for a, b in _ALIASES.items()) + " end"
_ABOVE = {"QIXI_JIUYE": "QIXI", "TIQIAN": "XIAOZHAO"}
BRANDED = f"""br as (select distinct title, list_distinct(list_transform(regexp_extract_all(title, '{_PATTERN}'), lambda x: {_CASE})) ms from a),
be as (select title, list_sort(list_filter(ms, lambda b: not ((b = 'QIXI' and list_contains(ms, 'QIXI_JIUYE')) or (b = 'XIAOZHAO' and list_contains(ms, 'TIQIAN'))))) eff from br)"""


@query(f"""with {ARTICLES}, k as (select *, {norm('title')} key from a),
w as (select *, row_number() over (partition by key order by date desc, title desc, url desc) rn, count(*) over (partition by key) n from k where key <> '')
select key, url, account, date, title, n n_members from (select distinct key, url, date, title, n, account, row_number() over (partition by key order by date desc, title desc, url desc, account desc) r2 from w) where r2 = 1""")
def dedup_exact(spark, d):
    return dedup.exact_groups(articles(spark, d))


@query(f"""with {ARTICLES}, k as (select distinct url, {norm('title')} key from a), h as (select key, min(url) a from k group by 1)
select distinct h.a, k.url b from k join h using (key) where k.url <> h.a""")
def dedup_exact_pairs(spark, d):
    return dedup.exact_links(articles(spark, d))


def _unwrap_sql() -> str:
    from boardweave.functions import dims

    out = "norm"
    p = " ".join(f"when starts_with(norm,'{w}') and length(norm)-{len(w)}>=8 then substr(norm,{len(w) + 1})" for w in dims.WRAP_PREFIXES)
    s = " ".join(f"when suffix(p,'{w}') and length(p)-{len(w)}>=8 then left(p,length(p)-{len(w)})" for w in dims.WRAP_SUFFIXES)
    return f"""n as (select distinct url, {norm('title')} norm from a), p as (select url, norm, case {p} else {out} end p from n),
u as (select url, norm, case {s} else p end key from p)"""


#: Rows of later batches as an event column reports them again: its name before the title, its kind behind.
_WRAPPED = f"""w as (select * from a), a2 as (select url, case when batch_no > 0 then '{dims.WRAP_PREFIXES[0]}' || title || '{dims.WRAP_SUFFIXES[0]}' else title end title from a
union all select url || '#again', title || '{dims.WRAP_SUFFIXES[-1]}' from a where batch_no = 0)"""


def _wrapped(a):
    t = F.when(F.col("batch_no") > 0, F.concat(F.lit(dims.WRAP_PREFIXES[0]), "title", F.lit(dims.WRAP_SUFFIXES[0]))).otherwise(F.col("title"))
    again = a.where("batch_no = 0").select(F.concat("url", F.lit("#again")).alias("url"), F.concat("title", F.lit(dims.WRAP_SUFFIXES[-1])).alias("title"))
    return a.select("url", t.alias("title")).union(again)


@query(f"""with {ARTICLES}, {_WRAPPED}, {_unwrap_sql().replace(" from a)", " from a2)")}, h as (select key, min(struct_pack(url := url, norm := norm)) h from u where length(key) >= 8 group by 1)
select distinct h.h.url a, u.url b from u join h using (key) where u.url <> h.h.url and u.norm <> h.h.norm""")
def dedup_unwrap_pairs(spark, d):
    return dedup.unwrap_links(_wrapped(articles(spark, d)))


@query(f"""with {ARTICLES}, t as (select distinct {norm('title')} t from a), x as (select t from t where length(t) >= 5),
g as (select t, unnest(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)))) g from x)
select s.t short, g.t long from x s join g on left(s.t, 5) = g.g where contains(g.t, s.t) and length(g.t) > length(s.t)""")
def contain_candidates(spark, d):
    return dedup.contained(articles(spark, d))


@query()
def similar_candidates(spark, d):
    return dedup.similar(articles(spark, d))


@query()
def similar_candidates_topk(spark, d):
    return dedup.top_similar(articles(spark, d), 2000)


@query(f"with {ARTICLES}, {BRANDED} select title, array_to_string(eff, ',') brands from be")
def brand_effective(spark, d):
    return articles(spark, d).select("title").distinct().select("title", F.array_join(DEMO.effective(F.col("title")), ",").alias("brands"))


@query(f"""with {ARTICLES}, {BRANDED}, t as (select url, max(title) title from a group by 1), tb as (select url, eff from t join be using (title)),
e as (select distinct urls[1] a, urls[2] b from decided_pairs where duplicate and urls[1] <> urls[2])
select e.a, e.b, coalesce(len(x.eff) = 1 and len(y.eff) = 1 and x.eff[1] <> y.eff[1] and
 (not ((x.eff[1] = 'TIQIAN' and y.eff[1] = 'XIAOZHAO') or (x.eff[1] = 'XIAOZHAO' and y.eff[1] = 'TIQIAN') or (x.eff[1] = 'QIXI' and y.eff[1] = 'QIXI_JIUYE') or (x.eff[1] = 'QIXI_JIUYE' and y.eff[1] = 'QIXI'))
  or x.eff[1] in ('XIAOZHAO', 'TIQIAN')), false) veto from e join tb x on x.url = e.a join tb y on y.url = e.b""")
def brand_veto(spark, d):
    p = table(spark, d, "decided_pairs").where("duplicate").select(F.get("urls", F.lit(0)).alias("a"), F.get("urls", F.lit(1)).alias("b")).where("a <> b").distinct()
    return dedup.vetoed(p, articles(spark, d), DEMO)


def _entity_sql() -> str:
    from boardweave.functions import dims

    e = "regexp_replace(title,'[^\\p{L}\\p{N}]+','','g')"
    for w in sorted(dims.ENTITY_STOPWORDS, key=lambda w: (-len(w), w)):
        e = f"replace({e},'{w}','')"
    return f"lower({e})"


@query(f"with {ARTICLES} select row_id, {_entity_sql()} entity from a")
def entity_text(spark, d):
    return articles(spark, d).select("row_id", T.entity(F.col("title")).alias("entity"))


@query("""with x as (select pair_id, duplicate, rule, veto, decided_at, least(urls[1], urls[2]) lo, greatest(urls[1], urls[2]) hi, case when pair_id % 2 = 0 then 0 else 1 end gen from decided_pairs where urls[1] is not null and urls[2] is not null),
r as (select *, row_number() over (partition by lo, hi order by gen desc, decided_at desc nulls last, pair_id desc) rn from x where lo <> hi)
select lo, hi, duplicate, rule, veto, decided_at, pair_id from r where rn = 1""")
def decision_upsert(spark, d):
    p = table(spark, d, "decided_pairs")
    return dedup.upsert_decisions(p.where("pair_id % 2 = 0"), p.where("pair_id % 2 <> 0"))


@query(f"""with {ARTICLES}, {MEMBERS}, x as (select *, least(urls[1], urls[2]) lo, greatest(urls[1], urls[2]) hi from decided_pairs where urls[1] is not null and urls[2] is not null and urls[1] <> urls[2]),
dd as (select lo, hi, duplicate from (select *, row_number() over (partition by lo, hi order by decided_at desc nulls last, pair_id desc) rn from x) where rn = 1),
t as (select url, max({norm('title')}) norm from a group by 1), mm as (select distinct group_id, url, {norm('title')} norm from m),
c as (select distinct lo, hi, p.norm tl, q.norm th from x join t p on p.url = lo join t q on q.url = hi),
tog as (select distinct i.url lo, j.url hi, i.norm tl, j.norm th from mm i join mm j on i.group_id = j.group_id and i.url < j.url)
select c.lo, c.hi, case when tog.lo is not null then 'confirmed' when dd.duplicate then 'cached' when not dd.duplicate then 'rejected' else 'ask' end verdict
from c left join tog on tog.lo = c.lo and tog.hi = c.hi and tog.tl = c.tl and tog.th = c.th left join dd on dd.lo = c.lo and dd.hi = c.hi""")
def pair_reuse(spark, d):
    p = table(spark, d, "decided_pairs")
    known = dedup.upsert_decisions(p.limit(0), p)
    t = articles(spark, d).groupBy("url").agg(F.max(T.normalized(F.col("title"))).alias("norm"))
    c = known.select("lo", "hi").join(t.toDF("lo", "title_lo"), "lo").join(t.toDF("hi", "title_hi"), "hi")
    m = members(spark, d).select("group_id", "url", T.normalized(F.col("title")).alias("norm")).distinct()
    return dedup.reused(c, known, m)


EDGES = f"""e as (select distinct urls[1] a, urls[2] b from decided_pairs where duplicate and urls[1] <> urls[2]),
e2 as (select a, b from e union select b, a from e)"""


@query(f"""with recursive {EDGES}, r(v, w) as (select a, a from e2 union select r.v, e2.b from r join e2 on e2.a = r.w)
select v as value, min(w) root from r group by 1""")
def components(spark, d):
    p = table(spark, d, "decided_pairs").where("duplicate").select(F.get("urls", F.lit(0)).alias("a"), F.get("urls", F.lit(1)).alias("b"))
    return graph.connected(p)


@query(f"""with recursive {EDGES}, {ARTICLES}, r(v, w) as (select a, a from e2 union select r.v, e2.b from r join e2 on e2.a = r.w), c as (select v url, min(w) root from r group by 1),
t as (select url, max(struct_pack(date := date, title := title)) x from a group by 1), j as (select c.root, c.url, x.date, x.title, row_number() over (partition by c.root order by x.date desc, x.title desc, c.url desc) rn, count(*) over (partition by c.root) n from c join t using (url))
select root, url, date, title, n n_members from j where rn = 1""")
def group_canonical(spark, d):
    t = articles(spark, d).groupBy("url").agg(F.max(F.struct("date", "title")).alias("x")).select("url", "x.*")
    j = components(spark, d).withColumnRenamed("value", "url").join(t, "url")
    best = F.max_by(F.struct("url", "date", "title"), F.struct("date", "title", "url"))
    return j.groupBy("root").agg(best.alias("c"), F.count(F.lit(1)).alias("n_members")).select("root", "c.*", "n_members")


@query(f"""with {MEMBERS} select group_id, substr(sha256(array_to_string(list_sort(list(distinct url)), chr(10))),1,24) id, count(distinct url) n from m group by 1""")
def group_ids(spark, d):
    g = table(spark, d, "dedup_groups").select("group_id", F.filter(F.transform("members", lambda m: m["文章链接"]), lambda u: u.isNotNull()).alias("u")).where(F.size("u") > 0)
    return g.select("group_id", group_id(F.col("u")).alias("id"), F.size(F.array_distinct("u")).cast("bigint").alias("n"))


@query(f"""with {MEMBERS}, a as (select coalesce(title,'') title from m), {BRANDED}, x as (select m.group_id // 4 group_id, e.eff[1] b from m join be e on e.title = coalesce(m.title,'') where len(e.eff) = 1)
select group_id, array_to_string(list_sort(list(distinct b)), ',') brands from x group by 1 having count(distinct b) > 1""")
def mixed_brand_audit(spark, d):
    """Four neighbouring rows stand for a group that was wrongly merged."""
    m = members(spark, d).select(F.floor(F.col("group_id") / 4).alias("group_id"), DEMO.effective(F.coalesce("title", F.lit(""))).alias("b")).where(F.size("b") == 1)
    g = m.groupBy("group_id").agg(F.array_sort(F.collect_set(F.get("b", F.lit(0)))).alias("b"))
    return g.where(F.size("b") > 1).select("group_id", F.array_join("b", ",").alias("brands"))
