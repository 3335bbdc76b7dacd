"""Queries of the training-data operators, each over its whole tables, and the SQL that some can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLE, LINK = "文章标题", "文章链接"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the members that supply each surviving field of a group."""
    from boardweave.llm.canonical import survivors

    return survivors(_read(spark, sf_dir, "dedup_groups")).select("group_id", "account_link", "date_link", "title_link")


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving records, with the number of values judged true for each field."""
    from boardweave.llm.canonical import survivors

    s = survivors(_read(spark, sf_dir, "dedup_groups"))
    return s.select("group_id", "account", "date", "title", *[F.coalesce(F.size(f"{f}s_true"), F.lit(0)).alias(f"true_{f}s") for f in ("account", "date", "title")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the city and unit lists that typed cities and employers stand for; -1 for none."""
    from boardweave.llm.mapping import typed_to_listed

    return typed_to_listed(*(_read(spark, sf_dir, t) for t in ("screen_results", "preferences", "city_list", "unit_list")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of articles of batch 1 and later that repeat or nearly repeat a row of a smaller batch."""
    from boardweave.llm.incremental import repeated_rows

    return repeated_rows(_read(spark, sf_dir, "articles"), "row_id", "batch_no", TITLE, LINK).where("batch >= 1").select(F.col("id").alias("row_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each joined link that isn't the smallest of its group, with that smallest link."""
    from boardweave.llm import components, links

    edges = links.verdict_edges(_read(spark, sf_dir, "decided_pairs")).union(links.member_edges(_read(spark, sf_dir, "dedup_groups")))
    found = components.linked(edges, "a", "b").where("value <> group")
    return found.select(F.col("group").alias("group_link"), F.col("value").alias("link"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose title is that of a kept row in another format."""
    from boardweave.llm.formatting import copies

    return copies(_read(spark, sf_dir, "articles"), "row_id", TITLE).toDF("keep_row_id", "copy_row_id")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per title of articles, with the exact number of its copies."""
    from boardweave.llm.formatting import representatives

    return representatives(_read(spark, sf_dir, "articles"), "row_id", TITLE).toDF("keep_row_id", "copies")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different spellings of one employer."""
    from boardweave.llm.variants import variant_pairs

    return variant_pairs(*(_read(spark, sf_dir, t) for t in ("screen_results", "city_list", "unit_list")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of rows in a group of near-duplicate titles, but for copies of one title."""
    from boardweave.llm.near_titles import near_pairs

    return near_pairs(_read(spark, sf_dir, "articles"), "row_id", TITLE)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    from boardweave.llm.tokenizer import encoded

    return encoded(_read(spark, sf_dir, "documents"), "doc_id", "text").toDF("doc_id", "ids")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ids of every document decode to its text again."""
    from boardweave.llm.tokenizer import round_trips

    return round_trips(_read(spark, sf_dir, "documents"), "doc_id", "text").toDF("doc_id", "n_ids", "same")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least about half of an evaluation passage."""
    from boardweave.llm.leakage import leaks

    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents more than half of which is repeated keywords, links or tags."""
    from boardweave.llm.stuffing import stuffed_pages

    return stuffed_pages(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_survivors, p2_found, p3_found, p4_found, p5_found, p5_counts, p6_found, p7_found, p8_ids, p8_round_trip, p9_found, p10_found)}


# Fixed values as in canonical: what stands for a missing account or title.
P1_SQL = r"""with m as (select group_id, substr(generated_at, 1, 10) g, unnest(members) x from dedup_groups),
c as (select group_id, x."文章链接" link, case when regexp_full_match(x."发布日期", '\d{4}-\d{2}-\d{2}') and try_cast(x."发布日期" as date) is not null and x."发布日期" <= g then x."发布日期" end d,
 trim(coalesce(x."公众号", '')) not in ('', 'N/A', '未知', '—', 'null', '待补充') a,
 trim(coalesce(x."文章标题", '')) not in ('', 'N/A', 'null', '-', '无标题', '分享图片', '（标题缺失）') and not regexp_matches(x."文章标题", '(…|⋯|\.\.|。。)\s*$') t
 from m where trim(coalesce(x."文章链接", '')) <> ''),
o as (select *, row_number() over (partition by group_id order by d desc nulls last, link) k from c),
f as (select group_id, count(distinct link) n, arg_min(link, k) date_link, arg_min(link, k) filter (where a) account_link, arg_min(link, k) filter (where t) title_link from o group by 1)
select group_id, account_link, date_link, title_link from f where n >= 2"""

P4_SQL = """with recursive p as (select urls[1] a, urls[2] b from decided_pairs where duplicate and urls[1] <> urls[2]),
l as (select group_id, list_distinct(list_filter(list_transform(members, lambda m: m."文章链接"), lambda u: u is not null)) u from dedup_groups),
q as (select u[1] a, unnest(u[2:]) b from l where len(u) > 1), e as (select a, b from p union select b, a from p union select a, b from q union select b, a from q),
r(v, w) as (select a, a from e union select r.v, e.b from r join e on e.a = r.w), g as (select v, min(w) w from r group by 1)
select w group_link, v link from g where v <> w"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested in tests/llm."""
    return {"p1_found": P1_SQL, "p4_found": P4_SQL}
