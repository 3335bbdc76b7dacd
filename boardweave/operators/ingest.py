"""Incremental collection: flattening, merging, stop rules, resume depth, first-seen state and the ledger."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardweave.functions.events import epoch_day
from boardweave.functions.titles import normalized, text
from boardweave.operators.state import upsert


def flattened(pages: DataFrame) -> DataFrame:
    """Articles of API pages: reviews, then sub-reviews; the link from the original id, with ~ as _."""
    r = pages.select(F.explode("reviews").alias("r")).select(F.explode("r.subReviews").alias("s"), F.col("r.createTime").alias("rt"))
    rv = F.col("s.review")
    url = F.concat(F.lit("https://mp.weixin.qq.com/s/"), F.translate(rv["mpInfo"]["originalId"], "~", "_"))
    out = r.select(F.trim(rv["mpInfo"]["title"]).alias("title"), url.alias("url"), epoch_day(F.coalesce(rv["createTime"], F.col("rt"))).alias("date"))
    return out.where("title <> '' and url is not null").dropDuplicates(["url"])


def unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose link isn't collected yet."""
    return rows.join(known.select("url").distinct(), "url", "left_anti")


def merged(old: DataFrame, fresh: DataFrame, order: list[str]) -> DataFrame:
    """By link; fresh rows override."""
    return upsert(old.where("url is not null"), fresh.where("url is not null"), ["url"], order)


def crawl_cut(pages: DataFrame, last_offset: int = 5000) -> DataFrame:
    """account, stop_page, reason: the first page at which collection stops.

    pages(account, page, offset, n, n_known, oldest, start): two empty pages running, all known, older than the
    window, or the offset at its limit.
    """
    w = Window.partitionBy("account").orderBy("page")
    empty2 = (F.col("n") == 0) & (F.coalesce(F.lag("n").over(w), F.lit(-1)) == 0)
    reason = F.when(empty2, "empty").when((F.col("n") > 0) & (F.col("n_known") == F.col("n")), "known").when(F.col("oldest") < F.col("start"), "range").when(F.col("offset") >= last_offset, "offset")
    return pages.withColumn("reason", reason).where("reason is not null").groupBy("account").agg(F.min("page").alias("stop_page"), F.min_by("reason", "page").alias("reason"))


def resume_depth(state: DataFrame, runs: DataFrame) -> DataFrame:
    """account, depth: kept at the larger of old and swept offset; cleared when a run got past it."""
    j = state.join(runs, "account", "full")
    old, swept = F.coalesce("depth", F.lit(0)), F.coalesce("swept", F.lit(0))
    done = F.coalesce("stopped_at_known", F.lit(False)) | F.coalesce("reached_end", F.lit(False))
    return j.select("account", F.when(F.coalesce("interrupted", F.lit(False)), F.greatest(old, swept)).when(done, 0).otherwise(F.greatest(old, swept)).cast("bigint").alias("depth"))


def first_seen(state: DataFrame, rows: DataFrame, today: str) -> DataFrame:
    """url, first_seen, last_seen, is_new: new rows only where there was a state before (the first run is a baseline)."""
    had = state.agg((F.count(F.lit(1)) > 0).alias("had"))
    r = rows.where("url is not null").select("url").distinct().withColumn("now", F.lit(today))
    j = state.join(r, "url", "full").crossJoin(F.broadcast(had))  # one row, an aggregate
    return j.select("url", F.coalesce("first_seen", "now").alias("first_seen"), F.coalesce("now", "last_seen").alias("last_seen"), (F.col("first_seen").isNull() & F.col("had")).alias("is_new"))


def ledger_dates(ledger: DataFrame) -> DataFrame:
    """account, key, date: titles of the ledger with exactly one date."""
    l = ledger.select("account", normalized(F.col("title")).alias("key"), "date").where("coalesce(date, '') <> ''")
    return l.groupBy("account", "key").agg(F.min("date").alias("date"), F.max("date").alias("last")).where("date = last").drop("last")


def enriched(rows: DataFrame, records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows with missing dates filled from records by link, then from the ledger by account and title."""
    rec = records.where("coalesce(date, '') <> ''").groupBy("url").agg(F.max("date").alias("rd"))
    led = ledger_dates(ledger).withColumnRenamed("date", "ld")
    j = rows.withColumn("key", normalized(F.col("title"))).join(rec, "url", "left").join(led, ["account", "key"], "left")
    nz = lambda c: F.nullif(F.trim(text(F.col(c))), F.lit(""))
    return j.withColumn("date", F.coalesce(nz("date"), nz("rd"), nz("ld"), F.lit(""))).drop("key", "rd", "ld")


def daily(rows: DataFrame, today: str) -> DataFrame:
    """rows with the day of their partition: their date, or today's."""
    return rows.withColumn("day", F.coalesce(F.nullif(F.trim(text(F.col("date"))), F.lit("")), F.lit(today)))
