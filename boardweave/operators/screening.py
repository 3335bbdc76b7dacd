"""Screening results: reuse, extraction and merging. The model itself is an injected function."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardweave.functions import dims
from boardweave.functions.titles import text


def reusable(kind: Column, version: Column, title: Column) -> Column:
    """Whether a stored result may be used again."""
    return F.coalesce(version == dims.RESULT_VERSION, F.lit(False)) | ((kind == "kept") & ~text(title).rlike(dims.FAIR_TITLE))


def reuse_split(groups: DataFrame, screens: DataFrame) -> DataFrame:
    """group_id, entry_id, how: the stored result of a group by the first of its links, else by its title; null: pending."""
    ok = screens.where(reusable(F.col("kind"), F.col("v"), F.col("title")))
    order = F.struct("screened_date", F.col("kind") != "kept", "entry_id")
    by_url = ok.select("entry_id", order.alias("o"), F.explode("urls").alias("url")).groupBy("url").agg(F.min_by("entry_id", "o").alias("e"))
    by_title = ok.where("trim(title) <> ''").groupBy(F.trim("title").alias("title")).agg(F.min_by("entry_id", order).alias("t"))
    u = groups.select("group_id", F.posexplode("urls").alias("pos", "url")).join(by_url, "url").groupBy("group_id").agg(F.min_by("e", "pos").alias("e"))
    j = groups.select("group_id", F.trim("title").alias("title")).join(u, "group_id", "left").join(by_title, "title", "left")
    return j.select("group_id", F.coalesce("e", "t").alias("entry_id"), F.when(F.col("e").isNotNull(), "url").when(F.col("t").isNotNull(), "title").otherwise("pending").alias("how"))


def merged_entry(urls: Column, more_urls: Column, accounts: Column, more_accounts: Column) -> Column:
    """Links as a sorted set, accounts distinct in order."""
    none = F.array().cast("array<string>")
    u = F.array_sort(F.array_compact(F.array_union(F.coalesce(urls, none), F.coalesce(more_urls, none))))
    return F.struct(u.alias("urls"), F.array_compact(F.array_distinct(F.concat(F.coalesce(accounts, none), F.coalesce(more_accounts, none)))).alias("accounts"))


def json_cut(reply: Column) -> Column:
    """From the first { to the last } of a model's reply; '' without."""
    return F.regexp_extract(text(reply), r"(?s)(\{.*\})", 1)


def extracted(pages: DataFrame, model) -> DataFrame:
    """url, reply, error of an injected model(text) -> str; a failing call is an error row, to be tried again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies, errors = [], []
            for t in pdf.text:
                try:
                    replies.append(model(t or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    replies.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"url": pdf.url, "reply": replies, "error": errors})

    return pages.select("url", "text").mapInPandas(run, "url string, reply string, error string")


def image_slices(images: DataFrame, width: int = 1000, tall: int = 2200, window: int = 2000, step: int = 1880) -> DataFrame:
    """image_id, part, top, height of the slices of images(image_id, w, h) that aren't decoration."""
    big = images.where("not ((h < 100 and w < 200) or h < 60 or w < 60)")
    sw = F.least(F.col("w"), F.lit(width))
    sh = F.when(F.col("w") > width, F.floor(F.col("h") * width / F.col("w"))).otherwise(F.col("h")).cast("bigint")
    b = big.select("image_id", sw.cast("bigint").alias("sw"), sh.alias("sh"))
    tops = F.when(F.col("sh") > tall, F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("sh") - 1, F.lit(step).cast("bigint")), lambda t: (t == 0) | (t + (window - step) < F.col("sh")))).otherwise(F.array(F.lit(0).cast("bigint")))
    s = b.select("image_id", "sw", "sh", F.posexplode(tops).alias("part", "top"))
    return s.select("image_id", F.col("part").cast("bigint").alias("part"), "top", F.when(F.col("sh") > tall, F.least(F.lit(window).cast("bigint"), F.col("sh") - F.col("top"))).otherwise(F.col("sh")).alias("height"))


def by_day(screens: DataFrame) -> DataFrame:
    """day, n, kept, entries: the entries of each screened day in order, as the day's file lists them."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("entry_id")), lambda x: x.cast("string")), " ")
    return screens.groupBy(F.col("screened_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "kept").alias("kept"), ids.alias("entries"))
