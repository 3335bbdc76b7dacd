"""Writing the board's files. Tables of any size are written in parallel, partitioned; reports are ordered text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardweave.functions.titles import text
from boardweave.operators.ingest import daily
from boardweave.operators.scratch import dropped, written
from boardweave.operators.state import upsert
from boardweave.sources import files


def account_csvs(articles: DataFrame, folder: str) -> None:
    """One folder of CSV files per account, all fields quoted."""
    articles.withColumn("account", text(F.col("公众号"))).write.mode("overwrite").partitionBy("account").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)


def summary_csv(articles: DataFrame, path: str, source: str = "微信读书") -> None:
    """The five columns, with a constant source, latest first."""
    a = articles.select("公众号", "发布日期", "文章标题", "文章链接", F.lit(source).alias("来源"))
    a.orderBy(F.desc("发布日期"), F.desc("文章标题"), "文章链接").write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def daily_partitions(rows: DataFrame, folder: str, today: str, order: list[str]) -> None:
    """Rows merged by link into their days' files; the greatest by ``order`` of a link stays; other days aren't touched.

    What the days held is written to the shared folder first, as a folder can't be read while it is overwritten.
    """
    fresh = daily(rows, today)
    if files.exists(rows.sparkSession, folder):
        days = fresh.select("day").distinct()
        kept = rows.sparkSession.read.schema(fresh.schema).parquet(folder).join(F.broadcast(days), "day", "left_semi")  # days: one row a day
        fresh = upsert(kept.select(*fresh.columns).limit(0), kept.select(*fresh.columns).unionByName(fresh), ["url", "day"], order)
    merged = written(fresh)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
    dropped(merged)


def markdown_lines(groups: DataFrame) -> DataFrame:
    """date, account, line of a report, one line per group with the number of its other members."""
    more = F.when(F.col("n_members") > 1, F.concat(F.lit("（同题 "), F.col("n_members").cast("string"), F.lit(" 篇）"))).otherwise("")
    return groups.select("date", "account", F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")"), more).alias("line"))


def markdown(groups: DataFrame, path: str) -> None:
    markdown_lines(groups).orderBy(F.desc("date"), "account", "line").select("line").write.mode("overwrite").text(path)


def group_json(groups: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").json(path)


def clicked_json(clicks: DataFrame, path: str) -> None:
    clicks.groupBy("url").agg(F.max("clicked_at").alias("clicked_at")).orderBy("url").write.mode("overwrite").json(path)
