"""Continuous ingestion with Structured Streaming."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardweave.operators.state import upsert


def article_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int | None = None) -> DataFrame:
    """New article files of a folder, with all their rows."""
    r = spark.readStream.schema(schema)
    s = (r.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else r).parquet(folder)
    return s.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))  # watermarks need an instant


def unrepeated(stream: DataFrame, lateness: str = "14 days") -> DataFrame:
    """An article stream with the first row to come of each link within the watermark; what comes later than that is lost."""
    return stream.withWatermark("fetched_at", lateness).dropDuplicatesWithinWatermark(["文章链接"])


def upsert_batches(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str], parts: int = 16, **trigger):
    """Every micro-batch upserted into a folder of parts by key hash; late rows are accepted whatever their date.

    Of rows with the same keys the greatest by ``order`` stays, in whichever batches they come; rows with a null or
    blank key are left out. A batch reads and rewrites only the parts that it touches, as ``table/n=<batch>/part=<k>``,
    and then writes what batch each part stands in to ``table/state/<batch>``. A batch that is run again starts from
    the state before it and writes the same. Parts that neither of the last two states names are removed.
    """

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(parts)).cast("int")
        fresh = batch.where(" and ".join(f"trim(coalesce(cast(`{k}` as string), '')) <> ''" for k in keys))
        touched = {r[0] for r in fresh.select(part).distinct().collect()}  # at most ``parts`` numbers
        before = _state(spark, table, n - 1)
        old = _parts(spark, table, {k: m for k, m in before.items() if k in touched}, batch.schema)
        merged = upsert(old.limit(0), old.unionByName(fresh), keys, order).withColumn("part", part)  # old rows may be the greater
        merged.repartition(min(parts, max(1, len(touched))), "part").write.mode("overwrite").partitionBy("part").parquet(f"{table}/n={n}")
        now = before | {k: n for k in touched}
        spark.createDataFrame(sorted(now.items()), STATE).coalesce(1).write.mode("overwrite").parquet(f"{table}/state/{n}")
        kept = set(now.items()) | set(before.items())
        for k, m in _state(spark, table, _before(spark, table, n - 1)).items():
            if (k, m) not in kept:
                fs, at = _at(spark, f"{table}/n={m}/part={k}")
                fs.delete(at, True)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).trigger(**(trigger or {"availableNow": True})).start()


STATE = "part int, n bigint"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _before(spark: SparkSession, table: str, n: int) -> int:
    """The last batch up to n that left a state, -1 for none; a state without its success mark doesn't count."""
    fs, at = _at(spark, f"{table}/state")
    done = [int(f.getPath().getName()) for f in fs.listStatus(at)] if fs.exists(at) else []
    return max([m for m in done if m <= n and fs.exists(_at(spark, f"{table}/state/{m}/_SUCCESS")[1])], default=-1)


def _state(spark: SparkSession, table: str, n: int) -> dict[int, int]:
    m = _before(spark, table, n) if n >= 0 else -1
    return {r.part: r.n for r in spark.read.schema(STATE).parquet(f"{table}/state/{m}").collect()} if m >= 0 else {}


def _parts(spark: SparkSession, table: str, state: dict[int, int], schema) -> DataFrame:
    paths = [f"{table}/n={n}/part={k}" for k, n in sorted(state.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upserted(spark: SparkSession, table: str, schema) -> DataFrame:
    """What upsert_batches has written so far."""
    return _parts(spark, table, _state(spark, table, 1 << 62), schema)


def limited_attempts(attempts: DataFrame, most: int = 10, seconds: int = 300) -> DataFrame:
    """client, at, accepted: at most ``most`` accepted attempts in the last ``seconds``; rejected ones don't count.

    Accepted attempts depend on one another, so the fold keeps the last stamps of each client as state. Rows come
    sorted by client, as a stream of batches, so no client is gathered whole: a client's state is at most ``most`` stamps.
    """
    cols = "client string, at bigint, id bigint, accepted boolean"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, recent = None, []
        for pdf in batches:
            out = []
            for c, at in zip(pdf["client"], pdf["at"]):
                if c != client:
                    client, recent = c, []
                recent = [x for x in recent if x > at - seconds]
                ok = len(recent) < most
                if ok:
                    recent.append(at)
                out.append(ok)
            yield pdf.assign(accepted=out)

    a = attempts.select(F.col("client").cast("string").alias("client"), F.col("at").cast("bigint").alias("at"), F.col("id").cast("bigint").alias("id")).where("client is not null and at is not null")
    return a.repartition("client").sortWithinPartitions("client", "at", "id").mapInPandas(fold, cols)


def counted_clicks(stream: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Clicks per window and type of an event stream(ts, event_type)."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
