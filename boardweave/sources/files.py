"""Reading the board's files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardweave.functions.titles import text

# The columns of an account file.
ARTICLE_COLUMNS = ("公众号", "发布日期", "文章标题", "文章链接", "来源")
MEMBER = "struct<`公众号`:string,`发布日期`:string,`文章标题`:string,`文章链接`:string>"
GROUP_FILE = f"generated_at string, source_rows bigint, groups array<struct<canonical:{MEMBER},members:array<{MEMBER}>>>, decided_pairs array<struct<urls:array<string>,titles:array<string>,duplicate:boolean,rule:string,veto:string,decided_at:string>>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def account_files(spark: SparkSession, folder: str, name: str = "*.csv") -> DataFrame:
    """All account CSVs of a folder but for those named 汇总-*; byte-order marks, quotes and quoted line breaks are read; '' for missing."""
    schema = ", ".join(f"`{c}` string" for c in ARTICLE_COLUMNS)
    if not exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], schema + ", file string")
    r = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(f"{folder}/{name}")
    r = r.select("*", F.url_decode(F.col("_metadata.file_name")).alias("file")).where(~F.startswith("file", F.lit("汇总-")))
    return r.select(*[text(F.col(f"`{c}`")).alias(c) for c in ARTICLE_COLUMNS], "file")


def account_file(spark: SparkSession, folder: str, account: str) -> DataFrame:
    """One account's rows, of its file alone; no file, no rows."""
    return account_files(spark, folder, f"{account}.csv").drop("file")


def group_file(spark: SparkSession, path: str) -> DataFrame:
    """group_id, canonical, members of a group file; its place in the file is its id."""
    g = spark.read.schema(GROUP_FILE).option("multiLine", True).json(path)
    return g.select("generated_at", F.posexplode("groups").alias("group_id", "g")).select("group_id", "generated_at", "g.*")


def decision_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUP_FILE).option("multiLine", True).json(path).select(F.explode("decided_pairs").alias("d")).select("d.*")


def json_rows(spark: SparkSession, path: str, schema: str, where: str = "true") -> DataFrame:
    """Rows of a JSON array; a missing or damaged file, and rows that fail the condition, give none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where(where)


def clicked_file(spark: SparkSession, path: str, prefix: str, now: str) -> DataFrame:
    """url, clicked_at of a click file, wrapped in {urls: {..}} or bare; a stamp that is no text counts as now."""
    if not exists(spark, path):
        return spark.createDataFrame([], "url string, clicked_at string")
    t = spark.read.text(path, wholetext=True)
    return clicked_json(t, "value", prefix, now)


def clicked_json(df: DataFrame, col: str, prefix: str, now: str) -> DataFrame:
    whole = F.get_json_object(col, "$.urls")
    body = F.coalesce(whole, F.col(col))
    m = df.select(F.explode(F.from_json(body, "map<string,variant>")).alias("url", "v"))
    # every string is a stamp, whatever it says; numbers, objects and null aren't
    stamp = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
    return m.where(F.startswith("url", F.lit(prefix))).select("url", F.coalesce(stamp, F.lit(now)).alias("clicked_at"))


def clicked_report(spark: SparkSession, path: str, prefix: str, now: str) -> DataFrame:
    """The click map embedded in a report page."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)var\s+CLICKED\w*\s*=\s*(\{.*?\})\s*;", 1).alias("value"))
    return clicked_json(t.where("value <> ''"), "value", prefix, now)


def account_list(spark: SparkSession, path: str, default: list[str]) -> DataFrame:
    """Names of a text file without blank lines and comments; the default where none is left."""
    got = spark.read.text(path).select(F.trim("value").alias("account")).where("account <> '' and not startswith(account, '#')")
    return got if got.limit(1).count() else spark.createDataFrame([(d,) for d in default], "account string")


def cache_rows(shares: DataFrame, prefix: str) -> DataFrame:
    """account, title, url of cache rows(url, author, share_data JSON); the author, else the brand name."""
    j = shares.select("url", "author", F.from_json("share_data", "title string, brandName string").alias("j"))
    account = F.coalesce(F.nullif(F.trim(text(F.col("author"))), F.lit("")), F.trim(text(F.col("j.brandName"))))
    return j.select(account.alias("account"), F.trim(text(F.col("j.title"))).alias("title"), "url").where(F.startswith(text(F.col("url")), F.lit(prefix)) & (F.col("title") != ""))
