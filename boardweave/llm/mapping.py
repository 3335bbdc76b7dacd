"""Typed values mapped to the closest entry of a reference list; values that stand for no entry are reported.

Method: prefix-filter set-similarity join. A value and each entry are token sets (characters of a Chinese name's
core, padded letter pairs of a Latin one, and the line of business where given). Tokens are ordered by global
rarity; only the rarest |x| - ceil(t |x|) + 1 of a set are joined; the length filter and the positional filter
leave few pairs, whose Jaccard similarity is computed exactly; the best entry at or above the threshold is kept.
Ties go to the entry with more characters in the same place, then to the smaller id.

Values are made distinct before anything else, so a value typed by a third of all rows is mapped once.

Defined results: null and blank values are no values; a value without letters ('-') stands for no entry; every
record and field has each entry once, -1 at most once; an empty list maps everything to -1; an empty table gives
an empty result; columns besides those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardweave.llm.common import written
from boardweave.llm.names import Lists

#: Jaccard similarity from which a value stands for an entry.
CITY_LIKE, UNIT_LIKE = 0.5, 0.6
#: What separates the values of a typed list (fixed value).
SEPARATORS = r"[、，,;；/|\s\p{Z}]+"


def grams(text: str) -> list[str]:
    """Padded letter pairs."""
    t = f"^{text}$"
    return [t[i : i + 2] for i in range(len(t) - 1)]


def _latin(text: str) -> bool:
    return text.isascii()


def tokens(name: str, industry: str = "") -> list[str]:
    out = set(grams(name) if _latin(name) else name)
    return sorted(out | ({f"<{industry}>"} if industry else set()))


def city_entries(lists: Lists, cities: list[tuple]) -> list[tuple]:
    """(ref_id, name, tokens) of each way to write a city of the list."""
    return [(i, n, tokens(n)) for i, zh, _, la in cities for n in (zh, (la or "").lower()) if n]


def unit_entries(lists: Lists) -> list[tuple]:
    return [(i, n, tokens(n, ind)) for i, (zh, la, ind) in lists.core.items() for n in (zh, la.replace(" ", "")) if n]


def prefix_join(values: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """value, ref_id of the best entry of each value: values(value, name, tokens), entries(ref_id, name, tokens)."""
    sides = values.select(F.lit(0).alias("side"), F.col("value").alias("key"), "name", "tokens").unionByName(
        entries.select(F.lit(1).alias("side"), F.concat_ws(" ", F.col("ref_id").cast("string"), "name").alias("key"), "name", "tokens")
    )
    each = sides.select("side", "key", F.explode("tokens").alias("token"))
    rare = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(rare, "token").groupBy("side", "key").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
    n = F.size("o")
    keep = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    cut = ordered.select("side", "key", F.col("o.token").alias("set"), n.alias("n"), F.posexplode(F.slice("o", F.lit(1), keep)).alias("pos", "t")).select("side", "key", "set", "n", "pos", F.col("t.token").alias("token"))
    x, y = cut.where("side = 0").drop("side"), cut.where("side = 1").drop("side")
    y = y.toDF("ykey", "yset", "m", "ypos", "token")
    long = F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9
    # after this token at most so many more can be common
    reach = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("ypos")) >= F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m")) - 1e-9
    pairs = x.join(y, "token").where(long & reach).select("key", "ykey", "set", "yset").distinct()
    common = F.size(F.array_intersect("set", "yset"))
    like = common / (F.size("set") + F.size("yset") - common)
    good = pairs.withColumn("like", like).where(F.col("like") >= threshold - 1e-9)
    good = good.join(values.select(F.col("value").alias("key"), F.col("name").alias("xn")), "key").withColumn("ref_id", F.split("ykey", " ")[0].cast("bigint")).withColumn("yn", F.substring_index("ykey", " ", -1))
    same = F.aggregate(F.sequence(F.lit(1), F.least(F.length("xn"), F.length("yn"))), F.lit(0), lambda a, i: a + (F.substr("xn", i, F.lit(1)) == F.substr("yn", i, F.lit(1))).cast("int"))
    best = F.min_by("ref_id", F.struct(-F.col("like"), -same, F.col("ref_id")))
    return good.groupBy("key").agg(best.alias("ref_id")).withColumnRenamed("key", "value")


def mapped(records: DataFrame, kind: str, lists: Lists, entries: list[tuple], threshold: float) -> DataFrame:
    """rec_id, ref_id for records(rec_id, value); kind is 'city' or 'unit'."""
    spark = records.sparkSession

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, sets = [], []
            for v in pdf.value:
                if kind == "city":
                    name, industry = lists.place(v), ""
                else:
                    got = lists.parse(v)
                    name, industry = (got.core, got.industry) if got else ("", "")
                names.append(name)
                sets.append(tokens(name, industry) if name else [])
            yield pdf.assign(name=names, tokens=sets)

    distinct = records.select("value").distinct()
    values = written(distinct.mapInPandas(read, "value string, name string, tokens array<string>"))
    refs = spark.createDataFrame(entries, "ref_id bigint, name string, tokens array<string>") if entries else spark.createDataFrame([], "ref_id bigint, name string, tokens array<string>")
    best = prefix_join(values.where(F.size("tokens") > 0), refs, threshold)
    answer = written(values.select("value").join(best, "value", "left").select("value", F.coalesce("ref_id", F.lit(-1)).cast("bigint").alias("ref_id")))
    return records.join(answer, "value").select("rec_id", "ref_id").distinct()


def _pieces(text: Column) -> Column:
    invisible = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{Cf}]", "")
    return F.array_distinct(F.filter(F.split(invisible, SEPARATORS), lambda x: x != ""))


def typed_places(screens: DataFrame) -> DataFrame:
    """rec_id, value of every city typed in locations."""
    return screens.select(F.col("entry_id").cast("bigint").alias("rec_id"), F.explode(_pieces(F.col("locations"))).alias("value"))


def preferred_places(preferences: DataFrame) -> DataFrame:
    """rec_id, value of every preferred city: a JSON array, or a plain list where it is none."""
    listed = F.from_json("cities", "array<string>")
    bare = F.regexp_replace("cities", r'^\s*\[|\]\s*$|"', "")
    text = F.when(listed.isNotNull(), F.array_join(listed, "、")).otherwise(bare)
    return preferences.select(F.col("user_id").cast("bigint").alias("rec_id"), F.explode(_pieces(text)).alias("value"))


def typed_units(screens: DataFrame) -> DataFrame:
    blank = F.regexp_replace(F.coalesce("unit", F.lit("")), r"[\s\p{Z}\p{Cf}]+", "") == ""
    return screens.where(~blank).select(F.col("entry_id").cast("bigint").alias("rec_id"), F.col("unit").alias("value"))


def typed_to_listed(screens: DataFrame, preferences: DataFrame, cities: DataFrame, units: DataFrame) -> DataFrame:
    """field_name, rec_id, ref_id over all typed values of the two tables."""
    from boardweave.llm.names import learned

    lists = learned(cities, units)
    towns = city_entries(lists, [tuple(r) for r in cities.select("city_id", "city_name", "province", "latin_name").collect()])
    parts = [
        mapped(typed_places(screens), "city", lists, towns, CITY_LIKE).withColumn("field_name", F.lit("locations")),
        mapped(preferred_places(preferences), "city", lists, towns, CITY_LIKE).withColumn("field_name", F.lit("cities")),
        mapped(typed_units(screens), "unit", lists, unit_entries(lists), UNIT_LIKE).withColumn("field_name", F.lit("unit")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).select("field_name", "rec_id", "ref_id")
