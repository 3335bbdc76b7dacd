"""Copies hidden by formatting: one representative and an exact count for each set of equal titles.

Method: canonical records are range-partitioned and sorted (Spark sorts externally, spilling to disk),
then one scan over adjacent runs compares the full keys.

The canonical record of a title is made inside the JVM: half-width, lower case, letters and digits only, with one
blank where signs stood. The order of a title's parts can't be made canonical by splitting, because the signs that
part a title (blank, dot, bar) are also the noise that is strewn into its words. So records are range-partitioned
and sorted by a hash of the title's sorted letters, which no order of parts changes, and the scan then compares the
full keys: two forms of a run are copies when every unbroken stretch of either stands unbroken in the other, in any
of the ways in which rows of these forms are split. That rejects titles with the same letters in another order (12
for 21, two words swapped inside a part).

Defined results: null and blank titles (no letter or digit) are no copies of anything and give no row;
a title of its own has one copy, itself; repeated rows (equal id and title) count once each; rows without an id
are left out; an empty
table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardweave.functions.width import NON_WORD, half_width
from boardweave.llm.common import partitions, written


def spaced(text: Column) -> Column:
    """The unbroken stretches of letters and digits of a title, parted by one blank; '' for null."""
    return narrowed(stretches(text))


def stretches(text: Column) -> Column:
    """The first half of spaced(), which is made but once where it is a column of its own."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NON_WORD, " ")


def narrowed(s: Column) -> Column:
    """The second half of spaced()."""
    return F.trim(F.when(s.rlike("[０-９ａ-ｚ]"), half_width(s)).otherwise(s))  # few titles have wide letters


def titled(text: Column) -> Column:
    """Whether a title has a letter or digit. Cheaper than to compare spaced(), which would be made twice."""
    return text.rlike(r"[\p{L}\p{N}]")


def unspaced(s: Column) -> Column:
    """The form of a spaced title: equal to folded() of its text."""
    return F.replace(s, F.lit(" "), F.lit(""))


def form_key(form: Column) -> Column:
    """16 bytes that stand for a form in joins."""
    return F.unhex(F.md5(form))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, form: the rows with an id and a title, and the key of their form."""
    t = df.where(titled(F.col(f"`{text_col}`")) & F.col(f"`{id_col}`").isNotNull())
    return t.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), form_key(unspaced(spaced(F.col(f"`{text_col}`")))).alias("form"))


def forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """letters, s, first_id, n: each different spaced title, pre-aggregated before it is shuffled: hot titles shrink to one row."""
    t = df.where(titled(F.col(f"`{text_col}`")) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), spaced(F.col(f"`{text_col}`")).alias("s"))
    g = t.groupBy("s").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return g.select(F.xxhash64(F.sort_array(F.split(unspaced(F.col("s")), ""))).alias("letters"), "s", "first_id", "n")


class _Form:
    """A form of a run, with the ways in which its rows split it."""

    def __init__(self, text: str):
        self.text, self.splits, self.first, self.n = text, [], math.inf, 0

    def add(self, s: str, first: int, n: int) -> None:
        self.splits.append(s.split(" "))
        self.n += n
        self.first = min(first, self.first)

    def same(self, other: "_Form") -> bool:
        """Whether two forms are the same title with its parts in another order."""
        return sorted(self.text) == sorted(other.text) and any(all(x in other.text for x in a) for a in self.splits) and any(all(x in self.text for x in b) for b in other.splits)


def _classes(run: list[_Form]) -> list[list[_Form]]:
    """The copies within one run, each class headed by its smallest id."""
    found: list[list[_Form]] = []
    for f in sorted(run, key=lambda f: f.first):
        hit = [c for c in found if any(f.same(x) for x in c)]
        rest = [c for c in found if not any(c is h for h in hit)]
        found = [*rest, [*(x for c in hit for x in c), f]]
    return found


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, run = None, {}

    def closed(run: dict) -> list[tuple]:
        if len(run) == 1:
            return [(f.text, f.first, f.n, f.n) for f in run.values()]
        return [(f.text, c[0].first, f.n, sum(x.n for x in c)) for c in _classes(list(run.values())) for f in c]

    for pdf in batches:
        rows: list[tuple] = []
        for letters, s, first, n in zip(pdf.letters.tolist(), pdf.s.tolist(), pdf.first_id.tolist(), pdf.n.tolist()):
            if letters != key:
                if run:
                    rows += closed(run)
                key, run = letters, {}
            text = s.replace(" ", "")
            if text not in run:
                run[text] = _Form(text)
            run[text].add(s, first, n)
        yield pd.DataFrame(rows, columns=["form", "keep_id", "n", "copies"])
    yield pd.DataFrame(closed(run) if run else [], columns=["form", "keep_id", "n", "copies"])


def copy_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """form, keep_id, n, copies: each different form, the smallest id of its copies, its own rows and all copies.

    A spaced title is one row here however many rows have it, so no run of the scan holds more than the ways
    in which the parts of one title were split and ordered.
    """
    f = forms(df, id_col, text_col)
    ranged = f.repartitionByRange(partitions(df.sparkSession), "letters").sortWithinPartitions("letters")
    return ranged.mapInPandas(_scan, "form string, keep_id bigint, n bigint, copies bigint")


def representatives(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """keep_id, copies: one row per title, with the exact number of rows that are copies of it."""
    return copy_classes(df, id_col, text_col).groupBy("keep_id").agg(F.sum("n").alias("copies"))


def copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """keep_id, copy_id: one row for each copy of a title besides the kept one."""
    from boardweave.llm.common import salted_join

    classes = written(copy_classes(df, id_col, text_col).where("copies > 1").select("keep_id", "n", form_key(F.col("form")).alias("form")))
    rows = keyed(df, id_col, text_col).withColumnRenamed("id", "copy_id")
    return salted_join(rows, classes, "form", "n").where("copy_id <> keep_id").select("keep_id", "copy_id")
