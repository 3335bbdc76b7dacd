"""Variant spellings of employer names, linked to one another.

Method: MinHash banding over padded q-grams, verification by Monge-Elkan similarity, star clustering.

Different typed values are read once each (names.Lists takes off cities, legal forms and lines of business) and
reduced to different names: core, line of business, script. Names get MinHash signatures over the padded q-grams
of their core, in two spaces: of its characters, and of its sound, in which Chinese and Latin spellings meet.
How many bands each space has follows from the collision curve: the least number for which a pair at the
similarity that one slip leaves (in Latin the slips that LATIN_ALIKE accepts) is found with probability RECALL. Candidates whose lines of business differ are
dropped; the rest are verified by Monge-Elkan similarity: of each token of one name the best match in the other,
averaged, in both directions, the smaller counts. Star clustering then makes the name with most verified links
the centre of a star, ties by frequency and then by the name, takes its neighbours as its satellites and goes on
with the others, in rounds in which every local maximum becomes a centre at once.

The entries of the reference list take part as names, so that spellings of a listed employer share its star.

Defined results: null and blank values and values that name nobody in particular pair with nothing; repeated
values count once; an empty table gives an empty result; columns besides unit are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardweave.llm.common import dropped, written
from boardweave.llm.names import Lists
from boardweave.llm.near_titles import mix

#: Probability with which a pair at the given similarity shares a band.
RECALL = 0.999
#: Monge-Elkan similarity from which two names are one.
ALIKE = 0.72
#: Similarity of two Latin spellings (1 - edits / length) from which they are one.
LATIN_ALIKE = 0.8
#: Letters of the Latin cores of listed names.
LATIN_LETTERS = range(9, 18)


def slipped(q: int, letters: int) -> float:
    """Similarity of the padded q-grams that the slips accepted by LATIN_ALIKE leave at worst: swaps, which spoil q + 1 grams each."""
    spoiled = (q + 1) * int((1 - LATIN_ALIKE) * letters + 1e-9)
    return (letters + q - 1 - spoiled) / (letters + q - 1 + spoiled)


#: Per space: q, rows of a band, similarity that one slip leaves, in Latin all accepted ones. Pairs of letters outlive
#: slips better than triples, so the same recall takes 312 bands in place of 1345.
SPACES = {"letters": (2, 2, 0.5), "sound": (2, 3, min(slipped(2, n) for n in LATIN_LETTERS))}
#: Band keys that are handed on at once.
KEYS = 1 << 19


def bands(rows: int, similarity: float, recall: float = RECALL) -> int:
    """The least number of bands with 1 - (1 - s^rows)^bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def padded(text: str, q: int, single: bool = False) -> set[str]:
    """The padded q-grams of a text, and with ``single`` its characters, which in Chinese cores stand for syllables."""
    t = "^" * (q - 1) + text + "$" * (q - 1)
    return {t[i : i + q] for i in range(len(t) - q + 1)} | (set(text) if single else set())


def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours."""
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        prev2, prev = prev, row
    return prev[-1]


def inner(x: str, y: str) -> float:
    """Similarity of two tokens."""
    return 1 - edits(x, y) / max(len(x), len(y))


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The smaller of the two directions' mean best matches."""
    return min(sum(max(inner(x, y) for y in q) for x in p) / len(p) for p, q in ((a, b), (b, a)))


def alike(core_a: str, latin_a: bool, sound_a: str, core_b: str, latin_b: bool, sound_b: str) -> bool:
    """Chinese cores by their characters, which stand for syllables; others as one Latin token each.

    Monge-Elkan similarity knows no order, so three characters in common anywhere would do; an exact check
    asks for one slip at most, or the same characters.
    """
    if latin_a or latin_b:
        return monge_elkan([sound_a], [sound_b]) >= LATIN_ALIKE
    return monge_elkan(list(core_a), list(core_b)) >= ALIKE and (edits(core_a, core_b) <= 1 or sorted(core_a) == sorted(core_b))


def names(values: DataFrame, lists: Lists) -> DataFrame:
    """value, core, industry, latin, sound of each different value that names somebody."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(v, n.core, n.industry, n.latin, n.core if n.latin else lists.romanised(n.core)) for v in pdf.value if (n := lists.parse(v))]
            yield pd.DataFrame(rows, columns=["value", "core", "industry", "latin", "sound"])

    return values.mapInPandas(read, "value string, core string, industry string, latin boolean, sound string")


def band_rows(named: DataFrame, space: str) -> DataFrame:
    """band, id, kind: the bands of each name (id, text, kind) in a space."""
    q, rows, similarity = SPACES[space]
    n, single = bands(rows, similarity), space == "letters"
    seeds = mix(np.arange(1, rows * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own = mix(np.arange(n, dtype=np.uint64))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, kinds, keys = [], [], []
            for i, text, kind in zip(pdf.id, pdf.text, pdf.kind):
                grams = padded(text, q, single)
                h = np.array([int.from_bytes(g.encode("utf-32-le")[:12], "little") & (2**64 - 1) ^ (ord(g[-1]) << 40) for g in sorted(grams)], np.uint64)
                low = mix(h[None, :] ^ seeds[:, None]).min(1).reshape(n, rows)
                key = np.zeros(n, np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(31) + low[:, r])
                keys.append(mix(key ^ own))
                ids.append(i)
                kinds.append(kind)
                if len(ids) * n >= KEYS:
                    yield told(ids, kinds, keys)
                    ids, kinds, keys = [], [], []
            if ids:
                yield told(ids, kinds, keys)

    def told(ids: list, kinds: list, keys: list) -> pd.DataFrame:
        return pd.DataFrame({"band": np.concatenate(keys).view(np.int64), "id": np.repeat(ids, n), "kind": np.repeat(kinds, n)})

    return named.mapInPandas(sign, "band bigint, id bigint, kind bigint")


def links(named: DataFrame) -> DataFrame:
    """a, b: verified pairs of names (id, core, industry, latin, sound), both ways."""
    # kind: the line of business and the script in one number, whose collisions the exact check below refuses
    kind = F.when(F.col("industry") == "", F.lit(0)).otherwise(F.xxhash64("industry").bitwiseOR(F.lit(2))).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("latin").cast("int"))
    fit = "((ka & -2) = (kb & -2) or (ka & -2) = 0 or (kb & -2) = 0)"
    name = named.select("id", "core", "sound", "latin", kind.cast("bigint").alias("kind"))
    core, sound = name.where("not latin").select("id", F.col("core").alias("text"), "kind"), name.select("id", F.col("sound").alias("text"), "kind")
    x, y = ("a", "ka"), ("b", "kb")
    # Spark takes what Python makes for as small as its input, so these joins say that they are no broadcasts
    han = band_rows(core, "letters")
    pairs = han.toDF("band", *x).join(han.toDF("band", *y).hint("merge"), "band").where(f"a < b and {fit}").select("a", "b")
    # sounds only decide where one of two names is Latin, so the Latin ones ask all
    heard, asking = band_rows(sound, "sound"), band_rows(sound.where("(kind & 1) = 1"), "sound")
    spoken = asking.toDF("band", *x).join(heard.toDF("band", *y).hint("merge"), "band").where(f"a <> b and (a < b or (kb & 1) = 0) and {fit}")
    pairs = pairs.union(spoken.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    cols = ["id", "core", "latin", "sound", "industry"]
    left, right = named.select(*cols).toDF("a", "ca", "la", "sa", "ia"), named.select(*cols).toDF("b", "cb", "lb", "sb", "ib")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [alike(*r) for r in zip(pdf.ca, pdf.la, pdf.sa, pdf.cb, pdf.lb, pdf.sb)]
            yield pdf.loc[ok, ["a", "b"]] if len(pdf) else pdf[["a", "b"]]

    # a swap counts two in Spark's distance, so these bounds lose nothing that alike() accepts
    most = F.floor((1 - LATIN_ALIKE) * F.greatest(F.length("sa"), F.length("sb")) + 1e-9).cast("int")
    letters = lambda c: F.sort_array(F.split(c, ""))
    near = F.when(F.col("la") | F.col("lb"), F.levenshtein("sa", "sb") <= 2 * most).otherwise((F.levenshtein("ca", "cb", 2) >= 0) | (letters("ca") == letters("cb")))
    one = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").where("ia = ib or ia = '' or ib = ''").where(near).mapInPandas(verify, "a bigint, b bigint")
    one = written(one)
    return one.union(one.select("b", "a"))


def stars(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """id, star over all of weights(id, weight): star clustering by number of links, then weight, then smaller id.

    A round makes every open vertex that precedes all its open neighbours a centre; the neighbours of new centres
    become satellites of the first of them. An open vertex without open neighbours is its own star.
    """
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("deg")).withColumnRenamed("a", "id")
    rank = F.struct(-F.coalesce("deg", F.lit(0)), -F.col("weight"), F.col("id"))
    open_ = written(weights.join(degree, "id", "left").select("id", rank.alias("rank")))
    e = written(edges)
    done: list[DataFrame] = []
    while open_.limit(1).count():
        r = open_.toDF("b", "rb")
        first = e.join(r, "b").groupBy("a").agg(F.min("rb").alias("least")).withColumnRenamed("a", "id")
        judged = open_.join(first, "id", "left")
        centre = written(judged.where("least is null or rank < least").select("id", "rank"))
        own = centre.select("id", F.col("id").alias("star"))
        near = e.join(centre.toDF("a", "ra"), "a").groupBy("b").agg(F.min_by("a", "ra").alias("star")).withColumnRenamed("b", "id")
        sat = near.join(open_.select("id"), "id").select("id", "star")
        done.append(written(own.union(sat.join(centre.select("id"), "id", "left_anti"))))
        rest = written(open_.join(done[-1].select("id"), "id", "left_anti"))
        left = written(e.join(rest.select(F.col("id").alias("a")), "a", "left_semi").join(rest.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b"))
        dropped(open_, e, centre)
        open_, e = rest, left
    out = done[0] if done else weights.select("id", F.col("id").alias("star"))
    for d in done[1:]:
        out = out.union(d)
    return out


def clustered(screens: DataFrame, cities: DataFrame, units: DataFrame) -> DataFrame:
    """value, star: each different value that names an employer, and its star. A written table."""
    from boardweave.llm.names import learned

    lists = learned(cities, units)
    blank = F.regexp_replace(F.coalesce("unit", F.lit("")), r"[\s\p{Z}\p{Cf}]+", "") == ""
    typed = screens.where(~blank).groupBy(F.col("unit").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    read = written(names(typed.select("value"), lists).join(typed, "value"))
    listed = [(zh, ind, False, lists.romanised(zh)) for zh, _, ind in lists.core.values() if zh]
    ref = screens.sparkSession.createDataFrame(listed, "core string, industry string, latin boolean, sound string") if listed else read.select("core", "industry", "latin", "sound").limit(0)
    key = ["core", "industry", "latin", "sound"]
    every = read.select(*key, "n").union(ref.select(*key, F.lit(0).cast("bigint").alias("n")))
    named = written(every.groupBy(*key).agg(F.sum("n").alias("weight")).withColumn("id", F.monotonically_increasing_id()))
    found = stars(links(named), named.select("id", "weight"))
    return written(read.join(named, key).join(found, "id").select("value", "star"))


def variant_pairs(screens: DataFrame, cities: DataFrame, units: DataFrame) -> DataFrame:
    """unit_a, unit_b: all pairs of different values of one star, the smaller first: the result asked for."""
    c = clustered(screens, cities, units)
    return c.toDF("unit_a", "star").join(c.toDF("unit_b", "star"), "star").where("unit_a < unit_b").select("unit_a", "unit_b")
