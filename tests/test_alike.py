"""Candidate pairs against brute force."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from boardweave.operators import alike


def _edited(t, letters, n):
    for _ in range(n):
        i = random.randrange(len(t) + 1)
        t = random.choice([t[:i] + random.choice(letters) + t[i:], t[:i] + t[i + 1 :], t[i:] + t[:i]] if len(t) > 9 else [t[:i] + random.choice(letters) + t[i:]])
    return t


def _titles(letters):
    random.seed(9)
    base = ["".join(random.choice(letters) for _ in range(random.choice([1, 2, 3, 5, 9, 20, 36, 45]))) for _ in range(90)]
    return sorted({*base, *[_edited(t, letters, k) for t in base for k in (1, 2, 5, 9)]})


def test_no_alike_pair_is_missed(spark, monkeypatch):
    for rows, few in ((20_000, 32), (10, 3)):  # as they are; with split letter pairs and groups compared in blocks
        monkeypatch.setattr(alike, "SHARD_ROWS", rows)
        monkeypatch.setattr(alike, "FEW", few)
        for letters, at in (("甲乙丙丁", 0.85), ("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳", 0.8)):
            titles = _titles(letters)
            t = spark.createDataFrame(list(enumerate(titles)), "id bigint, s string")
            got = {frozenset(r) for r in alike.alike(t, "s", at).collect()}
            want = {frozenset((i, j)) for i, a in enumerate(titles) for j, b in enumerate(titles) if i != j and a and b and SequenceMatcher(None, a, b).ratio() >= at}
            assert want and want <= got


def test_no_held_title_is_missed(spark):
    titles = _titles("甲乙丙丁戊")
    titles += [t[3:-2] for t in titles if len(t) > 12] + ["甲乙丙丁戊", "己甲乙丙丁戊"]
    titles = sorted(set(titles))
    t = spark.createDataFrame(list(enumerate(titles)), "id bigint, s string")
    got = {tuple(r) for r in alike.holding(t, "s").collect()}
    want = {(i, j) for i, a in enumerate(titles) for j, b in enumerate(titles) if i != j and len(a) >= 5 and a in b}
    assert want and want <= got


def test_unrelated_titles_of_common_letters_are_hardly_candidates(spark):
    random.seed(3)
    t = spark.createDataFrame([(i, "".join(random.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉") for _ in range(36))) for i in range(3000)], "id bigint, s string")
    assert alike.alike(t, "s", 0.8).count() < 100_000  # of 4.5 million
    none = t.limit(0)
    assert alike.alike(none, "s", 0.8).count() == 0 and alike.holding(none.select("id", F.lit("").alias("s")), "s").count() == 0
