"""The three tiers of duplicate detection over articles(url, account, date, title), and their decisions."""

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardweave.functions import dims
from boardweave.functions import titles as T
from boardweave.operators import alike
from boardweave.operators.scratch import dropped, freed, written


def exact_groups(articles: DataFrame) -> DataFrame:
    """One row per normalised title: its canonical member (latest date, then title, then link) and its size."""
    a = articles.withColumn("key", T.normalized(F.col("title"))).where("key <> ''")
    # aggregates combine before the shuffle; a window would gather a hot title in one task
    best = F.max_by(F.struct("url", "account", "date", "title"), F.struct("date", "title", "url", "account"))
    return a.groupBy("key").agg(best.alias("c"), F.count(F.lit(1)).alias("n_members")).select("key", "c.*", "n_members")


def exact_links(articles: DataFrame) -> DataFrame:
    """a, b: every row's link with that of its group's smallest, a star and not all pairs."""
    k = articles.where("url is not null").select("url", T.normalized(F.col("title")).alias("key")).distinct()
    hub = k.groupBy("key").agg(F.min("url").alias("a"))
    return k.join(hub, "key").where("url <> a").select("a", F.col("url").alias("b")).distinct()


def unwrap_links(articles: DataFrame) -> DataFrame:
    """a, b: stars of links whose titles agree once column prefix and event suffix are gone, of different titles."""
    n = T.normalized(F.col("title"))
    k = articles.where("url is not null").select("url", n.alias("norm"), T.unwrapped(n).alias("key")).where(F.length("key") >= dims.UNWRAP_MIN).distinct()
    hub = k.groupBy("key").agg(F.min(F.struct("url", "norm")).alias("h"))
    return k.join(hub, "key").where("url <> h.url and norm <> h.norm").select(F.col("h.url").alias("a"), F.col("url").alias("b")).distinct()


def contained(articles: DataFrame, least: int = 5) -> DataFrame:
    """short, long: different normalised titles of which one holds the other.

    Blocking without loss: the shorter title's first five letters occur in the longer one.
    """
    t = articles.select(T.normalized(F.col("title")).alias("t")).where(F.length("t") >= least).distinct()
    head = t.select(F.col("t").alias("short"), F.left("t", F.lit(least)).alias("g"))
    at = F.sequence(F.lit(1), F.length("t") - least + 1)
    grams = t.select(F.col("t").alias("long"), F.explode(F.array_distinct(F.transform(at, lambda i: F.substr("t", i, F.lit(least))))).alias("g"))
    return head.join(grams, "g").where(F.contains("long", F.col("short")) & (F.length("long") > F.length("short"))).select("short", "long")


#: Scores from which the best candidates are looked for before all candidates are.
LEVELS = (1.0, 0.95)


def _scored(entity_at: float, full_at: float):
    """title_a, title_b, score of pairs of normalised titles and entities, without those that no ratio admits."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter
        from difflib import SequenceMatcher

        letters: dict = {}

        def most(x: str, y: str) -> float:
            """A bound on the ratio, by the letters in common."""
            for z in (x, y):
                if z not in letters:
                    letters[z] = Counter(z)
            return 2.0 * (letters[x] & letters[y]).total() / (len(x) + len(y)) if x and y else 0.0

        low = min(entity_at, full_at)
        for pdf in batches:
            letters.clear()
            out: list = []
            for a, b, x, y, held in zip(pdf.title_a, pdf.title_b, pdf.ent_a, pdf.ent_b, pdf.inside):
                if held:  # no ratio is above 1
                    out.append(1.0)
                    continue
                entity = SequenceMatcher(None, x, y).ratio() if most(x, y) >= low else 0.0
                top, said = most(a, b), entity >= entity_at
                full = SequenceMatcher(None, a, b).ratio() if top >= low and not (said and top <= entity) else 0.0
                out.append(max(full, entity) if said or full >= full_at else None)
            pdf["score"] = pd.Series(out, pdf.index, "float64")
            yield pdf.loc[pdf.score.notna(), ["title_a", "title_b", "score"]]

    return score


def _titles(articles: DataFrame, brands: T.Brands) -> DataFrame:
    """id, norm, date, title, ent, brand of the different normalised titles, a written table."""
    a = articles.withColumn("norm", T.normalized(F.col("title"))).where("norm <> ''")
    t = a.groupBy("norm").agg(F.max(F.struct("date", "title")).alias("m")).select("norm", "m.date", "m.title")
    # everything that depends on one title is made once, before pairs exist; rows are numbered by a written table
    t = t.withColumns({"ent": T.entity(F.col("title")), "brand": brands.effective(F.col("title"))})
    return written(t.withColumn("id", F.monotonically_increasing_id()))


def _holding(t: DataFrame) -> DataFrame:
    freed(t.sparkSession)
    return written(alike.holding(t, "norm"))


def _similar(t: DataFrame, held: DataFrame, brands: T.Brands, entity_at: float, full_at: float) -> DataFrame:
    """similar() of the titles t, of which held has the pairs that may hold one another."""
    found = [held]
    searches = [("norm", full_at)] * (full_at < 1) + [("ent", entity_at)]  # normalised titles are never equal
    for col, at in searches:
        freed(t.sparkSession)  # one search's shuffle on disk at a time
        found.append(written(alike.alike(t, col, at)))
    freed(t.sparkSession)
    pairs = reduce(DataFrame.union, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda n: t.select(F.col("id").alias(n), F.struct("date", "title", "norm", "ent", "brand").alias(f"s{n}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    later = F.struct("sa.date", "sa.title", "sa.norm") > F.struct("sb.date", "sb.title", "sb.norm")
    p = p.select(F.when(later, F.col("sa")).otherwise(F.col("sb")).alias("l"), F.when(later, F.col("sb")).otherwise(F.col("sa")).alias("r"))
    nl, nr = F.col("l.norm"), F.col("r.norm")
    inside = (F.least(F.length(nl), F.length(nr)) >= 5) & (F.contains(nl, nr) | F.contains(nr, nl))
    p = p.where(~brands.veto(F.col("l.brand"), F.col("r.brand")))
    p = p.select(nl.alias("title_a"), nr.alias("title_b"), F.col("l.ent").alias("ent_a"), F.col("r.ent").alias("ent_b"), inside.alias("inside"))
    if min(entity_at, full_at) >= 1:
        p = p.where("inside or ent_a = ent_b")  # all that has a ratio of 1, so no other pair is sent to be scored
    # scored once: a filter on a scored column would be pushed down and score every pair that it keeps twice
    return p.mapInPandas(_scored(entity_at, full_at), "title_a string, title_b string, score double")


def similar(articles: DataFrame, brands: T.Brands | None = None, entity_at: float = 0.8, full_at: float = 0.85) -> DataFrame:
    """title_a, title_b, score: pairs of different titles alike by entity, by whole title or by containment.

    Left is the earlier in the order of date and title, latest first, as the ratio depends on the order.
    """
    brands = brands or T.Brands()
    t = _titles(articles, brands)
    return _similar(t, _holding(t), brands, entity_at, full_at)


def top_candidates(candidates: DataFrame, k: int = 2000) -> DataFrame:
    """The k best candidates by score, then titles: a report of a stated length."""
    return candidates.orderBy(F.desc("score"), F.desc("title_a"), F.desc("title_b")).limit(k)


def top_similar(articles: DataFrame, k: int = 2000, brands: T.Brands | None = None, entity_at: float = 0.8, full_at: float = 0.85) -> DataFrame:
    """top_candidates() of similar(), looked for from the top.

    A score is the larger ratio, so a search with a level as both thresholds finds every candidate of that score and
    above. Where these are k or more the best k are among them, and nothing below the level need be looked for.
    """
    brands = brands or T.Brands()
    t = _titles(articles, brands)
    held = _holding(t)
    for level in LEVELS:
        if level >= max(entity_at, full_at):
            found = written(_similar(t, held, brands, level, level))
            if found.count() >= k:
                return top_candidates(found, k)
            dropped(found)
    return top_candidates(_similar(t, held, brands, entity_at, full_at), k)


def upsert_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Verdicts keyed by the two links in order; new ones win, then the later decided, then the larger pair_id."""
    tag = lambda d, n: d.select(*_pair_key(), "duplicate", "rule", "veto", "decided_at", "pair_id", F.lit(n).alias("gen"))
    both = tag(old, 0).union(tag(new, 1)).where("lo is not null and hi is not null and lo <> hi")
    best = F.max_by(F.struct("duplicate", "rule", "veto", "decided_at", "pair_id"), F.struct("gen", "decided_at", "pair_id"))
    return both.groupBy("lo", "hi").agg(best.alias("v")).select("lo", "hi", "v.*")


def _pair_key():
    a, b = F.get("urls", F.lit(0)), F.get("urls", F.lit(1))
    ok = a.isNotNull() & b.isNotNull()
    return F.when(ok, F.least(a, b)).alias("lo"), F.when(ok, F.greatest(a, b)).alias("hi")


def reused(candidates: DataFrame, decisions: DataFrame, members: DataFrame) -> DataFrame:
    """lo, hi, verdict of candidates(lo, hi, title_lo, title_hi): confirmed, cached, rejected or ask.

    confirmed: both links were in one group and their titles are unchanged; cached and rejected: a stored verdict.
    """
    m = members.select("group_id", "url", "norm")
    # each end of a candidate with its groups: rows in proportion to memberships, never pairs within a group
    asked = candidates.select("lo", "hi", "title_lo", "title_hi").distinct()
    end = lambda u, t: asked.join(m.select("group_id", F.col("url").alias(u), F.col("norm").alias(t)), [u, t])
    pair = ["lo", "hi", "title_lo", "title_hi"]
    both = end("lo", "title_lo").join(end("hi", "title_hi"), [*pair, "group_id"])
    together = both.select(*pair).distinct().withColumn("same", F.lit(True))
    d = decisions.select("lo", "hi", F.col("duplicate").alias("cached"))
    j = candidates.join(together, ["lo", "hi", "title_lo", "title_hi"], "left").join(d, ["lo", "hi"], "left")
    verdict = F.when(F.col("same"), "confirmed").when(F.col("cached"), "cached").when(~F.col("cached"), "rejected").otherwise("ask")
    return j.select("lo", "hi", verdict.alias("verdict"))


def vetoed(edges: DataFrame, articles: DataFrame, brands: T.Brands) -> DataFrame:
    """a, b, veto: each edge, and whether the brands of its titles forbid it."""
    t = articles.groupBy("url").agg(F.max("title").alias("title")).select("url", brands.effective(F.col("title")).alias("brand"))
    j = edges.join(t.toDF("a", "ba"), "a").join(t.toDF("b", "bb"), "b")
    return j.select("a", "b", brands.veto(F.col("ba"), F.col("bb")).alias("veto"))


def adjudicated(pairs: DataFrame, judge, batch: int = 40) -> DataFrame:
    """Verdicts of an injected judge(list of (title_a, title_b)) -> list of bool, a batch of pairs a call.

    Only pairs that were asked come back; a failing call fails the job.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said: list = []
            rows = list(zip(pdf.title_a, pdf.title_b))
            for i in range(0, len(rows), batch):
                answer = judge(rows[i : i + batch])
                if len(answer) != len(rows[i : i + batch]):
                    raise ValueError(f"{len(answer)} verdicts on {len(rows[i : i + batch])} pairs, from {rows[i]}")
                said += [bool(x) for x in answer]
            yield pdf[["title_a", "title_b"]].assign(duplicate=said)

    return pairs.select("title_a", "title_b").mapInPandas(ask, "title_a string, title_b string, duplicate boolean")
