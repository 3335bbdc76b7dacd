"""Pages of repeated keywords, link lists or tags rather than sentences.

Method: pointwise mutual information of neighbouring words from counts over the whole corpus. Words are Han
characters, Latin words, numbers and signs; links are taken out first. The counts of words, of neighbouring
pairs and of pairs parted by a line break or by a space between Han characters are kept in three hashed tables of
fixed size, so what is broadcast is bounded however large the corpus.

A text is cut into sentences; what ends without a sentence mark is joined with what follows in the same way, as
keywords run over many lines. A segment counts as stuffing when
- most of its pairs are excessively repeated collocations: REPEATS times or more in it, and EXCESS times what
  the corpus leads to expect, that is, with a PMI of segment and pair of at least log EXCESS;
- or it is a run of many short separate items and as incoherent as such runs are: of the joints of its items (the
  last word of one with the first of the next) no more than a share COHERENT are collocations of unbroken text;
- or it is made of links with labels.
A page is flagged when such segments hold more than half of its characters, spaces aside. The mean PMI of all
words would not do: on these texts it is 4.9 to 6.5 bits in Chinese runs of tags, and 5.3 to 7.8 in Chinese
sentences. At the joints they differ: sentences broken over lines go on there as unbroken ones do elsewhere. The
bound goes by script, as joints of English job names (teacher, engineer) are known more often than Chinese ones.

Defined results: null, empty and blank texts are not flagged; repeated documents are judged alike; an empty table
gives an empty result; whole texts of any length are read; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the hashed tables of word and pair counts.
WORD_SLOTS, PAIR_SLOTS = 1 << 18, 1 << 20
#: What makes a collocation excessive.
REPEATS, EXCESS = 3, 5.0
#: Share of known joints up to which a run of items is incoherent, and times the expected count that make one known.
COHERENT, KNOWN = {"han": 0.25, "latin": 0.65}, 2.0
#: Items of a run, and units (Han characters; a Latin word counts four) that three quarters of them don't exceed.
ITEMS, ITEM_UNITS = 6, 12
#: Characters of label that a link may have.
LABEL = 20

LINK = regex.compile(r"<a\b[^>]*>.*?</a>|https?://[^\s<>\"、，]+|www\.[^\s<>\"、，]+|&nbsp;", regex.S | regex.I)
WORD = regex.compile(r"\p{Han}|[^\W\d_\p{Han}]+|\d+|[^\s\w]|_")
SENTENCE = regex.compile(r"[^\n。！？!?]*?(?:[。！？!?]+|\n+|(?<=[a-z)])\.(?=\s|\p{Han}|$)|$)", regex.S)
ENDED = regex.compile(r"[。！？!?.]\s*$")
ITEM = regex.compile(r"[^\p{L}\p{N}\s]+|\n+|(?<=\p{Han})\s+(?=\p{Han})")
BREAK = regex.compile(r"\n+|(?<=\p{Han})\s+(?=\p{Han})")
INVISIBLE = regex.compile(r"[\p{Cf}\x01]")
UNIT = regex.compile(r"\p{Han}|\p{Latin}{4}")
HAN, ROMAN, SPACE = regex.compile(r"\p{Han}"), regex.compile(r"\p{Latin}"), regex.compile(r"\s")
HIDDEN = regex.compile("\x01(\\d+)\x01")
#: Words whose hashes a task keeps.
KEPT = 1 << 17
_hashes: dict[str, int] = {}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def slots(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of words, and of neighbouring pairs, in the hashed tables."""
    if len(_hashes) > KEPT:
        _hashes.clear()
    for w in set(found).difference(_hashes):
        _hashes[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h % np.uint64(WORD_SLOTS)).astype(np.int64), ((pair ^ (pair >> np.uint64(29))) % np.uint64(PAIR_SLOTS)).astype(np.int64)


def segments(text: str) -> list[str]:
    """Sentences; pieces that no sentence mark ends are joined with the next such piece."""
    out: list[str] = []
    open_ = False
    for m in SENTENCE.finditer(text):
        s = m.group()
        if not s.strip():
            continue
        ended = bool(ENDED.search(s))
        if open_ and not ended:
            out[-1] += s
        else:
            out.append(s)
        open_ = not ended
    return out


class Judge:
    """Scores texts with the corpus counts."""

    def __init__(self, word_n: np.ndarray, pair_n: np.ndarray, parted_n: np.ndarray):
        self.word_n, self.pair_n, self.whole_n = word_n, pair_n, pair_n - parted_n
        self.all_words, self.all_pairs = max(1, int(word_n.sum())), max(1, int(pair_n.sum()))

    def stuffed(self, segment: str) -> bool:
        ids = HIDDEN.findall(segment)
        rest = HIDDEN.sub(" ", segment) if ids else segment
        if ids and len(SPACE.sub("", rest)) <= LABEL * len(ids) + 5:
            return True
        found = words(rest)
        if len(found) < ITEMS + 1:
            return False
        pairs = list(zip(found, found[1:]))
        here = Counter(pairs)
        # only where repeated pairs make up half can those that are also excessive do so
        if 2 * sum(k for k in here.values() if k >= REPEATS) >= len(pairs):
            n = np.array([here[p] for p in pairs])
            usual = self.pair_n[slots(found)[1]] / self.all_pairs * len(pairs)
            if np.mean((n >= REPEATS) & (n >= EXCESS * usual)) >= 0.5:
                return True
        items = [x for x in ITEM.split(rest) if x.strip()]
        if len(items) < ITEMS:
            return False
        sizes = sorted(len(UNIT.findall(x)) if HAN.search(x) else 4 * len(x.split()) for x in items)
        if sizes[len(sizes) * 3 // 4] > ITEM_UNITS:
            return False
        script = "han" if len(HAN.findall(rest)) >= len(ROMAN.findall(rest)) else "latin"
        return self.known_joints(items) <= COHERENT[script]

    def known_joints(self, items: list[str]) -> float:
        """Share of the joints of neighbouring items that are collocations of unbroken text."""
        parts = [w for x in items if (w := words(x))]
        if len(parts) < 2:
            return 0.0
        ws, ps = slots([x for a, b in zip(parts, parts[1:]) for x in (a[-1], b[0])])
        n, w = self.whole_n[ps[::2]], self.word_n[ws].astype(float)
        return float(np.mean(n >= np.maximum(1, KNOWN * w[::2] * w[1::2] / self.all_words)))

    def share(self, text: str) -> float:
        """Part of the characters that belongs to stuffing."""
        links: list[str] = []

        def hide(m) -> str:
            links.append(m.group())
            return f"\x01{len(links) - 1}\x01"

        total = len(SPACE.sub("", text))
        hidden = LINK.sub(hide, INVISIBLE.sub("", text))
        bad = 0
        for s in segments(hidden):
            if self.stuffed(s):
                whole = HIDDEN.sub(lambda m: links[int(m.group(1))], s)
                bad += len(SPACE.sub("", whole))
        return bad / total if total else 0.0


def add(n: np.ndarray, text: str) -> None:
    """Add a text to the three tables of counts, which lie one after the other."""
    pieces = [words(x) for x in BREAK.split(LINK.sub(" ", text))]
    found = [w for x in pieces for w in x]
    if found:
        w, p = slots(found)
        np.add.at(n, w, 1)
        np.add.at(n, WORD_SLOTS + p, 1)
        ends = np.unique(np.cumsum([len(x) for x in pieces]))
        np.add.at(n, WORD_SLOTS + PAIR_SLOTS + p[ends[(ends > 0) & (ends < len(found))] - 1], 1)


def corpus_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of words, of neighbouring pairs and of parted ones over all texts, hashed: WORD_SLOTS + 2 PAIR_SLOTS numbers at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(WORD_SLOTS + 2 * PAIR_SLOTS, np.int64)
        for pdf in batches:
            for t in pdf.text:
                add(n, t)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"slot": at, "n": n[at]})

    got = texts.mapInPandas(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(WORD_SLOTS + 2 * PAIR_SLOTS, np.int64)
    n[got.slot.to_numpy()] = got.n.to_numpy()
    return n[:WORD_SLOTS], n[WORD_SLOTS:-PAIR_SLOTS], n[-PAIR_SLOTS:]


def shares(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, share of every document with a text that isn't blank."""
    t = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null and text rlike '\\\\S'")
    counts = documents.sparkSession.sparkContext.broadcast(corpus_counts(t.select("text")))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = None
        for pdf in batches:
            judge = judge or Judge(*counts.value)
            yield pd.DataFrame({"id": pdf.id, "share": [judge.share(x) for x in pdf.text]})

    return t.mapInPandas(score, "id bigint, share double")


def stuffed_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id of every document more than half of which is stuffing."""
    return shares(documents, id_col, text_col).where("share > 0.5").select("id").distinct()
