"""Evaluation passages leaking into documents.

Method: CGK random-walk embedding and bit-sampling LSH, then exact edit verification. A passage is cut into
pieces. Each piece, and the window of the same length at every place of a document, is embedded by a random
walk: at each step the current letter is put out and a random function of step and letter says whether the
walk moves on, so that windows at a small edit distance come to a small Hamming distance. A table samples some
steps of the walk; pieces and windows that agree on all of them are candidates. Windows are dropped as soon as
their sampled letters are the beginning of no piece's, which few survive, so that a whole text is cheap.
TABLES tables are made: a document holds half a passage, hence several pieces, most of them unedited, and it
is enough that three tenths of all pieces are found once each (a quarter, at least one, of fewer than eight).

A candidate document and item are then compared exactly: each piece counts as held where its edit distance to
some stretch of the document is at most EDITS of its length (bit-parallel search), and the item is leaked when
held pieces make up SHARE of the passage. Case, width, spacing, line breaks and signs are left aside, so are
invisible characters.

The items are fixed and small and go to every executor (a table above ITEM_ROWS is refused, not cut), so the
documents are read once and nothing is shuffled; a source with a third of all documents makes no difference.

Defined results: null, empty and blank texts and passages hold or are held by nothing; repeated documents each
have their rows; repeated items likewise; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardweave.functions.width import fold_py
from boardweave.llm.near_titles import mix

#: Most items of the evaluation table.
ITEM_ROWS = 200_000
#: Length of a piece and number of sampled steps, for windows that begin with a Latin letter and for others.
LATIN, OTHER = (30, 10), (12, 6)
#: Independent tables.
TABLES = 5
#: Edits that a held piece may have, and the part of a passage that held pieces must make up.
EDITS, SHARE = 0.25, 0.42
#: Bits of a key's prefix by which windows are sifted at each sampled letter.
SIFT = 20
#: Letters are hashed to so many classes for the walk's random bits.
CLASSES = 4096


def pieces(passage: str) -> list[tuple[int, int]]:
    """Where a folded passage is cut: about equal pieces of the length of its script."""
    latin = sum("a" <= c <= "z" for c in passage) * 2 > len(passage)
    n = max(1, round(len(passage) / (LATIN if latin else OTHER)[0]))
    at = [round(len(passage) * j / n) for j in range(n + 1)]
    return list(zip(at, at[1:]))


def distance(piece: str, text: str, most: int) -> bool:
    """Whether some stretch of the text is within ``most`` edits of the piece (bit-parallel dynamic programme)."""
    m = len(piece)
    where: dict[str, int] = {}
    for i, c in enumerate(piece):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for c in text:
        eq = where.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (~(horizontal | up) & full), up & horizontal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score <= most:
                return True
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (~(vertical | rise) & full), rise & vertical
    return score <= most


def held(passage: str, cut: list[tuple[int, int]], text: str) -> bool:
    """Whether enough of the passage is in the text; stops as soon as that is certain either way."""
    need, got, rest = SHARE * len(passage), 0, []
    for a, b in cut:
        if passage[a:b] in text:
            got += b - a
        else:
            rest.append((a, b))
    left = sum(b - a for a, b in rest)
    for a, b in rest:
        if got >= need or got + left < need:
            break
        left -= b - a
        if distance(passage[a:b], text, int(EDITS * (b - a))):
            got += b - a
    return got >= need


def letter_classes(flat: np.ndarray) -> np.ndarray:
    return ((flat * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(CLASSES)).astype(np.int64)


def sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << SIFT, bool)
    out[(keys >> np.uint64(64 - SIFT)).astype(np.int64)] = True
    return out


class Tables:
    """The sampled walks of all pieces of all items."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 1):
        self.items = [(i, p, pieces(p)) for i, p in items if p]
        self.plans = []
        starts: dict[bool, list] = {True: [], False: []}
        self.piece_item: list[int] = []
        for n, (_, p, cut) in enumerate(self.items):
            for a, _ in cut:
                latin = "a" <= p[a] <= "z"
                width = (LATIN if latin else OTHER)[0]
                starts[latin].append((len(self.piece_item), p[max(0, min(a, len(p) - width)) :][:width]))
                self.piece_item.append(n)
        rng = np.random.default_rng(seed)
        for latin, (width, samples) in ((True, LATIN), (False, OTHER)):
            owner = np.array([n for n, _ in starts[latin]], np.int64)
            texts = [s for _, s in starts[latin]]
            if not texts:
                continue
            codes = np.zeros((len(texts), width), np.uint32)
            for k, s in enumerate(texts):
                codes[k, : len(s)] = np.frombuffer(s.encode("utf-32-le"), np.uint32)
            flat = np.r_[codes.ravel(), np.zeros(width, np.uint32)]
            classes = letter_classes(flat)
            for _ in range(TABLES):
                steps = np.sort(rng.choice(2 * width - 2, samples, replace=False))
                bits = rng.integers(0, 2, (2 * width, CLASSES), dtype=np.uint8)
                stages: list[np.ndarray] = []
                keys, _ = self.walk(flat, classes, np.arange(len(texts)) * width, width, steps, bits, None, stages)
                order = np.argsort(keys)
                self.plans.append((latin, width, steps, bits, [sieve(s) for s in stages], keys[order], owner[order]))

    @staticmethod
    def walk(flat, classes, start, width, steps, bits, known, stages):
        """Keys of the sampled letters of each window; with ``known``, windows that no piece begins like are left out.

        known has, for each sampled step, a table of SIFT bits that tells what prefixes of keys may begin a piece;
        it never leaves out one that does, and the whole keys are looked up exactly at the end.
        """
        alive = np.arange(len(start))
        at, key = start.copy(), np.zeros(len(start), np.uint64)
        sampled = set(steps.tolist())
        nth = 0
        for step in range(int(steps[-1]) + 1):
            # before as many steps as the window is wide no walk can have left it
            inside = None if step < width else at < start + width
            here = at if inside is None else np.where(inside, at, start)
            if step in sampled:
                c = flat[here].astype(np.uint64)
                if inside is not None:
                    c[~inside] = 0
                key = mix(key * np.uint64(1_000_003) + c + np.uint64(1))
                if known is None:
                    stages.append(key.copy())
                else:
                    keep = np.flatnonzero(known[nth][(key >> np.uint64(64 - SIFT)).astype(np.int64)])
                    alive, start, at, key, here = alive[keep], start[keep], at[keep], key[keep], here[keep]
                    inside = None if inside is None else inside[keep]
                    if not len(alive):
                        break
                nth += 1
            k = classes[here]
            if inside is not None:
                k = np.where(inside, k, 0)
            at = at + bits[step][k]
        return key, alive

    def candidates(self, texts: list[str]) -> set[tuple[int, int]]:
        """(text number, item number) of texts with windows that agree with enough pieces of the item in some table."""
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate([*codes, np.zeros(LATIN[0], np.uint32)])
        classes = letter_classes(flat)
        owner = np.repeat(np.arange(len(texts)), sizes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        latin = (flat[: len(owner)] >= 97) & (flat[: len(owner)] <= 122)
        found: list[np.ndarray] = []
        for is_latin, width, steps, bits, stages, keys, items in self.plans:
            start = np.flatnonzero((latin == is_latin) & (np.arange(len(owner)) + width <= ends))
            for i in range(0, len(start), 500_000):
                s = start[i : i + 500_000]
                key, alive = self.walk(flat, classes, s, width, steps, bits, stages, None)
                if len(alive):
                    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    many = hi - lo
                    window = np.repeat(owner[s[alive]], many)
                    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
                    found.append(np.unique(np.stack([window, items[at]], 1), axis=0))
        if not found:
            return set()
        hits = np.unique(np.concatenate(found), axis=0)
        of = np.array(self.piece_item, np.int64)[hits[:, 1]]
        pairs, n = np.unique(np.stack([hits[:, 0], of], 1), axis=0, return_counts=True)
        need = np.array([max(1, len(cut) // 4) if len(cut) < 8 else max(2, len(cut) * 3 // 10) for _, _, cut in self.items])
        return {(int(w), int(i)) for w, i in pairs[n >= need[pairs[:, 1]]]}


def leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage") -> DataFrame:
    """doc_id, item_id of every document that holds at least about half of an item's passage."""
    got = items.select(F.col(f"`{item_col}`").cast("bigint"), F.col(f"`{passage_col}`")).limit(ITEM_ROWS + 1).collect()
    if len(got) > ITEM_ROWS:
        raise ValueError(f"the evaluation table has more than {ITEM_ROWS} items")
    folded = sorted((i, fold_py(p)) for i, p in got if i is not None and p and fold_py(p))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = None
        for pdf in batches:
            tables = tables or Tables(folded)
            rows = []
            texts = [fold_py(t) if t else "" for t in pdf.text]
            if any(texts) and tables.plans:
                for w, n in tables.candidates(texts):
                    i, p, cut = tables.items[n]
                    if held(p, cut, texts[w]):
                        rows.append((pdf.id.iat[w], i))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"], dtype="int64")

    t = documents.select(F.col(f"`{doc_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return t.mapInPandas(find, "doc_id bigint, item_id bigint").distinct()
