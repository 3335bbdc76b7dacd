"""Encoding of whole texts with a byte-level BPE vocabulary, by a lazily determinised transducer.

The merge list is compiled into one fact per pair of tokens: whether the two, written next to each other, are
what BPE makes of their bytes. By the prefix property of BPE each prefix of a piece then has exactly one last
token: the one that ends there and is compatible with the last token of the prefix before it. The transducer
reads letters; its state is the last token emitted, the bytes not yet emitted and the last tokens of those
positions where a longer token may still begin. A token is emitted as soon as all such positions agree on it,
so lookahead is bounded by the longest token of the vocabulary. States and transitions are made when first met.

Texts are first cut into pieces by the vocabulary's own pattern. Strings that look like control marks are
ordinary text. Defined results: null and empty texts have an empty list; every other text, however long, is
encoded whole; repeated ids give repeated rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files.
VOCABULARIES = "/opt/tokenizers"
#: How byte_bpe_50k cuts a text into pieces (fixed value of that vocabulary).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Transitions and whole pieces that are remembered; beyond, memory is cleared and filled anew.
MEMORY = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: one base64 token and its id per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Pieces in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[str, tuple[int, ...]] = {}
        self._clear()

    def _clear(self) -> None:
        start = (None, b"", ())
        self.states, self.number = [start], {start: 0}
        self.moves: list[dict] = [{}]
        self.ends: list = [()]
        self.made = 0

    def merged(self, data: bytes) -> list[bytes]:
        """BPE by definition: the lowest rank among neighbours merges first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes | None, right: bytes) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding."""
        got = self.pairs.get((left, right))
        if got is None:
            got = self.pairs[left, right] = self.merged(right) == [right] if left is None else self.merged(left + right) == [left, right]
        return got

    def _step(self, state: tuple, letter: str) -> tuple[tuple, tuple[int, ...]]:
        """The state after one more letter, and the ids that became certain."""
        prev, pending, lasts = state
        lasts = list(lasts)  # last token of each position after 1..len(pending) bytes; None where no token can begin
        pending += letter.encode()
        for end in range(len(lasts) + 1, len(pending) + 1):
            last = None
            for size in range(min(end, self.longest), 0, -1):
                token, at = pending[end - size : end], end - size
                if token in self.ranks and (at == 0 or lasts[at - 1] is not None) and self.fits(lasts[at - 1] if at else prev, token):
                    last = token
                    break
            lasts.append(last)
        end = len(pending)
        live = [p for p in range(end) if pending[p:] in self.prefixes and (p == 0 or lasts[p - 1] is not None)] + [end]
        roads = [self._road(pending, lasts, p) for p in live]
        common = 0
        for tokens in zip(*roads):
            if any(t != tokens[0] for t in tokens):
                break
            common += 1
        out = roads[0][:common]
        cut = sum(map(len, out))
        # positions that no later token can begin at, and that no live road passes, are forgotten
        used = {p for p in live if p > cut}
        for road in roads:
            at = cut
            for t in road[common:]:
                at += len(t)
                used.add(at)
        kept = tuple(lasts[p - 1] if p in used else None for p in range(cut + 1, end + 1))
        return (out[-1] if out else prev, pending[cut:], kept), tuple(self.ranks[t] for t in out)

    @staticmethod
    def _road(pending: bytes, lasts: list, end: int) -> list[bytes]:
        road = []
        while end:
            road.append(lasts[end - 1])
            end -= len(lasts[end - 1])
        return road[::-1]

    def _move(self, at: int, letter: str) -> tuple[int, tuple[int, ...]]:
        state, out = self._step(self.states[at], letter)
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.ends.append(None)
        self.moves[at][letter] = n, out
        self.made += 1
        return n, out

    def piece(self, text: str) -> list[int]:
        at, out = 0, []
        for letter in text:
            got = self.moves[at].get(letter) or self._move(at, letter)
            at = got[0]
            if got[1]:
                out.extend(got[1])
        end = self.ends[at]
        if end is None:
            _, pending, lasts = self.states[at]
            end = self.ends[at] = tuple(self.ranks[t] for t in self._road(pending, list(lasts), len(pending)))
        out.extend(end)
        if self.made > MEMORY:
            self._clear()
        return out

    def encode(self, text: str, cut=regex.compile(PIECES)) -> list[int]:
        out: list[int] = []
        for m in cut.finditer(text):
            p = m.group()
            ids = self.whole.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 16:
                    if len(self.whole) > MEMORY:
                        self.whole.clear()
                    self.whole[p] = tuple(ids)
            out.extend(ids)
        return out


class Utf8:
    """Incremental UTF-8 state machine: bytes in, letters out as soon as they are whole; U+FFFD for ill-formed ones."""

    def __init__(self):
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.code, self.need, self.low, self.high = self.code << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(b, (0x80, 0xBF))
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = {0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        rest, self.need = "�" if self.need else "", 0
        return rest


def decode(ids: Iterable[int], tokens: dict[int, bytes]) -> str:
    """The text of a stream of ids."""
    machine = Utf8()
    return "".join(machine.feed(tokens[i]) for i in ids) + machine.close()


def encoded(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """id, ids: the token ids of each text. No shuffle; the vocabulary file (under 1 MB) goes to each executor once."""
    data = df.sparkSession.sparkContext.broadcast(Path(folder, f"{vocabulary}.tiktoken").read_bytes())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = None
        for pdf in batches:
            t = t or Transducer(read_ranks(data.value))
            ids = [np.array(t.encode(x) if x else [], np.int32) for x in pdf.text]
            yield pd.DataFrame({"id": pdf.id, "ids": ids})

    t = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return t.mapInPandas(rows, "id bigint, ids array<int>")


def round_trips(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """id, n_ids, same: whether the ids of each text decode to that text again ('' for null)."""
    data = df.sparkSession.sparkContext.broadcast(Path(folder, f"{vocabulary}.tiktoken").read_bytes())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = None
        for pdf in batches:
            tokens = tokens or {i: b for b, i in read_ranks(data.value).items()}
            same = [decode(i, tokens) == (x or "") for i, x in zip(pdf.ids, pdf.text)]
            yield pd.DataFrame({"id": pdf.id, "n_ids": [len(i) for i in pdf.ids], "same": same})

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = None
        for pdf in batches:
            t = t or Transducer(read_ranks(data.value))
            yield from rows(iter([pdf.assign(ids=[t.encode(x) if x else [] for x in pdf.text])]))

    t = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return t.mapInPandas(both, "id bigint, n_ids bigint, same boolean")
