"""Token counts by merging ranks in step, over ragged numpy arrays of distinct chunks.

Every distinct chunk of a batch is cut into pre-tokens by the tokenizer's own pattern. All of them
are held as one flat array of symbols; each step finds the lowest-ranked pair of every pre-token
and merges all its places at once, until no pre-token has a pair left. A text counts what its
chunks count; distinct chunks are merged once per worker.

Null and empty texts count 0. An added token inside a text counts one, and what stands around it is
counted apart, as the library does by default. Texts of any length are taken whole. Rows are
answered one by one, so ties and repeated rows need no rule; an empty table gives no row; a null
doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from nudgetrail.llm.common import slices, texts
from nudgetrail.llm.tokens import Cutter, Remembered

LIMIT = 1024
NONE = np.iinfo(np.int32).max


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ranks:
    """Merge ranks of a byte-level BPE, by pair of symbol numbers."""

    def __init__(self, config: dict):
        model = config["model"]
        vocab = model["vocab"]
        self.byte = np.zeros(256, dtype=np.int64)
        for char, b in byte_symbols().items():
            self.byte[b] = vocab[char]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.n = max(vocab.values()) + 1
        code = left * self.n + right
        order = np.argsort(code, kind="stable")
        self.code, self.rank, self.made = code[order], order.astype(np.int32), made

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.n + right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], NONE)


def merged_sizes(ranks: Ranks, pieces: list[bytes]) -> np.ndarray:
    """Symbols that survive in each piece."""
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    out = size.copy()
    symbol = ranks.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), size)
    pair = np.full(len(symbol), NONE, dtype=np.int32)  # rank of a symbol with the one after it
    if len(symbol) > 1:
        same = owner[:-1] == owner[1:]
        pair[:-1] = np.where(same, ranks.of(symbol[:-1], symbol[1:]), NONE)
    while len(symbol):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        lowest = np.minimum.reduceat(pair, first)
        number = np.diff(np.append(first, len(owner)))
        active = lowest != NONE
        out[owner[first]] = number
        if not active.all():  # finished pieces leave the arrays
            stay = np.repeat(active, number)
            symbol, owner, pair = symbol[stay], owner[stay], pair[stay]
            number, lowest = number[active], lowest[active]
            if not len(symbol):
                break
        hit = pair == np.repeat(lowest, number)
        place = np.flatnonzero(hit)
        run = np.cumsum(np.diff(place, prepend=-2) > 1)  # pairs that overlap: every other one
        head = place[np.searchsorted(run, run)]
        place = place[(place - head) % 2 == 0]
        symbol[place] = ranks.made[pair[place]]
        keep = np.ones(len(symbol), dtype=bool)
        keep[place + 1] = False
        new = np.cumsum(keep)[place] - 1
        symbol, owner, pair = symbol[keep], owner[keep], pair[keep]
        for at in (new, new[new > 0] - 1):  # only pairs beside a merge have changed
            last = at == len(symbol) - 1
            after = np.where(last, at, at + 1)
            inside = ~last & (owner[at] == owner[after])
            pair[at] = np.where(inside, ranks.of(symbol[at], symbol[after]), NONE)
    return out


class Counter:
    """Counts tokens of whole texts for one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.cutter = Cutter(config)
        if self.cutter.build != "byte":
            raise ValueError(f"{path}: ranks are merged for byte-level BPE only")
        self.ranks = Ranks(config)
        added = sorted(self.cutter.added, key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.cutter.added = []  # split off here, before chunks are cut
        self.cutter.whole = lambda text: False
        self.memory = Remembered(self._learn, np.dtype(np.int32))

    def _learn(self, chunks: list[str]) -> list[list[int]]:
        pieces = [self.cutter.pattern.findall(x) for x in chunks]
        flat = [y.encode() for x in pieces for y in x]
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        total = np.concatenate([[0], np.cumsum(merged_sizes(self.ranks, flat))])
        ends = np.cumsum(size)
        return (total[ends] - total[ends - size]).reshape(-1, 1).tolist()

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            some = self.added is not None and any(self.added.findall(text))
            split = self.added.split(text) if some else [text]
            extra[i] = len(split) - 1
            parts += split
            owner += [i] * len(split)
        counted, at = self.memory.of(self.cutter.cut(parts))
        total = np.concatenate([[0], np.cumsum(counted, dtype=np.int64)])
        sums = total[at[1:]] - total[at[:-1]]
        return extra + np.bincount(owner, weights=sums, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for a worker process."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text = batch.column("text")
            n = counter(path).count(text.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pc.binary_length(text).cast(pa.int64()),
                    pa.array(n),
                    pa.array(n > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
