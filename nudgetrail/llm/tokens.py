"""Whole texts to token ids, as the tokenizers library gives them, with repeated words encoded once.

Cutting before a space or a line end cannot change what a byte-level or word-end BPE makes of either
side, unless white space runs on there. So each distinct chunk goes to the library once per worker,
and texts are put together from remembered ids. Texts with runs of white space are cut by the
library's own pattern; a text that holds an added token or a code point that Unicode tables may
disagree on, and any tokenizer of another build, goes to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from nudgetrail.llm.words import digest_spans

#: Fixed value: the split pattern that the library's byte-level pre-tokenizer states.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Chunks that a worker remembers (about 40 bytes each).
REMEMBERED = 3_000_000

_MARK, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_RARE = regex.compile(r"[\U00010000-\U0001EFFF\U00020000-\U0010FFFF\p{Cn}]")


def build_of(config: dict) -> str:
    """"byte", "word" or "other": what is known of where the tokenizer may be split."""
    pre, model, norm = (config.get(k) or {} for k in ("pre_tokenizer", "model", "normalizer"))
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("unk_token")
    if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not norm:
        return "other" if pre.get("add_prefix_space") else "byte"
    kinds = [x.get("type") for x in pre.get("pretokenizers", [])]
    steps = [x.get("type") for x in norm.get("normalizers", [])]
    if plain and kinds == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"]:
        split = pre["pretokenizers"][0]
        apart = split.get("behavior") == "Removed" and split.get("invert")
        if apart and r"[^\s\p{L}\p{N}]" in split["pattern"].get("Regex", ""):
            return "word"
    return "other"


@dataclass
class Cut:
    """Chunks of a batch of texts: distinct ones, and which of them each text is made of."""

    key: np.ndarray  # 64-bit digest of each distinct chunk
    sample: list[tuple[int, int]]  # where in data it stands
    member: np.ndarray  # the distinct chunk of every chunk, in text order
    first: np.ndarray  # chunks of text i: first[i]:first[i + 1]
    data: bytes

    def chunk(self, i: int) -> str:
        a, b = self.sample[i]
        return self.data[a:b].decode()


class Cutter:
    """Cuts texts into chunks that can be tokenized alone, in order and without loss."""

    def __init__(self, config: dict):
        self.build = build_of(config)
        self.added = [x["content"] for x in config.get("added_tokens", [])]
        self.pattern = regex.compile(BYTE_LEVEL)

    def whole(self, text: str) -> bool:
        """Whether only the library itself may split this text."""
        if self.build == "other" or any(x in text for x in self.added):
            return True
        return not text.isascii() and _RARE.search(text) is not None

    def even(self, text: str) -> bool:
        """Whether every white space stands alone between words."""
        if self.build == "word":
            return True
        if any(x in text for x in ("  ", " \n", "\n\n")) or text.endswith(" "):
            return False
        return not any(x in text for x in _OTHER_SPACE)

    def cut(self, texts: list[str]) -> Cut:
        coded = [x.encode() for x in texts]
        at = np.concatenate([[0], np.cumsum([len(x) for x in coded], dtype=np.int64)])
        data = b"".join(coded)
        byte = np.frombuffer(data, dtype=np.uint8)
        edge = (byte == 32) | (byte == 10)
        # One mark between an ASCII letter and white space is a piece of its own.
        mark, letter = _MARK[byte[1:-1]], _LETTER[byte[:-2]]
        edge[1:-1] |= mark & letter & edge[2:]
        for i, text in enumerate(texts):
            whole = self.whole(text)
            if whole or not self.even(text):
                a, b = at[i], at[i + 1]
                edge[a:b] = False
                if not whole:
                    size = [len(x.encode()) for x in self.pattern.findall(text)]
                    edge[a + np.cumsum([0, *size[:-1]])[: len(size)]] = True
        edge[at[:-1][np.diff(at) > 0]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(byte))
        key, sample, member = np.unique(
            digest_spans(byte, start, end), return_index=True, return_inverse=True
        )
        spans = list(zip(start[sample].tolist(), end[sample].tolist(), strict=True))
        return Cut(key, spans, member, np.searchsorted(start, at), data)


class Remembered:
    """Number lists by chunk: ``learn`` gives them for chunks not seen before."""

    def __init__(self, learn: Callable[[list[str]], list[list[int]]], dtype: np.dtype):
        self.learn, self.dtype = learn, dtype
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)  # in order, with the slot of each
        self.slot = np.zeros(0, dtype=np.int32)
        self.size = np.zeros(0, dtype=np.int32)
        self.pool = np.zeros(0, dtype=self.dtype)

    def of(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """(all numbers in text order, where those of text i begin, with the end)."""
        if len(self.key) > REMEMBERED:
            self._clear()
        at = np.searchsorted(self.key, cut.key)
        known = np.zeros(len(at), dtype=bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == cut.key[inside]
        new = np.flatnonzero(~known)
        if len(new):
            got = self.learn([cut.chunk(i) for i in new.tolist()])
            size = np.fromiter(map(len, got), dtype=np.int32, count=len(got))
            flat = np.fromiter(chain.from_iterable(got), dtype=self.dtype, count=size.sum())
            slots = np.arange(len(self.size), len(self.size) + len(new), dtype=np.int32)
            self.key = np.insert(self.key, at[new], cut.key[new])
            self.slot = np.insert(self.slot, at[new], slots)
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, flat])
            at = np.searchsorted(self.key, cut.key)
        slot = self.slot[at]
        where = (np.cumsum(self.size, dtype=np.int64) - self.size)[slot][cut.member]
        size = self.size[slot][cut.member]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        take = np.arange(ends[-1]) + np.repeat(where - ends[:-1], size)
        return self.pool[take], ends[cut.first]


class Encoder:
    """ids of whole texts, as the library gives them without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.cutter = Cutter(json.load(f))
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.memory = Remembered(self._library, self.dtype)

    def _library(self, chunks: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of text i begin, with the end)."""
        return self.memory.of(self.cutter.cut(texts))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for a worker process."""
    return Encoder(path)
