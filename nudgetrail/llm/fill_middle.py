"""Fill-in-the-middle texts from seekable compressed frames.

A text is kept as independent zstandard frames of ``UNITS`` units each, beside cumulative counts of
units, code points and bytes. A unit is a run of ASCII letters or any other single code point, so
the units of a text are the whole text. To cut a text at a unit, the counts name one frame, and only
that frame is unpacked; the parts between cuts are then streamed frame by frame, in the order that
the form asks for.

Draws are the first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``; a null doc_id counts
as no digits, and rows that repeat a doc_id are drawn alike. A null text is empty; an empty text, one
that holds a marker already, and a drawn share stay plain. A unit is never split between frames, so
a run of many letters is one long frame. Rows that repeat are kept one by one, an empty table gives
no row, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from nudgetrail.llm.common import slices, texts

UNITS = 4096  # of a frame
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
SCHEMA = "doc_id long, marked boolean, units array<long>, chars array<long>, places array<long>, frames binary"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_starts(data: bytes) -> np.ndarray:
    """Where the units of a UTF-8 text begin, in bytes."""
    byte = np.frombuffer(data, dtype=np.uint8)
    letter = _LETTER[byte]
    begins = ~letter & ((byte & 0xC0) != 0x80)
    begins[:1] |= letter[:1]
    begins[1:] |= letter[1:] & ~letter[:-1]
    return np.flatnonzero(begins)


def code_points(data: bytes) -> int:
    return int(((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80).sum())


@dataclass
class Frames:
    """Frames of one text; entry i of units, chars and places is what lies before frame i."""

    units: np.ndarray
    chars: np.ndarray
    places: np.ndarray
    data: bytes

    @classmethod
    def of(cls, text: bytes, units: int = UNITS) -> Frames:
        starts = unit_starts(text)
        heads = starts[::units]
        ends = np.append(heads[1:], len(text)) if len(heads) else heads
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        parts = [text[a:b] for a, b in zip(heads.tolist(), ends.tolist(), strict=True)]
        packed = [pack.compress(x) for x in parts]
        before = np.append(np.arange(0, len(starts), units), len(starts))
        chars = np.cumsum([0, *map(code_points, parts)])
        return cls(before, chars, np.cumsum([0, *map(len, packed)]), b"".join(packed))

    def __len__(self) -> int:
        return len(self.places) - 1

    def frame(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(
            self.data[self.places[i] : self.places[i + 1]]
        )

    def find(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before) of a unit; one past the last is the end."""
        i = int(np.searchsorted(self.units, unit, "right")) - 1
        if unit >= self.units[-1]:
            return len(self), 0, int(self.chars[-1])
        if unit == self.units[i]:
            return i, 0, int(self.chars[i])
        part = self.frame(i)
        at = int(unit_starts(part)[unit - self.units[i]])
        return i, at, int(self.chars[i]) + code_points(part[:at])

    def stream(self, start: tuple[int, int, int], end: tuple[int, int, int]) -> Iterator[bytes]:
        """The text between two places, a frame at a time."""
        for i in range(start[0], min(end[0] + (end[1] > 0), len(self))):
            part = self.frame(i)
            last = end[1] if i == end[0] else len(part)
            yield part[start[1] if i == start[0] else 0 : last]


@dataclass
class Filled:
    """One text, cut and put in order: ``parts`` streams the output."""

    units: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    parts: Iterator[bytes]


def fill(frames: Frames, doc_id: int | None, marked: bool, seed: int = 1) -> Filled:
    """Draws form and cuts of a text and streams the parts in that order."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = int(frames.units[-1])
    begin, end = (0, 0, 0), (len(frames), 0, int(frames.chars[-1]))
    if n == 0 or marked or h3 % 100 >= PLAIN_FROM:
        return Filled(n, "plain", None, None, frames.stream(begin, end))
    first, second = (frames.find(x) for x in sorted((h1 % (n + 1), h2 % (n + 1))))
    spm = h4 % 100 < SPM_BELOW

    def parts() -> Iterator[bytes]:
        if spm:
            yield SUFFIX
            yield from frames.stream(second, end)
        yield PREFIX
        yield from frames.stream(begin, first)
        if not spm:
            yield SUFFIX
            yield from frames.stream(second, end)
        yield MIDDLE
        yield from frames.stream(first, second)

    return Filled(n, "spm" if spm else "psm", first[2], second[2] - first[2], parts())


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made of; markers cannot arise where parts meet."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX, 1)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX, 1)
    return prefix + middle + suffix


def write_frames(docs: DataFrame, folder: str, units: int = UNITS) -> None:
    """Writes the frames of every text to ``folder``, one row a document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            coded = [x.encode() for x in batch.column("text").to_pylist()]
            made = [Frames.of(x, units) for x in coded]
            marked = [any(m in x for m in (PREFIX, SUFFIX, MIDDLE)) for x in coded]
            counts = [pa.array([getattr(x, k) for x in made], pa.list_(pa.int64())) for k in _COUNTS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(marked),
                    *counts,
                    pa.array([x.data for x in made], pa.binary()),
                ],
                names=["doc_id", "marked", *_COUNTS, "frames"],
            )

    texts(docs).mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(folder)


_COUNTS = ("units", "chars", "places")


def _filled(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[int | None, Filled]]:
    for row in batch.to_pylist():
        counts = [np.array(row[k], dtype=np.int64) for k in _COUNTS]
        frames = Frames(*counts, row["frames"])
        yield row["doc_id"], fill(frames, row["doc_id"], row["marked"], seed)


_HEAD = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def _heads(rows: list[tuple[int | None, Filled]]) -> dict[str, pa.Array]:
    return {
        "doc_id": pa.array([d for d, _ in rows], pa.int64()),
        "n": pa.array([x.units for _, x in rows], pa.int64()),
        "form": pa.array([x.form for _, x in rows], pa.string()),
        "prefix_chars": pa.array([x.prefix_chars for _, x in rows], pa.int64()),
        "middle_chars": pa.array([x.middle_chars for _, x in rows], pa.int64()),
    }


def read_filled(spark: SparkSession, folder: str, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every text in the frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "frames"):
            rows = list(_filled(batch, seed))
            output = pa.array([b"".join(x.parts).decode() for _, x in rows], pa.string())
            yield pa.RecordBatch.from_pydict(_heads(rows) | {"output": output})

    return _table(spark, folder).mapInArrow(run, f"{_HEAD}, output string")


def read_digests(spark: SparkSession, folder: str, seed: int = 1) -> DataFrame:
    """As ``read_filled``, with SHA-256 of each output, streamed, and of the text rebuilt from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "frames"):
            rows = list(_filled(batch, seed))
            made, back = [], []
            for _, x in rows:
                digest, held = hashlib.sha256(), []
                for part in x.parts:
                    digest.update(part)
                    held.append(part)
                made.append(digest.hexdigest())
                back.append(hashlib.sha256(restore(b"".join(held), x.form)).hexdigest())
            digests = {"output_sha256": pa.array(made), "restored_sha256": pa.array(back)}
            yield pa.RecordBatch.from_pydict(_heads(rows) | digests)

    return _table(spark, folder).mapInArrow(
        run, f"{_HEAD}, output_sha256 string, restored_sha256 string"
    )


def _table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)
