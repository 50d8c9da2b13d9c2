"""Packing by concatenating and cutting: every document, one after another, in fixed windows.

Pass one tokenizes each document once, writes the ids and the place of each document within its
task; prefix sums over the tasks' totals give global offsets. Pass two cuts each document where a
window ends. Both passes are maps: nothing is shuffled but one total a task.

Null and empty texts are documents of the end id alone. A text of any length is cut into as many
pieces as windows it crosses. Repeated rows are packed as often as they come; a null doc_id is
carried along. An empty table gives no piece. Other columns are ignored. Only the last sequence
can be short; it is padded by whoever loads it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nudgetrail.llm.common import Stages, slices, texts
from nudgetrail.llm.token_stage import token_stage
from nudgetrail.llm.tokens import encoder

WINDOW = 2048
END_ID = 1
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long"
)


def cut_windows(stage: DataFrame, window: int, dtype: str, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents of a token stage: boundary records, with their ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            rows: dict[str, list] = {k.split()[0]: [] for k in PIECES.split(", ")}
            pieces = []
            cols = [batch.column(x).to_pylist() for x in ("doc_id", "start", "n_tokens", "ids")]
            for doc, first, n, raw in zip(*cols, strict=True):
                ids = np.frombuffer(raw, dtype=dtype).astype("<u4")
                cuts = [first, *range((first // window + 1) * window, first + n, window), first + n]
                for a, b in zip(cuts, cuts[1:]):
                    piece = ids[a - first : b - first].tobytes()
                    values = (doc, a - first, b - a, zlib.crc32(piece), n, a // window, a % window)
                    for column, value in zip(rows.values(), values, strict=True):
                        column.append(value)
                    if with_ids:
                        pieces.append(piece)
            out = {k: pa.array(v, pa.int64()) for k, v in rows.items()}
            if with_ids:
                out["ids"] = pa.array(pieces, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = f"{PIECES}, ids binary" if with_ids else PIECES
    return stage.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents; ``with_ids`` adds theirs as little-endian 32-bit integers."""
    stages = Stages(docs.sparkSession, "packing")
    stage = token_stage(stages, texts(docs), path, end_id)
    return cut_windows(stage, window, encoder(path).dtype.str, with_ids)
