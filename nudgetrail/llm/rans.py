"""Token ids in binary shards, coded by a static range asymmetric numeral system (rANS).

A shard is a folder of parquet rows, each row one block: a byte string that can be decoded alone,
given the table. The table of symbol frequencies is counted over the whole corpus, scaled to
``2 ** bits`` and shared by all blocks. A block holds whole documents, in order, dealt to ``LANES``
interleaved 64-bit states that share one stream of 32-bit words; every ``STRIDE`` steps a checkpoint
keeps the states and the place in the stream, so that a long block is decoded from all its
checkpoints at once. A checksum covers the block.

Documents are in ascending order of doc_id, null first; rows with the same doc_id are in the order
of their text. Null and empty texts hold the end id alone. A document is never split, so a very
long one is one long block with many checkpoints. An empty table gives no block and an empty table
of frequencies. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgetrail.llm.common import Stages, slices, texts
from nudgetrail.llm.token_stage import token_stage
from nudgetrail.llm.tokens import encoder

END_ID = 2
LANES = 64
STRIDE = 256  # steps between checkpoints
BLOCK = 1 << 16  # tokens after which a block is closed
BATCH = 1 << 20  # tokens that one task codes in step
SLICE = 4 << 20  # bytes of text or ids taken at a time
LOW = np.uint64(1 << 31)
MAGIC = b"RNS1"
HEAD = struct.Struct("<4sIQIII")  # magic, documents, tokens, words, checkpoints, lanes
MIN_BITS, SPARE_BITS = 16, 4


class Table:
    """Frequencies that sum to 2 ** bits; every symbol that occurs has one of at least 1."""

    def __init__(self, symbol: np.ndarray, count: np.ndarray):
        self.symbol = symbol.astype(np.int64)
        n = len(symbol)
        self.bits = max(MIN_BITS, int(max(n, 1) - 1).bit_length() + SPARE_BITS)
        total = 1 << self.bits
        share = count / max(1, count.sum()) * (total - n)
        freq = 1 + np.floor(share).astype(np.int64)
        if n:
            rest = np.argsort(-(share - np.floor(share)), kind="stable")[: total - freq.sum()]
            freq[rest] += 1
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if n else freq
        self.of_slot = np.repeat(np.arange(n), freq).astype(np.int32)
        self.index = np.full(int(symbol.max()) + 1 if n else 0, -1, dtype=np.int32)
        self.index[symbol] = np.arange(n)


def encode_blocks(table: Table, blocks: list[np.ndarray]) -> list[tuple[bytes, int, int]]:
    """(checkpoints and words, number of words, number of checkpoints) of each block of ids.

    Blocks are coded in step with those of like length: none is padded to over twice its own.
    """
    out: list[tuple[bytes, int, int]] = [(b"", 0, 0)] * len(blocks)
    group: list[int] = []
    for i in sorted(range(len(blocks)), key=lambda i: -len(blocks[i])):
        if group and 2 * len(blocks[i]) < len(blocks[group[0]]):
            for b, coded in zip(group, _in_step(table, [blocks[b] for b in group]), strict=True):
                out[b] = coded
            group = []
        group.append(i)
    for b, coded in zip(group, _in_step(table, [blocks[b] for b in group]), strict=True):
        out[b] = coded
    return out


def _in_step(table: Table, blocks: list[np.ndarray]) -> list[tuple[bytes, int, int]]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    steps = np.array([-(-len(blocks[i]) // LANES) for i in order])
    most = int(steps[0])
    index = np.zeros((most, len(blocks), LANES), dtype=np.int32)
    for b, i in enumerate(order):
        flat = np.zeros(steps[b] * LANES, dtype=np.int32)
        flat[: len(blocks[i])] = table.index[blocks[i]]
        index[: steps[b], b] = flat.reshape(-1, LANES)
    state = np.full((len(blocks), LANES), LOW)
    word = np.zeros(index.shape, dtype=np.uint32)
    wrote = np.zeros(index.shape, dtype=bool)
    marks = np.zeros((-(-most // STRIDE), len(blocks), LANES), dtype=np.uint64)
    bits, half = np.uint64(table.bits), np.uint64(32)
    room = (LOW >> bits) << half
    active = np.searchsorted(-steps, -np.arange(most), side="left")  # blocks of more than t steps
    for t in range(most - 1, -1, -1):
        n = active[t]
        x, s = state[:n], index[t, :n]
        f = table.freq[s]
        full = x >= room * f
        word[t, :n] = x.astype(np.uint32)
        wrote[t, :n] = full
        x = np.where(full, x >> half, x)
        q, r = np.divmod(x, f)
        state[:n] = (q << bits) + r + table.start[s]
        if t % STRIDE == 0:
            marks[t // STRIDE] = state
    out: list[tuple[bytes, int, int]] = [(b"", 0, 0)] * len(blocks)
    for b, i in enumerate(order):
        kept = wrote[: steps[b], b]
        words = word[: steps[b], b][kept]
        n = -(-int(steps[b]) // STRIDE)
        at = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])[: steps[b] : STRIDE]
        data = at.astype("<u4").tobytes() + marks[:n, b].astype("<u8").tobytes()
        out[i] = (data + words.astype("<u4").tobytes(), len(words), n)
    return out


def block_bytes(table: Table, docs: list[list[tuple[int | None, np.ndarray]]]) -> list[bytes]:
    """A sealed block for each list of (doc_id, ids)."""
    coded = encode_blocks(table, [np.concatenate([ids for _, ids in block]) for block in docs])
    out = []
    for block, (data, words, marks) in zip(docs, coded, strict=True):
        sizes = np.array([len(ids) for _, ids in block], dtype="<u4")
        known = np.array([doc is not None for doc, _ in block], dtype=np.uint8)
        names = np.array([doc or 0 for doc, _ in block], dtype="<i8")
        head = HEAD.pack(MAGIC, len(block), int(sizes.sum()), words, marks, LANES)
        body = head + names.tobytes() + sizes.tobytes() + known.tobytes() + data
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


def decode_blocks(table: Table, blocks: list[bytes]) -> list[list[tuple[int | None, np.ndarray]]]:
    """The documents of each block; a block that fails its checksum raises."""
    parsed, entry = [], []
    words, base = [], 0
    for block in blocks:
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("a block does not match its checksum")
        magic, docs, tokens, n_words, marks, lanes = HEAD.unpack_from(block)
        if magic != MAGIC or lanes != LANES:
            raise ValueError("not a block of this format")
        at = HEAD.size

        def take(dtype: str, n: int, block: bytes = block) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(block, dtype=dtype, count=n, offset=at)
            at += got.nbytes
            return got

        names, sizes, known = take("<i8", docs), take("<u4", docs), take("u1", docs)
        place, states = take("<u4", marks), take("<u8", marks * LANES).reshape(marks, LANES)
        words.append(take("<u4", n_words))
        steps = -(-tokens // LANES)
        for k in range(marks):
            entry.append((base + int(place[k]), min(STRIDE, steps - k * STRIDE), states[k]))
        parsed.append((names, sizes, known, tokens, marks))
        base += n_words
    stream = np.concatenate([*words, np.zeros(1, dtype="<u4")]).astype(np.uint64)
    order = sorted(range(len(entry)), key=lambda i: -entry[i][1])
    steps = np.array([entry[i][1] for i in order])
    at = np.array([entry[i][0] for i in order])
    state = np.stack([entry[i][2] for i in order]).astype(np.uint64)
    index = np.zeros((len(entry), int(steps[0]), LANES), dtype=np.int32)
    row = np.array(order)
    bits, half = np.uint64(table.bits), np.uint64(32)
    mask = np.uint64((1 << table.bits) - 1)
    for t in range(int(steps[0])):
        n = int(np.searchsorted(-steps, -t, side="left"))
        x = state[:n]
        slot = x & mask
        s = table.of_slot[slot]
        index[row[:n], t] = s
        x = table.freq[s] * (x >> bits) + slot - table.start[s]
        short = x < LOW
        rank = np.cumsum(short, axis=1)
        read = stream[np.minimum(at[:n, None] + rank - 1, len(stream) - 1)]
        state[:n] = np.where(short, (x << half) | read, x)
        at[:n] += rank[:, -1]
    out, k = [], 0
    for names, sizes, known, tokens, marks in parsed:
        symbols = table.symbol[index[k : k + marks].reshape(-1)[:tokens]]
        k += marks
        ids = np.split(symbols, np.cumsum(sizes.astype(np.int64))[:-1])
        out.append(
            [(int(d) if ok else None, x) for d, ok, x in zip(names, known, ids, strict=True)]
        )
    return out


def _counts(stage: DataFrame, dtype: str) -> DataFrame:
    """(symbol, n) over all ids of a token stage; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in slices(batches, "ids", SLICE):
            raw = b"".join(batch.column("ids").to_pylist())
            count = np.bincount(np.frombuffer(raw, dtype=dtype))
            if len(count) > len(total):
                count[: len(total)] += total
                total = count
            else:
                total[: len(count)] += count
        symbol = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(symbol), pa.array(total[symbol])], names=["symbol", "n"]
        )

    counted = stage.select("ids").mapInArrow(run, "symbol long, n long")
    return counted.groupBy("symbol").agg(F.sum("n").alias("n"))


def read_table(frequencies: DataFrame) -> Table:
    """The shared table; it has at most one row for each id of the vocabulary."""
    pdf = frequencies.orderBy("symbol").toPandas()
    return Table(pdf["symbol"].to_numpy(dtype=np.int64), pdf["n"].to_numpy(dtype=np.int64))


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> None:
    """Writes ``folder``/shards and ``folder``/frequencies for all rows of ``docs``.

    Rows are dealt to shards by ranges of doc_id, tokenized once and written as a stage; prefix
    sums over the shards give every block the number of ids before it.
    """
    stages = Stages(docs.sparkSession, "rans")
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    stage = token_stage(stages, ordered, path, end_id, SLICE)
    dtype = encoder(path).dtype.str
    _counts(stage, dtype).write.parquet(f"{folder}/frequencies")
    table = read_table(docs.sparkSession.read.parquet(f"{folder}/frequencies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, list]] = []  # shard, first token, tokens, documents

        def flush() -> Iterator[pa.RecordBatch]:
            done = block_bytes(table, [x[3] for x in held])
            for (shard, first, n, _), data in zip(held, done, strict=True):
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard], pa.int32()),
                        "first_token": pa.array([first], pa.int64()),
                        "n_tokens": pa.array([n], pa.int64()),
                        "block": pa.array([data], pa.binary()),
                    }
                )
            held.clear()

        for batch in slices(batches, "ids", SLICE):
            cols = [batch.column(x).to_pylist() for x in ("part", "doc_id", "start", "ids")]
            for shard, doc, start, raw in zip(*cols, strict=True):
                ids = np.frombuffer(raw, dtype=dtype)
                last = held[-1] if held else None
                if last is None or last[0] != shard or last[1] + last[2] != start:
                    last = None
                if last is None or last[2] >= BLOCK:
                    if sum(x[2] for x in held) >= BATCH:
                        yield from flush()
                    held.append((shard, start, 0, []))
                shard, first, n, block = held.pop()
                block.append((doc, ids))
                held.append((shard, first, n + len(ids), block))
        if held:
            yield from flush()

    blocks = stage.select("part", "doc_id", "start", "ids").mapInArrow(
        run, "shard int, first_token long, n_tokens long, block binary"
    )
    (
        blocks.sortWithinPartitions("shard", "first_token")
        .write.partitionBy("shard")
        .option("compression", "uncompressed")
        .parquet(f"{folder}/shards")
    )
    stages.drop()


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards."""
    table = read_table(spark.read.parquet(f"{folder}/frequencies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "block", 1 << 20):
            blocks = decode_blocks(table, batch.column("block").to_pylist())
            rows: list[tuple] = []
            for first, block in zip(batch.column("first_token").to_pylist(), blocks, strict=True):
                for doc, ids in block:
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc, first, len(ids), zlib.crc32(raw), raw))
                    first += len(ids)
            cols = list(zip(*rows, strict=True))
            out = {
                name: pa.array(col, pa.int64())
                for name, col in zip(("doc_id", "start", "n_tokens", "ids_crc32"), cols)
            }
            if with_ids:
                out["ids"] = pa.array(cols[4], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    blocks = spark.read.schema("first_token long, block binary").parquet(f"{folder}/shards")
    return blocks.mapInArrow(run, schema + ", ids binary" if with_ids else schema)
