"""Scores of whole texts by a class-based bigram model, its classes found by exchange.

A text is its words in ASCII lower case and one end token. The probability of a word is that of its
class after the class before, times that of the word in its class (Brown et al. 1992). Words that
hold at least ``SHARE`` of all training tokens, so at most ``1 / SHARE`` of them, are the core:
their bigrams are counted exactly and exchange clustering moves them between classes, a part of them
at a time against the counts of all others, wherever the bigrams' likelihood gains most. Every
other word, however rare, joins the class that its own neighbours of the core favour, by a vote
weighed by its counts; transitions are then counted over all training tokens. The end of a text is a
class of its own, so it also stands for the beginning.

Both parts are smoothed and sum to one over all known words and one unknown word: transitions lean on
class frequencies (``PSEUDO`` counts), and every word gives up a share of one count, estimated
from how many words occur once and twice, to the unknown word of its class. After an unknown word
the model goes on as after words that occur once in their block.

Texts are kept in blocks of about ``BLOCK`` bytes. The words of a block, not those of a document,
are looked up, and a block meets its words in one task; a text is never split, so a very long one is
a block of its own. What goes through the driver are the core, classes, and sums by class.

A null text is empty: one end token. A null doc_id is a row like any other, and so is each of
repeated rows. Without training texts every token is the one unknown word and all scores are 0. An
empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nudgetrail.llm.common import SLICE_BYTES, Stages, slices
from nudgetrail.llm.words import U64, digest_spans, words_of

CLASSES = 64  # class 0 is the end alone
SHARE = 2.0**-18
SWEEPS, PARTS = 5, 2  # times that every core word may move, and in how many turns each
BLOCK = 24 << 20
PSEUDO = 64.0
HELD = 4 << 20  # distinct entries that a task merges at once
END = U64(0)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def token_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a key for every token of all texts, where those of text i begin, with the end)."""
    words = words_of([x.encode().translate(LOWER) for x in texts], digest_spans)
    keys = np.insert(words.hash, words.first[1:], END)
    return keys, words.first + np.arange(len(words.first))


class Tally:
    """Counts of 64-bit codes, merged whenever many have come together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, codes: np.ndarray) -> None:
        self.parts.append(np.unique(codes, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > HELD and len(self.parts) > 1:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        codes, where = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
        count = np.zeros(len(codes), dtype=np.int64)
        np.add.at(count, where, np.concatenate([n for _, n in self.parts]))
        return codes, count


def _batches(columns: dict[str, np.ndarray], rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(columns.values())))
    for i in range(0, size, rows):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[i : i + rows]) for k, v in columns.items()})


@dataclass
class Core:
    """The frequent words: keys in order, and the rank of each; counts and classes are by rank."""

    keys: np.ndarray
    rank: np.ndarray
    count: np.ndarray

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each key, -1 for words outside the core."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], np.int32(-1))


def _blocks(docs: DataFrame, train: Column, stages: Stages, block_bytes: int) -> DataFrame:
    """The texts as they come, each with the number of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, "text"):
            size = batch.column("text").nbytes
            if held and held + size > block_bytes:
                block, held = block + 1, 0
            held += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, block)), *batch.columns],
                names=["block", *batch.schema.names],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    schema = "block long, doc_id long, train boolean, text string"
    return stages.cut(rows.mapInArrow(run, schema), "blocks")


def _counted_words(blocks: DataFrame) -> DataFrame:
    """(key, n) of every token of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in slices(batches, "text"):
            tally.add(token_keys(batch.column("text").to_pylist())[0])
        keys, n = tally.merged()
        yield from _batches({"key": keys.view(np.int64), "n": n})

    texts = blocks.where("train").select("text")
    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _core(words: DataFrame, tokens: int, share: float) -> Core:
    """Words of at least that share, and the end; there are at most 1 / share + 1."""
    enough = (F.col("n") >= max(1, math.ceil(tokens * share))) | (F.col("key") == int(END))
    rows = words.where(enough).toPandas()
    keys = rows["key"].to_numpy(dtype=np.int64).view(U64)
    count = rows["n"].to_numpy(dtype=np.int64)
    order = np.lexsort((keys, -count, keys != END))  # the end is rank 0
    keys, count = keys[order], count[order]
    in_order = np.argsort(keys)
    return Core(keys[in_order], in_order.astype(np.int32), count)


def _neighbours(blocks: DataFrame, core: Core, stages: Stages) -> DataFrame:
    """(word, left, right) of each core word: its neighbours in the core, with counts."""
    size = max(1, len(core.keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in slices(batches, "text"):
            ranks = core.ranks(token_keys(batch.column("text").to_pylist())[0]).astype(np.int64)
            before = np.concatenate([[0], ranks[:-1]])  # rank 0 is the end, and so the beginning
            both = (ranks >= 0) & (before >= 0)
            tally.add(before[both] * size + ranks[both])
        codes, n = tally.merged()
        yield from _batches(
            {"a": (codes // size).astype(np.int32), "b": (codes % size).astype(np.int32), "n": n}
        )

    texts = blocks.where("train").select("text")
    pairs = texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # Each pair once under either word. A word has no more neighbours than the core has words.
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.lit(1).alias("right")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.lit(0).alias("right")),
    )
    entry = F.struct(F.col("side.other").alias("other"), "n")
    lists = (
        pairs.select("n", F.explode(sides).alias("side"))
        .groupBy(F.col("side.word").alias("word"))
        .agg(
            F.collect_list(F.when(F.col("side.right") == 0, entry)).alias("left"),
            F.collect_list(F.when(F.col("side.right") == 1, entry)).alias("right"),
        )
    )
    return stages.cut(lists, "neighbours")


def _histogram(lists: pa.Array, words: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(counts of neighbours by class, counts of the word beside itself) for each row."""
    flat = lists.flatten()
    other = flat.field("other").to_numpy()
    n = flat.field("n").to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(words)), np.diff(lists.offsets.to_numpy()))
    own = other == words[row]
    code = row * CLASSES + classes[other]
    counts = np.bincount(code[~own], n[~own], len(words) * CLASSES).reshape(-1, CLASSES)
    return counts, np.bincount(row[own], n[own], len(words))


def _entropy_terms(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_move(
    pairs: np.ndarray, left: np.ndarray, right: np.ndarray, own: float, home: int
) -> tuple[int, float]:
    """The class that a word gains most by moving to, and the gain in log-likelihood.

    ``pairs`` are counts of classes after classes with the word in ``home``; ``left`` and
    ``right`` are its neighbours by class, ``own`` how often it follows itself.
    """
    rest = pairs.copy()
    rest[home] -= right
    rest[:, home] -= left
    rest[home, home] -= own
    # Wherever the word goes, the words around it keep it as a neighbour.
    rows, cols = rest.sum(axis=1) + left, rest.sum(axis=0) + right
    terms = _entropy_terms(rest)
    by_row = _entropy_terms(rest + right) - terms  # row b: the word's right side joins class b
    by_col = _entropy_terms(rest + left[:, None]) - terms
    there = np.arange(len(rest))
    corner = _entropy_terms(rest[there, there] + left + right + own) - terms[there, there]
    gain = by_row.sum(axis=1) - by_row[there, there] + by_col.sum(axis=0) - by_col[there, there]
    gain += corner
    gain -= _entropy_terms(rows + right.sum() + own) - _entropy_terms(rows)
    gain -= _entropy_terms(cols + left.sum() + own) - _entropy_terms(cols)
    gain[0] = -np.inf  # the end stays alone
    best = int(gain.argmax())
    return best, float(gain[best] - gain[home])


def _pair_counts(neighbours: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often each class follows each class within the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES)
        for batch in batches:
            words = batch.column("word").to_numpy()
            flat = batch.column("right").flatten()
            row = np.repeat(classes[words], np.diff(batch.column("right").offsets.to_numpy()))
            code = row.astype(np.int64) * CLASSES + classes[flat.field("other").to_numpy()]
            total += np.bincount(code, flat.field("n").to_numpy(), CLASSES * CLASSES)
        code = np.flatnonzero(total)
        yield from _batches({"code": code, "n": total[code].astype(np.int64)})

    counted = neighbours.select("word", "right").mapInArrow(run, "code long, n long")
    return _matrix(counted, CLASSES)


def _matrix(counted: DataFrame, rows: int) -> np.ndarray:
    """Sums of (code, n) rows as a matrix of classes; one row for each pair comes to the driver."""
    out = np.zeros(rows * CLASSES)
    for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r["code"]] = r["n"]
    return out.reshape(rows, CLASSES)


def likelihood(pairs: np.ndarray) -> float:
    """Log-likelihood of class bigrams, but for a term that no exchange changes."""
    ends = _entropy_terms(pairs.sum(axis=1)).sum() + _entropy_terms(pairs.sum(axis=0)).sum()
    return float(_entropy_terms(pairs).sum() - ends)


def exchanged(neighbours: DataFrame, size: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(class of every core word by rank, pair counts), the best seen over all turns."""
    classes = 1 + np.arange(size) % (CLASSES - 1)
    classes[:1] = 0
    pairs = _pair_counts(neighbours, classes)
    best = likelihood(pairs), classes, pairs
    for turn in range(sweeps * PARTS):

        def run(
            batches: Iterator[pa.RecordBatch],
            turn: int = turn,
            classes: np.ndarray = classes,
            pairs: np.ndarray = pairs,
        ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column("word").to_numpy()
                mine = np.flatnonzero((words % PARTS == turn % PARTS) & (words > 0))
                batch, words = batch.take(pa.array(mine)), words[mine]
                left, own = _histogram(batch.column("left"), words, classes)
                right, _ = _histogram(batch.column("right"), words, classes)
                moves = [
                    best_move(pairs, left[i], right[i], own[i], classes[w])
                    for i, w in enumerate(words.tolist())
                ]
                to = np.array([m[0] for m in moves], dtype=np.int32)
                gain = np.array([m[1] for m in moves])
                yield from _batches({"word": words[gain > 1e-6], "to": to[gain > 1e-6]})

        moved = neighbours.mapInArrow(run, "word int, to int").toPandas()
        if moved.empty and turn:
            break
        classes = classes.copy()
        classes[moved["word"].to_numpy()] = moved["to"].to_numpy()
        pairs = _pair_counts(neighbours, classes)
        if (now := likelihood(pairs)) > best[0]:
            best = now, classes, pairs
    return best[1], best[2]


def transition_table(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Probability of each class after each; the rows lean on the shares of ``classes``."""
    share = classes / max(1.0, classes.sum())
    return (counts + PSEUDO * share) / (counts.sum(axis=1, keepdims=True) + PSEUDO)


def _votes(blocks: DataFrame, core: Core, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """Two kinds of rows: words outside the core with their votes, and class transitions.

    (block, key, n, vote) of every word of a block; (null, code, n, null) where code is a class
    after a class, the class ``CLASSES`` standing for words that occur once in their block.
    """
    after = transition_table(pairs, pairs.sum(axis=0))
    with np.errstate(divide="ignore"):
        share = pairs.sum(axis=0) / max(1.0, pairs.sum())
        from_left = np.log(np.maximum(np.vstack([after, share]), 1e-12)).astype(np.float32)
        from_right = np.log(np.maximum(np.vstack([after.T, np.ones(CLASSES)]), 1e-12))
    from_left[:, 0] = -np.inf
    from_right = from_right.astype(np.float32)
    by_rank = np.append(classes, CLASSES).astype(np.int64)  # rank -1: outside the core

    def voted(word: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
        """The class that the neighbours of each word favour."""
        order = np.argsort(word, kind="stable")
        word, left, right = word[order], left[order], right[order]
        out, step, wide = np.zeros(n, dtype=np.int64), 1 << 14, CLASSES + 1
        for i in range(0, n, step):
            a, b = np.searchsorted(word, [i, i + step])
            rows, own = min(step, n - i), (word[a:b] - i) * wide
            lefts = np.bincount(own + left[a:b], minlength=rows * wide).reshape(rows, wide)
            rights = np.bincount(own + right[a:b], minlength=rows * wide).reshape(rows, wide)
            points = np.zeros((rows, CLASSES), dtype=np.float32)
            points[:, 1:] = lefts.astype(np.float32) @ from_left[:, 1:]
            points[:, 1:] += rights.astype(np.float32) @ from_right[:, 1:]
            out[i : i + step] = 1 + points[:, 1:].argmax(axis=1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions = np.zeros((CLASSES + 1) * CLASSES, dtype=np.int64)
        block, held = None, []  # keys and whether they train, for each slice of the block

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for k, _ in held])
            trains = np.concatenate([t for _, t in held])
            held.clear()
            kind = by_rank[core.ranks(keys)]
            other = np.flatnonzero(kind == CLASSES)
            words, word = np.unique(keys[other], return_inverse=True)
            learns = trains[other]
            n = np.bincount(word[learns], minlength=len(words))
            # Neither the first nor the last token of a block is outside the core and inside a
            # text: the end is in the core, and it closes every text.
            before = np.concatenate([[0], kind[:-1]])
            left, right = before[other][learns], np.append(kind[1:], 0)[other][learns]
            vote = voted(word[learns], left, right, len(words))
            kind[other] = vote[word]
            before = np.concatenate([[0], kind[:-1]])
            code = before * CLASSES + kind
            transitions[:] += np.bincount(code[trains], minlength=len(transitions))
            once = np.zeros(len(keys), dtype=bool)
            once[other] = (n == 1)[word]
            once = np.concatenate([[False], once[:-1]]) & trains
            code = CLASSES * CLASSES + kind[once]
            transitions[:] += np.bincount(code, minlength=len(transitions))
            yield from rows(np.full(len(words), block), words.view(np.int64), n, vote)

        def rows(block, key, n, vote) -> Iterator[pa.RecordBatch]:
            for batch in _batches({"block": block, "key": key, "n": n, "vote": vote}):
                yield batch.set_column(3, "vote", batch.column("vote").cast(pa.int32()))

        for batch in slices(batches, "text"):
            for part in _by_block(batch):
                number = part.column("block")[0].as_py()
                if held and number != block:
                    yield from flush()
                block = number
                keys, first = token_keys(part.column("text").to_pylist())
                train = part.column("train").to_numpy(zero_copy_only=False)
                held.append((keys, np.repeat(train, np.diff(first))))
        if held:
            yield from flush()
        code = np.flatnonzero(transitions)
        block = np.full(len(code), -1)
        yield from rows(block, code, transitions[code], np.zeros(len(code), dtype=np.int64))

    return blocks.mapInArrow(run, "block long, key long, n long, vote int")


def _by_block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    number = batch.column("block").to_numpy()
    heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    for a, b in zip(heads, np.append(heads[1:], len(number)), strict=True):
        yield batch.slice(a, b - a)


def _dictionary(votes: DataFrame, stages: Stages) -> DataFrame:
    """(block, key, n, class, first): the corpus' count and class of every word of a block.

    A word has one row for each block it is in, and is outside the core, so that no key holds more
    than ``SHARE`` of the tokens. ``first`` marks one row of each word.
    """
    of_vote = F.sum("n").over(Window.partitionBy("key", "vote"))
    word = Window.partitionBy("key")
    favoured = F.max(F.struct("points", -F.col("vote"))).over(word)
    rows = (
        votes.where("block >= 0")
        .repartition("key")
        .withColumn("points", of_vote)
        .select(
            "block",
            "key",
            F.sum("n").over(word).alias("n"),
            (-favoured["col2"]).cast("int").alias("class"),
            (F.row_number().over(Window.partitionBy("key").orderBy("vote", "block")) == 1).alias("first"),
        )
        .where("n > 0")
    )
    return stages.cut(rows, "dictionary")


@dataclass
class Model:
    """All that scores need beside the counts and classes of words outside the core."""

    core: Core
    classes: np.ndarray  # by rank
    tokens: int
    words: int
    discount: float
    size: np.ndarray  # tokens of each class
    log_after: np.ndarray  # log10 of each class after each class, and after unknown words
    log_unknown: np.ndarray  # log10 of the unknown word after each

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def token_scores(self, keys: np.ndarray, extra: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """(count, log10 probability) of every token of texts that follow each other."""
        rank = self.core.ranks(keys)
        count = np.append(self.core.count, 0)[rank]
        kind = np.append(self.classes, CLASSES)[rank]
        other, (known, n, of) = np.flatnonzero(rank < 0), extra
        if len(known) and len(other):
            at = np.minimum(np.searchsorted(known, keys[other]), len(known) - 1)
            hit = known[at] == keys[other]
            count[other[hit]], kind[other[hit]] = n[at[hit]], of[at[hit]]
        before = np.concatenate([[0], kind[:-1]])
        new = kind == CLASSES
        there = np.where(new, 0, kind)
        with np.errstate(divide="ignore", invalid="ignore"):
            # The end gives nothing up: it is the only token of its class.
            inside = (count - np.where(there == 0, 0, self.discount)) / self.size[there]
            seen = self.log_after[before, there] + np.log10(inside)
        return count, np.where(new, self.log_unknown[before], seen)


def _model(
    core: Core,
    classes: np.ndarray,
    transitions: np.ndarray,
    dictionary: DataFrame,
    tokens: int,
    words: int,
    seen: tuple[int, int],
) -> Model:
    size = np.bincount(classes, core.count, CLASSES)
    types = np.bincount(classes, minlength=CLASSES).astype(np.float64)
    rare = dictionary.where("first").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    for r in rare.collect():
        size[r["class"]] += r["n"]
        types[r["class"]] += r["v"]
    discount = (seen[0] + 1) / (seen[0] + 2 * seen[1] + 2)
    after = transition_table(transitions, size)
    given_up = discount * types / np.maximum(size, 1)
    given_up[0] = 0
    with np.errstate(divide="ignore"):
        # With no word but the end there is no unknown one either: then it may have all.
        unknown = after @ given_up
        unknown = np.where(unknown > 0, unknown, 0.5 / (tokens + 1))
        return Model(
            core, classes, tokens, words, discount, size, np.log10(after), np.log10(unknown)
        )


def class_scores(
    docs: DataFrame,
    train: Column,
    stages: Stages,
    share: float = SHARE,
    block_bytes: int = BLOCK,
    sweeps: int = SWEEPS,
) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    ``train`` says of a row of ``docs`` whether the model learns from its text. Scores are log10
    probabilities; ``base_score`` is that of a smoothed unigram model of the same counts.
    """
    blocks = _blocks(docs, train, stages, block_bytes)
    words = stages.cut(_counted_words(blocks), "words")
    total = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count("*").alias("words"),
        F.count_if(F.col("n") == 1).alias("once"),
        F.count_if(F.col("n") == 2).alias("twice"),
    ).first()
    core = _core(words, total["tokens"], share)
    stages.drop("words")
    neighbours = _neighbours(blocks, core, stages)
    classes, pairs = exchanged(neighbours, len(core.keys), sweeps)
    stages.drop("neighbours")
    votes = stages.cut(_votes(blocks, core, classes, pairs), "votes")
    counted = votes.where("block < 0").select(F.col("key").alias("code"), "n")
    transitions = _matrix(counted, CLASSES + 1)
    dictionary = _dictionary(votes, stages)
    stages.drop("votes")
    model = _model(
        core, classes, transitions, dictionary, total["tokens"], total["words"], total[2:]
    )

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        key = known.column("key").to_numpy().view(U64)
        order = np.argsort(key)
        extra = tuple(
            x[order] for x in (key, known.column("n").to_numpy(), known.column("class").to_numpy())
        )
        out = []
        for batch in slices(texts.to_batches(), "text", SLICE_BYTES):
            keys, first = token_keys(batch.column("text").to_pylist())
            if model.tokens:
                count, score = model.token_scores(keys, extra)
                base = model.base(count)
            else:
                count = score = base = np.zeros(len(keys))
            n = np.diff(first)
            sums = [np.add.reduceat(x, first[:-1]) for x in (count > 0, base, score)]
            cols = {
                "doc_id": batch.column("doc_id"),
                "train": batch.column("train"),
                "n_tokens": pa.array(n),
                "n_known": pa.array(sums[0].astype(np.int64)),
                "train_tokens": pa.array(np.full(len(n), model.tokens, dtype=np.int64)),
                "base_score": pa.array(sums[1].astype(np.float64)),
                "score": pa.array(sums[2].astype(np.float64)),
                "perplexity": pa.array(10 ** (-sums[2] / n)),
            }
            out.append(pa.RecordBatch.from_pydict(cols))
        return pa.Table.from_batches(out, _SCORES) if out else _SCORES.empty_table()

    grouped = dictionary.select("block", "key", "n", "class").groupBy("block")
    return blocks.groupBy("block").cogroup(grouped).applyInArrow(run, _SCORE_SCHEMA)


_SCORE_SCHEMA = (
    "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double, perplexity double"
)
_SCORES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("train", pa.bool_()),
        *((x, pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")),
        *((x, pa.float64()) for x in ("base_score", "score", "perplexity")),
    ]
)
