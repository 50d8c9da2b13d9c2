"""Repeated passages across documents: paragraph MinHash banding, verified and clustered.

Passages are copied from anywhere to anywhere, also into the middle of a line, so a paragraph is cut
by content: ``PARAGRAPH`` words from an anchor on, and an anchor is every word whose run of
``SHINGLE`` words has the smallest hash of any ``WINDOW`` neighbouring ones. Any shared passage of
more than ``PARAGRAPH + WINDOW - 2`` = 50 words has an anchor, and so a whole paragraph, at the same
place in each of its copies.

Bands are tuned for recall: ``BANDS`` of ``ROWS`` MinHash values each find equal paragraphs always
and any pair of similarity 0.8 with a probability of 0.994. A row of a band is a distinct content.
Every content of a bucket that spans documents is compared with the smallest one of the bucket, and
buckets that are not one component then are compared within, in blocks, wherever two contents are
not yet connected: by the exact Jaccard similarity of their word shingles, all of them. Components
of links are classes, the first paragraph of a class stays, and those of other documents are removed.

Documents shorter than a paragraph and null texts have none and stay as they are. Repeats within one
document are not removed for their own sake. Ties are broken by doc_id, then place; rows that repeat
doc_id and text are one document, of which ``without_repeats`` returns one row. There, rows with a
null doc_id take part by a hash of their text (see ``identity``); ``repeated_paragraphs``, whose rows
say doc_ids, leaves them out. Texts of any length are taken whole. An empty table gives no row. Other
columns are kept by ``without_repeats`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nudgetrail.llm.common import Stages, slices, texts
from nudgetrail.llm.components import components
from nudgetrail.llm.identity import identified
from nudgetrail.llm.sieve import Sieve
from nudgetrail.llm.words import U64, mix, words_of

SHINGLE = 5
PARAGRAPH = 25
WINDOW = 27
BANDS, ROWS = 5, 2
SIMILAR = 0.8
CONTEXT = WINDOW + 2  # equal words beside equal paragraphs are fewer, or hold one more
NEXT = 256  # bytes to the next paragraph of a chain
LOW = (1 << 32) - 1
BLOCK = 256  # contents of a bucket compared at a time


def _runs(word: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each place on."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), dtype=U64)
        for j in range(k):
            total = total * U64(0xD6E8FEB86659FD93) + word[at + j] + U64(j + 1)
    return mix(total)


def _anchors(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the smallest value of any WINDOW neighbours of the same text, or of all it has."""
    n = len(value)
    if not n:
        return np.zeros(0, dtype=np.int64)
    found = [np.zeros(0, dtype=np.int64)]
    if n >= WINDOW:
        least = np.lib.stride_tricks.sliding_window_view(value, WINDOW).argmin(axis=1)
        start = np.arange(len(least))
        found.append((start + least)[owner[start] == owner[start + WINDOW - 1]])
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    size = np.diff(np.append(first, n))
    for a, m in zip(first[size < WINDOW].tolist(), size[size < WINDOW].tolist()):
        found.append(np.array([a + int(value[a : a + m].argmin())]))
    return np.unique(np.concatenate(found))


def _shingles(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The shingles of the paragraph at each place, one row each."""
    inside = np.arange(PARAGRAPH - SHINGLE + 1)
    places = at[:, None] + inside
    return _runs(word, places.reshape(-1), SHINGLE).reshape(places.shape)


def _band(rows: np.ndarray, band: int) -> np.ndarray:
    """One key of each row of shingles, from ROWS of its MinHash values."""
    key = np.full(len(rows), band, dtype=U64)
    for row in range(ROWS):
        with np.errstate(over="ignore"):
            least = mix(rows, 31 + band * ROWS + row).min(axis=1)
            key = mix(key * U64(0x9E3779B97F4A7C15) + least)
    return key


def paragraphs(docs: DataFrame, keyed: bool = True) -> DataFrame:
    """(doc_id, span, content, keys): every paragraph of every text; the keys if ``keyed``.

    ``span`` holds start and end in bytes of UTF-8, see ``_start``; ``content`` names the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of([x.encode() for x in batch.column("text").to_pylist()])
            count = np.diff(words.first)
            owner = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(owner)) - np.repeat(words.first[:-1], count)
            whole = np.flatnonzero(np.repeat(count, count) - place >= PARAGRAPH)
            at = whole[_anchors(_runs(words.hash, whole, SHINGLE), owner[whole])]
            ids = batch.column("doc_id").to_numpy(False)
            found = [
                pa.array(ids[owner[at]], pa.int64()),
                pa.array((words.start[at] << 32) + words.end[at + PARAGRAPH - 1]),
                pa.array(_runs(words.hash, at, PARAGRAPH).view(np.int64)),
            ]
            if not keyed:
                yield pa.RecordBatch.from_arrays(found, names=["doc_id", "span", "content"])
                continue
            keys = []
            for part in range(0, len(at), 1 << 15):
                rows = _shingles(words.hash, at[part : part + (1 << 15)])
                keys.append(np.stack([_band(rows, b) for b in range(BANDS)], axis=1))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros((0, BANDS), np.int64)
            ends = np.arange(0, flat.size + 1, BANDS, dtype=np.int32)
            found.append(pa.ListArray.from_arrays(ends, flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays(found, names=["doc_id", "span", "content", "keys"])

    schema = "doc_id long, span long, content long" + (", keys array<long>" if keyed else "")
    return docs.mapInArrow(run, schema)


def _start(span: str) -> Column:
    return F.shiftright(span, 32).cast("int")


def _end(span: str) -> Column:
    return F.col(span).bitwiseAND((1 << 32) - 1).cast("int")


def _grams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each paragraph in order, and which of them differ from the one before."""
    rows = _shingles(words_of(raws).hash, np.arange(len(raws)) * PARAGRAPH)
    rows.sort(axis=1)
    fresh = np.ones(rows.shape, dtype=bool)
    fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return rows, fresh


def similarities(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """Jaccard similarity of the word shingles of each two paragraphs."""
    (x, new_x), (y, new_y) = _grams(one), _grams(two)
    shared = ((x[:, :, None] == y[:, None, :]).any(axis=2) & new_x).sum(axis=1)
    return shared / (new_x.sum(axis=1) + new_y.sum(axis=1) - shared)


def _said(spots: DataFrame, rows: DataFrame) -> DataFrame:
    """(content, raw): the words of each content, read where it stands first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column("raw").to_pylist())
            whole = np.flatnonzero(np.diff(words.first) == PARAGRAPH)
            name = _runs(words.hash, words.first[whole], PARAGRAPH).view(np.int64)
            same = whole[name == batch.column("content").to_numpy(False)[whole]]
            yield batch.take(pa.array(same))

    raw = F.substring(F.col("text").cast("binary"), _start("span") + 1, _end("span") - _start("span"))
    rows = Sieve(spots, "doc_id").kept(rows, "doc_id")
    found = spots.join(rows, "doc_id").select("content", raw.alias("raw"))
    return found.mapInArrow(run, "content long, raw binary").dropDuplicates(["content"])


def _verified(pairs: DataFrame, said: DataFrame) -> DataFrame:
    """Pairs (a, b) of contents that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "ra"):
                one, two = (part.column(c).to_pylist() for c in ("ra", "rb"))
                keep = pa.array(similarities(one, two) >= SIMILAR)
                yield part.select(["a", "b"]).filter(keep)

    joined = pairs.join(said.toDF("a", "ra"), "a").join(said.toDF("b", "rb"), "b")
    return joined.select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def _within(members: DataFrame, said: DataFrame) -> DataFrame:
    """Links (a, b) between contents of a bucket that are not connected yet.

    Members (key, content, component, least) are dealt to blocks, those of the least component of
    the bucket apart. Every two blocks of a bucket meet in one group but for two of that component,
    so that no group has more than about two blocks; buckets of less than a block share a group.
    A group compares all of a bucket that meet exactly and returns a forest of links.
    """

    def compare(table: pa.Table) -> pa.Table:
        name, key = table.column("content").to_numpy(), table.column("key").to_numpy()
        part = table.column("component").to_numpy()
        block = table.column("block").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        rows, fresh = _grams(table.column("raw").to_pylist())
        size = fresh.sum(axis=1)
        shingle, number, times = np.unique(rows[fresh], return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        owner = np.nonzero(fresh)[0]
        twice = times[number] > 1
        has = np.zeros((len(name), int((times > 1).sum())), dtype=np.float32)
        has[owner[twice], column[number[twice]]] = 1
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        shared = has[one] @ has[two].T
        alike = shared / (size[one][:, None] + size[two] - shared)
        near = (alike >= SIMILAR) & (part[one][:, None] != part[two])
        near &= key[one][:, None] == key[two]
        root = {x: x for x in part.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b = [], []
        for i, j in np.argwhere(near).tolist():
            i, j = one[i], two[j]
            x, y = find(int(part[i])), find(int(part[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(max(name[i], name[j]))
                b.append(min(name[i], name[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    main = F.col("component") == F.col("least")
    counted = members.groupBy("key").agg(
        F.count("*").alias("n"), F.count(F.when(main, 1)).alias("mains")
    )
    small, others = F.col("n") <= BLOCK, F.col("n") - F.col("mains")
    bins = max(1, members.count() // BLOCK)
    counted = counted.select(
        "key",
        F.when(small, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("key")).alias("home"),
        small.alias("small"),
        F.when(small, 0).otherwise(F.ceil(F.col("mains") / BLOCK)).cast("int").alias("mains"),
        F.when(small, 1).otherwise(F.ceil(others / BLOCK)).cast("int").alias("others"),
    )
    spread, apart = F.xxhash64("content"), main & ~F.col("small")
    block = F.when(apart, F.col("others") + F.pmod(spread, "mains"))
    block = block.otherwise(F.pmod(spread, "others")).cast("int")
    last = F.when(apart, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    dealt = members.join(counted, "key").withColumn("block", block)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        "small", "home", "key", "content", "component", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    met = met.join(said, "content")
    return met.groupBy("small", "home", "low", "high").applyInArrow(compare, "a long, b long")


def _links(contents: DataFrame, rows: DataFrame, stages: Stages) -> DataFrame:
    """Links (a, b) that connect all similar contents that share a bucket that spans documents.

    Bands are taken one after another, so that the disk holds the rows of one at a time.
    """
    found = []
    for band in range(BANDS):
        keyed = contents.select(F.col("keys")[band].alias("key"), "content", "doc_id", "last")
        hubs = keyed.groupBy("key").agg(
            F.min("content").alias("hub"), F.max("content").alias("most"),
            F.min("doc_id").alias("doc_id"), F.max("last").alias("last"),
        )
        hubs = hubs.where("hub < most AND doc_id < last").select("key", "hub")
        hubs = stages.cut(hubs, f"hubs-{band}")
        joined = keyed.select("key", "content").join(hubs, "key")
        found.append(stages.cut(joined, f"members-{band}"))
        stages.drop(f"hubs-{band}")
    members = reduce(DataFrame.unionByName, found)
    wanted = stages.cut(members.select("content").distinct(), "wanted")
    spots = contents.select("content", "doc_id", "span").join(wanted, "content", "left_semi")
    spots = stages.cut(spots, "spots")
    said = stages.cut(_said(spots, rows), "said")
    pairs = members.where("content > hub").select("content", "hub").distinct().toDF("a", "b")
    return _connected(members, _verified(pairs, said), said, stages)


def _connected(members: DataFrame, links: DataFrame, said: DataFrame, stages: Stages) -> DataFrame:
    """The links of hubs, and those between members that these leave apart."""
    links = stages.cut(links, "hub-links")
    # A hub is smaller than what links to it: two jumps bring most members to one root. Whoever is
    # not there yet is only tested once more than it had to be.
    up = stages.cut(links.groupBy("a").agg(F.min("b").alias("up")), "up")
    for jump in range(2):
        over = up.toDF("up", "over")
        up = up.join(over, "up", "left").select("a", F.coalesce("over", "up").alias("up"))
        up = stages.cut(up, f"up-{jump}")
    placed = members.join(up.toDF("content", "up"), "content", "left").select(
        "key", "content", F.coalesce("up", "content").alias("component")
    )
    placed = stages.cut(placed, "placed")
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most")
    )
    mixed = stages.cut(mixed.where("least < most").select("key", "least"), "mixed")
    more = stages.cut(_within(placed.join(mixed, "key"), said), "more-links")
    return links.unionByName(more)


def _repeats(docs: DataFrame, stages: Stages) -> DataFrame:
    """(doc_id, span, class_id, keeper, at, own, own_at): see ``repeated_paragraphs``.

    ``keeper`` and ``at`` are where the class stands first, ``own`` and ``own_at`` the content. Rows
    of documents that repeat come as often; nothing follows the join, so that a content with any
    share of all places can be split.
    """
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.where("doc_id IS NOT NULL")
    units = stages.cut(paragraphs(rows, keyed=False), "paragraphs")
    contents = paragraphs(rows).groupBy("content").agg(
        F.min(F.struct("doc_id", "span", "keys")).alias("x"), F.max("doc_id").alias("last")
    )
    contents = stages.cut(contents.select("content", "x.*", "last"), "contents")
    links = _links(contents, rows, stages)
    classes = components(links, stages).withColumnRenamed("node", "content")
    stages.drop("placed", "said", *[f"members-{band}" for band in range(BANDS)])

    named = contents.drop("keys").join(classes, "content", "left")
    named = named.where("component IS NOT NULL OR doc_id < last").select(
        "content", F.coalesce("component", "content").alias("class_id"), "doc_id", "span", "last"
    )
    named = stages.cut(named, "named")
    keepers = named.groupBy("class_id").agg(
        F.min(F.struct("doc_id", "span")).alias("keeper"), F.max("last").alias("last")
    )
    keepers = keepers.where("keeper.doc_id < last").select(
        "class_id", F.col("keeper.doc_id").alias("keeper"), F.col("keeper.span").alias("at")
    )
    named = named.drop("last").withColumnsRenamed({"doc_id": "own", "span": "own_at"})
    named = stages.cut(named.join(keepers, "class_id"), "kept")
    stages.drop("contents", "named")
    return units.join(named, "content").drop("content")


def repeated_paragraphs(docs: DataFrame, stages: Stages) -> DataFrame:
    """(doc_id, start, end, class_id, keeper_doc_id, keeper_start, removed).

    Every paragraph of a class that spans documents; class_id is the smallest content of the class.
    """
    return _repeats(docs, stages).select(
        "doc_id", _start("span").alias("start"), _end("span").alias("end"), "class_id",
        F.col("keeper").alias("keeper_doc_id"), _start("at").alias("keeper_start"),
        (F.col("doc_id") != F.col("keeper")).alias("removed"),
    ).distinct()


def _chains(removed: DataFrame) -> DataFrame:
    """(doc_id, source, low, high, shift, spans): runs of removed paragraphs beside their source.

    Spans of a chain stand ``shift`` bytes earlier than in the source, which has them in low to high.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), batch.column("found").to_pylist()):
                places = sorted(
                    (x["source"], (x["at"] >> 32) - (x["span"] >> 32), x["span"], x["at"]) for x in found
                )
                for source, shift, span, at in places:
                    last = rows[-1] if rows else None
                    if last and last[0] == doc and (last[1], last[4]) == (source, shift):
                        if (at >> 32) - last[3] <= NEXT:
                            last[3] = max(last[3], at & LOW)
                            last[5].append(span)
                            continue
                    rows.append([doc, source, at >> 32, at & LOW, shift, [span]])
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
            names = ["doc_id", "source", "low", "high", "shift", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, source long, low long, high long, shift long, spans array<long>"
    return removed.mapInArrow(run, schema)


def _segments(chains: DataFrame, rows: DataFrame) -> DataFrame:
    """(source, low, high, start, raw): bytes low to high of a text, with CONTEXT words about them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for source, text, parts in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                raw = text.encode()
                words = words_of([raw])
                for low, high in [(x["low"], x["high"]) for x in parts]:
                    first = max(0, int(np.searchsorted(words.start, low)) - CONTEXT)
                    last = min(len(words.end), int(np.searchsorted(words.end, high)) + 1 + CONTEXT)
                    if first < last:
                        start = int(words.start[first])
                        out.append((source, low, high, start, raw[start : int(words.end[last - 1])]))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            names = ["source", "low", "high", "start", "raw"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    parts = chains.groupBy("source").agg(F.collect_set(F.struct("low", "high")).alias("parts"))
    rows = Sieve(chains, "source").kept(rows, "doc_id")
    joined = rows.join(parts, F.col("doc_id") == F.col("source")).select("source", "text", "parts")
    found = joined.mapInArrow(run, "source long, low long, high long, start long, raw binary")
    return found.groupBy("source", "low", "high").agg(F.min(F.struct("start", "raw")).alias("said"))


def _extended(text: bytes, chains: list[dict]) -> list[tuple[int, int]]:
    """The spans of all chains, each with the words about it that its source has there as well."""
    own = words_of([text])
    cut = []
    for chain in chains:
        other = words_of([chain["raw"]])
        done = 0
        for span in sorted(chain["spans"]):
            start, end = span >> 32, span & LOW
            if end <= done:
                continue
            cut.append((start, end))
            i = int(np.searchsorted(own.start, start))
            k = int(np.searchsorted(other.start, start + chain["shift"] - chain["start"]))
            if own.end[i + PARAGRAPH - 1 : i + PARAGRAPH].tolist() != [end]:
                continue  # the doc_id has another text as well
            # A similar paragraph may begin a word or two beside the source's.
            beside = [
                (int((own.hash[i : i + PARAGRAPH] == other.hash[j : j + PARAGRAPH]).sum()), -abs(j - k), j)
                for j in range(max(0, k - 2), k + 3)
                if j + PARAGRAPH <= len(other.hash)
            ]
            if not beside:
                continue
            j = max(beside)[2]
            n = min(i, j)
            before = np.flatnonzero(own.hash[i - n : i][::-1] != other.hash[j - n : j][::-1])
            left = int(before[0]) if len(before) else n
            i, j = i + PARAGRAPH, j + PARAGRAPH
            n = min(len(own.hash) - i, len(other.hash) - j)
            after = np.flatnonzero(own.hash[i : i + n] != other.hash[j : j + n])
            right = int(after[0]) if len(after) else n
            done = int(own.end[i + right - 1])
            cut.append((int(own.start[i - PARAGRAPH - left]), done))
    return cut


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, their texts cut where a passage was kept in another document.

    A removed paragraph takes along the words before and after it as far as they are the same in
    the first document of its class, and in the first that has just this paragraph.
    n_chars, where there is one, follows the text. A document of which nothing is left is dropped.
    """
    stages = Stages(docs.sparkSession, "substrings")
    columns, schema = docs.columns, docs.schema
    docs, key = identified(docs, stages)
    rows = texts(docs.select(F.col(key).alias("doc_id"), "text"))
    removed = _repeats(rows, stages).where("doc_id != keeper")
    first = F.struct(F.col("keeper").alias("source"), "at")
    exact = F.struct(F.col("own").alias("source"), F.col("own_at").alias("at"))
    removed = removed.select("doc_id", "span", F.explode(F.array_distinct(F.array(first, exact))).alias("x"))
    removed = removed.where("x.source < doc_id").groupBy("doc_id").agg(
        F.collect_set(F.struct("span", "x.source", "x.at")).alias("found")
    )
    chains = stages.cut(_chains(removed), "chains")
    stages.drop("paragraphs", "kept")
    said = stages.cut(_segments(chains, rows), "segments")
    spans = chains.join(said, ["source", "low", "high"]).groupBy(F.col("doc_id").alias("cut_doc")).agg(
        F.collect_list(F.struct("spans", "shift", "said.start", "said.raw")).alias("cut_spans")
    )
    spans = stages.cut(spans, "spans")

    # Documents that are not cut do not have to be shuffled with those that may be.
    docs = Sieve(spans, "cut_doc").marked(docs, key, "cut_maybe")
    same_doc = F.col(key) == F.col("cut_doc")
    joined = docs.where("cut_maybe").join(spans, same_doc, "left").select(*columns, "cut_spans")
    nothing = F.lit(None).cast(spans.schema["cut_spans"].dataType).alias("cut_spans")
    joined = joined.unionByName(docs.where("NOT cut_maybe").select(*columns, nothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, keep = [], []
            found = batch.column("cut_spans").to_pylist()
            for t, chains in zip(batch.column("text").to_pylist(), found, strict=True):
                left = t if chains is None else _left(t, chains)
                text.append(left)
                keep.append(chains is None or left.strip() != "")
            out = {c: batch.column(c) for c in columns}
            out["text"] = pa.array(text, batch.schema.field("text").type)
            if "n_chars" in out:
                size = zip(found, text, out["n_chars"].to_pylist(), strict=True)
                kind = batch.schema.field("n_chars").type
                out["n_chars"] = pa.array([n if s is None else len(t) for s, t, n in size], kind)
            yield pa.RecordBatch.from_pydict(out).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, schema)


def _left(text: str, chains: list[dict]) -> str:
    """The text without the chains and what they take along; they may overlap."""
    raw, kept, at = text.encode(), [], 0
    for start, end in sorted(_extended(raw, chains)):
        kept.append(raw[at : max(at, start)])
        at = max(at, end)
    return b"".join([*kept, raw[at:]]).decode()
