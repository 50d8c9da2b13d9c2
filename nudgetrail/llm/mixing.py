"""Mixing sources to target weights, by a minimum-cost flow from documents to sources.

Documents are added up by membership pattern, the set of sources that they belong to. Words of a
pattern can be taken up to ``MOST`` times, each time at a higher cost, and flow to the targets of
its sources. What flows is then selected in a seeded order: the words of a pattern, laid out in
that order once for each time they are taken, are cut between its sources, and the hashes at the
cuts are found by refining histograms. Only patterns, sources and histogram cells pass through the
driver: their number depends on how many sources are mixed, not on the documents.

A null text has no words. Null is a source of its own, after all others; a document of no source
(an empty array) is never taken. Rows with the same doc_id and size move together. Documents are
taken whole, so a source misses its target by part of one document. A table without words takes
nothing. Other columns are kept as they are but for the ones this module adds.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nudgetrail.llm.common import Stages

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20240117
HASH_BITS, STEP_BITS = 62, 8


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST
) -> dict[str | None, float]:
    """Each source's words: all words shared by weight, none above ``most`` times its own size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in order if s in free and weight[s] * unit > most * sizes[s]]
        if not full:
            # In order: whoever walks the targets must not depend on how a set is laid out.
            target |= {s: weight[s] * unit for s in free}
            return {s: target[s] for s in order}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)
    return {s: target[s] for s in order}


def route(
    patterns: list[tuple[tuple, int]], targets: dict[str | None, float], most: int = MOST
) -> list[dict]:
    """Words that flow from each (sources, size) to each of its sources, at the least cost.

    The n-th time that a pattern is taken costs n - 1 a word. Successive shortest paths with
    potentials; every path fills an arc.
    """
    sources = list(targets)
    n = len(patterns)
    at = {s: 1 + n + i for i, s in enumerate(sources)}
    sink = 1 + n + len(sources)
    arcs: list[list[int]] = []  # to, room, cost; arc i ^ 1 goes back
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    routes = []
    for i, (members, size) in enumerate(patterns):
        for again in range(most):
            arc(0, 1 + i, size, again)
        routes.append({s: arc(1 + i, at[s], most * size, 0) for s in members if s in at})
    for s in sources:
        arc(at[s], sink, round(targets[s]), 0)
    potential = [0] * (sink + 1)
    while True:
        far = [float("inf")] * (sink + 1)
        far[0], via, heap = 0, [-1] * (sink + 1), [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k in out[a]:
                b, room, cost = arcs[k]
                if room and d + cost + potential[a] - potential[b] < far[b]:
                    far[b] = d + cost + potential[a] - potential[b]
                    via[b] = k
                    heapq.heappush(heap, (far[b], b))
        if far[sink] == float("inf"):
            return [{s: arcs[k ^ 1][1] for s, k in r.items() if arcs[k ^ 1][1]} for r in routes]
        potential = [p + min(f, far[sink]) for p, f in zip(potential, far, strict=True)]
        path, b = [], sink
        while b:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        room = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= room
            arcs[k ^ 1][1] += room


@dataclass
class Cut:
    """A place in the seeded order of a pattern's words, known to lie in low <= hash < high."""

    pattern: int
    words: float  # after ``low``
    low: int = 0
    high: int = 1 << HASH_BITS
    found: bool = False


def _find(sized: DataFrame, cuts: list[Cut]) -> None:
    """Narrows every cut to the hash of one document, a histogram for all cuts at a time."""
    spark = sized.sparkSession
    while open_cuts := [(i, c) for i, c in enumerate(cuts) if not c.found]:
        bits = {i: max(0, (c.high - c.low).bit_length() - 1 - STEP_BITS) for i, c in open_cuts}
        rows = [(i, c.pattern, c.low, c.high, bits[i]) for i, c in open_cuts]
        ranges = spark.createDataFrame(rows, "cut int, at int, low long, high long, bits int")
        inside = sized.join(
            F.broadcast(ranges),
            (F.col("pattern") == F.col("at"))
            & (F.col("hash") >= F.col("low"))
            & (F.col("hash") < F.col("high")),
        )
        cell = F.expr("shiftright(hash - low, bits)").alias("cell")
        got = (
            inside.groupBy("cut", cell)
            .agg(F.sum("size").alias("size"), F.count_distinct("hash").alias("n"))
            .collect()
        )
        cells: dict[int, list] = {}
        for r in got:
            cells.setdefault(r["cut"], []).append((r["cell"], r["size"], r["n"]))
        for i, c in open_cuts:
            low, width = c.low, 1 << bits[i]
            c.found = True
            for cell_no, size, n in sorted(cells.get(i, [])):
                c.low, c.high = low + cell_no * width, low + (cell_no + 1) * width
                if c.words <= size:
                    c.found = n == 1 or width == 1  # one document is left
                    break
                c.words -= size
                c.low = c.high


def _fill(sized: DataFrame, cuts: list[Cut]) -> dict[int, int]:
    """For last cuts, which end before a document: the hash of the one that fills best what is left."""
    short = [(c.pattern, c.low, float(c.words)) for c in cuts if c.words >= 1]
    if not short:
        return {}
    rows = sized.sparkSession.createDataFrame(short, "at int, low long, words double")
    after = sized.join(
        F.broadcast(rows), (F.col("pattern") == F.col("at")) & (F.col("hash") >= F.col("low"))
    )
    miss = F.abs(F.col("size") - F.col("words"))
    best = (
        after.where(miss < F.col("words"))
        .groupBy("pattern")
        .agg(F.min(F.struct(miss.alias("miss"), "hash")).alias("best"))
    )
    return {r["pattern"]: r["best"]["hash"] for r in best.collect()}


def _plan(
    sized: DataFrame,
    patterns: list[tuple[tuple, int]],
    routes: list[dict],
) -> list[list[tuple]]:
    """For each pattern, the ranges of hashes taken, each with its source: one copy a range."""
    cuts: list[Cut] = []
    pieces: list[tuple[int, str | None, Cut | None, Cut | None]] = []
    last: list[Cut] = []
    for p, ((names, size), flows) in enumerate(zip(patterns, routes, strict=True)):
        place, mark = 0, None
        for s in names:
            left = flows.get(s, 0)
            while left:
                step = min(left, size - place)
                left, place = left - step, place + step
                ahead = None if place == size else Cut(p, place)
                pieces.append((p, s, mark, ahead))
                if ahead:
                    cuts.append(ahead)
                mark, place = ahead, place % size
        if mark is not None:
            last.append(mark)
    _find(sized, cuts)
    extra = _fill(sized, last)
    ranges: list[list[tuple]] = [[] for _ in patterns]
    for p, s, start, end in pieces:
        ranges[p].append((s, start.low if start else 0, end.low if end else 1 << HASH_BITS))
        if end is not None and end is last_of(last, p) and p in extra:
            ranges[p].append((s, extra[p], extra[p] + 1))
    return ranges


def last_of(cuts: list[Cut], pattern: int) -> Cut | None:
    return next((c for c in cuts if c.pattern == pattern), None)


def mix(
    docs: DataFrame,
    sources: Column,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
    whole: bool = True,
) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with what the mix takes of each, and the prefix of the added columns.

    ``sources`` is an array of the sources that a document belongs to. Added are ``size``,
    ``routed`` (the source of each copy taken) and ``quotas`` (source, source_size and target of
    each of its sources). Without ``whole`` the rows have doc_id and those only, and texts are not
    read again.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "mixing")
    x = "mix_"
    while any(c.lower().startswith(x) for c in docs.columns):
        x = "_" + x
    members = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    # One string for a pattern, in which a null differs from every name.
    named = F.transform(f"{x}members", lambda m: F.coalesce(F.concat(F.lit("="), m), F.lit("null")))
    keyed = (
        docs.withColumn(f"{x}members", members)
        .withColumn(f"{x}size", words_in(F.col("text")))
        .withColumn(f"{x}name", F.to_json(named))
        .withColumn(
            f"{x}hash",
            F.shiftrightunsigned(
                F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), f"{x}size"), 64 - HASH_BITS
            ),
        )
    )
    added = [f"{x}{c}" for c in ("members", "size", "name", "hash")]
    held = stages.cut(keyed.select("doc_id", *added), "sizes")

    found = held.groupBy(f"{x}members", f"{x}name").agg(F.sum(f"{x}size").alias("size")).collect()
    found.sort(key=lambda r: [(s is None, s or "") for s in r[0]])
    patterns = [(tuple(r[0]), r["size"]) for r in found]
    sizes: dict[str | None, int] = {}
    for names, size in patterns:
        for s in names:
            sizes[s] = sizes.get(s, 0) + size
    targets = source_targets(sizes, weights, most)
    numbers = F.broadcast(
        spark.createDataFrame([(r[1], i) for i, r in enumerate(found)], "name string, pattern int")
    )
    sized = held.join(numbers, F.col(f"{x}name") == F.col("name")).select(
        "pattern", F.col(f"{x}size").alias("size"), F.col(f"{x}hash").alias("hash")
    )
    ranges = _plan(sized, patterns, route(patterns, targets, most))
    quotas = [[(s, sizes[s], float(targets[s])) for s in names] for names, _ in patterns]
    plan = spark.createDataFrame(
        [(r[1], a, b) for r, a, b in zip(found, ranges, quotas, strict=True)],
        f"{x}plan string, {x}ranges array<struct<source string, low long, high long>>, "
        f"{x}quotas array<struct<source string, source_size long, target double>>",
    )
    h = F.col(f"{x}hash")
    taken = F.filter(f"{x}ranges", lambda r: (h >= r["low"]) & (h < r["high"]))
    rows = keyed if whole else held
    routed = rows.join(F.broadcast(plan), F.col(f"{x}name") == F.col(f"{x}plan"))
    return routed.select(
        *(docs.columns if whole else ["doc_id"]),
        f"{x}size",
        F.transform(taken, lambda r: r["source"]).alias(f"{x}routed"),
        f"{x}quotas",
    ), x
