"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Vectors of a label are dealt to shards of about ``SHARD`` by the hash of their id; a graph is built
for each shard and every shard is searched for the vectors of every shard of its label, each two
shards once. Beams start at ``BEAM`` and are doubled, with more places to start from, for queries
whose beam is full of links, and for all queries while an audit of ``AUDIT`` of them against brute
force misses a link. Cosines of what is found are verified in double precision. A task returns
counts and a spanning forest of its links, never the links themselves; components are united over
the forests.

Vectors that are null, zero or hold null or non-finite components, and null labels, link with
nothing. Equal vectors of a label are one member that weighs as many. Rows that repeat vec_id, label
and vector are one vector; a null vec_id links with nothing and has a null component. Vectors of
different lengths never link. Other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgetrail.llm.common import Stages
from nudgetrail.llm.components import components
from nudgetrail.llm.words import U64, mix

SIMILAR = 0.98
SHARD = 2048
DEGREE = 16  # links of a node in upper layers, half of those in the lowest
BEAM, BUILD_BEAM, AUDIT, AT_ONCE = 32, 48, 64, 4
SLACK = 1e-4  # single precision in the search, double afterwards


class Graph:
    """Layers of neighbour lists over unit vectors; -1 fills short lists."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        draw = ((mix(ids.astype(U64), 41) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        self.level = np.minimum((-np.log(draw) / np.log(DEGREE)).astype(int), 8)
        order = np.argsort(-self.level, kind="stable")  # upper layers first
        self.entry = int(order[0]) if n else 0
        top = int(self.level.max(initial=0))
        self.layers = [
            np.full((n, 2 * DEGREE if x == 0 else DEGREE), -1, dtype=np.int32)
            for x in range(top + 1)
        ]
        done = 0
        while done < n:
            batch = order[done : done + max(16, min(256, done))]
            self._insert(batch, order[:done])
            done += len(batch)

    def _insert(self, batch: np.ndarray, known: np.ndarray) -> None:
        """Links a batch to what its search of the graph finds, and to each other."""
        at = np.full(len(batch), self.entry)
        among = self.vectors[batch] @ self.vectors[batch].T
        np.fill_diagonal(among, -2)
        for x in range(len(self.layers) - 1, -1, -1):
            lists = self.layers[x]
            inside = np.flatnonzero(self.level[batch] >= x)
            if len(known) and (lists[self.entry] >= 0).any():
                found, near = self._beam(self.vectors[batch], at[:, None], x, BUILD_BEAM)
                at = found[:, 0]
            else:
                found = np.full((len(batch), 1), self.entry if len(known) else -1)
                near = np.where(found >= 0, self.vectors[batch] @ self.vectors[self.entry][:, None], -2.0)
            for i in inside.tolist():
                mates = inside[np.argsort(-among[i][inside])[: lists.shape[1]]]
                other = np.concatenate([found[i], batch[mates]])
                sims = np.concatenate([near[i], among[i][mates]])
                keep = (other >= 0) & (other != batch[i]) & (sims > -1.5)
                chosen = self._choose(other[keep], sims[keep], lists.shape[1] // 2)
                lists[batch[i], : len(chosen)] = chosen
                for j in chosen.tolist():
                    self._add(lists, j, int(batch[i]))

    def _choose(self, other: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """The nearest, but first those that no nearer one stands before."""
        other, first = np.unique(other, return_index=True)
        order = np.argsort(-sims[first], kind="stable")
        other, sims = other[order], sims[first][order]
        if len(other) <= most:
            return other
        among = self.vectors[other] @ self.vectors[other].T
        apart: list[int] = []
        for i in range(len(other)):
            if len(apart) == most:
                break
            if not apart or among[i, apart].max() < sims[i]:
                apart.append(i)
        rest = [i for i in range(len(other)) if i not in apart]
        return other[apart + rest[: most - len(apart)]]

    def _add(self, lists: np.ndarray, node: int, new: int) -> None:
        row = lists[node]
        if new in row:
            return
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = new
            return
        other = np.append(row, new)
        kept = self._choose(other, self.vectors[other] @ self.vectors[node], len(row) - 2)
        row[:] = -1
        row[: len(kept)] = kept

    def _beam(
        self, query: np.ndarray, start: np.ndarray, layer: int, beam: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of each query's beam, nearest first; all queries step together."""
        lists, n, q = self.layers[layer], len(self.vectors), len(query)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), dtype=bool)
        seen[:, n] = True  # stands for no node
        nodes = np.full((q, beam), n, dtype=np.int64)
        sims = np.full((q, beam), -2.0, dtype=np.float32)
        closed = np.ones((q, beam), dtype=bool)
        fresh = np.where(start < 0, n, start).astype(np.int64)
        step = max(AT_ONCE, beam // 32)
        while True:
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
            fresh[seen[rows, fresh]] = n
            seen[rows, fresh] = True
            value = np.full(fresh.shape, -2.0, dtype=np.float32)
            a, b = np.nonzero(fresh < n)
            for part in range(0, len(a), 1 << 16):
                c, d = a[part : part + (1 << 16)], b[part : part + (1 << 16)]
                value[c, d] = np.einsum("ij,ij->i", query[c], self.vectors[fresh[c, d]])
            nodes = np.concatenate([nodes, fresh], axis=1)
            sims = np.concatenate([sims, value], axis=1)
            closed = np.concatenate([closed, fresh == n], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            nodes, sims = np.take_along_axis(nodes, best, 1), np.take_along_axis(sims, best, 1)
            closed = np.take_along_axis(closed, best, 1)
            turn = np.cumsum(~closed, axis=1)
            now = ~closed & (turn <= step)
            if not now.any():
                return np.where(nodes == n, -1, nodes), sims
            closed |= now
            widest = int(now.sum(axis=1).max())
            picked = np.full((q, widest), n, dtype=np.int64)
            a, b = np.nonzero(now)
            picked[a, turn[a, b] - 1] = nodes[a, b]
            near = np.concatenate([lists, np.full((1, lists.shape[1]), -1, np.int32)])[picked]
            fresh = np.where(near < 0, n, near).reshape(q, -1).astype(np.int64)

    def links(self, query: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """For each query the nodes with a cosine of ``least`` or more that its beam finds.

        A beam that is full of them is doubled.
        """
        n = len(self.vectors)
        query = query.astype(np.float32)
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(query)
        todo = np.arange(len(query))
        while len(todo):
            at = np.full(len(todo), self.entry)
            for x in range(len(self.layers) - 1, 0, -1):
                at = self._beam(query[todo], at[:, None], x, 1)[0][:, 0]
            more = np.linspace(0, n - 1, min(n, beam // BEAM)).astype(int)
            start = np.column_stack([at, np.broadcast_to(more, (len(todo), len(more)))])
            again = []
            for part in range(0, len(todo), 256):
                some = todo[part : part + 256]
                nodes, sims = self._beam(query[some], start[part : part + 256], 0, min(beam, n))
                for i, node, sim in zip(some.tolist(), nodes, sims):
                    hit = (sim >= least) & (node >= 0)
                    out[i] = node[hit]
                    if hit.all() and beam < n:
                        again.append(i)
            todo, beam = np.array(again, dtype=np.int64), 2 * beam
        return out


def pack(ids: np.ndarray, weight: np.ndarray, vectors: np.ndarray, graph: Graph) -> bytes:
    head = struct.pack("<5i", len(ids), vectors.shape[1], len(graph.layers), graph.entry, 0)
    arrays = [ids, weight, vectors, *graph.layers]
    return head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    n, d, layers, entry, _ = struct.unpack_from("<5i", data)
    at = 20

    def take(dtype: str, *shape: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, dtype=dtype, count=int(np.prod(shape)), offset=at)
        at += got.nbytes
        return got.reshape(shape)

    ids, weight, vectors = take("<i8", n), take("<i8", n), take("<f8", n, d)
    graph = Graph.__new__(Graph)
    graph.vectors, graph.entry = vectors.astype(np.float32), entry
    graph.layers = [take("<i4", n, 2 * DEGREE if x == 0 else DEGREE) for x in range(layers)]
    return ids, weight, vectors, graph


def pairs_between(left: bytes, right: bytes, same: bool, least: float = SIMILAR) -> np.ndarray:
    """(row of left, row of right) of every verified link; each once where both are the same."""
    _, _, query, _ = unpack(left)
    _, _, vectors, graph = unpack(right)
    checked = np.unique(np.linspace(0, len(query) - 1, min(AUDIT, len(query))).astype(int))
    truth = [np.flatnonzero(vectors @ query[i] >= least) for i in checked]
    beam = BEAM
    while True:
        found = graph.links(query, least - SLACK, beam)
        if beam >= len(vectors) * BEAM or all(
            np.isin(t, found[i]).all() for i, t in zip(checked.tolist(), truth, strict=True)
        ):
            break
        beam *= 2
    a = np.repeat(np.arange(len(query)), [len(x) for x in found])
    b = np.concatenate(found) if found else a
    if same:
        a, b = np.minimum(a, b), np.maximum(a, b)
        code = np.unique(a[a < b] * len(vectors) + b[a < b])
        a, b = code // len(vectors), code % len(vectors)
    keep = [
        np.einsum("ij,ij->i", query[a[p : p + 65536]], vectors[b[p : p + 65536]]) >= least
        for p in range(0, len(a), 65536)
    ]
    keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
    return np.column_stack([a[keep], b[keep]])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links with the smallest node it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _searched(pairs: DataFrame) -> DataFrame:
    """(rep, links, root) over pairs of shards: what each vector weighs in and where it hangs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("left")[i].as_py(), batch.column("right")[i].as_py()
                same = batch.column("same")[i].as_py()
                found = pairs_between(left, right, same)
                if not len(found):
                    continue
                (ids_a, mass_a, *_), (ids_b, mass_b, *_) = unpack(left), unpack(right)
                a, b = ids_a[found[:, 0]], ids_b[found[:, 1]]
                node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                mass = np.concatenate([mass_b[found[:, 1]], mass_a[found[:, 0]]])
                links = np.zeros(len(node), dtype=np.int64)
                np.add.at(links, at, mass)
                _, root = _forest(a, b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(links), pa.array(root)],
                    names=["rep", "links", "root"],
                )

    return pairs.select("left", "right", "same").mapInArrow(run, "rep long, links long, root long")


def linked_vectors(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    stages = Stages(vectors.sparkSession, "hnsw")
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), doubles.alias("embedding")
    )
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    # Squares of very large or small components overflow or vanish: such vectors are scaled first.
    most = F.array_max(F.transform("embedding", F.abs))
    scaled = F.transform("embedding", lambda x: F.try_divide(x, most))
    plain = norm.between(1e-100, 1e100)
    rows = rows.withColumn("embedding", F.when(plain, F.col("embedding")).otherwise(scaled))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull()
        & (norm > 0) & (norm < float("inf"))
    )  # fmt: skip  # a null or non-finite component makes the norm null, NaN or infinite
    name = F.md5(F.concat_ws("|", F.size("embedding"), F.to_json("embedding")))
    rows = rows.withColumn("name", F.when(F.coalesce(usable, F.lit(False)), name))
    members = stages.cut(rows.select("vec_id", "label", "name").distinct(), "members")
    group = ["label", "name"]
    counted = members.where("name IS NOT NULL").groupBy(*group).agg(F.count("*").alias("weight"))
    first = (
        rows.where("name IS NOT NULL")
        .groupBy(*group)
        .agg(F.min(F.struct("vec_id", "embedding")).alias("x"))
    )
    reps = first.join(counted, group).select(
        "label", "name", "weight", F.col("x.vec_id").alias("rep"), "x.embedding",
        F.size("x.embedding").alias("width"),
    )
    reps = stages.cut(reps, "reps")
    sizes = reps.groupBy("label", "width").agg(
        F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("shards")
    )
    dealt = reps.join(stages.cut(sizes, "sizes"), ["label", "width"]).withColumn(
        "shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")
    )

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        ids = table.column("rep").to_numpy()
        unit = np.array(table.column("embedding").to_pylist(), dtype=np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        data = pack(ids, table.column("weight").to_numpy(), unit, Graph(unit, ids))
        one = {x: table.column(x).slice(0, 1) for x in ("label", "width", "shard")}
        return pa.table(one | {"graph": pa.array([data], pa.binary())})

    kind = vectors.schema["label"].dataType.simpleString()
    graphs = dealt.select("label", "width", "shard", "rep", "weight", "embedding")
    graphs = graphs.groupBy("label", "width", "shard").applyInArrow(
        build, f"label {kind}, width int, shard int, graph binary"
    )
    graphs = stages.cut(graphs, "graphs")
    right = graphs.toDF("label", "width", "other", "right")
    pairs = graphs.join(right, ["label", "width"]).where("shard <= other")
    pairs = pairs.select(
        F.col("graph").alias("left"), "right", (F.col("shard") == F.col("other")).alias("same")
    )
    # A task holds two graphs at a time; pairs are dealt evenly whatever their label.
    spread = vectors.sparkSession.sparkContext.defaultParallelism * 4
    found = stages.cut(_searched(pairs.repartition(spread)), "found")
    edges = found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    parts = components(edges, stages).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = reps.select("label", "name", "rep", "weight").join(links, "rep", "left")
    classes = classes.join(parts, "rep", "left").select(
        F.col("label").alias("of"), F.col("name").alias("named"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    classes = stages.cut(classes, "classes")
    stages.drop("graphs", "found", "reps")
    same = (F.col("label") == F.col("of")) & (F.col("name") == F.col("named"))
    return (
        members.join(classes, same, "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
