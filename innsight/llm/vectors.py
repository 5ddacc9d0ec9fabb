"""Embedding near-duplicates by int8 tile products with error bounds.

Distinct unit vectors are rounded to int8 with a scale of their own; the length of
what rounding lost bounds how far the cosine of two of them can be off. The rounded
vectors of a label are dealt out over tiles of bounded size, and each pair of tiles is
one group of two rows of tiles: their product tells which pairs link for sure, which
never, and which are open. Only the vectors of open pairs are fetched in double
precision, and only these pairs computed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.arrow import map_batches
from innsight.llm.components import connected_components
from innsight.sources.scratch import stage_table

THRESHOLD = 0.98
TILE = 4096  # vectors, on average
_ROWS = 512  # of a product at once
_SLACK = 1e-6  # for rounding in the bounds themselves
_CHECKED = 1 << 15  # open pairs computed at once
ANSWER = "node long, links long, root long, low int, high int"

Rounded = tuple[np.ndarray, np.ndarray, np.ndarray]  # int8 vectors, scales, lengths lost


def units(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that no square overflows
    unit = x / np.abs(x).max(1, keepdims=True)
    return unit / np.sqrt((unit * unit).sum(1, keepdims=True))


def quantised(unit: np.ndarray) -> Rounded:
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1))
    return q, scale, lost


def pairs_of(
    left: Rounded, right: Rounded, threshold: float, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indexes of pairs of rows that may reach the threshold, and whether they do for sure;
    a block of rows at a time. With ``same`` the tiles are one and a pair comes once."""
    q_l, scale_l, lost_l = left
    q_r, scale_r, lost_r = right
    # products of int8 numbers sum exactly in single precision up to this width
    exact = np.float32 if q_l.shape[1] * 127 * 127 < 1 << 24 else np.float64
    turned = np.ascontiguousarray(q_r.T, dtype=exact)
    for at in range(0, len(q_l), _ROWS):
        some = slice(at, at + _ROWS)
        cosine = (q_l[some].astype(exact) @ turned) * scale_l[some, None] * scale_r
        off = lost_l[some, None] + lost_r + lost_l[some, None] * lost_r + _SLACK
        i, j = np.nonzero(cosine + off >= threshold)
        sure = (cosine - off)[i, j] >= threshold
        i += at
        if same:
            once = i < j
            i, j, sure = i[once], j[once], sure[once]
        yield i, j, sure


def joined_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each place is connected with, when links come to those that
    have led to ``root``."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(root, root[root]):
            root = root[root]


class Links:
    """Weighted numbers of links, and a forest that connects what they do."""

    def __init__(self, nodes: np.ndarray, times: np.ndarray):
        order = np.argsort(nodes)  # the least place is then the least node
        self.place = np.empty_like(order)
        self.place[order] = np.arange(len(order))
        self.nodes, self.times = nodes[order], times[order]
        self.links = np.zeros(len(nodes), np.int64)
        self.root = np.arange(len(nodes))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.place[i], self.place[j]
        np.add.at(self.links, i, self.times[j])
        np.add.at(self.links, j, self.times[i])
        self.root = joined_roots(self.root, i, j)

    def answer(self, open_nodes: np.ndarray) -> pa.Table:
        linked = self.links > 0
        whole = _answer(self.nodes[linked], self.links[linked], self.nodes[self.root][linked])
        return pa.concat_tables([whole, _answer(open_nodes, None, None)])


def _tiles(table: pa.Table, columns: Callable) -> tuple[list, bool] | None:
    """What ``columns`` makes of the vectors of each of the two tiles of a group, or of the
    one; None if one of two is not there."""
    parts = {}
    for row in range(table.num_rows):
        vectors = table["vectors"][row].values
        parts[table["tile"][row].as_py()] = columns(vectors, table["dim"][row].as_py())
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    if low not in parts or high not in parts:
        return None
    return ([parts[low]], True) if low == high else ([parts[low], parts[high]], False)


def _rounded(vectors: pa.StructArray, dim: int):
    q = np.frombuffer(b"".join(vectors.field("q").to_pylist()), np.int8).reshape(-1, dim)
    numbers = [vectors.field(c).to_numpy() for c in ("scale", "lost", "node", "times")]
    return (q, *numbers[:2]), *numbers[2:], vectors


def _round_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, q, scale, lost) of (node, dim, embedding)."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(dims) - dims
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            q, scale, lost = quantised(units(flat[starts[rows, None] + np.arange(dim)]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").take(pa.array(rows)),
                    pa.array([x.tobytes() for x in q], pa.binary()),
                    pa.array(scale),
                    pa.array(lost),
                ],
                ["node", "q", "scale", "lost"],
            )


def _first(threshold: float):
    """Sure links of a pair of tiles, and the vectors of open pairs (links null)."""

    def run(table: pa.Table) -> pa.Table:
        found = _tiles(table, _rounded)
        if found is None:
            return _answer([], [], [])
        tiles, same = found
        (left, nodes, times, _), (right, *_) = tiles[0], tiles[-1]
        shift = 0 if same else len(nodes)
        if not same:
            nodes, times = (np.concatenate([t[k] for t in tiles]) for k in (1, 2))
        links, is_open = Links(nodes, times), np.zeros(len(nodes), bool)
        for i, j, sure in pairs_of(left, right, threshold, same):
            j = j + shift
            links.add(i[sure], j[sure])
            is_open[i[~sure]] = is_open[j[~sure]] = True
        return links.answer(nodes[is_open])

    return run


def _second(threshold: float):
    """Links of the open pairs among the vectors that a pair of tiles has left open."""

    def columns(vectors: pa.StructArray, dim: int):
        x = vectors.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return (*_rounded(vectors, dim)[:3], units(x.reshape(-1, dim)))

    def run(table: pa.Table) -> pa.Table:
        found = _tiles(table, columns)
        if found is None:
            return _answer([], [], [])
        tiles, same = found
        (left, nodes, times, unit_l), (right, _, _, unit_r) = tiles[0], tiles[-1]
        shift = 0 if same else len(nodes)
        if not same:
            nodes, times = (np.concatenate([t[k] for t in tiles]) for k in (1, 2))
        links = Links(nodes, times)
        for i, j, sure in pairs_of(left, right, threshold, same):
            i, j = i[~sure], j[~sure]
            for at in range(0, len(i), _CHECKED):
                a, b = i[at : at + _CHECKED], j[at : at + _CHECKED]
                near = np.einsum("nd,nd->n", unit_l[a], unit_r[b]) >= threshold
                links.add(a[near], b[near] + shift)
        return links.answer(nodes[:0])

    return run


def _answer(node, links, root) -> pa.Table:
    none = pa.nulls(len(node), pa.int64())
    return pa.table(
        {
            "node": pa.array(node, pa.int64()),
            "links": none if links is None else pa.array(links, pa.int64()),
            "root": none if root is None else pa.array(root, pa.int64()),
        }
    )


def _by_pair(met: DataFrame, group: list[str], run: Callable) -> DataFrame:
    """``run`` on each pair of tiles; its answer with the numbers of the two."""

    def named(key, table):
        made = run(table)
        for name in ("low", "high"):
            number = table[name][0].as_py()
            made = made.append_column(name, pa.array([number] * made.num_rows, pa.int32()))
        return made

    return met.groupBy(*group).applyInArrow(named, ANSWER)


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    tile: int = TILE,
) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links (other vectors of equal
    label with a cosine of ``threshold`` or more), component_id (smallest vec_id
    that links reach, the own one included), kept (vec_id = component_id).

    Rows with a null id or label, and vectors that are null, empty, zero or hold
    null or non-finite components link with nothing; a null id has a null
    component and is not kept. Vectors of different length are never compared.
    Equal vectors are compared once, with their number as weight, and repeated rows
    count as vectors of their own. Extra columns do not matter.
    """
    own = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(embedding).cast("array<double>").alias("embedding"),
        F.col(label).alias("label"),
    )
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    able = F.coalesce(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & ~F.exists("embedding", infinite)
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    marked = own.withColumn("able", able)
    known = marked.where("able").withColumn("hash", F.xxhash64("label", "embedding"))
    key = ["hash", "label", "embedding"]
    classes = known.groupBy(*key).agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times")
    )
    # once written, the numbers are the same for every reader
    classes = stage_table(
        classes.select(
            F.monotonically_increasing_id().alias("node"),
            *key,
            F.size("embedding").alias("dim"),
            "least",
            "times",
        ),
        "vector_classes",
    )
    sizes = classes.groupBy("label", "dim").agg(
        F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")
    )
    rounded = map_batches(
        classes.select("node", "dim", "embedding"), _round_vectors, "node long, q binary, scale double, lost double"
    )
    dealt = stage_table(
        classes.drop("embedding", "least")
        .join(rounded, "node")
        .join(sizes, ["label", "dim"])
        .withColumn("tile", F.pmod("hash", F.col("tiles")).cast("int"))
        .drop("hash"),
        "vector_tiles",
    )
    group = ["label", "dim", "low", "high"]
    low, high = F.least("tile", "met").alias("low"), F.greatest("tile", "met").alias("high")
    met = (
        dealt.groupBy("label", "dim", "tiles", "tile")
        # of a tile, whose size the number of tiles bounds
        .agg(F.collect_list(F.struct("node", "times", "q", "scale", "lost")).alias("vectors"))
        .withColumn("met", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("label", "dim", low, high, "tile", "vectors")
    )
    first = stage_table(_by_pair(met, group, _first(threshold)), "vector_links")
    unsettled = first.where("links is null").select("node", "low", "high")
    fetched = (
        unsettled.join(dealt.drop("tiles"), "node")
        .join(classes.select("node", "embedding"), "node")
        .groupBy(*group, "tile")
        .agg(F.collect_list(F.struct("node", "times", "q", "scale", "lost", "embedding")).alias("vectors"))
    )
    second = stage_table(_by_pair(fetched, group, _second(threshold)), "vector_links")
    pairs = first.where("links is not null").unionByName(second).select("node", "links", "root")
    counts = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(pairs, "node", "root")
    settled = (
        classes.join(counts, "node", "left")
        .join(roots, "node", "left")
        .select(
            *key,
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    ids = settled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settled.join(ids, "root").select(*key, "n_links", "component_id")
    linked = known.join(named, key).select("vec_id", "n_links", "component_id")
    alone = marked.where("not able").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
