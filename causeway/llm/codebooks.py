"""Vector code compression: each of a vector's parts is named by the nearest entry of the part's codebook.

Codebooks are fitted in rounds. A round broadcasts one kd-tree a codebook (a fixed number of entries, whatever the
input), tasks look up the nearest entries and add up the parts that fell to each, and Spark adds up the tasks' sums.
All is integer arithmetic, so that neither the order of rows nor a task that is run again changes anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 8  # entries of a tree's leaf
LARGEST = 1 << 28  # of an integer component: squared distances over four of them fit in 64 bits
ROWS_AT_ONCE = 4096
SUM_SCHEMA = "part int, entry int, place int, total long, n long"


@dataclass
class Node:
    """A box around entries; a leaf has the entries themselves, in order of their index."""

    low: np.ndarray
    high: np.ndarray
    index: np.ndarray | None = None
    points: np.ndarray | None = None
    below: list[Node] = field(default_factory=list)


def kd_tree(points: np.ndarray, index: np.ndarray | None = None) -> Node:
    """Splits at the median of the widest axis until LEAF entries are left, or only equal ones."""
    index = np.arange(len(points)) if index is None else index
    own = points[index]
    node = Node(own.min(axis=0), own.max(axis=0))
    wide = int((node.high - node.low).argmax())
    if len(index) <= LEAF or node.high[wide] == node.low[wide]:
        node.index = np.sort(index)
        node.points = points[node.index]
        return node
    order = index[np.argsort(own[:, wide], kind="stable")]
    half = len(order) // 2
    node.below = [kd_tree(points, order[:half]), kd_tree(points, order[half:])]
    return node


def _bound(node: Node, x: np.ndarray) -> np.ndarray:
    """Squared distance from each row of ``x`` to the node's box."""
    gap = np.maximum(np.maximum(node.low - x, x - node.high), 0)
    return (gap * gap).sum(axis=1)


def nearest(tree: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row of ``x``, of several the lowest index.

    Branch and bound over all rows at once. A node is left out only if its bound is greater than the distance
    found, so that an entry of equal distance and lower index is still met.
    """
    best = np.full(len(x), np.iinfo(np.int64).max)
    found = np.full(len(x), np.iinfo(np.int64).max)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.index is not None:
            gap = x[rows][:, None, :] - node.points[None]
            d = (gap * gap).sum(axis=2)
            k = d.argmin(axis=1)  # of equal ones the first, which has the lowest index
            d, i = d[np.arange(len(rows)), k], node.index[k]
            better = (d < best[rows]) | ((d == best[rows]) & (i < found[rows]))
            best[rows[better]], found[rows[better]] = d[better], i[better]
            return
        own = x[rows]
        bounds = [_bound(child, own) for child in node.below]
        left_first = bounds[0] <= bounds[1]
        for first, second, mine in ((0, 1, left_first), (1, 0, ~left_first)):
            here = rows[mine]
            visit(node.below[first], here)
            visit(node.below[second], here[bounds[second][mine] <= best[here]])

    visit(tree, np.arange(len(x)))
    return found, best


@dataclass
class Codebooks:
    """For each part its entries, (entries, components of a part)."""

    entries: list[np.ndarray]
    dim: int

    def trees(self) -> list[Node]:
        return [kd_tree(e) for e in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for v in e.reshape(-1)).encode()).hexdigest()


def _whole(batch: pa.RecordBatch, dim: int, scale: int) -> np.ndarray:
    """Integer components of a batch's vectors, (rows, dim)."""
    x = np.floor(batch.column("_v").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component times {scale} is over {LARGEST}, where squared distances leave 64 bits")
    return x.astype(np.int64).reshape(-1, dim)


def _kept(df: DataFrame, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    return df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def _start(kept: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    first = kept.select("_id", "_v").orderBy(F.col("_id").asc_nulls_last(), F.col("_v")).limit(1).toArrow()
    if not first.num_rows:
        return None
    dim = len(first.column("_v")[0])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    rows = kept.where(F.size("_v") == dim).select("_id", "_v").orderBy(F.col("_id").asc_nulls_last(), F.col("_v")).limit(entries).toArrow()
    whole = np.concatenate([_whole(b, dim, scale) for b in rows.to_batches()])
    return Codebooks(list(whole.reshape(len(whole), parts, -1).transpose(1, 0, 2).copy()), dim)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def _next_round(kept: DataFrame, books: Codebooks, parts: int, scale: int) -> Codebooks:
    """Entries replaced by the floored means of the parts nearest to them. What comes back is a row for each part, entry and place."""
    shared, width, dim = kept.sparkSession.sparkContext.broadcast(books.trees()), books.dim // parts, books.dim
    sizes = [len(e) for e in books.entries]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((n, width), np.int64) for n in sizes]
        count = [np.zeros(n, np.int64) for n in sizes]
        seen = 0

        def rows() -> pa.RecordBatch:
            out = [(p, e, j, int(total[p][e, j]), int(count[p][e])) for p, n in enumerate(sizes) for e in range(n) if count[p][e] for j in range(width)]
            columns = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["part", "entry", "place", "total", "n"])

        for batch in _chunks(batches):
            x = _whole(batch, dim, scale)
            if seen + len(x) > 1 << 33:  # sums of LARGEST components still fit
                yield rows()
                seen = 0
                for t, c in zip(total, count):
                    t[:], c[:] = 0, 0
            seen += len(x)
            for p, tree in enumerate(shared.value):
                own = x[:, p * width : (p + 1) * width]
                k, _ = nearest(tree, own)
                np.add.at(total[p], k, own)
                count[p] += np.bincount(k, minlength=sizes[p])
        yield rows()

    added = kept.select("_v").mapInArrow(sums, SUM_SCHEMA).groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    new = [e.copy() for e in books.entries]
    for r in added.collect():  # parts x entries x components of a part
        new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    shared.unpersist()
    return Codebooks(new, dim)


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks that start from the ``entries`` vectors of smallest id and are moved ``rounds`` times over all vectors.

    None where no vector is kept. Vectors that are null, empty, or have null or non-finite components aren't kept. The
    vector of the smallest id sets the number of components; vectors with another number aren't kept either. Null ids
    come last and vectors of equal ids in order of their components. Fewer vectors than ``entries`` give as many entries.
    """
    kept = _kept(vectors, vector_col).select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    books = _start(kept, parts, entries, scale)
    if books:
        same = kept.where(F.size("_v") == books.dim)
        for _ in range(rounds):
            books = _next_round(same, books, parts, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, codes, error) of every vector kept: its parts' entries in order, and the sum of their squared distances.

    Repeated rows stay; without codebooks (no vector kept) or rows the result is empty. Further columns aren't read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"`{id_col}` {kinds[id_col]}, `{label_col}` {kinds[label_col]}, codes array<int>, error long"
    kept = _kept(vectors, vector_col).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_v"))
    if not books:
        return kept.where("false").select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
    shared, dim, parts = vectors.sparkSession.sparkContext.broadcast(books.trees()), books.dim, len(books.entries)
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            x = _whole(batch, dim, scale)
            codes, error = np.zeros((len(x), parts), np.int32), np.zeros(len(x), np.int64)
            for p, tree in enumerate(shared.value):
                codes[:, p], d = nearest(tree, x[:, p * width : (p + 1) * width])
                error += d
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), lists, pa.array(error)], [id_col, label_col, "codes", "error"])

    return kept.where(F.size("_v") == dim).mapInArrow(run, schema)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, codes, error, label_error, codebooks_sha256): ``encode`` with codebooks fitted on the same vectors.

    ``label_error`` is the error summed over all vectors of a label, null labels together. Sums are made before the
    join, which is by the label; Spark splits a label that many vectors have.
    """
    books = fit_codebooks(vectors, id_col, vector_col)
    found = materialise(encode(vectors, books, id_col, vector_col, label_col), "codes")
    sums = found.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = found.join(sums, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")
    return joined.withColumn("codebooks_sha256", F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest()))
