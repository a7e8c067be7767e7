"""Pair scores, and all-candidate scoring by blocks.

Ranking every candidate for every query needs all query-candidate scores, but
never as rows. Candidates are placed in cells around pivots; a query is held only
against the cells whose distance bounds do not already decide the answer. Both sides are
packed into blocks that are written once; partitions of blocks meet as a product read from the
checkpoint, so no row is copied or shuffled for it. A search with excluded candidates deals
rows to a few parts instead, a fixed number of copies, so that an excluded candidate meets its
query where it lies. A task works block by block and emits a count or a short list per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlab.functions import vectors as V
from pairlab.functions.hashing import hash_key
from pairlab.session import truncate_lineage

BLOCK = 2048  # rows of queries and of candidates that are multiplied at once
PARTS = 8  # parts of each side: the copies of a row
PART_BLOCKS = 64  # blocks of a part at most; larger tables have more parts
PACKED = 8192  # rows of a packed block at most, about
FEWEST = 256  # rows of a packed block at least: smaller ones are not worth a task
HELD = 64 << 20  # bytes of packed blocks that a task holds of one side
CELL_TARGET = 8192  # wanted candidates per pivot cell
MAX_PIVOTS = 256  # bound of what is broadcast: MAX_PIVOTS vectors
ONLY = bytearray([128])  # the bit of a single cell
SLACK = 1e-6  # scores this close are recomputed exactly before they are compared


def cosine_pairs(
    pairs: DataFrame,
    a: str,
    b: str,
    vectors: DataFrame,
    metric: str = "cosine",
    out: str = "score",
    left_vectors: DataFrame | None = None,
    width: int | None = None,
) -> DataFrame:
    """Score of each listed pair: two joins on the id and an Arrow-batched kernel.

    ``left_vectors`` (id, v) replaces the vectors of the first side; ``width`` is
    the dimension of sparse vectors.
    """
    first = vectors if left_vectors is None else left_vectors
    left = first.select(F.col("id").alias(a), F.col("v").alias("_va"))
    right = vectors.select(F.col("id").alias(b), F.col("v").alias("_vb"))
    joined = pairs.join(left, a).join(right, b)
    return joined.select(*pairs.columns, V.pair_score_udf(metric, width)("_va", "_vb").alias(out))


def mean_pair_cosine(vectors: DataFrame) -> DataFrame:
    """Mean cosine over all unordered pairs, in one linear pass.

    The sum over all pairs is (|sum of unit vectors|^2 - n) / 2.
    """
    norm = V.l2_norm("v")
    unit = vectors.filter(norm > 0).select(F.posexplode(F.transform("v", lambda x: x / norm)).alias("dim", "x"))
    total = unit.groupBy("dim").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    n = vectors.agg(F.count("*").alias("n"), F.count_if(norm > 0).alias("nz"))
    both = n.withColumn("sq", total.scalar())
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return both.select(
        "n", pairs.cast("bigint").alias("n_pairs"), ((F.col("sq") - F.col("nz")) / 2 / pairs).alias("mean_cosine")
    )


def mean_cosine_per_entity(vectors: DataFrame) -> DataFrame:
    """(id, n_pairs, mean_cosine) over all partners of an entity, in linear time.

    The sum of cosines to everybody is the dot product with the sum of all unit
    vectors (one number per dimension, sent with the plan); the entity's own term
    is taken off.
    """
    norm = V.l2_norm("v")
    unit = vectors.select("id", F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))).alias("u"))
    row = unit.agg(vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("s"), F.count("*").alias("n")).first()
    total, others = F.lit(list(row["s"])), F.lit(row["n"] - 1)
    return unit.select("id", others.alias("n_pairs"), ((V.dot("u", total) - V.dot("u", "u")) / others).alias("mean_cosine"))


# --- cells ---------------------------------------------------------------------


def n_parts(rows: int, block: int) -> int:
    return max(1, min(PARTS, math.ceil(rows / block)), math.ceil(rows / (block * PART_BLOCKS)))


def _part(rows: int, block: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_parts(rows, block))).cast("int")


class Cells:
    """Pivots and per-cell size and distance range, all bounded by MAX_PIVOTS."""

    def __init__(self, pivots: np.ndarray, metric: str):
        self.pivots, self.metric = pivots, metric
        self.size = self.near = self.far = None

    def points(self, m: np.ndarray) -> np.ndarray:
        """Coordinates whose Euclidean distance orders the candidates as the metric does.

        A zero vector has cosine 0 to everything: one extra axis of its own.
        """
        if self.metric != "cosine":
            return m
        u = V.unit_rows(m)
        return np.hstack([u, (~u.any(axis=1)).astype(float)[:, None]])

    def distances(self, m: np.ndarray) -> np.ndarray:
        p = self.points(m)
        sq = (p * p).sum(1)[:, None] + (self.pivots**2).sum(1)[None, :] - 2.0 * p @ self.pivots.T
        return np.sqrt(np.maximum(sq, 0.0))

    def threshold(self, score: np.ndarray) -> np.ndarray:
        """Distance at which a candidate has exactly this score."""
        if self.metric == "cosine":
            return np.sqrt(np.maximum(2.0 - 2.0 * score, 0.0))
        return -score

    def bounds(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible distance to a member of each cell."""
        d = self.distances(m)
        slack = 1e-5 * (1.0 + d.max())
        low = np.maximum(d - self.far[None, :], self.near[None, :] - d) - slack
        high = d + self.far[None, :] + slack
        if self.metric == "cosine":
            zero = ~m.any(axis=1)
            low[zero], high[zero] = -np.inf, np.inf
        return low, high


def build_cells(
    candidates: DataFrame, metric: str, pivots: int | None, block: int, width: int | None = None
) -> tuple[Cells, DataFrame]:
    """Cells and the candidates placed in them: (id, v, cell, part).

    A pivot is a candidate with a small id hash. To the driver come the pivots
    and three numbers per cell. Parts are dealt by id, so every cell, also a hot one, is spread over all.
    """
    n = candidates.select("id").count()
    if n == 0:
        raise ValueError("no candidates")
    if pivots is None:
        pivots = min(MAX_PIVOTS, max(1, n // CELL_TARGET))
    cells = Cells(np.zeros((0, 0)), metric)
    if pivots == 1:
        cells.size, cells.near, cells.far = np.array([n]), np.array([0.0]), np.array([np.inf])
        return cells, candidates.select("id", "v", F.lit(0).alias("cell"), _part(n, block, "id").alias("part"))
    chosen = candidates.orderBy(hash_key("pivot", F.col("id")), "id").limit(pivots).select("v").toArrow()
    cells.pivots = cells.points(V.arrow_matrix(chosen.column("v"), width))

    @F.arrow_udf("struct<cell:int,dist:double>")
    def place(v: pa.Array) -> pa.Array:
        d = cells.distances(V.arrow_matrix(v, width)) if len(v) else np.zeros((0, pivots))
        c = d.argmin(1)
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()), pa.array(d[np.arange(len(d)), c], pa.float64())], ["cell", "dist"])

    placed = candidates.select("id", "v", place("v").alias("_p")).select("id", "v", F.col("_p.cell").alias("cell"), F.col("_p.dist").alias("_d"))
    placed = truncate_lineage(placed)  # placed once, read by several stages
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("_d").alias("near"), F.max("_d").alias("far")).collect()
    k = chosen.num_rows
    cells.size, cells.near, cells.far = np.zeros(k, dtype=np.int64), np.zeros(k), np.zeros(k)
    for r in stats:
        cells.size[r["cell"]], cells.near[r["cell"]], cells.far[r["cell"]] = r["n"], r["near"], r["far"]
    return cells, placed.select("id", "v", "cell", _part(n, block, "id").alias("part"))


def _routes(queries: DataFrame, cells: Cells, decide, width: int | None, keep: bool = False) -> DataFrame:
    """Add ``cells``: a bit for each cell that a query has to visit (``decide`` picks them); rows without any are dropped unless ``keep``."""

    @F.arrow_udf("binary")
    def route(v: pa.Array, limit: pa.Array, home: pa.Array) -> pa.Array:
        if len(v) == 0:
            return pa.array([], pa.binary())
        low, high = cells.bounds(V.arrow_matrix(v, width))
        visit = decide(low, high, limit.to_numpy(zero_copy_only=False).astype(np.float64), home.to_numpy(zero_copy_only=False)) & (cells.size > 0)[None, :]
        return _bits(visit, keep)

    routed = queries.withColumn("cells", route("v", "limit", "home"))
    return routed if keep else routed.filter("cells is not null")


def _bits(visit: np.ndarray, keep: bool = False) -> pa.Array:
    packed, some = np.packbits(visit, axis=1), visit.any(1) | keep
    return pa.array([row.tobytes() if ok else None for row, ok in zip(packed, some, strict=True)], pa.binary())


def _grid(routed: DataFrame, placed: DataFrame, n_queries: int, n_candidates: int, block: int, keys: Sequence[str], columns: Sequence[str], skips: DataFrame | None = None):
    """Every part of the queries with every part of the candidates.

    ``keys`` spread the query rows over parts, also when one query has many rows.
    ``skips`` rows go straight to the part of their candidate.
    """
    across, down = n_parts(n_queries, block), n_parts(n_candidates, block)
    qb = _part(n_queries, block, *keys).alias("qb")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = ["part", "qb"]
    q = routed.select(every(down).alias("part"), qb, *columns)
    if skips is not None:
        q = q.unionByName(skips.select("part", qb, *columns))
    c = placed.select(F.col("part").alias("c_part"), every(across).alias("c_qb"), F.col("cell").alias("c_cell"), F.col("id").alias("c_id"), F.col("v").alias("c_v"))
    return q.groupBy(*at).cogroup(c.groupBy(*[f"c_{x}" for x in at]))


def packed_blocks(rows: DataFrame, n: int, *keys: str, size: int | None = None) -> DataFrame:
    """(block, rows): one row for each block, dealt by the hash of ``keys`` and written once; ``rows`` is an Arrow stream of them."""
    slots = rows.sparkSession.sparkContext.defaultParallelism
    size = size or min(PACKED, max(FEWEST, math.ceil(n / math.ceil(math.sqrt(3 * slots)))))
    blocks = max(1, math.ceil(n / size))

    def pack(t: pa.Table) -> pa.Table:
        sink, body = pa.BufferOutputStream(), t.drop_columns(["block"]).combine_chunks()
        with pa.ipc.new_stream(sink, body.schema) as out:
            out.write_table(body)
        return pa.table({"block": t.column("block")[:1], "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    return truncate_lineage(dealt.groupBy("block").applyInArrow(pack, "block int, rows binary"))


def _unpack(rows: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(rows.as_buffer()).read_all()


def _unpacked(packed: DataFrame, columns: Sequence[str], schema: str) -> DataFrame:
    """Some columns of the packed rows again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.column("rows"):
                yield from _unpack(rows).select(columns).to_batches()

    return packed.select("rows").mapInArrow(read, schema)


def add_up(*columns: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Merge of two results with the same rows in the same order: these columns are summed."""

    def merge(x: pa.Table, y: pa.Table) -> pa.Table:
        for c in columns:
            x = x.set_column(x.schema.get_field_index(c), c, pc.add(x.column(c), y.column(c)))
        return x

    return merge


def best_of(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Merge of two lists (query_id, id, score): the k highest scores of each query stay, of equal ones the smaller ids."""

    def merge(x: pa.Table, y: pa.Table) -> pa.Table:
        t = pa.concat_tables([x, y]).sort_by([("query_id", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
        q = _column(t, "query_id")
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        return t.filter(pa.array(place < k))

    return merge


def block_product(
    queries: DataFrame, candidates: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, merge: Callable[[pa.Table, pa.Table], pa.Table]
) -> DataFrame:
    """``kernel`` on each packed block of queries with all candidates: partitions meet as a product read from the
    checkpoints, where rows lie once. A task holds its queries and reads the candidates piece by piece; ``merge`` joins
    the results of the pieces, so that a query leaves a task once. Candidates have more than one partition only as far
    as the query partitions are too few for the slots: what leaves the tasks grows with the queries alone."""
    wanted = 3 * queries.sparkSession.sparkContext.defaultParallelism

    def facts(packed: DataFrame) -> tuple[int, int]:
        r = packed.agg(F.count("*").alias("n"), F.sum(F.length("rows")).alias("bytes")).first()
        return max(1, r["n"]), r["bytes"] or 0

    (n_q, q_bytes), (n_c, _) = facts(queries), facts(candidates)
    held = min(n_q, max(math.ceil(q_bytes / HELD), math.ceil(math.sqrt(wanted))))
    read = min(n_c, math.ceil(wanted / held))
    # the left side of the product is read row by row, the right one is kept
    met = candidates.coalesce(read).select(F.col("rows").alias("c_rows")).crossJoin(queries.coalesce(held).select("block", "rows").hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done, piece, size = {}, {}, [], 0

        def meet() -> None:
            c = pa.concat_tables([_unpack(x) for x in piece])
            for block, q in own.items():
                found = kernel(_unpack(q), c)
                done[block] = merge(done[block], found) if block in done else found

        for b in batches:
            for block, rows, c_rows in zip(b.column("block").to_pylist(), b.column("rows"), b.column("c_rows"), strict=True):
                if block == next(iter(own), block):  # the next block of candidates begins
                    if size >= HELD:
                        meet()
                        piece, size = [], 0
                    piece.append(pa.scalar(c_rows.as_py(), pa.binary()))  # a copy: not a part of the batch
                    size += len(piece[-1].as_buffer())
                if block not in own:
                    own[block] = pa.scalar(rows.as_py(), pa.binary())
        if piece:
            meet()
        for found in done.values():
            yield from found.combine_chunks().to_batches()

    return met.select("block", "rows", "c_rows").mapInArrow(run, schema)


def _as_candidates(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("cell").alias("c_cell"), F.col("id").alias("c_id"), F.col("v").alias("c_v"))


class Side:
    """The vectors of an Arrow column, taken by row number."""

    def __init__(self, column: pa.ChunkedArray, width: int | None) -> None:
        self.column, self.width = column, width
        self.dense = V.arrow_matrix(column) if width is None else None

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Sparse vectors are made dense block by block."""
        return self.dense[at] if self.width is None else V.arrow_matrix(self.column.take(pa.array(at)), self.width)


def _blocks(cells: pa.ChunkedArray, c: pa.Table, n_cells: int, block: int):
    """(query rows, [(candidate rows, which of the query rows visit them)]) block by block."""
    cell = c.column("c_cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1, [len(order)]])
    pieces = [(int(cell[order[a]]), order[x : min(x + block, b)]) for a, b in zip(edges[:-1], edges[1:], strict=True) for x in range(a, b, block)]
    for at in range(0, len(cells), block):
        bits = np.frombuffer(b"".join(cells.slice(at, block).to_pylist()), np.uint8).reshape(-1, -(-n_cells // 8))
        visit = np.unpackbits(bits, axis=1, count=n_cells).astype(bool)
        yield np.arange(at, at + len(visit)), [(rows, np.flatnonzero(visit[:, k])) for k, rows in pieces if visit[:, k].any()]


def _scores(qm: np.ndarray, cm: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Fast scores of a block, and how far they may be off."""
    if metric == "cosine":
        return V.unit_rows(qm) @ V.unit_rows(cm).T, SLACK
    q2, c2 = (qm * qm).sum(1), (cm * cm).sum(1)
    sq = q2[:, None] + c2[None, :] - 2.0 * qm @ cm.T
    return -np.sqrt(np.maximum(sq, 0.0)), SLACK * max(1.0, math.sqrt(q2.max()), math.sqrt(c2.max()))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


# --- ranks ---------------------------------------------------------------------


def rank_targets(
    queries: DataFrame,
    vectors: DataFrame,
    metric: str = "cosine",
    block: int = BLOCK,
    pivots: int | None = None,
    query_vectors: DataFrame | None = None,
    width: int | None = None,
) -> DataFrame:
    """Add ``score`` and ``rank`` of the target among all other entities.

    ``queries`` has query_id and target_id (both with a vector); ``query_vectors``
    (id, v) replaces the vectors the queries are scored with. rank = 1 + better
    candidates + equal candidates with a smaller id; the query itself never counts.
    No candidate is skipped: a cell is left out only when its bounds prove that all
    or none of its members beat the target.
    """
    vectors = vectors.select("id", "v")
    queries = truncate_lineage(queries)  # read for the count, the search and the result
    wanted = queries.select("query_id", "target_id").filter("query_id <> target_id").distinct()
    cells, placed = build_cells(vectors, metric, pivots, block, width)
    n_c, n_cells = int(cells.size.sum()), len(cells.size)
    left = placed.select(F.col("id").alias("query_id"), "v", F.col("cell").alias("home"))
    if query_vectors is not None:
        left = left.drop("v").join(query_vectors.select(F.col("id").alias("query_id"), "v"), "query_id")
    right = vectors.select(F.col("id").alias("target_id"), F.col("v").alias("_vb"))
    score = V.pair_score_udf(metric, width)("v", "_vb").alias("limit")
    q = wanted.join(left, "query_id").join(right, "target_id").select("query_id", "target_id", "home", "v", score)

    def decide(low, high, limit, _home):
        t = cells.threshold(limit)[:, None]
        return (low <= t) & (high >= t)  # some members may beat the target, some may not

    @F.arrow_udf("long")
    def sure_wins(v: pa.Array, limit: pa.Array, home: pa.Array) -> pa.Array:
        if len(v) == 0:
            return pa.array([], pa.int64())
        _, high = cells.bounds(V.arrow_matrix(v, width))
        win = high < cells.threshold(limit.to_numpy(zero_copy_only=False))[:, None]
        own = win[np.arange(len(v)), home.to_numpy(zero_copy_only=False)]
        return pa.array((win * cells.size[None, :]).sum(1) - own, pa.int64())

    pair = ["query_id", "target_id"]
    if n_cells == 1:
        routed = q.withColumns({"cells": F.lit(ONLY), "beats": F.lit(0).cast("long")})
    else:
        routed = _routes(q, cells, decide, width, keep=True).withColumn("beats", sure_wins("v", "limit", "home"))
    packed = packed_blocks(routed.select(*pair, F.col("limit").alias("score"), "beats", "v", "cells"), wanted.count(), *pair)
    id_type = placed.schema["id"].dataType.simpleString()
    schema = f"query_id {id_type}, target_id {id_type}, score double, beats long"

    def kernel(q: pa.Table, c: pa.Table) -> pa.Table:
        beats = np.zeros(q.num_rows, np.int64)
        if q.num_rows and c.num_rows:
            qs, cs = Side(q.column("v"), width), Side(c.column("c_v"), width)
            score, c_ids, q_ids, t_ids = _column(q, "score"), _column(c, "c_id"), _column(q, "query_id"), _column(q, "target_id")
            for some, visits in _blocks(q.column("cells"), c, n_cells, block):
                block_m = qs.rows(some)
                for rows, which in visits:
                    qm, cm, cid = block_m[which], cs.rows(rows), c_ids[rows]
                    t, qid, tid = score[some[which]], q_ids[some[which]], t_ids[some[which]]
                    s, reach = _scores(qm, cm, metric)
                    i, j = np.nonzero(np.abs(s - t[:, None]) <= reach)
                    s[i, j] = V.pair_score(qm[i], cm[j], metric)  # near the threshold only the exact score counts
                    s[qid[:, None] == cid[None, :]] = -np.inf
                    equal = s[i, j] == t[i]
                    beats[some[which]] += (s > t[:, None]).sum(1) + np.bincount(i[equal & (cid[j] < tid[i])], minlength=len(which))
        return pa.table({**{x: q.column(x) for x in (*pair, "score")}, "beats": pa.array(beats, pa.int64())})

    counted = block_product(packed, packed_blocks(_as_candidates(placed), n_c, "c_cell", "c_id"), kernel, schema, add_up("beats"))
    counted = counted.unionByName(_unpacked(packed, [*pair, "score", "beats"], schema))
    ranks = counted.groupBy(*pair).agg(F.first("score").alias("score"), (F.sum("beats") + 1).alias("rank"))
    return queries.join(truncate_lineage(ranks), pair)  # counted once, however often the ranks are read


# --- nearest neighbours --------------------------------------------------------


def top_neighbors(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    exclude: DataFrame | None = None,
    block: int = BLOCK,
    pivots: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): the k nearest candidates of each query, self excluded.

    ``exclude`` (query_id, id) lists candidates that must not be returned, any
    number per query; the list is sent to the blocks that hold the candidates.
    """
    vectors = vectors.select("id", "v")
    cells, placed = build_cells(vectors, metric, pivots, block, width)
    ids = queries.select("query_id").distinct()
    q = ids.join(vectors.select(F.col("id").alias("query_id"), "v"), "query_id")
    n_q = ids.count()
    id_type = placed.schema["id"].dataType.simpleString()
    schema = f"query_id {id_type}, id {id_type}, score double"
    query_cols = ["query_id", "v", "cells", "skip"]
    n_cells, n_c = len(cells.size), int(cells.size.sum())

    skips = None
    if exclude is not None:
        where = placed.select("id", "part")
        hidden = exclude.select("query_id", "id").join(ids, "query_id", "left_semi").join(where, "id")
        skips = hidden.withColumns(
            {"v": F.lit(None).cast(placed.schema["v"].dataType), "cells": F.lit(None).cast("binary"), "skip": F.col("id")}
        )

    def kernel(q: pa.Table, c: pa.Table) -> pa.Table:
        is_query = np.asarray(q.column("skip").is_null())
        qt, st = q.filter(pa.array(is_query)), q.filter(pa.array(~is_query))
        found = []
        if qt.num_rows and c.num_rows:
            q_ids, c_ids = _column(qt, "query_id"), _column(c, "c_id")
            qs, cs = Side(qt.column("v"), width), Side(c.column("c_v"), width)
            at_q = {x: i for i, x in enumerate(q_ids.tolist())} if st.num_rows else {}
            at_c = {x: i for i, x in enumerate(c_ids.tolist())} if st.num_rows else {}
            listed = zip(st.column("query_id").to_pylist(), st.column("skip").to_pylist(), strict=True)
            listed = np.array(sorted((at_q[a], at_c[b]) for a, b in listed if a in at_q and b in at_c), np.int64).reshape(-1, 2)
            place = np.full(c.num_rows, -1)  # where a candidate stands in the block at hand
            for some, visits in _blocks(qt.column("cells"), c, n_cells, block):
                block_m = qs.rows(some)
                floor = np.full(len(some), -1e300)  # no k-th score is less, so far
                best = []
                mine = listed[np.searchsorted(listed[:, 0], some[0]) : np.searchsorted(listed[:, 0], some[-1], "right")]
                for rows, which in visits:
                    qm, cm, cid = block_m[which], cs.rows(rows), c_ids[rows]
                    s, reach = _scores(qm, cm, metric)
                    s[q_ids[some[which]][:, None] == cid[None, :]] = -np.inf
                    if len(mine):
                        place[rows] = np.arange(len(rows))
                        line = np.full(len(some), -1)
                        line[which] = np.arange(len(which))
                        a, b = line[mine[:, 0] - some[0]], place[mine[:, 1]]
                        here = (a >= 0) & (b >= 0)
                        s[a[here], b[here]] = -np.inf
                        place[rows] = -1
                    if s.shape[1] >= k:
                        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                        floor[which] = np.maximum(floor[which], kth - reach)
                    # keep everything that could tie with the k-th, rescored exactly
                    i, j = np.nonzero(s >= np.maximum(floor[which] - reach, -1e300)[:, None])
                    best.append((which[i], rows[j], V.pair_score(qm[i], cm[j], metric)))
                if best:
                    i, j, exact = (np.concatenate(x) for x in zip(*best, strict=True))
                    order = np.lexsort((c_ids[j], -exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
                    keep = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
                    found.append((some[i[keep]], j[keep], exact[keep]))
        i, j, exact = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(
            {"query_id": qt.column("query_id").take(pa.array(i)), "id": c.column("c_id").take(pa.array(j)), "score": pa.array(exact, pa.float64())}
        )

    across = None if skips is not None else packed_blocks(_as_candidates(placed), n_c, "c_cell", "c_id")

    def search(routed: DataFrame) -> DataFrame:
        side = routed.withColumn("skip", F.lit(None).cast(id_type))
        if skips is None:
            return block_product(packed_blocks(side.select(*query_cols), n_q, "query_id"), across, kernel, schema, best_of(k))
        return _grid(side, placed, n_q, n_c, block, ["query_id"], query_cols, skips).applyInArrow(kernel, schema)

    if n_cells == 1:
        found = search(q.withColumn("cells", F.lit(ONLY)))
    else:
        # first the home cell, for a lower bound of the k-th score; then only the
        # cells that can still hold something nearer
        at_home = q.join(placed.select(F.col("id").alias("query_id"), F.col("cell").alias("home")), "query_id")

        @F.arrow_udf("binary")
        def bit(home: pa.Array) -> pa.Array:
            return _bits(np.arange(n_cells)[None, :] == home.to_numpy(zero_copy_only=False)[:, None])

        first = search(at_home.withColumn("cells", bit("home")))
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
        first = truncate_lineage(first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k))  # read for the bound and for the result
        limit = first.filter(F.col("_r") == k).select("query_id", F.col("score").alias("limit"))

        def decide(low, _high, lim, home):
            t = np.where(np.isnan(lim), np.inf, cells.threshold(np.where(np.isnan(lim), 0.0, lim)))
            return (low <= t[:, None]) & (np.arange(n_cells)[None, :] != home[:, None])

        rest = _routes(at_home.join(limit, "query_id", "left"), cells, decide, width)
        found = first.drop("_r").unionByName(search(rest))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
