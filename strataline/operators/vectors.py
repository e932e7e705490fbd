"""Embedding analysis: PCA overall and per source, extremes, direction similarity, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..session import materialise
from .sampling import top_per_group

ALL = "_all"
GRAM_BUFFER_BYTES = 256 << 20  # per Python worker
MODEL_BYTES = 64 << 20  # a PCA model up to this size travels with the tasks

MODEL_SCHEMA = ("grp string, pc bigint, n_rows bigint, explained_ratio double, explained_variance double, "
                "component array<double>, mean array<double>")


def _grouped(df: DataFrame, by: str | None) -> Column:
    return F.col(by).cast("string") if by else F.lit(ALL)


def _matrix(column: pa.Array) -> np.ndarray:
    widths = set(column.value_lengths().to_pylist())
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {sorted(widths)}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


SHIFT_ROWS = 100  # rows whose mean is taken off all vectors before they are multiplied


def _shift(narrow: DataFrame) -> np.ndarray:
    """A vector near the data. Scatter about the mean does not depend on it, but far from zero the difference of
    two large sums would lose the digits that matter."""
    vectors = [r["vec"] for r in narrow.select("vec").head(SHIFT_ROWS)]
    return np.mean([v for v in vectors if len(v) == len(vectors[0])], axis=0) if vectors else np.zeros(0)


def _gram_partials(batches: Iterator[pa.RecordBatch], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per task and group: row count, sum and the upper triangle of X'X of the shifted vectors, one matrix row per record."""
    held: dict[str, tuple[int, np.ndarray, np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for name, (rows, total, gram) in held.items():
            width = len(total)
            yield pa.RecordBatch.from_pydict({
                "grp": [name] * (width + 1),
                "row": list(range(-1, width)),
                "n": [rows] + [0] * width,
                "vec": [total.tolist()] + [gram[i, i:].tolist() for i in range(width)],
            }, schema=pa.schema([("grp", pa.string()), ("row", pa.int64()), ("n", pa.int64()),
                                 ("vec", pa.list_(pa.float64()))]))
        held.clear()

    for batch in batches:
        if batch.num_rows == 0:
            continue
        data = _matrix(batch.column("vec"))
        if data.shape[1] != len(shift):
            raise ValueError(f"vectors of different widths: {sorted({data.shape[1], len(shift)})}")
        data = data - shift
        names = batch.column("grp").dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        for code, name in enumerate(names.dictionary.to_pylist()):
            part = data[codes == code]
            rows, total, gram = len(part), part.sum(axis=0), part.T @ part
            if name in held:
                before = held[name]
                rows, total, gram = rows + before[0], total + before[1], gram + before[2]
            else:
                size += gram.nbytes
            held[name] = (rows, total, gram)
        if size > GRAM_BUFFER_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def _solver(components: int, min_rows: int, spare: int, shift: np.ndarray):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        rows = int(pdf["n"].iloc[0])
        total = np.asarray(pdf["vec"].iloc[0], dtype=np.float64)
        width = len(total)
        columns = ["grp", "pc", "n_rows", "explained_ratio", "explained_variance", "component", "mean"]
        if rows < min_rows:
            return pd.DataFrame(columns=columns)
        gram = np.zeros((width, width))
        for i, vec in enumerate(pdf["vec"].iloc[1:]):
            gram[i, i:] = vec
        gram = np.triu(gram) + np.triu(gram, 1).T
        mean = total / rows
        values, vectors = np.linalg.eigh((gram - rows * np.outer(mean, mean)) / max(rows - 1, 1))
        values = np.clip(values[::-1], 0.0, None)
        kept = min(components, rows - spare, width)
        whole = values.sum()
        records = []
        for pc in range(kept):
            direction = vectors[:, width - 1 - pc]
            if direction[np.abs(direction).argmax()] < 0:
                direction = -direction
            ratio = float(values[pc] / whole) if whole > 0 else 0.0
            records.append([pdf["grp"].iloc[0], pc + 1, rows, ratio, float(values[pc]),
                            direction.tolist(), (mean + shift).tolist()])
        return pd.DataFrame(records, columns=columns)

    return solve


def _fit(df: DataFrame, vector: str, by: str | None, components: int, min_rows: int, spare: int) -> DataFrame:
    """One scan builds X'X per group in the tasks; rows never gather by group.

    What is shuffled is D rows of matrix per task and group, summed by Spark's vector summariser. The
    eigenproblem of a group is D x D, whatever its number of rows. Rows without a vector are left out.
    """
    narrow = df.select(_grouped(df, by).alias("grp"), F.col(vector).alias("vec")).where("vec is not null")
    shift = _shift(narrow)
    partials = narrow.mapInArrow(lambda batches: _gram_partials(batches, shift), "grp string, row bigint, n bigint, vec array<double>")
    # a task emits each matrix row once, so there is nothing to combine before the shuffle
    summed = (partials.repartition("grp", "row").groupBy("grp", "row")
              .agg(Summarizer.sum(array_to_vector("vec")).alias("vec"), F.sum("n").alias("n"))
              .withColumn("vec", vector_to_array("vec")))
    return materialise(summed.groupBy("grp").applyInPandas(_solver(components, min_rows, spare, shift), MODEL_SCHEMA))


def pca_fit(df: DataFrame, vector: str, components: int = 10) -> DataFrame:
    """Mean-centred PCA of all rows, ``min(components, N, D)`` directions.

    One row per direction with its share of the total variance. The sign is fixed by making the
    largest loading positive.
    """
    return _fit(df, vector, None, components, min_rows=1, spare=0)


def pca_by_source(df: DataFrame, vector: str, source: str, components: int = 10) -> DataFrame:
    """PCA of each source with at least three rows, ``min(components, rows - 1)`` directions."""
    return _fit(df, vector, source, components, min_rows=3, spare=1)


def pc1_ranking(model: DataFrame) -> DataFrame:
    """Sources by the share of their first direction."""
    return (model.where(F.col("pc") == 1)
            .select(F.col("grp").alias("source"), (F.col("explained_ratio") * 100).alias("pc1_pct"))
            .orderBy(F.desc("pc1_pct"), "source"))


def scree_table(model: DataFrame) -> DataFrame:
    """Individual and cumulative share per direction, in percent."""
    running = W.partitionBy("grp").orderBy("pc")
    pct = F.col("explained_ratio") * 100
    return model.select("grp", "pc", pct.alias("pct"), F.sum(pct).over(running).alias("cumulative_pct"))


def pca_project(df: DataFrame, model: DataFrame, key: str, vector: str, by: str | None = None) -> DataFrame:
    """(key, grp, pc, score): centred scores of every row on its group's directions.

    A model of a checked size travels to the tasks, which multiply whole batches. A larger one
    (very many groups) is joined; the rows are salted so that one large group spreads. Rows without
    a vector have no scores.
    """
    narrow = df.select(key, _grouped(df, by).alias("grp"), F.col(vector).alias("vec")).where("vec is not null")
    size = model.agg(F.sum(16 * F.size("component"))).first()[0] or 0
    key_type = dict(df.dtypes)[key]
    if size <= MODEL_BYTES:
        return _project_batches(narrow, model, key, key_type)
    return _project_joined(narrow, model, key)


def _project_batches(narrow: DataFrame, model: DataFrame, key: str, key_type: str) -> DataFrame:
    directions: dict[str, list] = {}
    for row in model.select("grp", "pc", "component", "mean").orderBy("grp", "pc").collect():
        directions.setdefault(row["grp"], []).append((row["component"], row["mean"]))
    shared = narrow.sparkSession.sparkContext.broadcast(
        {grp: (np.array([c for c, _ in rows]), np.array(rows[0][1])) for grp, rows in directions.items()})
    arrow_key = narrow.select(key).limit(0).toArrow().schema.field(key).type

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data = _matrix(batch.column("vec"))
            names = batch.column("grp").dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            for code, grp in enumerate(names.dictionary.to_pylist()):
                if grp not in shared.value:
                    continue
                components, mean = shared.value[grp]
                at = np.flatnonzero(codes == code)
                scores = (data[at] - mean) @ components.T
                count = components.shape[0]
                keys = batch.column(key).take(pa.array(np.repeat(at, count)))
                yield pa.RecordBatch.from_arrays([
                    keys.cast(arrow_key), pa.array([grp] * len(keys)),
                    pa.array(np.tile(np.arange(1, count + 1), len(at))), pa.array(scores.ravel())],
                    names=[key, "grp", "pc", "score"])

    return narrow.mapInArrow(project, f"`{key}` {key_type}, grp string, pc bigint, score double")


def _project_joined(narrow: DataFrame, model: DataFrame, key: str, salts: int = 32) -> DataFrame:
    spread = model.select("grp", "pc", "component", "mean",
                          F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = narrow.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    centred = F.zip_with("vec", "mean", lambda x, m: x.cast("double") - m)
    score = F.aggregate(F.zip_with(centred, "component", lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
    return salted.join(spread, ["grp", "_salt"]).select(key, "grp", "pc", score.alias("score"))


def pc_extremes(scores: DataFrame, metadata: DataFrame, key: str, top_k: int = 5) -> DataFrame:
    """The highest and lowest rows along each direction, with their metadata and a 1-based rank."""
    group = ["grp", "pc"]
    high = top_per_group(scores, group, [F.desc("score"), F.col(key)], top_k)
    low = top_per_group(scores, group, [F.asc("score"), F.col(key)], top_k)
    both = (high.withColumn("direction", F.lit("positive"))
            .unionByName(low.withColumn("direction", F.lit("negative"))))
    return both.join(metadata, key).select("grp", "pc", "direction", "rank", "score", key,
                                           *[c for c in metadata.columns if c != key])


def direction_similarity(model: DataFrame, num_pcs: int = 2, owner: str = "") -> DataFrame:
    """Cosine of every pair of the first directions: the cells of the similarity matrix.

    A matrix product as a join on the dimension and a sum: each task sums its own products first.
    """
    label = F.concat(X.shorten_source(F.col("grp"), owner), F.lit(" PC"), F.col("pc").cast("string"))
    cells = (model.where(F.col("pc") <= num_pcs)
             .select(F.col("grp"), F.col("pc"), label.alias("label"),
                     F.posexplode(X.l2_normalize(F.col("component"))).alias("dim", "value")))
    left = cells.select(F.col("grp").alias("grp_a"), F.col("pc").alias("pc_a"), F.col("label").alias("label_a"),
                        "dim", F.col("value").alias("va"))
    right = cells.select(F.col("grp").alias("grp_b"), F.col("pc").alias("pc_b"), F.col("label").alias("label_b"),
                         "dim", F.col("value").alias("vb"))
    return (left.join(right, "dim")
            .groupBy("grp_a", "pc_a", "label_a", "grp_b", "pc_b", "label_b")
            .agg(F.sum(F.col("va") * F.col("vb")).alias("cosine")))


def scatter_points(df: DataFrame, key: str, vector: str, source: str) -> DataFrame:
    """2-D PCA coordinates of every row, with source and colour index.

    For a drawing of fewer points pass what ``subsample`` draws.
    """
    model = pca_fit(df, vector, 2)
    drawn = df.select(key, vector, source)
    scores = pca_project(drawn, model, key, vector)
    xy = (scores.groupBy(key).agg(F.max(F.when(F.col("pc") == 1, F.col("score"))).alias("x"),
                                  F.max(F.when(F.col("pc") == 2, F.col("score"))).alias("y")))
    colours = drawn.agg(F.array_sort(F.collect_set(source))).scalar()  # names of one chart's legend
    return (drawn.select(key, source).join(xy, key)
            .withColumn("colour", F.array_position(colours, F.col(source)) - 1))


def think_vs_response(df: DataFrame, key: str, vector: str, source: str, text_type: str,
                      types: tuple[str, ...] = ("think", "response")) -> DataFrame:
    """Scatter points of both text types, each with its own directions."""
    parts = [scatter_points(df.where(F.col(text_type) == t), key, vector, source).withColumn(text_type, F.lit(t))
             for t in types]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _nearest_in_pair(k: int):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
                others = batch.column("other_ids")[i].values.to_numpy(zero_copy_only=False)
                kind = batch.column("ids").type.value_type
                width = len(batch.column("vecs")[i].values) // len(ids)
                own = np.array(batch.column("vecs")[i].values).reshape(-1, width)
                theirs = np.array(batch.column("other_vecs")[i].values).reshape(-1, width)
                by_id = np.argsort(others)
                others, theirs = others[by_id], theirs[by_id]
                distance = 1.0 - own @ theirs.T
                distance[ids[:, None] == others[None, :]] = np.inf
                take = min(k, len(others))
                edge = np.partition(distance, take - 1, axis=1)[:, take - 1:take]
                closer, tied = distance < edge, distance == edge
                # of the rows at the k-th distance, those with the smallest ids
                room = take - closer.sum(axis=1, keepdims=True)
                row, column = np.nonzero((closer | (tied & (np.cumsum(tied, axis=1) <= room))) & np.isfinite(distance))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[row], kind), pa.array(others[column], kind), pa.array(distance[row, column])],
                    names=["id", "neighbor_id", "distance"])

    return nearest


MAX_PIVOTS = 1024  # cells of the neighbour index; bounds the pivots that travel with the tasks
ANGLE_SLACK = 1e-6  # radians by which rounding may shift an angle near 0 or pi


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _packed(batch: pa.RecordBatch, i: int, column: str, rows: int) -> np.ndarray:
    return np.array(batch.column(column)[i].values, dtype=np.float64).reshape(rows, -1)


def _nearest_cell(pivots: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = _angles(_matrix(batch.column("vec")), pivots)
            cell = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(cell.astype(np.int32)),
                                              pa.array(angle[np.arange(len(cell)), cell])], names=["id", "vec", "cell", "angle"])

    return assign


def _cells_to_visit(k: int, pivots: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray):
    """For each block and cell, the block's rows that may have a neighbour there.

    A row's k-th distance in its own block bounds how far its neighbours are. The members of a cell lie between angles
    ``low`` and ``high`` of its pivot, so by the triangle inequality none is nearer to a row at angle t of that pivot than
    t - high or low - t.
    """
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("ids").type
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                own = _packed(batch, i, "vecs", len(ids))
                if len(ids) > k:
                    among = np.partition(own @ own.T - 2 * np.eye(len(ids)), len(ids) - k, axis=1)[:, len(ids) - k]
                    reach = np.arccos(np.clip(among, -1.0, 1.0))
                else:
                    reach = np.full(len(ids), np.pi)
                to_pivot = _angles(own, pivots)[:, cells]
                gap = np.maximum(to_pivot - high[None, :], low[None, :] - to_pivot)
                wanted = gap <= reach[:, None] + ANGLE_SLACK
                for j in np.flatnonzero(wanted.any(axis=0)):
                    rows = np.flatnonzero(wanted[:, j])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(cells[j])], pa.int32()), pa.array([ids.take(pa.array(rows)).to_pylist()], kind),
                        pa.array([own[rows].ravel()], pa.list_(pa.float64()))], names=["cell", "ids", "vecs"])

    return visit


def knn_graph(df: DataFrame, key: str, vector: str, k: int = 15, block: int = 1000) -> DataFrame:
    """Exact cosine nearest neighbours among the rows of ``df``: (id, rank, neighbor_id, distance).

    Rows are dealt to the nearest of some pivots (rows drawn by hash, about the square root of all, at most MAX_PIVOTS), and
    each cell is packed into blocks. A row looks only into cells that the triangle inequality on angles does not rule out,
    given the k-th distance in its own block; a task multiplies the rows of one block with one block of such a cell and
    passes on each row's k nearest there. Data in clusters thus visit few cells; data without structure visit nearly all of them, and
    work then grows with the square of the rows (see ``visited_pairs``). Rows without a vector are left out.
    """
    asking, packed, key_type = _knn_stages(df, key, vector, k, block)
    answering = packed.select("cell", F.col("ids").alias("other_ids"), F.col("vecs").alias("other_vecs"))
    # a block asks in many cells, so this side is far larger than the planner takes it for: it must not be broadcast
    pairs = asking.join(answering.hint("merge"), "cell").select("ids", "vecs", "other_ids", "other_vecs")
    near = pairs.mapInArrow(_nearest_in_pair(k), f"id {key_type}, neighbor_id {key_type}, distance double")
    nearest = W.partitionBy("id").orderBy("distance", "neighbor_id")  # at most k rows per block
    return (near.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
            .select("id", "rank", "neighbor_id", "distance"))


def visited_pairs(df: DataFrame, key: str, vector: str, k: int = 15, block: int = 1000) -> DataFrame:
    """(visited, all_pairs): row pairs that ``knn_graph`` multiplies, and those of comparing all rows."""
    asking, packed, _ = _knn_stages(df, key, vector, k, block)
    sizes = packed.groupBy("cell").agg(F.sum(F.size("ids").cast("bigint")).alias("_size"))
    rows = packed.agg(F.coalesce(F.sum(F.size("ids").cast("bigint")), F.lit(0)).alias("n")).scalar()
    return asking.join(sizes, "cell").agg(F.coalesce(F.sum(F.size("ids") * F.col("_size")), F.lit(0)).alias("visited")).select(
        "visited", (rows * rows).alias("all_pairs"))


def _knn_stages(df: DataFrame, key: str, vector: str, k: int, block: int) -> tuple[DataFrame, DataFrame, str]:
    drawn = materialise(df.select(F.col(key).alias("id"), X.l2_normalize(F.col(vector)).cast("array<double>").alias("vec"))
                        .where(F.col(vector).isNotNull()), "knn")
    key_type = dict(df.dtypes)[key]
    count = drawn.count()
    wanted = max(1, min(MAX_PIVOTS, round(count ** 0.5)))
    chosen = drawn.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()
    pivots = np.array([r["vec"] for r in chosen], dtype=np.float64) if chosen else np.zeros((1, 1))
    dealt = drawn.mapInArrow(_nearest_cell(pivots), f"id {key_type}, vec array<double>, cell int, angle double")
    dealt = materialise(dealt, "knn-cells")
    # a cell has as many blocks as it needs, so one full of copies spreads
    shape = dealt.groupBy("cell").agg(F.count("*").alias("_rows"), F.min("angle").alias("_low"), F.max("angle").alias("_high"))
    known = sorted(map(tuple, shape.collect()))  # at most MAX_PIVOTS rows
    cells, sizes, low, high = (np.array(c) for c in zip(*known)) if known else (np.zeros(0, int),) * 4
    blocks = F.greatest(F.ceil(F.col("_rows") / block), F.lit(1))
    spread = dealt.join(F.broadcast(shape), "cell").withColumn("_block", F.pmod(F.xxhash64("id"), blocks))
    packed = materialise(spread.groupBy("cell", "_block").agg(F.collect_list(F.struct("id", "vec")).alias("rows")).select(
        "cell", F.col("rows.id").alias("ids"), F.flatten("rows.vec").alias("vecs")), "knn-blocks")
    asking = packed.select("ids", "vecs").mapInArrow(_cells_to_visit(k, pivots, cells, low, high), f"cell int, ids array<{key_type}>, vecs array<double>")
    return asking, packed, key_type
