"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart.  Vectors are sorted by the
cells, of that width, of a grid on their leading principal dimensions, and the
sequence is cut into blocks.  Pairs of sequence intervals are refined level by
level, from a few wide ones down to blocks; an interval pair whose bounding
boxes lie further apart than epsilon is dropped with everything below it.  Inside
a pair of blocks the recursion goes on over runs of rows, and what remains is
compared by matrix products.  Equal vectors are one row with a count.

A pair of blocks returns, per vector, a number of links and a few links that
connect what is connected, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm.arrow import with_columns
from wayside.llm.components import classes, components, join_class_results
from wayside.llm.ridge import sums
from wayside.llm.storage import stored

COSINE = 0.9
DIMENSIONS = 8
BLOCK = 4096
#: Rows of a block that are compared at once.
RUN = 256
#: Children of an interval.
FAN = 8
#: Vectors that the principal dimensions are taken from, about; they steer the order only, not what is found.
SAMPLE = 20_000
#: Allowance for rounding when boxes and rough products rule pairs out.
SLACK = 1e-4


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``rows`` with ``_unit``: the unit vector in double precision as bytes; null for null, empty, zero and non-finite vectors."""

    def work(batch: pa.RecordBatch) -> dict:
        out = []
        for value in batch.column(column).to_pylist():
            x = np.array([np.nan if v is None else v for v in value], dtype=float) if value else np.zeros(0)
            top = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(top) or top == 0:
                out.append(None)
                continue
            x = x / top  # keeps the norm of very large and very small vectors finite
            out.append((x / np.sqrt((x * x).sum()) + 0.0).tobytes())
        return {"_unit": out}

    return with_columns(rows, lambda: work, "_unit binary", drop=(column,))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Unit vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(column), width))
    for i, value in enumerate(column.to_pylist()):
        x = np.frombuffer(value)
        out[i, : len(x)] = x
    return out


def principal_axes(units: DataFrame, width: int, dimensions: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading eigenvectors of the covariance, summed by partition over a sample by hash."""
    n = units.count()
    u = F.pmod(F.xxhash64("_unit"), F.lit(1 << 30))
    rows = units.where(u < int((1 << 30) * min(1.0, sample / max(n, 1)))).select("_unit", F.lit(0).alias("fold"))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("_unit"), width)
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    found = sums(rows, moments, 1 + width + width * width)
    if not found:
        return np.zeros(width), np.eye(width)[:, :dimensions]
    total = sum(found.values())
    mean = total[1 : 1 + width] / total[0]
    covariance = total[1 + width :].reshape(width, width) / total[0] - np.outer(mean, mean)
    return mean, np.linalg.eigh(covariance)[1][:, ::-1][:, :dimensions]


def grid_blocks(units: DataFrame, id_column: str, width: int, epsilon: float, dimensions: int = DIMENSIONS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """Vectors in grid order, ``block`` of them to a row, with the bounds ``lo`` and ``hi`` on the principal dimensions; and the axes of these."""
    spark = units.sparkSession
    mean, axes = principal_axes(units, width, dimensions)
    cells = [f"_c{i}" for i in range(axes.shape[1])]

    def locate(batch: pa.RecordBatch) -> dict:
        at = np.floor((_matrix(batch.column("_unit"), width) - mean) @ axes / epsilon)
        return {c: at[:, i].astype(np.int32) for i, c in enumerate(cells)}

    located = with_columns(units, lambda: locate, ", ".join(f"{c} int" for c in cells))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = located.repartitionByRange(parts, *cells, id_column).sortWithinPartitions(*cells, id_column).drop(*cells)
    # the place within a stored partition plus what the partitions before it hold is the place in the whole sequence
    placed = stored(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row per partition
    before = np.concatenate(([0], np.cumsum([n for _, n in sizes])))[:-1].tolist() if sizes else []
    offsets = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before, strict=True)], "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("block", F.floor(place / block).cast("long"))

    def gather(group: pa.Table) -> pa.Table:
        group = group.sort_by("_at")
        data = _matrix(group.column("_unit"), width)
        on_axes = (data - mean) @ axes
        lengths = np.array([len(v) for v in group.column("_unit").to_pylist()], dtype=np.int64)
        made = {
            "block": [group.column("block")[0].as_py()],
            "ids": [group.column(id_column).to_numpy().astype(np.int64).tobytes()],
            "counts": [group.column("members").to_numpy().astype(np.int64).tobytes()],
            "lengths": [lengths.tobytes()],
            "data": [data.tobytes()],
            "lo": [on_axes.min(axis=0).tolist()],
            "hi": [on_axes.max(axis=0).tolist()],
        }
        return pa.table(made, schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "counts", "lengths", "data")), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]))

    schema = "block long, ids binary, counts binary, lengths binary, data binary, lo array<double>, hi array<double>"
    return stored(numbered.select("block", "_at", id_column, "members", "_unit").groupBy("block").applyInArrow(gather, schema)), axes


def interval_pairs(blocks: DataFrame, epsilon: float, fan: int = FAN) -> DataFrame:
    """``i, j`` (i <= j): the block pairs that boxes do not rule out, found from wide intervals down to blocks."""
    n = blocks.count()
    depth = max(0, math.ceil(math.log(max(n, 1), fan)) - 1) if n > fan else 0
    boxes = blocks.select("block", "lo", "hi")
    axes = len(boxes.first()["lo"]) if n else 1
    flat = boxes.select("block", *[F.element_at("lo", k + 1).alias(f"lo{k}") for k in range(axes)], *[F.element_at("hi", k + 1).alias(f"hi{k}") for k in range(axes)])

    def level(k: int) -> DataFrame:
        if k == 0:
            return flat.withColumnRenamed("block", "node")
        node = F.floor(F.col("block") / fan**k).cast("long").alias("node")
        return flat.groupBy(node).agg(*[F.min(f"lo{a}").alias(f"lo{a}") for a in range(axes)], *[F.max(f"hi{a}").alias(f"hi{a}") for a in range(axes)])

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("node").alias(name), F.floor(F.col("node") / fan).cast("long").alias(f"{name}_up"), *[F.col(f"{e}{a}").alias(f"{name}_{e}{a}") for e in ("lo", "hi") for a in range(axes)])

    gaps = [F.greatest(F.lit(0.0), F.col(f"i_lo{a}") - F.col(f"j_hi{a}"), F.col(f"j_lo{a}") - F.col(f"i_hi{a}")) for a in range(axes)]
    near = sum((g * g for g in gaps), F.lit(0.0)) <= (epsilon + SLACK) ** 2
    pairs = None
    for k in range(depth, -1, -1):
        left, right = side(level(k), "i"), side(level(k), "j")
        if pairs is None:  # at most ``fan`` squared nodes of the top level; their pairs come from a list of numbers, not from a cross join
            top = blocks.sparkSession.createDataFrame([(i, j) for j in range(-(-n // fan**depth)) for i in range(j + 1)], "i long, j long")
            met = top.join(left, "i").join(right, "j")
        else:
            up = pairs.select(F.col("i").alias("i_up"), F.col("j").alias("j_up"))
            met = up.join(left, "i_up").join(right, "j_up").where("i <= j")
        pairs = met.where(near).select("i", "j")
    return pairs


def _runs(data: np.ndarray, axes: np.ndarray) -> tuple[list[slice], np.ndarray, np.ndarray]:
    cuts = [slice(a, min(a + RUN, len(data))) for a in range(0, len(data), RUN)]
    on = data @ axes
    return cuts, np.array([on[c].min(axis=0) for c in cuts]), np.array([on[c].max(axis=0) for c in cuts])


def _forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smallest id connected with it within this matrix) of the linked rows and columns."""
    by_row, by_column = rows.copy(), columns.copy()
    high = np.iinfo(np.int64).max
    while True:
        new_row = np.minimum(by_row, np.where(linked, by_column[None, :], high).min(axis=1))
        new_column = np.minimum(by_column, np.where(linked, new_row[:, None], high).min(axis=0))
        if (new_row == by_row).all() and (new_column == by_column).all():
            break
        by_row, by_column = new_row, new_column
    ids, roots = np.concatenate([rows[linked.any(axis=1)], columns[linked.any(axis=0)]]), np.concatenate([by_row[linked.any(axis=1)], by_column[linked.any(axis=0)]])
    keep = ids != roots
    return ids[keep], roots[keep]


def compare_blocks(pairs: DataFrame, blocks: DataFrame, width: int, cosine: float, axes: np.ndarray) -> DataFrame:
    """``id, n, root``: links of a vector counted in one pair of runs, or (n = 0) a link of the forest that connects them."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    side = ["ids", "counts", "lengths", "data"]
    both = pairs.join(blocks.select(F.col("block").alias("i"), *[F.col(c).alias(f"{c}_i") for c in side]), "i").join(
        blocks.select(F.col("block").alias("j"), *[F.col(c).alias(f"{c}_j") for c in side]), "j"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                same = value["i"] == value["j"]
                ids = [np.frombuffer(value[f"ids_{s}"], dtype=np.int64) for s in "ij"]
                counts = [np.frombuffer(value[f"counts_{s}"], dtype=np.int64) for s in "ij"]
                lengths = [np.frombuffer(value[f"lengths_{s}"], dtype=np.int64) for s in "ij"]
                data = [np.frombuffer(value[f"data_{s}"]).reshape(-1, width) for s in "ij"]
                rough = [d.astype(np.float32) for d in data]
                mixed = len(np.unique(np.concatenate(lengths))) > 1
                (cuts_i, lo_i, hi_i), (cuts_j, lo_j, hi_j) = _runs(data[0], axes), _runs(data[1], axes)
                total = [np.zeros(len(x), dtype=np.int64) for x in ids]
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for a, ca in enumerate(cuts_i):
                    gap = np.maximum(0, np.maximum(lo_i[a] - hi_j, lo_j - hi_i[a]))
                    for b in np.flatnonzero((gap * gap).sum(axis=1) <= epsilon * epsilon):
                        if same and b < a:
                            continue
                        cb = cuts_j[b]
                        linked = rough[0][ca] @ rough[1][cb].T >= cosine - SLACK
                        if same and a == b:
                            np.fill_diagonal(linked, False)
                        if not linked.any():
                            continue
                        linked &= data[0][ca] @ data[1][cb].T >= cosine
                        if mixed:
                            linked &= lengths[0][ca][:, None] == lengths[1][cb][None, :]
                        total[0][ca] += linked @ counts[1][cb]
                        if not (same and a == b):
                            total[1][cb] += counts[0][ca] @ linked
                        found.append(_forest(linked, ids[0][ca], ids[1][cb]))
                many = [(x[t > 0], t[t > 0]) for x, t in zip(ids, total, strict=True)]
                linked_ids = np.concatenate([x for x, _ in many])
                ends, roots = (np.concatenate([f[k] for f in found]) if found else np.empty(0, dtype=np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([linked_ids, ends])),
                        pa.array(np.concatenate([*(t for _, t in many), np.zeros(len(ends), dtype=np.int64)])),
                        pa.array(np.concatenate([linked_ids, roots])),
                    ],
                    names=["id", "n", "root"],
                )

    return both.mapInArrow(work, "id long, n long, root long")


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, nor do vectors of different lengths with one another.
    Rows with one id and different vectors share their links and component; a row
    without an id links with nothing, has no component and is not kept.
    """
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = stored(usable(vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding"))))
    ready = rows.where("_unit IS NOT NULL AND vec_id IS NOT NULL")
    width = (ready.agg(F.max(F.length("_unit"))).first()[0] or 8) // 8
    members, reps = classes(ready, ["_unit"], "vec_id")
    units = reps.select(F.col("rep").alias("vec_id"), "members", "_unit")
    blocks, axes = grid_blocks(units, "vec_id", width, max(epsilon, 1e-6), min(DIMENSIONS, width), block)
    found = stored(compare_blocks(interval_pairs(blocks, epsilon), blocks, width, cosine, axes))
    counted = found.where("n > 0").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    connected = components(found.where("n = 0").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    results = (
        reps.groupBy("rep")
        .agg(F.sum("members").alias("members"))
        .join(counted, "rep", "left")
        .join(connected, "rep", "left")
        .select("rep", "members", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = join_class_results(members, results, "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where("_unit IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors with cosine 0.9 or more, and their components."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle_sql() -> str:
    """All pairs and the closure of the links in DuckDB."""
    return f"""
    WITH RECURSIVE usable AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
    counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings LEFT JOIN counted USING (vec_id) LEFT JOIN component USING (vec_id)"""
