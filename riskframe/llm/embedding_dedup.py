"""Embedding near-duplicates by int8 tile products with exact error bounds.

Equal vectors of one label are one class (grouped first, so copies never meet in
pairs). Classes are dealt into cells around bounded many sampled pivots, cells
into tiles of at most ``tile_rows`` vectors; a tile is one packed row of unit
vectors quantised to int8 with a scale and the norm of the rest per vector.
Every two tiles of a label are multiplied as integers unless their cells are too
far apart on the sphere. For unit u = s q + e the product differs from s_u s_v
(q_u . q_v) by at most (1 + |e_u|) |e_v| + |e_u|; pairs whose interval lies above
the threshold link, pairs below it do not. The rest are open: a tile pair that has
any returns their places in the tiles, and only for these tile pairs the original numbers
are fetched and the open pairs recomputed in double precision. A tile pair
returns link counts per vector and a spanning forest of its links, never the links
themselves. Components join the forests.

Defined cases: rows whose label or vector is null, whose vector is zero, or holds
a null, NaN or infinite number link with nothing and are components of their
own; vectors of different lengths never link; repeated rows count as vectors of
their own; a null id is a component's id only if all its ids are null; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import components, forest, key128, written

TILE_ROWS = 1024
PIVOTS = 64              # sampled pivots at most; they only group the vectors
_SLACK = 1e-9
_CHUNK = 1 << 21          # numbers of one recomputed run


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of the rest) of unit rows in double precision."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    rest = np.linalg.norm(x - codes * scale[:, None], axis=1) * (1 + 1e-12) + 1e-15
    return codes.astype(np.int8), scale, rest


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest entry is divided out first, so that neither
    huge nor tiny rows overflow or vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def bounded_pairs(a: dict, b: dict, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i of a, j of b, whether it links for certain) of the row pairs whose cosine may
    reach the threshold; i < j in a tile against itself."""
    dim = a["dim"]
    # exact in float32 while 127 * 127 * dim stays below 2^24
    kind = np.float32 if dim <= 1040 else np.float64
    codes = [np.frombuffer(t["codes"], np.int8).reshape(t["n"], dim).astype(kind) for t in (a, b)]
    scale, rest = ([np.frombuffer(t[c], np.float64) for t in (a, b)] for c in ("scales", "rests"))
    approx = (codes[0] @ codes[1].T).astype(np.float64)
    approx *= scale[0][:, None] * scale[1][None, :]
    bound = (1 + rest[0])[:, None] * rest[1][None, :] + rest[0][:, None] + _SLACK
    maybe = approx >= threshold - bound
    if same:
        maybe &= np.triu(np.ones(maybe.shape, bool), 1)
    i, j = np.nonzero(maybe)
    return i, j, approx[i, j] - bound[i, j] >= threshold


def exact_links(a: dict, b: dict, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of row i of a and row j of b reaches the threshold."""
    full = [np.frombuffer(t["vectors"], np.float64).reshape(t["n"], t["dim"]) for t in (a, b)]
    step = max(1, _CHUNK // a["dim"])
    return np.concatenate([exact_cosines(full[0][i[k:k + step]], full[1][j[k:k + step]]) >= threshold
                           for k in range(0, len(i), step)])


def link_rows(a: dict, b: dict, same: bool, i: np.ndarray, j: np.ndarray) -> list[pa.Array]:
    """(u, v, n): every linked vector, the smallest it reaches in the tiles, its links."""
    keys, copies = a["keys"], np.frombuffer(a["copies"], np.int64)
    if not same:
        j = j + len(keys)
        keys, copies = keys + b["keys"], np.concatenate([copies, np.frombuffer(b["copies"], np.int64)])
    n = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
    low = forest(i, j, len(keys))
    at = np.flatnonzero(n)
    return [pa.array([keys[x] for x in at], pa.binary()), pa.array([keys[x] for x in low[at]], pa.binary()),
            pa.array(n[at].astype(np.int64))]


def _pivots(reps: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """Unit pivots by dimension, from the rows of the smallest seeded hashes."""
    rows = (reps.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(PIVOTS).select("vector").collect())
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r["vector"]), []).append(r["vector"])
    return {d: unit_rows(np.array(v, np.float64)) for d, v in out.items()}


def _assign_cells(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell (nearest pivot) and angle (to it)."""
    told = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, angles = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.pi)
            dims = np.array([len(v) for v in batch.column("vector").to_pylist()], np.int64)
            flat, ends = batch.column("vector").flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d in told.value:
                    x = flat[ends[at][:, None] + np.arange(d)]
                    cos = unit_rows(x.astype(np.float64)) @ told.value[d].T
                    cells[at] = cos.argmax(axis=1)
                    angles[at] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield batch.append_column("cell", pa.array(cells)).append_column("angle", pa.array(angles))

    return reps.mapInArrow(run, _schema(reps) + ", cell int, angle double")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _pack(rows: pa.Table) -> pa.Table:
    """One packed row for the vectors of a tile."""
    x = np.array(rows.column("vector").to_pylist(), np.float64)
    codes, scale, rest = quantise(unit_rows(x))
    angles = rows.column("angle").to_numpy()
    first = {c: rows.column(c)[0].as_py() for c in ("label", "dim", "cell", "part")}
    return pa.table({
        **{c: [v] for c, v in first.items()}, "n": [len(x)], "reach": [float(angles.max())],
        "keys": [rows.column("key").to_pylist()], "copies": [rows.column("copies").to_numpy().astype(np.int64).tobytes()],
        "codes": [codes.tobytes()], "scales": [scale.tobytes()], "rests": [rest.tobytes()], "vectors": [x.tobytes()],
    }).cast(pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()),
                       ("n", pa.int32()), ("reach", pa.float64()), ("keys", pa.list_(pa.binary())),
                       *((c, pa.binary()) for c in ("copies", "codes", "scales", "rests", "vectors"))]))


_TILE = ("label long, dim int, cell int, part int, n int, reach double, keys array<binary>, copies binary, "
         "codes binary, scales binary, rests binary, vectors binary")


_LINKS = "u binary, v binary, n long"
_WHERE = ("label", "dim", "cell", "part")
_OPEN = ", ".join(f"{t}_{c} {'long' if c == 'label' else 'int'}" for t in "ab" for c in _WHERE) + (
    ", same boolean, i binary, j binary")


def _compare(threshold: float):
    """Rows of links, and one row of the open pairs' places for a tile pair that has any."""
    kinds = [pa.int64() if c == "label" else pa.int32() for _ in "ab" for c in _WHERE] + [
        pa.bool_(), pa.binary(), pa.binary()]
    names = ["u", "v", "n", *(f"{t}_{c}" for t in "ab" for c in _WHERE), "same", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                a, b, same = row["a"], row["b"], row["same"]
                i, j, sure = bounded_pairs(a, b, same, threshold)
                if sure.any():
                    links = link_rows(a, b, same, i[sure], j[sure])
                    yield pa.record_batch([*links, *(pa.nulls(len(links[0]), t) for t in kinds)], names)
                if not sure.all():
                    place = [*(t[c] for t in (a, b) for c in _WHERE), same,
                             *(x[~sure].astype(np.int32).tobytes() for x in (i, j))]
                    yield pa.record_batch([pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()),
                                           *(pa.array([x], t) for x, t in zip(place, kinds))], names)
    return run


def _recompute(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                i, j = (np.frombuffer(row[c], np.int32) for c in "ij")
                link = exact_links(row["a"], row["b"], i, j, threshold)
                if link.any():
                    yield pa.record_batch(link_rows(row["a"], row["b"], row["same"], i[link], j[link]), ["u", "v", "n"])
    return run


def _with_tiles(pairs: DataFrame, tiles: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Pairs of tiles with these columns of both as structs a and b."""
    for t in "ab":
        on = [F.col(c).alias(f"{t}_{c}") for c in _WHERE]
        pairs = pairs.join(tiles.select(*on, F.struct(*columns).alias(t)), [f"{t}_{c}" for c in _WHERE])
    return pairs.select("a", "b", *keep)


def near_duplicates(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", tile_rows: int = TILE_ROWS, seed: int = 3) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vector = F.col(vector_col)
    usable = (F.col(label_col).isNotNull() & vector.isNotNull()
              & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
                           F.lit(False))
              & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False)))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                     F.when(usable, F.transform(vector, lambda x: x.cast("double"))).alias("vector"))
    rows = rows.withColumn("key", F.when(F.col("vector").isNotNull(), key128("label", "vector")))
    reps = (rows.where("key is not null").groupBy("key")
            .agg(F.first("label").alias("label"), F.first("vector").alias("vector"),
                 F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
            .withColumn("dim", F.size("vector")))
    reps = written(reps, "vectors")
    cells = written(_assign_cells(reps, _pivots(reps, seed)), "vector-cells")
    sizes = (cells.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
             .select("label", "dim", "cell", F.ceil(F.col("n") / tile_rows).cast("int").alias("parts")))
    tiles = (cells.join(sizes, ["label", "dim", "cell"])
             .withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("parts")).cast("int"))
             .select("label", "dim", "cell", "part", "key", "copies", "vector", "angle")
             .groupBy("label", "dim", "cell", "part").applyInArrow(_pack, _TILE))
    tiles = written(tiles, "tiles")
    pairs = _tile_pairs(tiles, _pivots(reps, seed), threshold)
    met = _with_tiles(pairs, tiles, [c for c in tiles.columns if c not in ("vectors", "reach")], ["same"])
    told = written(met.mapInArrow(_compare(threshold), f"{_LINKS}, {_OPEN}"), "links")
    unsure = _with_tiles(told.where("u is null").drop("u", "v", "n"), tiles, ["n", "dim", "keys", "copies", "vectors"],
                         ["same", "i", "j"])
    exact = written(unsure.mapInArrow(_recompute(threshold), _LINKS), "exact-links")
    found = told.where("u is not null").select("u", "v", "n").unionByName(exact)
    links = found.groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    roots = components(found.select("u", "v"), "vector-components").withColumnRenamed("u", "key")
    known = (reps.select("key", "copies", "first_id").join(links, "key", "left").join(roots, "key", "left")
             .select("key", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("root", "key").alias("root")))
    known = written(known, "vector-classes")
    heads = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = known.join(heads, "root").select("key", "n_links", "component_id")
    return (rows.select("vec_id", "key").join(classes, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def _tile_pairs(tiles: DataFrame, pivots: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Pairs of tiles of one label and dimension that can hold a link: the angle
    between the pivots less the reach of both cells must not exceed the
    threshold's angle."""
    spark = tiles.sparkSession
    angles = [(d, i, j, float(np.arccos(np.clip(c, -1, 1)))) for d, p in pivots.items()
              for (i, j), c in np.ndenumerate(p @ p.T)]
    # at most PIVOTS x PIVOTS rows
    table = spark.createDataFrame(angles, "a_dim int, a_cell int, b_cell int, gap double")
    ends = [tiles.select(*(F.col(c).alias(f"{s}_{c}") for c in ("label", "dim", "cell", "part", "reach"))) for s in "ab"]
    both = (ends[0].join(ends[1], (F.col("a_label") == F.col("b_label")) & (F.col("a_dim") == F.col("b_dim")))
            .where((F.col("a_cell") < F.col("b_cell"))
                   | ((F.col("a_cell") == F.col("b_cell")) & (F.col("a_part") <= F.col("b_part")))))
    near = F.col("gap").isNull() | (F.col("gap") - F.col("a_reach") - F.col("b_reach")
                                    <= float(np.arccos(min(1.0, threshold))) + 1e-6)
    return (both.join(F.broadcast(table), ["a_dim", "a_cell", "b_cell"], "left").where(near)
            .withColumn("same", (F.col("a_cell") == F.col("b_cell")) & (F.col("a_part") == F.col("b_part")))
            .select(*(f"{s}_{c}" for s in "ab" for c in ("label", "dim", "cell", "part")), "same"))
