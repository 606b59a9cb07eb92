"""Problem 2: the most similar vectors of every vector.

Method: cross-polytope hashing. Pseudo-rotations, each three rounds of random
signs and a Hadamard transform, send unit vectors to their nearest signed axis;
a second digit over the first few axes of another rotation keeps buckets small
as the collection grows. Several tables are probed at the own bucket and the
next-best ones, the more the finer buckets are where far neighbours count, candidates of a bucket are screened with 8-bit vectors, and what
is left is ranked by exact cosine.

Directions that agree to four decimals are one vector with several ids; groups
of copies are never paired out. Buckets above `CROWDED` rows are cut into a grid
of blocks, every block of searchers against every block of members, so nothing
is dropped and no task holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annales.session import ensure_checkpoint_dir

TABLES = 6
PROBES = 1
#: Probes where no cosine of MEASURED or more is asked for, by the range of the second digit: neighbours are far there,
#: and finer buckets part them (brute-force recall of the five nearest is 0.9 or more at each, see the tests).
MEASURED = 0.85
FAR_PROBES = {0: 15, 1: 19, 2: 23, 4: 39, 8: 63, 16: 103, 32: 159, 64: 255}
#: Times BUCKET that an average bucket may hold where few vectors search.
MOST_BUCKETS = 20
#: Members of an average bucket; sets the range of the second digit.
BUCKET = 256
#: Rows of a bucket that one task compares at once.
CROWDED = 20_000
#: Candidates kept beyond k while similarities are approximate, and what these may be off by.
SPARE = 3
SLACK = 0.006
#: Crowded buckets that may be broadcast; more are joined by shuffle.
MOST_CROWDED = 50_000


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal; the width is a power of two."""
    out, n, h = rows.astype(np.float64), rows.shape[1], 1
    while h < n:
        pairs = out.reshape(len(out), -1, 2, h)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), n)
        h *= 2
    return out / np.sqrt(n)


def rotations(dims: int, count: int, seed: int) -> list[np.ndarray]:
    """Matrices of `count` pseudo-rotations of padded vectors.

    Below a few hundred dimensions one product with the composed matrix is
    faster than three passes of the transform over all vectors, and the same map.
    """
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        m = np.eye(dims)
        for _ in range(3):
            m = hadamard(m * rng.choice([-1.0, 1.0], dims))
        out.append(m.astype(np.float32))
    return out


def width(dims: int) -> int:
    return 1 << max(0, dims - 1).bit_length()


def second_axes(count: int, dims: int, bucket: int = BUCKET) -> int:
    """Axes of the second digit for `count` vectors; 0 for none."""
    wanted = count / (2 * dims * bucket)
    return 0 if wanted < 2 else min(dims, 1 << int(np.log2(wanted / 2)))


def probes_for(second: int, least: float) -> int:
    """Extra buckets a table in which a vector searches."""
    return PROBES if least >= MEASURED else FAR_PROBES.get(second, max(FAR_PROBES.values()) * max(1, second // 64))


def _axis(y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the `count` nearest signed axes, and their lengths, of each row."""
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    best = np.argsort(-both, axis=1, kind="stable")[:, :count]
    return best, np.take_along_axis(both, best, axis=1)


def codes(unit: np.ndarray, second: int, tables: int = TABLES, probes: int = PROBES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(rows x tables) own buckets and (rows x tables x probes) next-best buckets; -1 where there is none."""
    dims = width(unit.shape[1])
    padded = np.pad(unit, ((0, 0), (0, dims - unit.shape[1]))) if dims > unit.shape[1] else unit
    turns = rotations(dims, 2 * tables, seed)
    own = np.empty((len(unit), tables), np.int32)
    other = np.full((len(unit), tables, probes), -1, np.int32)
    for t in range(tables):
        a, la = _axis(padded @ turns[2 * t], 1 + probes)
        if second:
            b, lb = _axis(padded @ turns[2 * t + 1][:, :second], 1 + probes)
            n = 2 * second
            own[:, t] = a[:, 0] * n + b[:, 0]
            # A pair of ranks comes after all pairs of smaller ones.
            ranks = [(i, j) for i in range(a.shape[1]) for j in range(b.shape[1]) if 1 < (i + 1) * (j + 1) <= 1 + probes]
            i, j = (np.array(x, np.int64) for x in zip(*ranks)) if ranks else (np.empty(0, np.int64),) * 2
            options = a[:, i] * n + b[:, j]
            costs = la[:, :1] - la[:, i] + lb[:, :1] - lb[:, j]
        else:
            own[:, t], options, costs = a[:, 0], a[:, 1:], la[:, :1] - la[:, 1:]
        order = np.argsort(costs, axis=1, kind="stable")[:, :probes]
        other[:, t, : order.shape[1]] = np.take_along_axis(options, order, axis=1)
    return own, other


def _floats(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix) of the lists that hold `dims` finite numbers, not all zero."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dims)
    lists = column.take(pa.array(at))
    flat = lists.flatten()
    matrix = np.asarray(flat.fill_null(np.nan), dtype=np.float64).reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((matrix * matrix).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
    return at[good], matrix[good] / norm[good, None]


def unit_vectors(df: DataFrame, key: str, vector: str, dims: int, order: tuple[str, ...] = ()) -> DataFrame:
    """(id, order columns, vid, unit): comparable vectors at length one; vid is equal for equal directions.

    Left out: null ids and vectors that are null, of another length, with nulls
    or non-finite numbers inside, or all zero.
    """
    mult = np.random.default_rng(11).integers(0, 2**63, dims, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kinds = dict(df.dtypes)
    schema = ", ".join([f"id {kinds[key]}", *[f"_o{i} {kinds[c]}" for i, c in enumerate(order)], "vid long, unit binary"])

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, matrix = _floats(batch.column(batch.num_columns - 1), dims)
            if not len(at):
                continue
            grid = np.rint(matrix * 1e4).astype(np.int64).astype(np.uint64)
            vid = (grid * mult).sum(axis=1, dtype=np.uint64).view(np.int64)
            unit = matrix.astype(np.float32)
            rows = [batch.column(i).take(pa.array(at)) for i in range(batch.num_columns - 1)]
            names = ["id", *[f"_o{i}" for i in range(len(order))], "vid", "unit"]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(vid), _binary(unit)], names=names)

    rows = df.where(F.col(key).isNotNull()).select(F.col(key), *[F.col(c) for c in order], F.col(vector).cast("array<float>"))
    return rows.mapInArrow(norm, schema)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(rows)
    step = data.shape[1] * data.itemsize
    offsets = (np.arange(len(data) + 1, dtype=np.int64) * step).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(column), -1)


def _hashed(vectors: DataFrame, second: int, probes: int, payload: bool) -> DataFrame:
    """Rows (table, bucket, part[, vid, vector, scale, own buckets]) of every vector; part: 1 member, 2 searcher, 3 both."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column("unit"), np.float32)
            if not len(unit):
                continue
            seeks = np.flatnonzero(batch.column("seeks").to_numpy(zero_copy_only=False))
            own = codes(unit, second, probes=0)[0]
            other = codes(unit[seeks], second, probes=probes)[1]
            part = np.ones(len(unit), np.int32)
            part[seeks] = 3
            everyone = np.arange(len(unit))
            spots = [(t, everyone, own[:, t], part) for t in range(TABLES)] + [(t, seeks, other[:, t, p], np.full(len(seeks), 2, np.int32)) for t in range(TABLES) for p in range(probes)]
            if payload:
                scale = np.abs(unit).max(axis=1) / 127
                small = _binary(np.rint(unit / scale[:, None]).astype(np.int8))
                at = _binary(own)
                vid, scale = batch.column("vid"), pa.array(scale.astype(np.float32))
            for t, rows, bucket, kind in spots:
                there = np.flatnonzero(bucket >= 0)
                arrays = [pa.array(np.full(len(there), t, np.int32)), pa.array(bucket[there]), pa.array(kind[there])]
                names = ["tbl", "bucket", "kind"]
                if payload:
                    keep = pa.array(rows[there])
                    arrays += [x.take(keep) for x in (vid, small, scale, at)]
                    names += ["vid", "small", "scale", "own"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    more = ", vid long, small binary, scale float, own binary" if payload else ""
    return vectors.select("vid", "unit", "seeks").mapInArrow(emit, f"tbl int, bucket int, kind int{more}")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by `g`, several at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("g").to_numpy()
        first = np.searchsorted(g, g[-1])
        if held and held[-1].column("g")[-1].as_py() == g[-1]:
            held.append(batch)
            continue
        held.append(batch.slice(0, first))
        yield pa.Table.from_batches([b for b in held if b.num_rows] or [batch.slice(0, 0)])
        held = [batch.slice(first)]
    if held:
        yield pa.Table.from_batches(held)


def _screen(kept: int, least: float):
    """A function over sorted rows: pairs of vectors of a bucket whose approximate cosine is among a searcher's best."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            if not rows.num_rows:
                continue
            g = rows.column("g").to_numpy()
            vid = rows.column("vid").to_numpy()
            kind = rows.column("kind").to_numpy()
            tbl = rows.column("tbl").to_numpy()
            own = _matrix(rows.column("own"), np.int32)
            near = _matrix(rows.column("small"), np.int8).astype(np.float32) * rows.column("scale").to_numpy()[:, None]
            edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for start, end in zip(edges[:-1], edges[1:]):
                members = start + np.flatnonzero(kind[start:end] & 1)
                seekers = start + np.flatnonzero(kind[start:end] & 2)
                if not len(members) or not len(seekers):
                    continue
                step = max(1, 4_000_000 // len(members))
                for low in range(0, len(seekers), step):
                    seek = seekers[low : low + step]
                    close = near[seek] @ near[members].T
                    close[vid[seek][:, None] == vid[members][None, :]] = -2
                    if len(members) > kept:
                        floor = np.partition(close, len(members) - kept, axis=1)[:, len(members) - kept]
                        i, j = np.nonzero(close >= np.maximum(floor, least)[:, None])
                    else:
                        i, j = np.nonzero(close >= max(least, -1.5))
                    a, b = seek[i], members[j]
                    # A pair that shares a bucket of an earlier table has come out there.
                    before = (own[a] == own[b]) & (np.arange(own.shape[1])[None, :] < tbl[a][:, None])
                    fresh = ~before.any(axis=1)
                    found.append((vid[a[fresh]], vid[b[fresh]], close[i, j][fresh]))
            if found:
                a, b, c = (np.concatenate(x) for x in zip(*found))
                low, high = np.minimum(a, b), np.maximum(a, b)
                order = np.lexsort((high, low))
                low, high, c = low[order], high[order], c[order]
                once = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])] if len(low) else np.empty(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(low[once]), pa.array(high[once]), pa.array(c[once].astype(np.float32))], names=["a", "b", "near"])

    return pairs


def _gridded(rows: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Rows with the group `g` they are compared in and their part there."""
    if crowded is None:
        return rows.withColumn("g", F.xxhash64("tbl", "bucket"))
    rows = rows.join(crowded, ["tbl", "bucket"], "left")
    calm = rows.where("blocks IS NULL").drop("blocks").withColumn("g", F.xxhash64("tbl", "bucket"))
    packed = rows.where("blocks IS NOT NULL")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    mine = F.pmod(F.xxhash64("vid", "tbl"), F.col("blocks").cast("long")).cast("int")
    member = packed.where("kind <> 2").withColumn("_i", mine).withColumn("_j", others).withColumn("kind", F.lit(1))
    seeker = packed.where("kind <> 1").withColumn("_j", mine).withColumn("_i", others).withColumn("kind", F.lit(2))
    split = member.unionByName(seeker).withColumn("g", F.xxhash64("tbl", "bucket", "_i", "_j")).drop("blocks", "_i", "_j")
    return calm.unionByName(split)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _matrix(batch.column("unit_a"), np.float32), _matrix(batch.column("unit_b"), np.float32)
        cosine = np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)) if len(a) else np.empty(0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cosine)], names=["a", "b", "cosine"])


def _both_ways(pairs: DataFrame, score: str) -> DataFrame:
    ways = F.array(F.struct(F.col("a").alias("vid"), F.col("b").alias("other")), F.struct(F.col("b").alias("vid"), F.col("a").alias("other")))
    return pairs.select(F.explode(ways).alias("_w"), score).select("_w.vid", "_w.other", score)


def _best(rows: DataFrame, score: str, n: int) -> DataFrame:
    order = Window.partitionBy("vid").orderBy(F.col(score).desc(), F.col("other"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def similar_vectors(
    df: DataFrame, key: str = "id", vector: str = "embedding", dims: int = 64, k: int = 5, least: float = -1.0, order: tuple[str, ...] = ("loaded_at", "load_seq"), queries: DataFrame | None = None, crowded_at: int = CROWDED
) -> DataFrame:
    """(id, other, cosine, rank): for every id its k most similar other ids of cosine `least` or more.

    Of rows with one id the one with the largest `order` counts. Ids without a
    comparable vector (see unit_vectors) neither search nor are found. Ties in
    cosine go to the smaller id. Approximate: measured recall is in the README;
    the cosines themselves are exact, but that
    directions equal to four decimals count as one, at cosine 1. `queries`, a table of ids, restricts who
    searches, not who is found. An empty table gives an empty result.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order = tuple(c for c in order if c in df.columns)
    units = unit_vectors(df, key, vector, dims, order)
    newest = units.groupBy("id").agg(F.max_by("vid", F.struct(*[F.col(f"_o{i}") for i in range(len(order))], F.col("vid"))).alias("vid"))
    vectors = units.select("vid", "unit").dropDuplicates(["vid"])
    if queries is None:
        vectors = vectors.withColumn("seeks", F.lit(True)).checkpoint()
    else:
        wanted = newest.join(queries.select("id"), "id", "left_semi").select("vid", F.lit(True).alias("seeks")).distinct()
        vectors = vectors.join(wanted, "vid", "left").withColumn("seeks", F.coalesce("seeks", F.lit(False))).checkpoint()
    count, searching = vectors.agg(F.count(F.lit(1)), F.count_if("seeks")).first()
    # Where few search, larger buckets cost no more comparisons and part fewer neighbours.
    second = second_axes(count, width(dims), BUCKET * min(MOST_BUCKETS, max(1, count // max(1, searching))))
    probes = probes_for(second, least)
    sizes = _hashed(vectors, second, probes, payload=False).groupBy("tbl", "bucket").agg(F.count(F.lit(1)).alias("n"))
    crowded = sizes.where(F.col("n") > crowded_at).select("tbl", "bucket", F.ceil(F.col("n") / crowded_at).cast("int").alias("blocks"))
    crowded = crowded.checkpoint()
    packed = crowded.count()
    table = None if not packed else F.broadcast(crowded) if packed <= MOST_CROWDED else crowded
    rows = _gridded(_hashed(vectors, second, probes, payload=True), table)
    rows = rows.select("g", "vid", "kind", "tbl", "small", "scale", "own").repartition("g").sortWithinPartitions("g")
    near = rows.mapInArrow(_screen(k + SPARE, least - SLACK), "a long, b long, near float").groupBy("a", "b").agg(F.max("near").alias("near"))
    near = _both_ways(near, "near")
    if queries is not None:
        near = near.join(vectors.where("seeks").select("vid"), "vid", "left_semi")
    kept = _best(near, "near", k + SPARE)
    pairs = kept.select(F.least("vid", "other").alias("a"), F.greatest("vid", "other").alias("b")).distinct()
    left, right = vectors.select(F.col("vid").alias("a"), F.col("unit").alias("unit_a")), vectors.select(F.col("vid").alias("b"), F.col("unit").alias("unit_b"))
    exact = pairs.join(left, "a").join(right, "b").select("a", "b", "unit_a", "unit_b").mapInArrow(_exact, "a long, b long, cosine double").where(F.col("cosine") >= least)
    nearest = _best(_both_ways(exact, "cosine"), "cosine", k)
    # From directions back to ids: copies of a direction come first, at cosine 1.
    newest = newest.join(vectors.select("vid"), "vid", "left_semi")
    by_id = Window.partitionBy("vid").orderBy("id")
    first = newest.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    few = first.groupBy("vid").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    seekers = newest if queries is None else newest.join(queries.select("id"), "id", "left_semi")
    own = seekers.join(few, "vid")
    copies = own.where(F.size("ids") > 1).select("id", F.explode(F.slice(F.array_remove("ids", F.col("id")), 1, k)).alias("other"), F.lit(1.0).alias("cosine"))
    beyond = nearest.join(few.select(F.col("vid").alias("other"), "ids"), "other").select("vid", F.explode("ids").alias("other"), "cosine")
    beyond = _best(beyond, "cosine", k)
    distant = own.where(F.size("ids") <= k).join(beyond, "vid").where(F.col("rank") <= k + 1 - F.size("ids")).select("id", "other", "cosine")
    ranked = Window.partitionBy("id").orderBy(F.col("cosine").desc(), F.col("other"))
    both = copies.unionByName(distant).where(F.col("cosine") >= least)
    return both.withColumn("rank", F.row_number().over(ranked))
