"""Product codes of vectors: exact integer k-means over Hilbert-sorted flat blocks.

Each component becomes the integer floor(1024 · x). A vector is cut into ``PARTS`` equal parts, each
with its own codebook of up to ``ENTRIES`` entries. The parts of all vectors are laid out once:
sorted by part position and Hilbert index, and cut into flat blocks of at most ``BLOCK_ROWS``. A block is
one row of a table: its integers, the smallest and largest value of each component (its box), the
componentwise sums and its size. In a round each block takes, from the distances of its box to the
entries, the shortlist of entries that can be nearest to any of its rows: those whose smallest
distance to the box is no larger than the smallest of the largest distances. A shortlist of one entry
takes the whole block by its sums; otherwise an exact integer kernel compares the rows with the
shortlist alone. Blocks give counts and sums per entry, which Spark adds up; only the new codebooks
(at most PARTS · ENTRIES entries) pass through the driver.

Rows whose vector is null or holds a null or a non-finite component are dropped. All kept vectors
must be of one width: rows of another width than the vector of the smallest kept vec_id (nulls
last; then the smallest vector) are dropped too, empty vectors among them unless all are empty. Parts of a width that
``PARTS`` does not divide end at floor(i · width / PARTS). Components are held to ±2^26 after the scaling
(|x| up to 65536), so that 64-bit sums cannot overflow. Fewer than ENTRIES kept rows make as
many entries as rows; rows with the same vec_id follow one another by their vectors. Repeated rows
count as often as they stand there. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import step_table

SCALE = 1024
LARGEST = 1 << 26
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK_ROWS = 256
HILBERT_BITS = 4
BLOCK_SCHEMA = "part int, n int, ids binary, vectors binary, low array<long>, high array<long>, sums array<long>"


def integers(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a whole finite vector, with ``ints`` = floor(SCALE · x) as array<long>."""
    whole = f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    held = f"least({LARGEST}L, greatest(-{LARGEST}L, floor(least({LARGEST}D, greatest(-{LARGEST}D, double(x) * {SCALE})))))"
    return rows.where(whole).withColumn("ints", F.expr(f"transform({vector}, x -> {held})"))


def cuts(width: int) -> list[int]:
    return [i * width // PARTS for i in range(PARTS + 1)]


def hilbert_keys(points: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int = HILBERT_BITS) -> list[bytes]:
    """Hilbert index of each row of ``points`` on a grid of 2^bits cells a side between ``low`` and ``high``,
    as bytes that sort like the index: Gray-code steps over all rows at once."""
    n, d = points.shape
    if d == 0:
        return [b""] * n
    span = np.maximum(high - low, 1)
    x = np.minimum(((points - low) << bits) // (span + 1), (1 << bits) - 1).T.astype(np.int64)
    for level in range(bits - 1, 0, -1):  # undo the rotations of the larger cells, axis by axis
        q, mask = 1 << level, (1 << level) - 1
        for axis in range(d):
            upper = (x[axis] & q) != 0
            swapped = np.where(upper, 0, (x[0] ^ x[axis]) & mask)
            x[0] ^= np.where(upper, mask, swapped)
            x[axis] ^= np.where(upper, 0, swapped)
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(n, dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    levels = np.stack([(x >> level) & 1 for level in range(bits - 1, -1, -1)])  # level, axis, row
    packed = np.packbits(levels.reshape(bits * d, n).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def flat_blocks(kept: DataFrame, width: int) -> DataFrame:
    """``kept`` (row, ints) as blocks: every part of every vector in one block of its position."""
    ends = cuts(width)
    pieces = kept.select("row", F.posexplode(F.array(*[F.slice("ints", a + 1, b - a) for a, b in zip(ends, ends[1:])])).alias("part", "ints"))
    bounds = kept.agg(*[F.struct(F.min(F.col("ints")[i]).alias("lo"), F.max(F.col("ints")[i]).alias("hi")).alias(f"c{i}") for i in range(width)]
                      ).first() if width else ()
    low = np.array([b["lo"] or 0 for b in bounds], dtype=np.int64)
    high = np.array([b["hi"] or 0 for b in bounds], dtype=np.int64)

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            keys: list[bytes] = [b""] * len(part)
            lists = batch.column("ints")
            values, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
            for p in np.unique(part):
                a, b = ends[p], ends[p + 1]
                at = np.flatnonzero(part == p)
                points = values[starts[at][:, None] + np.arange(b - a)]
                for i, key in zip(at, hilbert_keys(points, low[a:b], high[a:b])):
                    keys[i] = key
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), lists, pa.array(keys, pa.binary())],
                                             ["row", "part", "ints", "hilbert"])

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part, ids, points):
            return {"part": int(part), "n": len(ids), "ids": ids.astype("<i8").tobytes(), "vectors": points.astype("<i4").tobytes(),
                    "low": points.min(0), "high": points.max(0), "sums": points.sum(0, dtype=np.int64)}
        schema = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()),
                            ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])
        for batch in batches:  # rows come sorted; blocks end at each batch and at each change of the position
            part, ids = batch.column("part").to_numpy(), batch.column("row").to_numpy()
            lists = batch.column("ints")
            values, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
            out = []
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                d = ends[p + 1] - ends[p]
                points = values[starts[at][:, None] + np.arange(d)]
                out += [block(p, ids[at[i:i + BLOCK_ROWS]], points[i:i + BLOCK_ROWS]) for i in range(0, len(at), BLOCK_ROWS)]
            yield from pa.Table.from_pylist(out, schema).to_batches()

    keyed = pieces.mapInArrow(with_keys, "row long, part int, ints array<long>, hilbert binary")
    # the row number in the order cuts a very common vector like any other run of keys
    laid = keyed.repartitionByRange("part", "hilbert", "row").sortWithinPartitions("part", "hilbert", "row")
    return step_table(laid.drop("hilbert").mapInArrow(cut_blocks, BLOCK_SCHEMA))


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For boxes (rows of ``low`` and ``high``) and entries: which entries can be nearest to a point of the box.
    The largest distance of an entry within a box bounds the nearest one from above; ties stay."""
    lo, hi = low[:, None, :], high[:, None, :]
    outside = np.maximum(np.maximum(lo - entries, entries - hi), 0)
    corner = np.maximum(np.abs(entries - lo), np.abs(hi - entries))
    return (outside ** 2).sum(2) <= (corner ** 2).sum(2).min(1)[:, None]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry (ties to the lower index) and the squared distance, in exact
    integer arithmetic: as float products where every sum stays below 2^53, else in 64-bit integers."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if points.shape[1] * (2 * largest) ** 2 < 1 << 53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        distance = (p * p).sum(1)[:, None] - 2.0 * (p @ e.T) + (e * e).sum(1)
        best = distance.argmin(1)
        return best, distance[np.arange(len(p)), best].astype(np.int64)
    best = np.zeros(len(points), dtype=np.int64)
    least = np.full(len(points), np.iinfo(np.int64).max)
    for i, entry in enumerate(entries):
        distance = ((points - entry) ** 2).sum(1)
        nearer = distance < least
        best[nearer], least[nearer] = i, distance[nearer]
    return best, least


def _blocks_of(batch: pa.RecordBatch, books: list[np.ndarray]):
    """(part, shortlist, row) of each block of a batch; boxes of one position are compared together, some at a time."""
    part = batch.column("part").to_numpy()
    columns = {c: batch.column(c) for c in ("low", "high")}
    for p in np.unique(part):
        at, book = np.flatnonzero(part == p), books[p]
        for i in range(0, len(at), 64):
            some = at[i:i + 64]
            low, high = (np.array([columns[c][int(j)].as_py() for j in some], dtype=np.int64).reshape(len(some), -1) for c in ("low", "high"))
            for j, able in zip(some, shortlists(low, high, book)):
                yield int(p), np.flatnonzero(able), int(j)


def _points(batch: pa.RecordBatch, j: int, d: int) -> np.ndarray:
    n = batch.column("n")[j].as_py()
    return np.frombuffer(batch.column("vectors")[j].as_py(), "<i4").reshape(n, d).astype(np.int64)


def next_codebooks(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: each entry becomes floor(sum / count) of the parts nearest to it; unused ones stay."""
    widest = max(b.shape[1] for b in books)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        sums = [np.zeros(b.shape, dtype=np.int64) for b in books]
        for batch in batches:
            for p, able, j in _blocks_of(batch, books):
                if len(able) == 1:  # the whole block by its sums
                    counts[p][able[0]] += batch.column("n")[j].as_py()
                    sums[p][able[0]] += np.array(batch.column("sums")[j].as_py(), dtype=np.int64)
                    continue
                points = _points(batch, j, books[p].shape[1])
                entry = able[nearest(points, books[p][able])[0]]
                counts[p] += np.bincount(entry, minlength=len(books[p]))
                np.add.at(sums[p], entry, points)
        used = [(p, int(e)) for p, c in enumerate(counts) for e in np.flatnonzero(c)]
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
                 pa.array([counts[p][e] for p, e in used], pa.int64()), pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64()))],
                ["part", "entry", "n", "sums"])

    found = blocks.select("part", "n", "vectors", "low", "high", "sums").mapInArrow(gather, "part int, entry int, n long, sums array<long>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(widest)])
    after = [b.copy() for b in books]
    for r in total.collect():  # at most PARTS * ENTRIES rows
        after[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books[r["part"]].shape[1])]
    return after


def assign(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(row, part, entry, error) for every part of every vector."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, able, j in _blocks_of(batch, books):
                points = _points(batch, j, books[p].shape[1])
                best, error = nearest(points, books[p][able])
                ids = np.frombuffer(batch.column("ids")[j].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), p), pa.int32()), pa.array(able[best], pa.int32()), pa.array(error, pa.int64())],
                    ["row", "part", "entry", "error"])

    return blocks.select("part", "n", "ids", "vectors", "low", "high").mapInArrow(gather, "row long, part int, entry int, error long")


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per kept row: ``key``, ``code`` (two hex digits per part), ``error``, ``label_error`` (sum of error over
    equal labels, nulls together), ``codebooks_sha256``."""
    kept = integers(rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label")), "vector")
    kept = step_table(kept.select(F.monotonically_increasing_id().alias("row"), "key", "label", "ints"))
    order = [F.col("key").isNull(), "key", "ints"]
    first = kept.orderBy(F.size("ints") == 0, *order).select(F.size("ints").alias("width")).first()
    width = first["width"] if first else 0
    kept = kept.where(F.size("ints") == width)
    start = [r["ints"] for r in kept.orderBy(*order).limit(ENTRIES).select("ints").collect()]
    ends = cuts(width)
    books = [np.array([v[a:b] for v in start], dtype=np.int64).reshape(len(start), b - a) for a, b in zip(ends, ends[1:])]
    blocks = flat_blocks(kept, width)
    if start:
        for _ in range(ROUNDS):
            books = next_codebooks(blocks, books)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()
    codes = assign(blocks, books).groupBy("row").agg(F.sum("error").alias("error"), *[
        F.max(F.when(F.col("part") == p, F.col("entry"))).alias(f"e{p}") for p in range(PARTS)])
    coded = step_table(kept.select("row", "key", "label").join(codes, "row").select(
        "key", "label", "error", F.lower(F.concat(*[F.lpad(F.hex(f"e{p}"), 2, "0") for p in range(PARTS)])).alias("code")))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
