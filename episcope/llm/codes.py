"""Vector code compression: product codes whose codebooks are moved by Lloyd rounds over active entries only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episcope.llm.common import free_name, row_key
from episcope.operators.joins import enrich
from episcope.session import durable

SCALE = 256
ROWS = 2048  # rows compared at a time: ROWS x entries distances


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold no null or non-finite component."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _whole(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The batch's vectors as whole numbers: floor(256 x) of each component."""
    held = batch.column(batch.schema.names.index("__vector"))
    if batch.num_rows and len(held.flatten()) != size * batch.num_rows:
        raise ValueError(f"every vector needs {size} components")
    flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(batch.num_rows, size)


def _distances(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of one part to the given entries."""
    out = np.zeros((len(part), len(entries)), np.int64)
    for c in range(part.shape[1]):
        d = part[:, c, None] - entries[None, :, c]
        out += d * d
    return out


def reassign(part: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> int:
    """Assign the rows of one part anew, in place; ``code`` and ``distance`` hold the last assignment (code -1: none).

    A row whose entry stayed where it was keeps its exact distance, and as no other unmoved entry was nearer then, only
    moved entries can take it over: when nearer, or as near with a lower index. The other rows compare all entries.
    Returns the number of distances worked out.
    """
    at = np.flatnonzero(moved)
    stayed = (code >= 0) & ~moved[code]
    rest = np.flatnonzero(~stayed)
    work = 0
    for rows in np.array_split(rest, len(rest) // ROWS + 1):
        d = _distances(part[rows], entries)
        code[rows] = d.argmin(axis=1)  # the first of equal ones
        distance[rows] = d[np.arange(len(rows)), code[rows]]
        work += d.size
    if len(at):
        kept = np.flatnonzero(stayed)
        for rows in np.array_split(kept, len(kept) // ROWS + 1):
            d = _distances(part[rows], entries[at])
            best = d.argmin(axis=1)
            new, index = d[np.arange(len(rows)), best], at[best]
            better = (new < distance[rows]) | ((new == distance[rows]) & (index < code[rows]))
            code[rows[better]], distance[rows[better]] = index[better], new[better]
            work += d.size
    return work


def _assign(state: DataFrame, books: np.ndarray, moved: np.ndarray, fresh: bool) -> DataFrame:
    """The state with every part assigned to its codebook's nearest entry."""
    parts, _, width = books.shape
    limit = np.abs(books).max(initial=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n = batch.schema.names, batch.num_rows
            x = _whole(batch, parts * width)
            if n and 4 * max(int(np.abs(x).max()), int(limit)) ** 2 * parts * width >= 1 << 63:
                raise ValueError("components are too large for exact distances in 64 bits")
            if fresh:
                code, distance = np.full((n, parts), -1), np.zeros((n, parts), np.int64)
            else:
                code = np.frombuffer(b"".join(batch.column(names.index("__code")).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                distance = np.frombuffer(b"".join(batch.column(names.index("__distance")).to_pylist()), np.int64).reshape(n, parts).copy()
            for p in range(parts):
                c, d = code[:, p].copy(), distance[:, p].copy()
                reassign(x[:, p * width:(p + 1) * width], books[p], moved[p], c, d)
                code[:, p], distance[:, p] = c, d
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("__row")), batch.column(names.index("__vector")),
                 pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()),
                 pa.array([r.tobytes() for r in distance], pa.binary()), pa.array(distance.sum(axis=1))],
                names=["__row", "__vector", "__code", "__distance", "__error"])

    kept = T.StructType([state.schema["__row"], state.schema["__vector"]])
    return state.mapInArrow(run, kept.add("__code", "binary").add("__distance", "binary").add("__error", "long"))


def _moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each used entry at the floor of its parts' mean. A task sends one row per component of a used entry, and the driver
    gets as many in all: entries x components."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _whole(batch, parts * width)
            code = np.frombuffer(b"".join(batch.column(batch.schema.names.index("__code")).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p * width:(p + 1) * width])
                count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        p, e, c = np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p))
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (p, e, c, total[p, e, c], count[p, e])],
                                         names=["part", "entry", "at", "total", "n"])

    sums = (state.select("__vector", "__code").mapInArrow(run, "part long, entry long, at long, total long, n long")
            .groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())
    new = books.copy()
    for r in sums:
        new[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return new


def compress(df: DataFrame, carry: list[str], vec_id: str = "vec_id", vector: str = "embedding", parts: int = 16,
             entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """The carried columns with ``code`` (binary, one entry index per part) and ``error`` (the squared distance between a
    vector and its code), and the codebooks as an array of (part, entry, component).

    Components are taken as floor(256 x), so sums and distances are whole numbers and exact. Each part starts with the
    vectors of the ``entries`` smallest ids (null ids come last, ties by vector); a round assigns every part to the nearest
    entry, ties to the lower index, and moves each used entry to the floor of its mean. A part whose entry stayed compares
    itself with the moved ones only, by the exact distance that the state holds. The state goes to the shared folder after
    each round. Rows with null, NaN or infinite components are left out; repeated rows are rows; fewer vectors give fewer
    entries, and none an empty result. Vectors must have one length, a multiple of ``parts``. The two added columns replace
    carried ones of the same name.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has one byte: 256 entries at most")
    v = F.col(f"`{vector}`")
    if dict(df.dtypes)[vector] not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    held = [c for c in carry if c.lower() not in ("code", "error")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in held], F.lit(0).alias(free_name(df, "__one"))).alias("__row"),
                     F.col(f"`{vec_id}`").alias("__id"), v.alias("__vector")).where(usable(F.col("__vector")))
    first = [r["__vector"] for r in rows.orderBy(F.col("__id").asc_nulls_last(), "__vector").limit(entries).select("__vector").collect()]
    if len({len(x) for x in first}) > 1:
        raise ValueError("every vector needs as many components as the others")
    start = np.floor(np.array(first, np.float64) * SCALE).astype(np.int64) if first else np.empty((0, parts), np.int64)
    if start.shape[1] % parts:
        raise ValueError(f"vectors of {start.shape[1]} components cannot be cut into {parts} equal parts")
    books = np.stack(np.split(start, parts, axis=1))
    state, moved, fresh = rows.select("__row", "__vector"), np.ones(books.shape[:2], bool), True
    for _ in range(rounds):
        state = durable(_assign(state, books, moved, fresh))
        new = _moved_books(state, books)
        books, moved, fresh = new, (new != books).any(axis=2), False
    found = _assign(state, books, moved, fresh)
    return durable(found.select(*[F.col(f"__row.`{c}`") for c in held], F.col("__code").alias("code"), F.col("__error").alias("error"))), books


def label_errors(coded: DataFrame, label: str, out: str = "label_error") -> DataFrame:
    """Adds the error summed over the rows of an equal label; null labels are one group. Sums are formed before the
    shuffle, and labels that hold many rows are joined apart."""
    key = free_name(coded, "__key")
    keyed = coded.withColumn(key, row_key(coded, [label]))
    totals = durable(keyed.groupBy(key).agg(F.sum("error").alias(out)))
    return enrich(keyed, totals, key).drop(key)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
