"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import free_name, small_side
from episcope.session import durable

SHINGLE = 5
THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(1 << 63)


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall((text or "").lower())


def shingle_set(tokens: list[str], length: int) -> set[str]:
    return {" ".join(tokens[i:i + length]) for i in range(len(tokens) - length + 1)}


def shingle_hashes(tokens: list[str], lengths) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of the given lengths, ascending as unsigned numbers."""
    n = len(tokens)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n)
    found = []
    for length in lengths:
        if n < length:
            continue
        x = np.full(n - length + 1, length, np.uint64)
        for i in range(length):
            x = (x ^ h[i:n - length + 1 + i]) * MULTIPLIER
            x ^= x >> np.uint64(29)
        found.append(x)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def needed(size: int, threshold: float) -> int:
    """The fewest shared shingles at which an item of so many shingles counts as contained."""
    return math.ceil(threshold * size - 1e-9)


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs in the same order."""
    return (x ^ _HALF).view(np.int64)


def item_sketches(items: DataFrame, item_id: str, text: str, threshold: float) -> DataFrame:
    """``(key, item_id, copies, length, shingles, sketch, text)`` for items with words; items with equal words are one row
    under the smallest id, null if none has one. ``key`` names the words.

    The sketch holds the ``shingles - needed + 1`` smallest shingle hashes. A document that has the needed share of the
    item's shingles has at least one of any so many of them, so a search by these minima misses nothing. An item of
    fewer than five words is one shingle as long as itself.
    """
    def run(batches):
        for batch in batches:
            rows, out = [], []
            for row, t in enumerate(batch.column(1)):
                tokens = words(t.as_py())
                if tokens:
                    length = min(SHINGLE, len(tokens))
                    hashes = _signed(shingle_hashes(tokens, [length]))
                    sketch = hashes[:len(hashes) - needed(len(hashes), threshold) + 1]
                    rows.append(row)
                    out.append((length, len(hashes), sketch, " ".join(tokens)))
            kinds = {"length": pa.int32(), "shingles": pa.int32(), "sketch": pa.list_(pa.int64()), "text": pa.string()}
            # Ids stay in Arrow: in pandas a null would turn them into doubles.
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds.values())]],
                names=["item_id", *kinds])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(
        run, "item_id long, length int, shingles int, sketch array<long>, text string")
    return rows.groupBy("text", "length", "shingles", "sketch").agg(
        F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies")).withColumn("key", F.md5("text"))


def _size_class(size: int) -> int:
    return size.bit_length()


def _bounds(sketches: DataFrame, threshold: float) -> tuple[list[int], dict[int, int]]:
    """The shingle lengths in use (five at most) and for each size class of documents, powers of two, the largest hash
    that any item small enough to be contained in it has in its sketch. A row per power of two reaches the driver."""
    top = sketches.select("length", "shingles", F.element_at("sketch", -1).alias("top"))
    lengths = sorted(r["length"] for r in top.select("length").distinct().collect())
    least = F.ceil(F.col("shingles") * F.lit(threshold) - 1e-9).cast("long")
    by_need = top.groupBy(F.length(F.bin(least)).alias("c")).agg(F.max("top").alias("top")).collect()
    bounds, reached = {}, None
    by_class = {r["c"]: r["top"] for r in by_need}
    for c in range(1, 64):
        if c in by_class:
            reached = by_class[c] if reached is None else max(reached, by_class[c])
        if reached is not None:
            bounds[c] = reached
    return lengths, bounds


def candidates(docs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """``(doc_id, key)``: documents that hold at least one shingle of an item's sketch and enough shingles to contain
    it. A document passes on only its hashes up to the bound of its size class."""
    lengths, bounds = _bounds(sketches, threshold)

    def run(batches):
        for batch in batches:
            sizes, kept = [], []
            for t in batch.column(1):
                hashes = shingle_hashes(words(t.as_py()), lengths)
                bound = bounds.get(_size_class(len(hashes)))
                ordered = _signed(hashes)
                sizes.append(len(ordered))
                kept.append(ordered[:0] if bound is None else ordered[:np.searchsorted(ordered, bound, "right")])
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*kept, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), lists],
                                             names=["doc_id", "size", "hashes"])

    hashed = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size int, hashes array<long>")
    probes = sketches.select("key", "shingles", F.explode("sketch").alias("hash"))
    return (hashed.select("doc_id", "size", F.explode("hashes").alias("hash")).join(probes, "hash")
            .where(F.col("size") >= F.ceil(F.col("shingles") * F.lit(threshold) - 1e-9))
            .select("doc_id", "key").distinct())


def _verify(threshold: float):
    @F.pandas_udf("array<struct<item_id:long,copies:long,shared:int,shingles:int>>")
    def verify(text: pd.Series, items: pd.Series) -> pd.Series:
        def one(t, wanted):
            if wanted is None or not len(wanted):
                return []
            tokens, own, found = words(t), {}, []
            for item in wanted:
                parts = item["text"].split(" ")
                length = min(SHINGLE, len(parts))
                if length not in own:
                    own[length] = shingle_set(tokens, length)
                ask = shingle_set(parts, length)
                shared = len(ask & own[length])
                if shared >= needed(len(ask), threshold):
                    found.append({"item_id": item["item_id"], "copies": item["copies"], "shared": shared, "shingles": len(ask)})
            return found
        return pd.Series([one(t, wanted) for t, wanted in zip(text, items)])
    return verify


def _marked(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, threshold: float,
            how: str) -> tuple[DataFrame, str]:
    """The documents with an array of the items they contain; ``how="inner"`` keeps to those with candidates."""
    sketches = durable(item_sketches(items, item_id, item_text, threshold))
    found = candidates(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), sketches, threshold)
    asked = durable(found.join(sketches.select("key", "item_id", "copies", "text"), "key")
                    .groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "copies", "text")).alias("items")))
    key, wanted, hits = (free_name(docs, n) for n in ("__doc", "__items", "__hits"))
    asked = asked.select(F.col("doc_id").alias(key), F.col("items").alias(wanted))
    joined = docs.join(small_side(asked), F.col(doc_id).cast("long").eqNullSafe(F.col(key)), how)
    asked_text = F.when(F.col(wanted).isNotNull(), F.col(text))  # other texts need not reach Python
    return joined.withColumn(hits, _verify(threshold)(asked_text, F.col(wanted))).drop(key, wanted), hits


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, copies, shared, shingles, containment)``: every document and every benchmark item of whose
    distinct word shingles (five words, or the whole item if shorter) the document has at least ``threshold``.

    Items with equal words are one item under their smallest id, ``copies`` says how many; an item without any id is
    searched like others and reported with a null item_id. Null and wordless texts
    contain nothing and are contained in nothing; rows with a null doc_id are searched too; documents with a repeated id
    are judged row by row; an empty table on either side gives an empty result. Extra columns are ignored.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked, hits = _marked(narrow, items, "doc_id", "text", item_id, item_text, threshold, "inner")
    return (marked.select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*")
            .withColumn("containment", F.col("shared") / F.col("shingles")))


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no benchmark item, with their columns; rules as in ``contaminated``."""
    marked, hits = _marked(docs, items, doc_id, text, item_id, item_text, threshold, "left")
    return marked.where(F.size(hits) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
