"""Fill-in-middle: texts cut at token boundaries that are looked up in a compressed boundary set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 16
ARRAY, BITMAP, RUN = "array", "bitmap", "run"


class BoundarySet:
    """A set of offsets in containers of 2^16 values: a sorted array of the low 16 bits, a bitmap, or runs, whichever is
    smallest. Cumulative cardinalities lead a rank to its container, which selects the value by itself."""

    def __init__(self, offsets: np.ndarray):
        """``offsets``: distinct and ascending, none negative."""
        high = offsets >> 16
        starts = np.flatnonzero(np.append(True, np.diff(high) != 0)) if len(offsets) else np.empty(0, np.int64)
        self.keys = high[starts]
        self.cumulative = np.append(starts, len(offsets))  # members before each container
        self.containers = [self._container((part & (SPAN - 1)).astype(np.uint16))
                           for part in np.split(offsets, starts[1:])] if len(offsets) else []

    @staticmethod
    def _container(low: np.ndarray) -> tuple:
        breaks = np.flatnonzero(np.diff(low.astype(np.int64)) != 1) + 1
        runs = len(breaks) + 1
        if 2 + 4 * runs < min(2 * len(low), SPAN // 8):
            firsts = np.append(0, breaks)
            return RUN, low[firsts], firsts  # a run's first value, and the members before it
        if 2 * len(low) <= SPAN // 8:
            return ARRAY, low, None
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        packed = np.packbits(bits, bitorder="little").reshape(-1, 8)
        counts = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
        return BITMAP, packed, np.append(0, np.cumsum(counts))

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, rank: int) -> int:
        """The member with ``rank`` smaller ones."""
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        c = int(np.searchsorted(self.cumulative, rank, "right")) - 1
        kind, data, before = self.containers[c]
        rank -= int(self.cumulative[c])
        if kind == ARRAY:
            low = data[rank]
        elif kind == RUN:
            r = int(np.searchsorted(before, rank, "right")) - 1
            low = int(data[r]) + rank - int(before[r])
        else:
            w = int(np.searchsorted(before, rank, "right")) - 1  # a word of 64 bits
            bits = np.flatnonzero(np.unpackbits(data[w], bitorder="little"))
            low = 64 * w + bits[rank - int(before[w])]
        return (int(self.keys[c]) << 16) + int(low)


def boundaries(text: str) -> np.ndarray:
    """Code point offsets at which tokens start or end, 0 included: a token is a word with the white space before it, or
    the white space that ends the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(1, np.int64)
    white = (points == 32) | ((points >= 9) & (points <= 13))
    ends = ~white
    ends[:-1] &= white[1:]
    ends[-1] = True
    return np.append(0, np.flatnonzero(ends) + 1)


def _cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """The number of tokens and both cut offsets."""
    found = BoundarySet(boundaries(text))
    a, b = sorted((first % len(found), second % len(found)))
    return len(found) - 1, found.select(a), found.select(b)


@F.pandas_udf(T.StructType().add("n", T.LongType()).add("one", T.LongType()).add("two", T.LongType()))
def _cut_offsets(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, firsts, seconds in batches:
        yield pd.DataFrame([_cuts(*x) for x in zip(texts, firsts, seconds)], columns=["n", "one", "two"]).astype("int64")


def fill_in_middle(docs: DataFrame, fim_percent: int = 50, spm_percent: int = 80, seed: int = 42, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row per document: its id, ``n`` tokens, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` text.

    ``fim_percent`` of the documents are cut at two token boundaries drawn from a hash of seed and id, and ``spm_percent``
    of these give the suffix first. A draw depends on the id alone, so rows that repeat an id are cut at the same ranks; a
    null id counts as an empty one. Empty and null texts, and those that hold a sentinel, stay plain. No other columns of
    the frame are read, so none can clash; an empty table gives an empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), digest.alias("digest"))
    rows = rows.select("id", "t", *[draw(i).alias(f"h{i + 1}") for i in range(4)])
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.col("t").contains(mark)
    form = (F.when((F.col("t") == "") | held | (F.col("h3") % 100 >= fim_percent), "plain")
            .when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    cut = rows.select("id", "t", form.alias("form"), _cut_offsets("t", "h1", "h2").alias("c")).select("id", "t", "form", "c.*")
    part = lambda at, size: F.substr("t", (at + 1).cast("int"), size.cast("int"))
    prefix, middle = part(F.lit(0), F.col("one")), part(F.col("one"), F.col("two") - F.col("one"))
    suffix = part(F.col("two"), F.length("t") - F.col("two"))
    fim = F.col("form") != "plain"
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
              .otherwise(F.col("t")))
    return cut.select(F.col("id").alias(doc_id), "n", "form", F.when(fim, F.col("one")).alias("prefix_chars"),
                      F.when(fim, F.col("two") - F.col("one")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its parts hold no sentinel, so the first place of each is where it was put."""
    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substr(output, F.instr(output, F.lit(start)) + len(start)), end, 1)

    middle = F.substr(output, F.instr(output, F.lit(MIDDLE)) + len(MIDDLE))
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .otherwise(output))
