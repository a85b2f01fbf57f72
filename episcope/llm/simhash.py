"""Near-duplicate documents by SimHash fingerprints and meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import free_name, row_key
from episcope.llm.components import components
from episcope.session import durable

RADIUS = 3
SHINGLE = 3
#: The 64 bits fall into three blocks; a key leaves one block out.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Shingles are hashed and counted in pieces of this many, so a very long text needs little memory.
PIECE = 1 << 16
#: Buckets up to this size are compared as one small matrix.
SMALL = 64


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text: A-Z lower-cased, words between ASCII white space, 3-word shingles with repeats. A bit is
    set when it is set in over half of the XXH64 values (seed 42). Null and wordless texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles, total = map(b" ".join, zip(words, words[1:], words[2:])), len(words) - SHINGLE + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    ones = np.zeros(64, np.int64)
    for at in range(0, total, PIECE):
        n = min(PIECE, total - at)
        piece = np.fromiter(islice(hashes, n), np.dtype("<u8"), n)
        ones += np.unpackbits(piece.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """All columns but the text, and the fingerprint as a signed long."""
    rest = [f.name for f in docs.schema.fields if f.name != text]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in rest]
                                             + [pa.array(prints)], names=[*rest, out])

    schema = docs.select(*rest).withColumn(out, F.lit(0).cast("long")).schema
    return docs.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball_keys(print_: F.Column) -> F.Column:
    """Keys of all variants within half the radius: at most one bit flipped, seen without one of the three blocks. Two
    fingerprints at 1 to 3 differing bits share a key: leave out a block that holds one of three differing bits, then at
    most two remain, and each side covers one of them."""
    def one_block(part: int, low: int, width: int) -> F.Column:
        hidden = ((1 << width) - 1) << low
        mask = F.lit(_signed(((1 << 64) - 1) ^ hidden))
        flips = [0] + [1 << i for i in range(64) if not hidden >> i & 1]
        return F.transform(F.array(*[F.lit(_signed(x)) for x in flips]), lambda x: F.struct(
            F.lit(part).cast("byte").alias("part"), print_.bitwiseXOR(x).bitwiseAND(mask).alias("key")))

    return F.explode(F.flatten(F.array(*[one_block(part, low, width) for part, (low, width) in enumerate(BLOCKS)])))


def _spread(labels: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Smallest label reachable when all members of a group are linked; groups are given as group numbers."""
    while True:
        start = labels
        for inverse in groups:
            least = np.full(inverse.max() + 1, len(labels), np.int64)
            np.minimum.at(least, inverse, labels)
            labels = least[inverse]
        if np.array_equal(start, labels):
            return labels


def linked_in_bucket(prints: np.ndarray, part: int) -> np.ndarray:
    """For the distinct fingerprints of one bucket, the index of the smallest one each is connected to by links of at
    most 3 differing bits that this bucket can vouch for. Never all pairs of a large bucket: there, fingerprints are
    grouped by values whose sharing already proves the link."""
    m = len(prints)
    if m <= SMALL:
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= RADIUS
        labels = np.arange(m)
        while True:
            best = np.where(near, labels[None, :], m).min(axis=1)
            if np.array_equal(best, labels):
                return labels
            labels = best
    low, width = BLOCKS[part]
    hidden = np.uint64(((1 << width) - 1) << low)
    bits = [np.uint64(1 << i) for i in range(low, low + width)]
    # Outside the block two members differ by two bits at most, so they are linked when inside they differ by one.
    groups = [np.unique(prints & hidden & ~bit, return_inverse=True)[1] for bit in bits]
    labels = _spread(np.arange(m), groups)
    # Equal outside the block: three bits inside. One flip on each side and one bit left out meet.
    outside = prints & ~hidden
    values, counts = np.unique(outside, return_counts=True)
    for value in values[counts > 1]:
        own = np.flatnonzero(outside == value)
        inside, local = prints[own], np.arange(len(own))
        balls = [np.concatenate([inside & ~bit, *[(inside ^ flip) & ~bit for flip in bits if flip != bit]]) for bit in bits]
        numbers = [np.unique(b, return_inverse=True)[1] for b in balls]
        while True:
            start = local
            for inverse in numbers:
                least = np.full(inverse.max() + 1, len(own), np.int64)
                copies = len(inverse) // len(own)
                np.minimum.at(least, inverse, np.tile(local, copies))
                local = least[inverse].reshape(copies, len(own)).min(axis=0)
            if np.array_equal(start, local):
                break
        groups.append(np.arange(m))
        groups[-1][own] = own[local]
    return _spread(labels, groups)


def _bucket_links(batches):
    """Links inside the buckets of a partition that is sorted by part and key; a bucket may span batches."""
    def links(parts, keys, prints):
        edge = np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
        two = starts[ends - starts == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= RADIUS]
        us, vs = [prints[two]], [prints[two + 1]]
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            own = np.sort(prints[s:e])
            labels = linked_in_bucket(own, int(parts[s]))
            more = labels != np.arange(len(own))
            us.append(own[more])
            vs.append(own[labels[more]])
        return np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)

    rest = None
    for batch in batches:
        got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        got[2] = got[2].view(np.uint64)
        if not len(got[0]):
            continue
        if rest is not None:
            got = [np.concatenate([a, b]) for a, b in zip(rest, got)]
        same = (got[1] == got[1][-1]) & (got[0] == got[0][-1])
        cut = len(same) - (int(np.argmin(same[::-1])) if not same.all() else len(same))
        rest = [x[cut:] for x in got]
        if cut:
            u, v = links(*[x[:cut] for x in got])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
    if rest is not None:
        u, v = links(*rest)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def print_links(prints: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect the distinct fingerprints of column ``print`` as all pairs at 3 or fewer differing
    bits would; a bucket of m fingerprints gives less than m of them."""
    keyed = prints.select("print", _ball_keys(F.col("print")).alias("k")).select("k.part", "k.key", "print")
    return keyed.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(_bucket_links, "u long, v long")


def _members(docs: DataFrame, text: str) -> DataFrame:
    """The rows without their text, with ``print``, ``root`` (a fingerprint that names the group) and ``component_id``."""
    rows = durable(with_fingerprint(docs, text, "print"))
    least = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(print_links(least.select("print")))
    classes = durable(least.join(roots, least["print"] == roots["node"], "left")
                      .select("print", "least", F.coalesce("root", "print").alias("root")))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(classes.join(ids, "root").select("print", "root", "component_id"), "print")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per document.

    Documents whose fingerprints differ in at most 3 bits are linked; the component id is the smallest document id
    reachable. Equal fingerprints are one node from the start, so copies cost nothing. Null texts count as empty,
    wordless texts have fingerprint 0 and are linked like any other; rows with a null id take part and carry the
    component's id (null if no member has one); repeated rows stay repeated; an empty table gives an empty result.
    """
    found = _members(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each near-duplicate group: the one with the smallest id, of a repeated id the one whose
    content digest is smallest, of rows equal in id and text any one. Rows with a null id come last in their group.
    Columns stay as they are."""
    key = free_name(docs, "__row")
    keyed = docs.withColumn(key, row_key(docs, [doc_id, text]))
    found = _members(keyed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(key).alias("row")), "text")
    kept = (found.withColumn("rank", F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
            .groupBy("root").agg(F.min("rank")["row"].alias("row")).select(F.col("row").alias(key)))
    # Rows equal in id and text fall together before anything is shuffled, however many there are.
    return keyed.dropDuplicates([key]).join(kept, key, "left_semi").drop(key)
