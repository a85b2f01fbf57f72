"""BPE encoding and decoding: batched merge rounds over many words at once.

For vocabularies with an end-of-word suffix whose white space parts words and is dropped. The vocabulary file is read by
the driver (tens of thousands of tokens) and broadcast, so executors need no copy of it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words of more symbols than this are merged by rank buckets, whose cost follows the merges and not rounds x length.
LONG_WORD = 512
#: A worker remembers the ids of so many words, none longer than 32 characters, and then starts anew.
REMEMBERED, REMEMBERED_CHARS = 120_000, 32
#: Texts are encoded in groups of about so many characters, long ones in pieces.
GROUP_CHARS = 1 << 19
#: Words merged in the same rounds.
WORDS = 20_000
NONE = np.int64(1) << 40
_CHUNK, _BLANK, _FAR = re.compile(r"[^ \t-\r]+"), re.compile(r"[ \t-\r]"), re.compile("[^\0-\u02ff]")


class Vocabulary:
    """The tables of a BPE vocabulary: sorted pair keys with their ranks and results, symbols of bytes, tokens; and how it
    parts a text into words, as its own normalizer and splitter do."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, added = held["model"], held["added_tokens"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or held["decoder"] is not None:
            raise ValueError("a BPE vocabulary with an end-of-word suffix and no decoder is needed")
        if model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError("only plain merges are known")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens are matched in the raw text only")
        steps = [x["type"] for x in held["normalizer"]["normalizers"]], [x["type"] for x in held["pre_tokenizer"]["pretokenizers"]]
        split, level = held["pre_tokenizer"]["pretokenizers"]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or (
                split["behavior"], split["invert"], level["add_prefix_space"], level["use_regex"]) != ("Removed", True, False, False):
            raise ValueError("texts in lower case, and words found by a pattern, are needed")
        # Both objects can be pickled; the merges are done here.
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self._check_near()
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.symbol, self.last = (np.array([ids[c + end] for c in letters], np.int64) for end in ("", suffix))
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs))
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made  # rank = line of the merge list
        # A merge list is in order if no symbol takes part in a pair before it can be made. Then all places of the lowest
        # pair can be merged at once; else the result could depend on the order of the places.
        first = np.full(max(ids.values()) + 1, NONE)
        np.minimum.at(first, left, np.arange(len(made)))
        np.minimum.at(first, right, np.arange(len(made)))
        if (first[made] < np.arange(len(made))).any():
            raise ValueError("the merge list uses a symbol before it makes it")
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if added else None
        tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        self.tokens = np.array([tokens.get(i, "") for i in range(max(tokens) + 1)], object)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols by binary search; NONE for pairs that do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def words(self, text: str) -> list[str]:
        """The words of a text. White space parts them, so a text may be cut there."""
        if not _FAR.search(text):
            return self.pattern.findall(text.lower())
        found = []
        for c in _CHUNK.findall(text):
            if _FAR.search(c):  # tables of Unicode differ between libraries, normal forms too
                found += [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(c))]
            else:
                found += self.pattern.findall(c.lower())
        return found

    def _check_near(self) -> None:
        """Below U+0300 nothing is composed, and the short way gives what the vocabulary's own rules give."""
        for c in map(chr, range(0x300)):
            for s in (f"a{c}b1{c}!{c}{c}", c):
                own = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(s))]
                if own != self.pattern.findall(s.lower()):
                    raise ValueError(f"U+{ord(c):04X} is treated otherwise")

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes as symbols in one flat array, and the place where each word starts."""
        held = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(held), np.uint8)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(sizes)
        out = self.symbol[flat]
        out[ends - 1] = self.last[flat[ends - 1]]
        return out, ends - sizes


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones of Latin-1 are themselves, the others
    follow from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
    return [others.get(b, chr(b)) for b in range(256)]


def merge_words(v: Vocabulary, words: list[str]) -> list[np.ndarray]:
    """The ids of each (non-empty) word."""
    found: list = [None] * len(words)
    short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
    for i, w in enumerate(words):
        if len(w) > LONG_WORD:
            found[i] = _merge_long(v, v.symbols([w])[0])
    for at in range(0, len(short), WORDS):
        own = short[at:at + WORDS]
        flat, starts = v.symbols([words[i] for i in own])
        for i, ids in zip(own, _merge_rounds(v, flat, starts)):
            found[i] = ids
    return found


def _merge_rounds(v: Vocabulary, flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Rounds over all words at once: each word merges all places of its lowest-ranked pair, left to right; words without a
    pair leave the array."""
    names, done = np.arange(len(starts)), [flat[:0]] * len(starts)
    rank = _pair_ranks(v, flat, starts)
    while len(names):
        sizes = np.diff(np.append(starts, len(flat)))
        lowest = np.minimum.reduceat(rank, starts)
        over = lowest == NONE
        if over.any():
            for k in np.flatnonzero(over):
                done[names[k]] = flat[starts[k]:starts[k] + sizes[k]].copy()
            stay = np.repeat(~over, sizes)
            flat, rank, names, sizes, lowest = flat[stay], rank[stay], names[~over], sizes[~over], lowest[~over]
            starts = np.cumsum(sizes) - sizes
            if not len(names):
                break
        word = np.repeat(np.arange(len(names)), sizes)
        at = np.flatnonzero(rank == lowest[word])
        # Equal neighbours overlap (a a a): of a run of places each second one is merged, from the left.
        new_run = np.append(True, np.diff(at) != 1) | np.append(True, np.diff(word[at]) != 0)
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        flat[at] = v.made[rank[at]]
        keep = np.ones(len(flat), bool)
        keep[at + 1] = False
        sizes = sizes - np.bincount(word[at], minlength=len(names))
        place = np.cumsum(keep) - 1
        flat, rank, at = flat[keep], rank[keep], place[at]
        starts = np.cumsum(sizes) - sizes
        touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
        is_last = np.zeros(len(flat), bool)
        is_last[starts + sizes - 1] = True
        rank[touched] = np.where(is_last[touched], NONE, v.rank(flat[touched], flat[np.minimum(touched + 1, len(flat) - 1)]))
    return done


def _pair_ranks(v: Vocabulary, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    rank = np.append(v.rank(flat[:-1], flat[1:]), NONE)
    rank[starts[1:] - 1] = NONE
    return rank


def _merge_long(v: Vocabulary, flat: np.ndarray) -> np.ndarray:
    """One word of any length: places wait in a bucket for each rank, a round takes the lowest bucket, and what a merge
    changes goes to the buckets of its new ranks."""
    n = len(flat)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = _pair_ranks(v, flat, np.zeros(1, np.int64))
    buckets: dict[int, list[np.ndarray]] = {}
    lowest: list[int] = []

    def put(places: np.ndarray) -> None:
        places = places[rank[places] < NONE]
        places = places[np.argsort(rank[places], kind="stable")]
        own = rank[places]
        for part in np.split(places, np.flatnonzero(np.diff(own)) + 1):
            if len(part):
                r = int(rank[part[0]])
                if r not in buckets:
                    heapq.heappush(lowest, r)
                buckets.setdefault(r, []).append(part)

    put(np.arange(n))
    while lowest:
        r = heapq.heappop(lowest)
        at = np.unique(np.concatenate(buckets.pop(r)))
        at = at[rank[at] == r]  # others were changed meanwhile
        if not len(at):
            continue
        new_run = np.append(True, after[at[:-1]] != at[1:])
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        gone = after[at]
        flat[at], after[at], rank[gone] = v.made[r], after[gone], NONE
        flat[gone] = -1
        follow = at[after[at] < n]
        before[after[follow]] = follow
        touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
        nexts = after[touched]
        rank[touched] = np.where(nexts < n, v.rank(flat[touched], flat[np.minimum(nexts, n - 1)]), NONE)
        put(touched)
    return flat[flat >= 0]


class Encoder:
    """Encodes texts in groups of bounded size and remembers the ids of short words."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = []
        waiting: list[tuple[int, str, bool]] = []
        chars = 0
        for row, text in enumerate(texts):
            out.append([])
            for piece, special in self._pieces(text or ""):
                waiting.append((row, piece, special))
                chars += len(piece)
                if chars >= GROUP_CHARS:
                    self._flush(waiting, out)
                    waiting, chars = [], 0
        self._flush(waiting, out)
        return [b"".join(own) for own in out]

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of the text between added tokens, cut at white space when long, and the added tokens."""
        at, special = 0, self.v.special
        for m in special.finditer(text) if special else ():
            yield from self._cut(text, at, m.start())
            yield m[0], True
            at = m.end()
        yield from self._cut(text, at, len(text))

    @staticmethod
    def _cut(text: str, at: int, end: int) -> Iterator[tuple[str, bool]]:
        while at < end:
            blank = _BLANK.search(text, at + GROUP_CHARS, end) if end - at > GROUP_CHARS else None
            to = blank.start() if blank else end
            yield text[at:to], False
            at = to

    def _flush(self, waiting: list[tuple[int, str, bool]], out: list[list[bytes]]) -> None:
        v, known = self.v, self.known
        parted = [None if special else v.words(piece) for _, piece, special in waiting]
        fresh = list({w for own in parted if own for w in own if w not in known})
        found = {w: ids.astype("<u4").tobytes() for w, ids in zip(fresh, merge_words(v, fresh))}
        known.update(found)
        for (row, piece, _), own in zip(waiting, parted):
            out[row].append(np.array([v.added[piece]], "<u4").tobytes() if own is None else b"".join([known[w] for w in own]))
        for w in fresh:
            if len(w) > REMEMBERED_CHARS:
                del known[w]
        if len(known) > REMEMBERED:
            self.known = {}


def decode_ids(v: Vocabulary, ids: bytes | None) -> str | None:
    """The tokens of the ids, special ones too, joined by spaces as the vocabulary has no decoder; ids without a token
    give none."""
    if ids is None:
        return None
    i = np.frombuffer(ids, "<u4")
    tokens = v.tokens[i[i < len(v.tokens)]]
    return " ".join(t for t in tokens if t)


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary's tables, sent once to each executor (a few MB, whatever the data)."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def encode(text: Column, vocabulary: Broadcast) -> Column:
    """The ids of a text: a binary of little-endian unsigned 32-bit integers.

    Null and empty texts and texts of white space have no ids. Texts are encoded whole, repeated ones alike. Special
    tokens written in a text get their ids, as the library does it; none are added.
    """
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary.value)
        for texts in batches:
            yield pd.Series(encoder.encode(texts), dtype=object)

    return run(F.coalesce(text, F.lit("")))


def encode_and_decode(text: Column, vocabulary: Broadcast) -> Column:
    """``ids`` as ``encode`` gives them and ``decoded``, the text that they decode to, in one pass through Python."""
    @F.pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary.value)
        for texts in batches:
            ids = encoder.encode(texts)
            yield pd.DataFrame({"ids": ids, "decoded": [decode_ids(vocabulary.value, i) for i in ids]}, dtype=object)

    return run(F.coalesce(text, F.lit("")))


def decode(ids: Column, vocabulary: Broadcast) -> Column:
    """The text of ids as ``encode`` gives them; null stays null, no ids give the empty text."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in batches:
            yield pd.Series([decode_ids(vocabulary.value, i) for i in own], dtype=object)

    return run(ids)
