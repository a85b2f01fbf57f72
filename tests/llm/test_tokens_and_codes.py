"""Vector codes, fill-in-middle and BPE against brute force, round trips and the tokenizers library."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from episcope.llm import bpe, codes, fim, queries
from tests.conftest import rows

PATH = public_tokenizers.path("word_bpe_49k.json")


# 11 vector codes

def brute_codes(vectors, parts, entries, rounds):
    """Complete rescans with whole numbers of any size."""
    whole = [[int(np.floor(256 * float(x))) for x in v] for v in vectors]
    width = len(whole[0]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    for turn in range(rounds + 1):
        near = [[min((sum((a - b) ** 2 for a, b in zip(x[p], e)), i) for i, e in enumerate(books[p])) for p in range(parts)] for x in cut]
        if turn == rounds:
            return near, books
        for p in range(parts):
            for i in range(len(books[p])):
                own = [x[p] for x, n in zip(cut, near) if n[p][1] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own)]


@pytest.mark.parametrize("n, rounds", [(150, 2), (150, 4), (3, 2), (1, 1)])
def test_codes_against_full_rescans(spark, n, rounds):
    rng = np.random.default_rng(n)
    # Few distinct values: many ties, unused and unmoved entries.
    vectors = (rng.integers(-3, 4, (n, 8)) / 64).astype(np.float32)
    data = [(i, [float(x) for x in v], "ab"[i % 2] if i % 5 else None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label string").repartition(3)
    coded, books = codes.compress(df, ["vec_id", "label"], parts=4, entries=16, rounds=rounds)
    near, own = brute_codes(vectors, 4, 16, rounds)
    assert books.tolist() == own
    got = {r["vec_id"]: r for r in codes.label_errors(coded, "label").collect()}
    by_label = {}
    for i, row in enumerate(near):
        assert list(got[i]["code"]) == [e for _, e in row] and got[i]["error"] == sum(d for d, _ in row)
        by_label[data[i][2]] = by_label.get(data[i][2], 0) + got[i]["error"]
    assert {r["label"]: r["label_error"] for r in got.values()} == by_label


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (None, [-0.001] * 16, None), (2, None, 1), (3, [nan] + [0.0] * 15, 2),
            (4, [inf] + [0.0] * 15, 2), (5, [None] + [0.0] * 15, 2), (6, [0.25] * 16, 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("Code", F.lit("x")).withColumn("__row", F.lit(1))
    coded, books = codes.compress(df, df.columns[:1] + ["label", "Code", "__row"])
    assert coded.columns == ["vec_id", "label", "__row", "code", "error"]
    got = rows(codes.label_errors(coded.select("vec_id", "label", F.hex("code").alias("code"), "error"), "label").select("vec_id", "label", "code", "label_error"))
    # Equal vectors share the lower entry; -0.001 is floored to -1 and the null id comes last.
    assert got == sorted([(1, 1, "00" * 16, 0)] * 2 + [(6, 2, "02" * 16, 0), (None, None, "03" * 16, 0)], key=repr)
    assert books.shape == (16, 4, 1) and books[0, :, 0].tolist() == [128, 128, 64, -1]
    empty, books = codes.compress(df.limit(0), ["vec_id", "label"])
    assert empty.count() == 0 and codes.label_errors(empty, "label").count() == 0 and books.size == 0
    with pytest.raises(Exception, match="components"):
        codes.compress(df.limit(1).unionByName(df.limit(1).withColumn("embedding", F.expr("slice(embedding, 1, 8)"))), ["vec_id"])


def test_only_moved_entries_are_compared():
    rng = np.random.default_rng(7)
    part, book = rng.integers(-50, 50, (5000, 4)), rng.integers(-50, 50, (64, 4))
    code, distance = np.full(5000, -1), np.zeros(5000, np.int64)
    assert codes.reassign(part, book, np.ones(64, bool), code, distance) == 5000 * 64
    moved = np.zeros(64, bool)
    moved[[3, 40]] = True
    new = book.copy()
    new[moved] += rng.integers(-9, 9, (2, 4))
    rescanned = int(moved[code].sum())
    work = codes.reassign(part, new, moved, code, distance)
    assert work == rescanned * 64 + (5000 - rescanned) * 2
    full = ((part[:, None] - new[None]) ** 2).sum(axis=2)
    assert (code == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


# 12 fill in middle

@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 1 << 19), min_size=1, max_size=300), st.lists(st.tuples(st.integers(0, 1 << 19), st.integers(1, 70_000)), max_size=3),
       st.integers(1, 9))
def test_boundary_set_selects(single, runs, step):
    members = np.array(sorted(single.union(*[range(a, a + n, step) for a, n in runs])), np.int64)
    found = fim.BoundarySet(members)
    assert len(found) == len(members)
    for rank in {0, len(members) - 1, *np.random.default_rng(len(members)).integers(0, len(members), 200).tolist()}:
        assert found.select(rank) == members[rank]
    with pytest.raises(IndexError):
        found.select(len(members))


def test_every_kind_of_container():
    kinds = {fim.BoundarySet(np.array(m)).containers[0][0] for m in (range(0, 100, 3), range(0, 60_000, 3), range(5, 30_000))}
    assert kinds == {fim.ARRAY, fim.BITMAP, fim.RUN}


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text
    return (doc_id, len(tokens), "spm" if h4 % 100 < 80 else "psm", len(p), len(m),
            f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}")


def test_fim_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a", "é", "😀", " ", "\t\n", "word", "<", "P>", "S", " ", " x", "\x1c"], k=rng.randrange(40))) for _ in range(400)]
    texts += [None, "", " ", "\n\t ", "a", " a ", "<S", "<<S>", "x <P> y", "M><", "y " * 400_000, "z" * 1_000_000, "é " * 100_000 + " " * 70_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b c")] * 2 + [(7, "again and again")] * 2,
                                 "doc_id long, text string").withColumn("N", F.lit(1)).withColumn("output", F.lit("x"))
    made = fim.fill_in_middle(docs)
    given_ = rows(docs.select("doc_id", "text"))
    assert rows(made) == sorted([brute_fim(*r) for r in given_], key=repr)
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert rows(back) == sorted([(i, t or "") for i, t in given_], key=repr)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


# 13 BPE

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def odd_texts():
    rng = random.Random(11)
    pieces = ["the", "Straße", "ΣΑΣ", "é", "İ", "don't", "WE'LL", "'s", "123", "½", "你好世界", "😀", "👩‍👩‍👧", "...", "--", "<|endoftext|>", "<|startoftext|>",
              "<|endoftext", " ", "\n", " ", " ", "\x1c", "\x85", "​", "́", "﻿", "a_b", "\u0000", "aaaa", "\U0001e900", "Ᲊ"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(30))) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0xE000, 0x11000), rng.randrange(0x110000)])) for _ in range(40)).encode("utf-8", "ignore").decode()
              for _ in range(300)]
    return [*texts, None, "", " \n", "a" * 5000, "ab" * 3000, "a" * 513, "".join(rng.choices("abcdefghij", k=30_000)), "".join(rng.choices("aeinrst", k=600)), "word " * 100_000]


def test_bpe_against_the_library(spark, vocabulary, library):
    texts = odd_texts()
    encoder = bpe.Encoder(vocabulary)
    for at in range(0, len(texts), 64):
        for text, got in zip(texts[at:at + 64], encoder.encode(texts[at:at + 64])):
            assert got == ids_of(library, text), repr(text)[:200]
            assert bpe.decode_ids(vocabulary, got) == library.decode(np.frombuffer(got, "<u4").tolist(), skip_special_tokens=False)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    shared = bpe.share_vocabulary(spark, PATH)
    found = docs.withColumn("ids", bpe.encode(F.col("text"), shared)).withColumn("back", bpe.decode(F.col("ids"), shared)).collect()
    for r in found:
        assert bytes(r["ids"]) == ids_of(library, r["text"])
        assert r["back"] == bpe.decode_ids(vocabulary, bytes(r["ids"]))
    assert docs.limit(0).select(bpe.encode(F.col("text"), shared)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(vocabulary, library, text):
    assert bpe.Encoder(vocabulary).encode([text])[0] == ids_of(library, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abeinrst", min_size=1, max_size=200), min_size=1, max_size=30))
def test_rounds_and_buckets_agree(vocabulary, words):
    rounds = bpe._merge_rounds(vocabulary, *vocabulary.symbols(words))
    for w, ids in zip(words, rounds):
        assert bpe._merge_long(vocabulary, vocabulary.symbols([w])[0]).tolist() == ids.tolist()


def test_bpe_of_a_very_long_word(vocabulary, library):
    text = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    assert bpe.Encoder(vocabulary).encode([text])[0] == ids_of(library, text)


def test_long_texts_are_cut_at_white_space_only(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_CHARS", 7)
    texts = [t for t in odd_texts() if t and len(t) < 3000][:400]
    assert bpe.Encoder(vocabulary).encode(texts) == [ids_of(library, t) for t in texts]


def test_memory_of_words_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    encoder = bpe.Encoder(vocabulary)
    whole = [encoder.encode([f"w{i} w{i + 1}"])[0] for i in range(50)]
    assert len(encoder.known) <= 10 and whole == [bpe.Encoder(vocabulary).encode([f"w{i} w{i + 1}"])[0] for i in range(50)]


def test_bpe_query_over_all_documents(spark, sf, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.batched_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = ids_of(library, docs[r["doc_id"]])
        text = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
