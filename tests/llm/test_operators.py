"""Operators of the training-data subpackage against brute force, with nulls, empty tables, ties and long texts."""

import datetime as dt
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from episcope.llm import common, decontaminate, html, kdtree, language, mixing, neighbours, queries, secrets, simhash, urllists, warc
from tests.conftest import rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1 HTML extraction

@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("plain  text", "plain text"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<ul><li>a<li>b</ul><ol start=3><li>c<li>d</ol>", "- a\n- b\n\n3. c\n4. d"),
    ("<head><title>t</title></head><body>x<script>var a='</p>';</script><b hidden>no</b>"
     "<i style='color:red; display: none'>no</i> y</body>", "x y"),
    ("<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>longer<td>2</table>", "name    n\na       10\nlonger  2"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("a &amp; b &lt;c&gt;<br>d</nope></p><", "a & b <c>\nd<"),
])
def test_html(source, text):
    assert html.extract(source).strip("\n") == text


def test_html_long_and_deep(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    df = spark.createDataFrame([(1, deep), (2, "<p>" + "y " * 300_000), (3, None)], "page_id long, html string")
    got = dict(rows(df.select("page_id", html.visible_text(F.col("html")))))
    assert got[1] == "x" and got[2].count("y") == 300_000 and got[3] == ""


@pytest.mark.parametrize("before, after", [("<div>" * 300, "</div>" * 300), ("<font><b><span>" * 100, ""), ("<div>" * 20_000, "")])
@pytest.mark.parametrize("source, text", [
    ("x<div hidden>no<i>no</i></div><p style='display:none'>no</p><noscript>no</noscript><template>no</template><b hidden>no</b> y", "x y"),
    ("<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>longer<td>2</table>", "name    n\na       10\nlonger  2"),
    ("<ul><li>a<li>b</ul><ol start=3><li>c<li>d</ol>", "- a\n- b\n\n3. c\n4. d"),
])
def test_html_below_any_depth(before, after, source, text):
    assert html.extract(before + source + after).strip("\n") == text


@pytest.mark.parametrize("piece", ["x<b", "<a ", "<!--", "<script", "</script ", "<a", "<a href='", "</", "<!", "<b><!--", "<i>x<b"])
@pytest.mark.parametrize("before", ["", "<p>a</p>", "<script>x>"])
def test_html_without_tag_ends_takes_linear_time(piece, before):
    began = time.perf_counter()
    html.extract(before + piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 6


@pytest.mark.parametrize("source, text", [
    ("a<b", "a<b"), ("a<p>b<i c", "a\n\nb<i c"), ("a<!-- b <i>c</i> d", "a"), ("a<!-- b --> d <!-->e", "a d"), ("a</p", "a"), ("a<script>b</script c", "a"),
    ("a<b title='>'>c</b>d", "acd"), ("a <x<b>c", "a c"),
])
def test_html_of_unended_tags(source, text):
    assert html.extract(source).strip("\n") == text


def test_html_hidden_ancestor_of_deep_elements():
    assert html.extract("<div hidden>" + "<div>" * 400 + "no" + "</div>" * 400 + "no</div>yes") == "yes"


# 2 mixing

def test_mix_stays_within_a_block(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame(
        [(i, "x" * rng.randrange(1, 60), None, rng.choice(["a", "a", "b", "c", None]), 1) for i in range(3000)], DOCS)
    weights, block = {"a": 5, "b": 2, "*": 3}, 200
    got = mixing.mix(docs, weights, block).collect()
    assert len(got) == 3000
    slots = {}
    for r in got:
        slots.setdefault(r["slot"], set()).add((r["mix_source"], r["block"]))
        assert r["release"] <= r["slot"] < r["deadline"]
    assert all(len(x) == 1 for x in slots.values())
    last = min(max(r["slot"] for r in got if r["mix_source"] == s) for s in weights)
    had = dict.fromkeys(weights, 0)
    for slot in range(last):
        (source, _), = slots[slot]
        had[source] += 1
        assert all(abs(had[s] - (slot + 1) * w / 10) < 1 for s, w in weights.items())
    ranks = sorted({(r["position"], r["slot"]) for r in got})
    assert [p for p, _ in ranks] == list(range(len(ranks))) and [s for _, s in ranks] == sorted(s for _, s in ranks)


def test_mixed_keeps_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, None, None), (2, "", "x")],
                                 "doc_id long, text string, source string").withColumn("slot", F.lit(7)).withColumn("Size", F.lit("s"))
    got = mixing.mixed(docs, {"x": 1, "*": 1}, 1)
    assert got.columns == docs.columns and rows(got) == rows(docs)
    assert mixing.mixed(docs.limit(0), {"x": 1}, 10).count() == 0


# 3 secrets

PATTERN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in PATTERN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_long_random_tokens_take_linear_time(spark):
    rng, letters = random.Random(4), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    tokens = ["".join(rng.choices(letters, k=n)) for n in (1000, 50_000, 200_000)]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(tokens)], "doc_id long, text string")
    took = []
    for i in range(3):
        began = time.perf_counter()
        row = secrets.secret_report(docs.where(f"doc_id = {i}")).first()
        took.append(time.perf_counter() - began)
        assert row["spans"] == f"random:2:{2 + len(tokens[i])}"
    assert took[2] < 60 and took[2] - took[1] < 12 * max(1.0, took[1])  # four times the symbols


def test_secrets_against_patterns(spark, sf):
    rng = random.Random(2)
    pieces = ["password=hunter22x", "Secret : 'short'", 'api_key": "abcDEF123456"', "AKIA" + "A1B2" * 4, "AKIAA", "AKIAAKIA" + "9" * 9,
              "0f" * 16, "0f" * 15, "ÜTOKEN==abcdefghij", "token=token=abcdefgh1", "😀 passwd=😀", "apikey:  zzzzzzzzz", "\n", "é"]
    texts = [" ".join(rng.choices(pieces, k=12)) if i % 2 else "".join(rng.choices(pieces, k=9)) for i in range(200)]
    texts += [None, "", "x" * 200_000 + " password=abcdefgh1 " + "y" * 200_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in secrets.secret_report(docs).collect():
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [spans.count(k) for k in ("assign", "access", "hex")]
        assert set(spans.split(",")) - {""} <= set(r["spans"].split(","))
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.randomness_battery(spark, sf).collect():
        assert r["base_sha256"] == hashlib.sha256(base_spans(given[r["doc_id"]]).encode()).hexdigest()
    assert secrets.secret_report(docs.limit(0)).count() == 0


def test_battery_tells_random_tokens_from_names(spark):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = ["".join(rng.choices(letters, k=40)) for _ in range(100)]
    plain = [f"internationalization_of_the_words_{w}_number{i}" for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 25)]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(drawn + plain)], "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.secret_report(docs).collect() if "random" in r["spans"]}
    assert len([i for i in found if i < 100]) >= 90 and not [i for i in found if i >= 100]


def test_battery_finds_every_alphabet_at_every_length(spark):
    rng = random.Random(31)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"base36": lower + digits, "BASE36": lower.upper() + digits, "lower": lower, "upper": lower.upper(), "letters": lower + lower.upper(),
                 "base32": lower.upper() + "234567", "base32 lower": lower + "234567", "HEX": digits + "ABCDEF",
                 "base62": lower + lower.upper() + digits, "base64": lower + lower.upper() + digits + "+/",
                 "base64url": lower + lower.upper() + digits + "-_"}
    made = [(name, n, "".join(rng.choices(a, k=n))) for name, a in alphabets.items() for n in (24, 40, 64, 128) for _ in range(100)]
    made += [("uuid", 36, "-".join("".join(rng.choices("0123456789abcdef", k=n)) for n in (8, 4, 4, 4, 12))) for _ in range(100)]
    words = "patient record status update of the weekly laboratory surveillance report from every regional hospital network".split()
    for _ in range(100):
        w = [rng.choice(words) for _ in range(rng.randrange(4, 16))]
        made += [("snake", 0, "_".join(w)), ("path", 0, "/".join(w)), ("camel", 0, w[0] + "".join(x.title() for x in w[1:])),
                 ("run", 0, "".join(w)), ("digits", 0, str(rng.randrange(10 ** 30)).zfill(30))]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, (_, _, t) in enumerate(made)], "doc_id long, text string").repartition(8)
    found = {r["doc_id"] for r in secrets.secret_report(docs).collect() if "random" in r["spans"]}
    got, of = {}, {}
    for i, (name, n, _) in enumerate(made):
        of[name, n] = of.get((name, n), 0) + 1
        got[name, n] = got.get((name, n), 0) + (i in found)
    for (name, n), hits in got.items():
        if name in ("snake", "path", "camel", "run", "digits"):
            assert hits <= 0.02 * of[name, n], (name, hits)
        else:  # 24 letters alone can look like words
            assert hits >= (0.75 if n == 24 else 0.85) * of[name, n], (name, n, hits)


# 4 decontamination

def brute_contained(docs, items, threshold=0.8):
    out = set()
    for d, t in docs:
        for i, x in items:
            ask = decontaminate.words(x)
            if not ask:
                continue
            n = min(5, len(ask))
            own, want = decontaminate.shingle_set(decontaminate.words(t), n), decontaminate.shingle_set(ask, n)
            if len(want & own) >= threshold * len(want) - 1e-9:
                out.add((d, i, len(want & own), len(want)))
    return out


def test_containment_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice([1, 3, 5, 6, 20, 80]), 300)) for i in range(30)] + [(100, ""), (101, None), (102, "a b c a b c")]
    docs = []
    for i in range(200):
        words = prose(rng, rng.choice([0, 2, 30, 400]), 300).split()
        if i % 3 == 0:
            item = (rng.choice(items)[1] or "").split()
            for _ in range(i % 4):
                if item:
                    item[rng.randrange(len(item))] = "changed"
            words[len(words) // 2:len(words) // 2] = item
        docs.append((i, " ".join(words).upper() if i % 5 == 0 else ", ".join(words)))
    docs += [(500, None), (501, ""), (502, "a b c a b c")]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("__doc", F.lit(2))
    right = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(left, right)
    assert {(r["doc_id"], r["item_id"], r["shared"], r["shingles"]) for r in got.collect()} == brute_contained(docs, items)
    kept = decontaminate.remove_contaminated(left, right)
    hit = {d for d, *_ in brute_contained(docs, items)}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - hit and kept.columns == left.columns
    assert decontaminate.contaminated(left.limit(0), right).count() == 0
    assert decontaminate.remove_contaminated(left, right.limit(0)).count() == left.count()


def test_items_without_an_id(spark):
    rng = random.Random(41)
    texts = [prose(rng, 20, 300) for _ in range(5)]
    big = (1 << 53) + 1
    ids = [None, None, big, None, 7]
    items = spark.createDataFrame([*zip(ids, texts), (9, texts[3]), (None, None), (None, "a")], "item_id long, text string").coalesce(1)
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(texts)] + [(5, "clean words only"), (6, texts[0] + " " + texts[1])],
                                 "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["copies"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(0, None, 1), (1, None, 1), (2, big, 1), (3, 9, 2), (4, 7, 1), (6, None, 1)}
    assert decontaminate.contaminated(docs, items).where("doc_id = 6").count() == 2
    assert [r["doc_id"] for r in decontaminate.remove_contaminated(docs, items).collect()] == [5]


# 5 neighbours

def brute_nearest(vectors, k=5, every=50):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    norms = np.linalg.norm(x, axis=1)
    out = {}
    for at, q in enumerate(ids):
        if q % every == 0:
            score = x @ x[at] / norms / norms[at]
            order = [i for i in np.lexsort((ids, -np.round(score, 12))) if i != at][:k]
            out[q] = [(ids[i], score[i]) for i in order]
    return out


def test_neighbours_recall(spark, sf):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    vectors = {i: v for i, v in vectors.items() if len(v) and np.isfinite(v).all() and v.any()}
    truth, got = brute_nearest(vectors), {}
    for r in queries.cross_polytope(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(truth)
    hits = sum(len({v for v, _ in truth[q]} & {v for v, _ in got[q].values()}) for q in truth)
    assert hits >= 0.9 * sum(map(len, truth.values()))
    for q, found in got.items():
        for v, score in found.values():
            exact = vectors[q] @ vectors[v] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[v])
            assert abs(score - exact) < 1e-12


def test_neighbours_odd_vectors(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]),
            (7, [1.0]), (8, []), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (50, [0.0, 1.0]), (100, [float("inf"), 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0][:2] == [(0, 1, 1), (0, 2, 2)] and not {g[2] for g in got} & {3, 4, 5, 6, 7, 8, 100}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_neighbours_are_never_short(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    vectors = {i: centre + rng.normal(size=64) * 1e-3 for i in range(1, 500) if i % 50}
    vectors |= {50 * i: rng.normal(size=64) for i in range(1, 6)}  # five outliers find at most four of each other
    tables = [vectors] + [{50 * i: rng.normal(size=64) for i in range(n)} for n in range(2, 7)]
    for vectors in tables:
        df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
        got = {}
        for r in neighbours.nearest(df).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        truth = brute_nearest(vectors)
        assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in truth.items()}
        if len(vectors) < 7:
            assert {q: [x[i + 1] for i in range(len(x))] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in truth.items()}


# 6 language

def test_language_of_pages(spark, sf):
    got = {r["page_id"]: r for r in queries.language_fusion(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    told = [(got[p["page_id"]]["lang"], m[1]) for p in pages if (m := re.search(r"//[^/]+/(en|de|fr|es)/", p["url"] or ""))]
    told = [x for x in told if x[0] != language.UNKNOWN]
    assert len(told) > len(pages) / 2 and sum(a == b for a, b in told) >= 0.9 * len(told)


def test_language_rejects_only_what_has_no_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit_text_model(docs)
    odd = spark.createDataFrame([(-1, None, "en", "a", 0), (-2, "", None, None, None), (-3, "12 34 !!", "de", "b", 8)], DOCS)
    clean = docs.where("lang is not null and length(text) > 300").limit(50)
    kept = language.keep_known(clean.unionByName(odd).withColumn("post", F.lit(1)), model)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in clean.collect()}
    assert language.keep_known(docs.limit(0), model).count() == 0


def test_language_rejects_foreign_texts_and_noise(spark, sf):
    rng = random.Random(6)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心" * 2,
        *[" ".join("".join(rng.choices(letters, k=rng.randrange(2, 10))) for _ in range(40)) for _ in range(20)],
        *["".join(rng.choices(letters + letters.upper() + "0123456789+/", k=200)) for _ in range(20)]]
    planted = spark.createDataFrame([(-1 - i, t, ("en", "es", None)[i % 3], "src0", len(t)) for i, t in enumerate(odd)], DOCS)
    clean = docs.where("text rlike '[A-Za-z]'")
    kept = language.keep_known(clean.unionByName(planted), language.fit_text_model(docs))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert not [i for i in ids if i < 0] and len(ids) == clean.count()


# 7 shards

def shards_hold(got, n, shards, share):
    assert len(got) == n
    load = [0] * shards
    slots = {}
    for r in got:
        body = (r["text"] or "").encode()
        assert r["size"] == len(body) + 8 and r["text_crc32"] == zlib.crc32(body)
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load) - min(load) <= share * sum(load) / shards, load


def test_shards_have_equal_bytes(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame(
        [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["en", "de", None]), "src0" if i % 3 == 0 else f"src{i % 19}", None if i % 11 == 0 else i)
         for i in range(6000)] + [(i, "the same text " * 9, "en", "src0", 1) for i in range(6000, 9000)], DOCS).withColumn("SHARD", F.lit("x"))
    got = kdtree.kd_shards(docs, queries.document_coordinates(), queries.document_size(), 24).collect()
    shards_hold(got, 9000, 24, 0.1)
    whole = {}
    for r in got:
        if r["doc_id"] < 6000:
            whole.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in whole.values())


def test_every_dimension_is_cut(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, f"text {i} " * rng.randrange(1, 9), rng.choice(["en", "de", "fr", "es"]), f"src{rng.randrange(20)}", rng.randrange(1, 20_000))
                                  for i in range(3000)], DOCS)
    seen, medians = [], kdtree._medians
    monkeypatch.setattr(kdtree, "_medians", lambda *a: seen.append(medians(*a)) or seen[-1])
    got = kdtree.kd_shards(docs, queries.document_coordinates(), queries.document_size(), 24).collect()
    shards_hold(got, 3000, 24, 0.1)
    assert {c["axis"] for level in seen for c in level.values()} == {0, 1, 2}


def test_numbers_follow_the_files(spark, tmp_path):
    spark.range(1000).repartition(4).write.parquet(f"{tmp_path}/a")
    read = spark.read.parquet(f"{tmp_path}/a")
    for df in (read, read.where("id % 3 = 0"), spark.range(50), read.limit(0), read.unionByName(read)):
        got = common.numbered(df, "n")
        assert got.columns == [*df.columns, "n"] and sorted(r["n"] for r in got.collect()) == list(range(df.count()))
    first, again = (sorted(map(tuple, common.numbered(read, "n").collect())) for _ in range(2))
    assert first == again


def test_shards_of_little(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "", None, None, None), (None, "a", "en", "s", 1)], DOCS)
    for part in (docs, docs.limit(0)):
        got = kdtree.kd_shards(part, queries.document_coordinates(), queries.document_size(), 24).collect()
        assert len(got) == part.count() and all(0 <= r["shard"] < 24 for r in got)
    big = kdtree.kd_shards(docs, queries.document_coordinates(), queries.document_size(), target_bytes=10).collect()
    assert len(big) == 3


# 8 SimHash

def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Union by all pairs of distinct fingerprints; the smallest member of each group."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    found = sorted(root)
    for i, a in enumerate(found):
        for b in found[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in found}


def test_simhash_against_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "One", "one", "two words", "Ä Ö Ü", "a b c", "x y z x y z x y z"]
    for _ in range(40):
        words = prose(rng, rng.choice([3, 40, 300])).split()
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
            texts.append("\n".join(words).upper())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "One")], "doc_id long, text string")
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    roots = slow_components(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == least[roots[prints[r["doc_id"]]]]
    one = simhash.keep_one(docs.withColumn("row", F.lit(1)).withColumn("__row", F.lit(2)))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(least.values()) and "__row" in one.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_links_of_crowded_fingerprints(spark):
    """Chains, stars and crowds of near fingerprints, larger than what is compared pair by pair."""
    rng = random.Random(9)
    prints = set()
    for centre in (0, rng.getrandbits(64), rng.getrandbits(64)):
        prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(22) for b in range(22) if rng.random() < 0.5}
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(120)}
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(42, 64), 3)) for _ in range(80)}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    pairs = [(signed[r["u"]], signed[r["v"]]) for r in simhash.print_links(df).collect()]
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for a, b in pairs:
        root[find(a)] = find(b)
    truth, groups, own = slow_components(prints), {}, {}
    for p in prints:
        groups.setdefault(truth[p], set()).add(p)
        own.setdefault(find(p), set()).add(p)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in own.values()}


# 9 URL lists

def test_lists_as_of_the_fetch(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    entries = spark.createDataFrame([
        (1, "domain", "a.org", "add", "block", day(10)), (2, "domain", "a.org", "remove", None, day(20)),
        (3, "host", "x.a.org", "add", "allow", day(12)), (4, "prefix", "x.a.org/p/q", "add", "block", day(12)),
        (5, "domain", "a.org", "add", "allow", day(400)), (6, "domain", "a.org", "add", "block", day(400)),
        (7, "domain", None, "add", "block", day(1)), (8, None, "b.org", "add", "block", day(1)), (9, "domain", "b.org", "add", "block", None),
    ], "entry_id long, kind string, value string, action string, verdict string, day date")
    asked = [("http://a.org/", day(9), "none"), ("http://a.org/", day(10), "block"), ("http://a.org", day(19), "block"),
             ("http://a.org/", day(20), "none"), ("http://a.org/", day(400), "block"), ("http://a.org/", day(5000), "block"),
             ("http://X.A.org:80/p", day(15), "allow"), ("https://u:p@x.a.org/p/q/r?x=/", day(15), "block"),
             ("http://y.a.org/p/q", day(15), "block"), ("http://xa.org/", day(15), "none"), ("http://b.org/", day(15), "none"),
             (None, day(15), "none"), ("", day(15), "none"), ("nonsense", day(15), "none"), ("http://a.org/", None, "none"),
             ("http://a.org/", day(10), "block")]
    captures = spark.createDataFrame([(u, d, w) for u, d, w in asked], "url string, fetched date, want string").withColumn("Kind", F.lit("k"))
    got = urllists.judge(captures, entries).collect()
    assert len(got) == len(asked) and all(r["verdict"] == r["want"] for r in got)
    assert urllists.judge(captures.limit(0), entries).count() == 0
    assert {r["verdict"] for r in urllists.judge(captures, entries.limit(0)).collect()} == {"none"}


# 10 WARC

def test_warc_round_trip(spark):
    rng = random.Random(10)
    big, same, edge = "".join(rng.choices("abcdé", k=9_000_000)) * 2, "s" * 1000, "e" * 999
    data = [(1, "http://a/", "<p>x"), (2, None, None), (3, "", ""), (4, "http://é/ %41\n", same), (5, "u", same), (9, "u", same),
            (6, "u", edge), (7, "u", edge), (8, "u", big), (10, "u", "\0\r\n\r\nWARC/1.1\r\n" * 99)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert set(got) == {d[0] for d in data}
    for i, _, h in data:
        body = (h or "").encode()
        assert got[i]["payload_bytes"] == len(body) and got[i]["payload_digest"] == hashlib.sha1(body).hexdigest()
        again = i in (4, 5)
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 9) if again else ("response", None))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    one = warc.record("urn:1", "response", "u", None, 5, hashlib.sha1(b"hello").hexdigest(), b"hello")
    assert [r[6] for r in warc.records_of(one + warc.EMPTY + one)] == [b"hello", b"hello"]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records_of(one[:-12]))
    forged = warc.record("urn:1", "response", "u", None, 5, hashlib.sha1(b"other").hexdigest(), b"hello")
    assert [r[7] for r in warc.records_of(forged)] == [False]
