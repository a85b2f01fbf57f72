"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens with false-discovery control.

DataFrame functions only; a text never leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.session import durable

# The kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the whole run: a run that is too short has no later start that is longer
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Alphabets by encoding, in the order in which they are tried.
ENCODINGS = (("digits", r"^[0-9]+$", _DIGITS), ("hex", r"^[0-9a-f]+$", "0123456789abcdef"), ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
             ("lower", r"^[a-z]+$", _LOWER), ("upper", r"^[A-Z]+$", _UPPER), ("letters", r"^[A-Za-z]+$", _UPPER + _LOWER),
             ("base32", r"^[A-Z2-7]+$", _UPPER + "234567"), ("base32 lower", r"^[a-z2-7]+$", _LOWER + "234567"),
             ("base32hex", r"^[0-9A-V]+$", _DIGITS + _UPPER[:22]), ("base32hex lower", r"^[0-9a-v]+$", _DIGITS + _LOWER[:22]),
             ("Crockford", r"^[0-9A-HJKMNP-TV-Z]+$", "0123456789ABCDEFGHJKMNPQRSTVWXYZ"),
             ("Crockford lower", r"^[0-9a-hjkmnp-tv-z]+$", "0123456789abcdefghjkmnpqrstvwxyz"),
             ("base36", r"^[0-9a-z]+$", _DIGITS + _LOWER), ("BASE36", r"^[0-9A-Z]+$", _DIGITS + _UPPER),
             ("base58", r"^[1-9A-HJ-NP-Za-km-z]+$", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"),
             ("base62", r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
             ("base64", r"^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
             ("base64url", r"", _UPPER + _LOWER + _DIGITS + "-_"))
# Letters a to z in a thousand of written English, German, French and Spanish; none below one.
LETTERS = ((82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 1),
           (65, 19, 31, 51, 174, 17, 30, 48, 76, 2.7, 12, 34, 25, 98, 25, 8, 1, 70, 73, 62, 44, 7, 19, 1, 1, 11),
           (82, 9, 34, 37, 175, 11, 9, 7.4, 73, 6, 1, 55, 30, 71, 58, 25, 14, 66, 79, 72, 63, 18, 1, 4, 3, 3),
           (122, 14, 45, 56, 135, 7, 10, 7, 66, 4.4, 1, 50, 32, 67, 92, 25, 9, 69, 80, 46, 39, 9, 1, 2, 9, 5))
# Fixed values of written language: chance that two letters, that three letters are equal, and changes between lower
# case, upper case, digits and signs per character, generously.
EQUAL_2, EQUAL_3, CHANGES = 0.065, 0.0058, 0.08
#: Each test of the battery accepts a truly random token but once in a thousand.
Z_LIMIT = 3.29
#: Steps of one twentieth of a power of ten in p; the histogram for false-discovery control has this many per stratum.
STEPS, MAX_STEP = 20, 600


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)  # never hand it the index too


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def _running(values: Column, chunk: int = 256) -> Column:
    """Inclusive running sums of an array of longs, by way of chunk totals, so long arrays stay cheap."""
    sums = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / chunk).cast("int") - 1),
                       lambda c: _total(F.slice(values, c * chunk + 1, chunk)))
    return _let(sums, lambda s: _let(
        F.transform(s, lambda x, c: _total(F.slice(s, 1, c))),
        lambda before: F.transform(values, lambda x, i: F.element_at(before, F.floor(i / chunk).cast("int") + 1)
                                   + _total(F.slice(values, F.floor(i / chunk).cast("int") * chunk + 1, i % chunk + 1)))))


def _spans(text: Column, found: Column, pattern: str) -> Column:
    """Code point spans of the matches of a pattern: what lies between the matches gives their places."""
    def ends(between: Column) -> Column:
        lengths = F.transform(found, lambda m, i: (F.length(m) + F.length(F.element_at(between, i + 1))).cast("long"))
        return _let(lengths, _running)

    # The pieces outnumber the matches by one.
    return F.when(F.size(found) > 0, F.zip_with(
        found, _let(F.split(text, pattern, -1), ends), lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"))))


def _normal_tail(z: Column) -> Column:
    """An upper bound of P(Z <= z) for z below 0, and 1 above (Chernoff)."""
    return F.when(z < 0, F.exp(-z * z / 2)).otherwise(1.0)


def _battery(token: Column) -> Column:
    """``(random, p)`` of a token: whether it passes the tests for a uniform draw from the alphabet of the encoding it
    seems to have, and a bound on the chance that written language looks so random, which shrinks with the length.

    Dashes and underscores are symbols only of tokens with lower case, upper case and digits (base64url); in others, as in
    UUIDs, they part groups and are left out. Digits alone never speak against written language."""
    body = F.regexp_replace(token, "=+$", "")
    grouped = body.rlike("[-_]") & ~(body.rlike("[a-z]") & body.rlike("[A-Z]") & body.rlike("[0-9]"))
    body = F.when(grouped, F.regexp_replace(body, "[-_]", "")).otherwise(body)
    alphabet = F.lit(ENCODINGS[-1][2])
    for _, pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(body.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def tests(b: Column, a: Column) -> Column:
        n, k = F.length(b).cast("double"), F.length(a).cast("double")
        symbols = F.split(b, "")  # linear in the length, which a lookup by place is not
        index = F.transform(symbols, lambda c: F.instr(a, c).cast("double"))
        # Symbols outside the alphabet (a mix of both base64 alphabets) count as one more symbol.
        counts = F.transform(F.sequence(F.lit(0), F.length(a)), lambda i: F.when(
            i > 0, F.length(b) - F.length(F.replace(b, F.substr(a, i, F.lit(1)), F.lit("")))).otherwise(0).cast("double"))
        # Names change the case of letters at will, so case counts only next to digits.
        cased = F.split(F.when(b.rlike("[0-9]"), b).otherwise(F.lower(b)), "")
        kind = F.transform(cased, lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3))
        folded = F.lower(b)
        letters = F.array(*[(F.length(b) - F.length(F.replace(folded, F.lit(x), F.lit("")))).cast("double") for x in _LOWER])

        def changes(x: Column) -> Column:
            return F.aggregate(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1),
                                          lambda p, q: (p != q).cast("double")), F.lit(0.0), lambda s, v: s + v)

        def total(x: Column) -> Column:
            return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))

        # No lambda below refers to a sum: it would be worked out again for each symbol. Sums of whole numbers are exact, so
        # none of them needs the deviations from the mean.
        def measured(x: Column) -> Column:
            squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
            chi = k / n * squares - n
            z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
            high = F.transform(x, lambda v: v > k / 2)
            n1 = total(high)
            pairs = 2 * n1 * (n - n1)
            z_runs = (changes(high) + 1 - (pairs / n + 1)) / F.sqrt(F.greatest(pairs * (pairs - n) / (n * n * (n - 1)), F.lit(1e-9)))
            mean = total(x) / n
            var = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) - n * mean * mean
            products = total(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda p, q: p * q))
            cov = products - mean * (2 * n * mean - F.element_at(x, 1) - F.element_at(x, -1)) + (n - 1) * mean * mean
            z_serial = (cov / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
            equal = (squares - n) / 2
            of = n * (n - 1) / 2
            z_equal = (equal - of * EQUAL_2) / F.sqrt(of * EQUAL_2 * (1 - EQUAL_2) + n * (n - 1) * (n - 2) * (EQUAL_3 - EQUAL_2 ** 2))
            rate, seen = n * CHANGES, changes(kind)
            p_changes = F.when(seen > rate, F.exp(-(seen * F.log(seen / rate) - seen + rate))).otherwise(1.0)
            # The likelihood ratio of a language's letters to equal ones is below c with a chance below c in that language.
            ratios = [F.aggregate(F.zip_with(letters, F.array(*[F.lit(math.log(26 * w / sum(own))) for w in own]), lambda c, w: c * w),
                                  F.lit(0.0), lambda s, v: s + v) for own in LETTERS]
            p_letters = F.exp(F.least(F.greatest(*ratios), F.lit(0.0)))
            both = F.greatest(p_changes * p_letters, F.lit(1e-300))  # Fisher's rule for two independent chances
            p = F.least(4 * F.least(_normal_tail(z_equal), p_changes, p_letters, both * (1 - F.log(both))), F.lit(1.0))
            passed = (z_chi <= Z_LIMIT) & (F.abs(z_runs) <= Z_LIMIT) & (F.abs(z_serial) <= Z_LIMIT) & (n1 > 0) & (n1 < n)
            return F.struct(passed.alias("random"), p.alias("p"))

        return _let(index, measured)

    return F.when(F.length(body) >= 12, _let(body, lambda b: _let(alphabet, lambda a: tests(b, a))))


def scan(docs: DataFrame, carry: list[str], text: str = "text", rate: float = 0.01) -> DataFrame:
    """The carried columns with ``base`` and ``spans``, arrays of ``(start, kind, end)`` with the kind's number, sorted.

    Base kinds are the fixed patterns, leftmost and non-overlapping per kind. Tokens of 20 characters and more outside
    them are added as ``random`` when they pass the battery (chi-squared uniformity, runs, serial correlation over the
    alphabet inferred from the character classes they hold) and their chance under written language survives
    Benjamini-Hochberg at ``rate`` among all tokens of their length class (powers of two) of the whole table. Null texts
    are empty; repeated rows are rows; an empty table gives an empty result. Texts of any length are scanned whole.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("carried"), t.alias("t"))
    rows = rows.select("carried", "t", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(n) for n, p in (
        ("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN))])
    value = F.when(F.size("assign") > 0, F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)))
    rows = rows.select(
        "carried", value.alias("value"), "token",
        *[_spans(F.col("t"), F.col(n), p).alias(f"{n}_at") for n, p in (
            ("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN))])
    empty = F.array().cast("array<struct<start:long,kind:int,end:long>>")

    def spans(kind: int, at: Column) -> Column:
        return F.coalesce(F.transform(at, lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))), empty)

    long_enough = F.filter("assign_at", lambda s, i: F.length(F.element_at("value", i + 1)) >= 8)
    rows = rows.select("carried", "token", "token_at", F.array_sort(F.concat(
        spans(0, long_enough), spans(1, F.col("access_at")), spans(2, F.col("hex_at")))).alias("base"))
    tested = F.zip_with("token", F.col("token_at"), lambda m, s: F.when(
        ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        _let(_battery(m), lambda r: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), r["random"].alias("random"),
            F.floor(F.log2(F.length(m).cast("double"))).cast("int").alias("stratum"),
            F.least(F.floor(-F.log10(F.greatest(r["p"], F.lit(1e-300))) * STEPS), F.lit(MAX_STEP)).cast("int").alias("step")))))
    rows = durable(rows.select("carried", "base", F.filter(F.when(F.size("token") > 0, tested), lambda x: x.isNotNull()
                                                            & x["step"].isNotNull()).alias("tested")))

    # Benjamini-Hochberg by length class, from a histogram of p: at most MAX_STEP rows for each power of two.
    counts = rows.select(F.explode("tested").alias("x")).groupBy("x.stratum", "x.step").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("step"))
    whole = Window.partitionBy("stratum")
    passed = (counts.withColumn("upto", F.sum("n").over(down)).withColumn("m", F.sum("n").over(whole))
              .where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("upto") / F.col("m"))
              .groupBy("stratum").agg(F.min("step").alias("step")).collect())
    accepted = F.lit(False)
    least = {r["stratum"]: r["step"] for r in passed}

    def found(x: Column) -> Column:
        ok = accepted
        for stratum, step in least.items():
            ok = ok | ((x["stratum"] == stratum) & (x["step"] >= step))
        return x["random"] & ok

    added = F.transform(F.filter("tested", found), lambda x: F.struct(
        x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return rows.select("carried.*", "base", F.array_sort(F.concat(F.col("base"), F.coalesce(added, empty))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts by fixed kind, a digest of the base spans and all spans."""
    found = scan(docs, [doc_id], text)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col(doc_id), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
