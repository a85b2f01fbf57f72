"""Language identification by Bayesian fusion of text, declared markup language, address suffix and host priors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import free_name, row_key, small_side
from episcope.session import durable

#: Letters are told from the rest by this table over the Basic Multilingual Plane; code points beyond it count as letters.
LETTER = np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(1 << 16)])
BUCKETS = 1 << 15
#: Trigrams of one text overlap, so their joint evidence is counted at this power.
TEXT_POWER = 0.5
#: Texts are read in pieces of so many characters.
PIECE = 1 << 20
UNKNOWN = "und"
#: A text fits a language when its log likelihood per trigram lies less than this part of the way from the level of the
#: language's own labelled text down to that of uniform noise; a short text may miss it by so many standard errors.
NOISE_SHARE, STANDARD_ERRORS = 0.7, 2.0
NOISE = -float(np.log(BUCKETS))


def _trigrams(text: str):
    """Hashed letter trigrams of a text, piece by piece; every run of other characters counts as one blank."""
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = LETTER[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
        codes = np.where(letter, codes, 32)
        codes = codes[letter | np.concatenate([[True], letter[:-1]])]
        codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
        middle = codes[1:-1] != 32
        mixed = (codes[:-2] * np.uint64(1_000_003) + codes[1:-1]) * np.uint64(998_244_353) + codes[2:]
        mixed = (mixed ^ (mixed >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
        yield (mixed[middle] >> np.uint64(64 - 15)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of hashed trigrams, a row per language; bounded by languages x 2^15. ``level`` and ``spread`` are
    mean and deviation of a trigram's log probability in the language's own labelled text, each judged by the others."""
    languages: tuple[str, ...]
    log_p: np.ndarray
    level: np.ndarray
    spread: np.ndarray


def fit_text_model(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 20_000,
                   max_languages: int = 64) -> TextModel:
    """Trigram frequencies by language from a bounded sample of about ``sample_rows`` labelled rows (drawn by a hash of
    the text; all rows when there are fewer), with add-one smoothing. Rows without text or label are left out. More than
    ``max_languages`` labels are an error, as the model goes to every task."""
    rows = labelled.select(F.col(text).alias("text"), F.lower(F.trim(lang)).alias("lang")).where(
        "text is not null and lang is not null and lang <> ''")
    n = max(1, labelled.count())
    share = min(1.0, sample_rows / n)
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1)):
                own = sums.setdefault(name.as_py(), np.zeros(BUCKETS, np.int64))
                for grams in _trigrams(t.as_py()):
                    own += np.bincount(grams, minlength=BUCKETS)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])],
                                             names=["lang", "gram", "n"])

    counted = drawn.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = durable(counted)
    languages = tuple(r["lang"] for r in counted.select("lang").distinct().orderBy("lang").limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = np.zeros((len(languages), BUCKETS))
    for r in counted.collect():
        counts[languages.index(r["lang"]), r["gram"]] = r["n"]
    smooth = counts + 1.0
    total = smooth.sum(axis=1, keepdims=True)
    others = np.log(np.maximum(counts, 1.0) / total)  # add-one smoothing without the trigram itself
    weight = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    level = (weight * others).sum(axis=1)
    spread = np.sqrt((weight * (others - level[:, None]) ** 2).sum(axis=1))
    return TextModel(languages, np.log(smooth / total), level, spread)


def text_likelihoods(df: DataFrame, text: str, model: TextModel, carry: list[str]) -> DataFrame:
    """The carried columns, ``grams`` (trigrams seen) and ``loglik`` (log likelihood per language)."""
    table = df.sparkSession.sparkContext.broadcast(model.log_p)  # languages x 2^15 doubles at most

    def run(batches):
        log_p = table.value
        for batch in batches:
            out, grams = np.zeros((batch.num_rows, len(log_p))), np.zeros(batch.num_rows, np.int64)
            for i, t in enumerate(batch.column(batch.schema.get_field_index(text))):
                for g in _trigrams(t.as_py() or ""):
                    grams[i] += len(g)
                    out[i] += log_p[:, g].sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(log_p)),
                                             pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in carry]
                                             + [pa.array(grams), lists], names=[*carry, "grams", "loglik"])

    schema = df.select(*carry).withColumn("grams", F.lit(0).cast("long")).withColumn(
        "loglik", F.lit(None).cast("array<double>")).schema
    return df.select(*carry, text).mapInArrow(run, schema)


def softmax(log_p: Column) -> Column:
    top = F.array_max(log_p)
    weight = F.transform(log_p, lambda x: F.exp(x - top))
    return F.transform(weight, lambda x: x / F.aggregate(weight, F.lit(0.0), lambda a, b: a + b))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _log(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(x))


def _sums(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Languages' shares summed by key, as an array; partial sums come first, so a key with most rows is no hot group."""
    summed = df.groupBy(*by).agg(*[F.sum(F.element_at("share", i + 1)).alias(f"__{i}") for i in range(n)])
    return summed.select(*by, F.array(*[f"__{i}" for i in range(n)]).alias("sums"))


def _smoothed(sums: Column, parent: Column, strength: float, without: Column | None = None) -> Column:
    """Shares of languages under a prior worth ``strength`` rows; ``without`` takes a row's own part out of the sums."""
    left = sums if without is None else F.zip_with(sums, without, lambda s, w: F.greatest(s - w, F.lit(0.0)))
    total = F.aggregate(left, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(left, parent, lambda s, p: (s + strength * p) / (total + strength))


def identify(df: DataFrame, model: TextModel, text: Column, declared: Column, host: Column, domain: Column, suffix: Column,
             carry: list[str], strength: float = 5.0, trust: float = 2.0) -> DataFrame:
    """The carried columns with ``lang``, ``confidence``, ``declared``, ``text_lang``, ``grams`` and ``fits``, one row per row.

    Evidence, multiplied as in naive Bayes: the trigram likelihood of the text; P(declared language | language) and
    P(address suffix | language), counted over all rows by their text posteriors; and the host's prior, smoothed towards
    its domain's, that towards the whole collection's, and without the row's own part. A declaration starts with
    ``trust`` rows in favour of what it says. Null evidence (no declaration, no host, no suffix) has no say. A row without
    a single letter trigram is ``und`` with confidence 0, whatever else speaks for a language; so are null and empty
    texts. ``fits`` says whether the text is as likely as the labelled text of some language, which the posterior among
    the labelled languages cannot tell. Ties go to the language that comes first by name. Repeated rows are rows; an empty table gives an empty result.
    """
    names, n = list(model.languages), len(model.languages)
    if not n:
        return df.select(*carry, F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("confidence"),
                         F.lower(declared).alias("declared"), F.lit(UNKNOWN).alias("text_lang"), F.lit(0).cast("long").alias("grams"),
                         F.lit(False).alias("fits"))
    known = F.array(*[F.lit(x) for x in names])
    said = F.lower(F.substring_index(F.trim(declared), "-", 1))
    rows = df.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], text.alias("text"),
                     F.when(said.isNotNull() & (said != ""), F.when(F.array_contains(known, said), said).otherwise("*")).alias("said"),
                     F.lower(declared).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))
    kept = [f"__c{i}" for i in range(len(carry))] + ["said", "declared", "host", "domain", "suffix"]
    scored = text_likelihoods(rows, "text", model, kept)
    scored = durable(scored.withColumn("loglik", F.transform("loglik", lambda x: x * TEXT_POWER))
                     .withColumn("share", F.when(F.col("grams") > 0, softmax(F.col("loglik")))))

    flat = F.array(*[F.lit(1.0 / n)] * n)
    whole = scored.agg(*[F.sum(F.element_at("share", i + 1)).alias(f"s{i}") for i in range(n)]).head()
    total = [float(x or 0) for x in whole]
    base = F.array(*[F.lit((x + 1.0) / (sum(total) + n)) for x in total])

    def likelihood(by: str, start: Column) -> DataFrame:
        """log P(value | language) over the values of a column, each language's rows with ``start`` added."""
        sums = _sums(scored.where(F.col(by).isNotNull()), [by], n)
        return sums.select(by, F.zip_with(_plus(F.col("sums"), start), F.array(*[F.lit(x + trust * (n + 1)) for x in total]),
                                          lambda a, b: F.log(a / b)).alias(f"log_{by}"))

    agrees = F.transform(known, lambda x: F.when(x == F.col("said"), F.lit(trust * n)).otherwise(F.lit(trust / n)))
    by_said = likelihood("said", agrees)
    by_suffix = likelihood("suffix", F.transform(flat, lambda x: x * trust))
    by_host = _sums(scored.where(F.col("host").isNotNull()), ["domain", "host"], n)
    by_domain = by_host.groupBy("domain").agg(*[F.sum(F.element_at("sums", i + 1)).alias(f"d{i}") for i in range(n)])
    by_domain = by_domain.select("domain", F.array(*[f"d{i}" for i in range(n)]).alias("domain_sums"))
    hosts = (by_host.join(by_domain, by_host["domain"].eqNullSafe(by_domain["domain"]), "left")
             .select(F.col("host"), F.col("sums"), F.col("domain_sums")))

    own = F.coalesce(F.col("share"), F.transform(flat, lambda x: F.lit(0.0)))
    zero = F.transform(flat, lambda x: F.lit(0.0))
    of_domain = _smoothed(F.coalesce(F.col("domain_sums"), zero), base, strength, own)
    prior = F.when(F.col("sums").isNotNull(), _smoothed(F.col("sums"), of_domain, strength, own)).otherwise(base)
    fused = (scored.join(hosts, "host", "left").join(F.broadcast(by_said), "said", "left").join(by_suffix, "suffix", "left")
             .withColumn("log_post", _plus(_plus(F.col("loglik"), _log(prior)),
                                           _plus(F.coalesce("log_said", zero), F.coalesce("log_suffix", zero))))
             .withColumn("post", softmax(F.col("log_post"))))
    seen = F.col("grams") > 0
    floors = [level + NOISE_SHARE * min(NOISE - level, 0.0) for level in map(float, model.level)]
    fits = F.lit(False)
    for i, (floor, spread) in enumerate(zip(floors, map(float, model.spread))):
        fits = fits | (F.element_at("loglik", i + 1) / TEXT_POWER
                       >= floor * F.col("grams") - STANDARD_ERRORS * spread * F.sqrt("grams"))

    def best(p: Column) -> Column:
        return F.when(seen, F.element_at(known, F.array_position(p, F.array_max(p)).cast("int"))).otherwise(UNKNOWN)

    return fused.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], best(F.col("post")).alias("lang"),
                        F.when(seen, F.array_max("post")).otherwise(0.0).alias("confidence"), "declared",
                        best(F.col("share")).alias("text_lang"), "grams", (seen & fits).alias("fits"))


def visible_text(html: Column) -> Column:
    """Text for scoring: scripts, styles, comments, tags and entities become blanks."""
    return F.regexp_replace(F.coalesce(html, F.lit("")),
                            r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")


def identify_pages(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``identify`` for web pages: declared by the ``lang`` attribute of ``<html>``, host, registered domain (the last two
    labels) and suffix (the last label) from the address."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    said = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]+(?:-[A-Za-z0-9]+)*)""", 1)
    blank = lambda c: F.when(c != "", c)
    return identify(pages, model, visible_text(F.col(html)), blank(said), blank(host), blank(F.substring_index(host, ".", -2)),
                    blank(F.substring_index(host, ".", -1)), [page_id]).drop("fits")


def keep_known(docs: DataFrame, model: TextModel, text: str = "text", lang: str = "lang", source: str = "source",
               least: float = 0.5) -> DataFrame:
    """The documents whose language is told with confidence ``least`` or more; the label stands for the declaration and
    the source for the host. Rejected are texts without letters, those between languages, and those that fit no
    labelled language: other languages, noise, encoded data, patchworks of many languages. A label that the text
    contradicts is no reason to reject. Columns stay."""
    key = free_name(docs, "__row")
    keyed = docs.withColumn(key, row_key(docs, docs.columns))
    none = F.lit(None).cast("string")
    verdict = identify(keyed, model, F.col(text), F.col(lang), F.col(source), F.col(source), none, [key])
    rejected = durable(verdict.where((F.col("lang") == UNKNOWN) | ~F.col("fits") | (F.col("confidence") < least)).select(key).distinct())
    return keyed.join(small_side(rejected), key, "left_anti").drop(key)
