"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.llm import bpe, codes, decontaminate, fim, html, kdtree, language, mixing, neighbours, secrets, simhash, urllists, warc
from episcope.llm.registry import query, table

#: Target shares of the sources, in hundredths of bytes; every other source is in ``*``.
WEIGHTS = {"src0": 20, **{f"src{i}": 4 for i in range(1, 20)}, "*": 4}
BLOCK_BYTES = 1 << 18
SHARDS = 24
FIRST_DAY = "2019-01-01"


def document_size() -> F.Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)) + 8


def document_coordinates() -> list[F.Column]:
    return [kdtree.text_coordinate(F.col("lang")), kdtree.text_coordinate(F.col("source")),
            kdtree.number_coordinate(F.col("n_chars"))]


@query("op1_html_text")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """The visible text of every page."""
    return table(spark, sf, "pages").select("page_id", "url", html.visible_text(F.col("html")).alias("text"))


@query("op2_pfair_mix")
def pfair_mix(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, WEIGHTS, BLOCK_BYTES).select(
        "doc_id", "mix_source", "size", "start", "block", "release", "deadline", "slot", "position")


@query("op3_randomness_battery")
def randomness_battery(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf, "documents"))


@query("op4_minhash_containment")
def minhash_containment(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_cross_polytope")
def cross_polytope(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"))


@query("op6_language_fusion")
def language_fusion(spark: SparkSession, sf: str) -> DataFrame:
    model = language.fit_text_model(table(spark, sf, "documents"))
    return language.identify_pages(table(spark, sf, "pages"), model)


@query("op7_kd_tree_shards")
def kd_tree_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's shard and slot among 24 shards of near equal bytes."""
    docs = table(spark, sf, "documents")
    sharded = kdtree.shard_table(docs, ["doc_id"], document_coordinates(), document_size(), SHARDS)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


@query("op8_simhash_ball")
def simhash_ball(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def _number(c: F.Column) -> F.Column:
    """28 bits of a string's MD5."""
    return F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long")


def captures(pages: DataFrame) -> DataFrame:
    """The pages' addresses with a day of fetch within four years, drawn by the page id."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (_number(F.concat(F.lit("fetch"), F.col("page_id").cast("string"))) % 1460).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list about the pages: a fifth of all domains, hosts and path prefixes that occur is put on it, taken off and
    put on again, on days drawn by its name."""
    named = (pages.select(F.explode(urllists.keys_of(F.col("url"))).alias("x")).select("x.kind", "x.value").distinct()
             .withColumn("n", _number(F.concat_ws(":", "kind", "value"))).where("n % 5 = 0"))
    moved = named.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("i", F.col("i").cast("long"))
    return moved.select(
        (F.col("n") * 4 + F.col("i")).alias("entry_id"), "kind", "value",
        F.when(F.col("i") == 1, "remove").otherwise("add").alias("action"),
        F.when((F.floor(F.col("n") / 5) + F.col("i")) % 4 == 0, "allow").otherwise("block").alias("verdict"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("n") % 400 + F.col("i") * (100 + F.col("n") % 301)).cast("int")).alias("day"))


URL_SQL = r"""
WITH pages_ AS (
  SELECT page_id, url, DATE '2019-01-01' + CAST(CAST('0x' || substr(md5('fetch' || page_id), 1, 7) AS BIGINT) % 1460 AS INT) AS day,
         lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)', 1)) AS host,
         [x FOR x IN string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/') IF x <> ''] AS parts
  FROM pages),
keyed AS (
  SELECT page_id, day, 'domain' AS kind, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS value,
         len(string_split(host, '.')) - i + 1 AS weight
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM pages_ WHERE host <> '')
  UNION ALL SELECT page_id, day, 'host', host, 1000 FROM pages_ WHERE host <> ''
  UNION ALL SELECT page_id, day, 'prefix', host || '/' || array_to_string(list_slice(parts, 1, i), '/'), i + 1000000
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM pages_ WHERE host <> '')),
named AS (
  SELECT * FROM (SELECT DISTINCT kind, value, CAST('0x' || substr(md5(kind || ':' || value), 1, 7) AS BIGINT) AS n FROM keyed)
  WHERE n % 5 = 0),
entries AS (
  SELECT kind, value, i, CASE WHEN (n // 5 + i) % 4 = 0 THEN 'allow' ELSE 'block' END AS verdict,
         DATE '2019-01-01' + CAST(n % 400 + i * (100 + n % 301) AS INT) AS valid_from
  FROM named, (SELECT unnest([0, 1, 2]) AS i)),
valid AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY kind, value ORDER BY valid_from) AS valid_to FROM entries),
best AS (
  SELECT k.page_id, v.verdict, v.kind, v.value, v.valid_from, v.valid_to,
         row_number() OVER (PARTITION BY k.page_id ORDER BY k.weight DESC) AS r
  FROM keyed k JOIN valid v ON k.kind = v.kind AND k.value = v.value AND v.i <> 1 AND k.day >= v.valid_from
       AND (v.valid_to IS NULL OR k.day < v.valid_to))
SELECT p.page_id, p.url, p.day AS fetched, coalesce(b.verdict, 'none') AS verdict, b.kind, b.value, b.valid_from, b.valid_to
FROM pages_ p LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (page_id)
"""


@query("op9_temporal_lists", URL_SQL)
def temporal_lists(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return urllists.judge(captures(pages), list_entries(pages))


@query("op10_warc_round_trip", """
SELECT page_id, bytes AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN bytes >= 1000 AND page_id < own THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 1000 AND page_id < own THEN own END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY body) AS own
      FROM (SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes FROM pages))""")
def warc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


def _round_sql(i: int) -> str:
    """The codebooks of a round (those of round 0 are the first vectors' parts) and the nearest entry of each part."""
    book = "book0 AS (SELECT p, row - 1 AS e, x AS b FROM parts WHERE row <= 64)" if i == 0 else f"""
sums{i} AS (
  SELECT p, e, i, sum(CAST(x[i] AS HUGEINT)) AS s, count(*) AS n
  FROM near{i - 1}, (SELECT unnest(range(1, (SELECT len(x) FROM parts LIMIT 1) + 1)) AS i) GROUP BY p, e, i),
book{i} AS (
  SELECT p, e, coalesce(m, b) AS b
  FROM book{i - 1} LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM sums{i} GROUP BY p, e) USING (p, e))"""
    return book + f""",
near{i} AS (
  SELECT row, p, any_value(x) AS x, min({{'d': d, 'e': e}}).e AS e, min({{'d': d, 'e': e}}).d AS d
  FROM (SELECT row, p, e, x, list_sum([(x[i] - b[i]) * (x[i] - b[i]) FOR i IN range(1, len(x) + 1)]) AS d
        FROM parts JOIN book{i} USING (p))
  GROUP BY row, p)"""


CODES_SQL = f"""
WITH whole AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (
  SELECT row, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x
  FROM whole, (SELECT unnest(range(16)) AS p)),
{_round_sql(0)},
{_round_sql(1)},
{_round_sql(2)},
coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY row),
book AS (SELECT sha256(coalesce(string_agg(array_to_string(b, ','), ',' ORDER BY p, e), '')) AS h FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM whole JOIN coded USING (row), book
"""


@query("op11_active_lloyd_codes", CODES_SQL)
def active_lloyd_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every usable vector's code and its error after two rounds; codes as hexadecimal digits."""
    coded, books = codes.compress(table(spark, sf, "embeddings"), ["vec_id", "label"])
    return codes.label_errors(coded, "label").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


@query("op12_boundary_set_fim", r"""
WITH cut AS (
  SELECT *, h1 % (n + 1) AS a, h2 % (n + 1) AS b FROM (
    SELECT *, len(tokens) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                 regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS tokens
          FROM documents))),
parts AS (
  SELECT *, array_to_string(list_slice(tokens, 1, least(a, b)), '') AS prefix,
         array_to_string(list_slice(tokens, least(a, b) + 1, greatest(a, b)), '') AS middle,
         array_to_string(list_slice(tokens, greatest(a, b) + 1, n), '') AS suffix,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts""")
def boundary_set_fim(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in its form; the outputs and the texts restored from them as digests."""
    made = fim.fill_in_middle(table(spark, sf, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(back, 256).alias("restored_sha256"))


@query("op13_batched_bpe")
def batched_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids, and the text that they decode to, as digests."""
    import public_tokenizers

    vocabulary = bpe.share_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    both = bpe.encode_and_decode(F.col("text"), vocabulary)
    return table(spark, sf, "documents").select("doc_id", both.alias("x")).select(
        "doc_id", F.floor(F.length("x.ids") / 4).alias("n_tokens"), F.sha2("x.ids", 256).alias("ids_sha256"),
        F.sha2("x.decoded", 256).alias("decoded_sha256"))
