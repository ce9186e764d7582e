"""Named queries of the text operators over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsecart.llm import (
    bpe, decontaminate, fim, language, licenses, mixing, neardup, phrases, search, secrets, substrings, toxicity, urls,
)
from pulsecart.llm.common import fold, table


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows outside the held-out fold."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True))
    labels = table(spark, folder, "labels", "doc_id", "toxic").where(~held_out)
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.col("toxicity.n_toxic_windows").alias("n_toxic_windows"),
    )


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts of the fixed patterns and all spans."""
    found = secrets.scan(table(spark, folder, "documents", "doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True))
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs.drop("lang"), model)
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"),
    )


def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes of repeated strings of 100 bytes, as digests."""
    cut = substrings.remove(substrings.find(table(spark, folder, "documents", "doc_id", "text")))
    return cut.select(
        "doc_id", F.col("cut.n_bytes").alias("n_bytes"), F.col("cut.n_removed").alias("n_removed"),
        F.col("cut.n_spans").alias("n_spans"), F.sha2("cut.kept", 256).alias("kept_sha256"),
    )


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and blocks of every document."""
    found = licenses.scan(table(spark, folder, "documents", "doc_id", "text"))
    at = F.transform("places", lambda p: p["at"].cast("long"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.array_union("template_labels", "wrapped_labels"))), ",").alias("labels"),
        F.greatest("score", "wrapped_score", F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def vocabulary() -> tuple[str, str]:
    """Vocabulary file and pattern of the encoding queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and their bytes again, as digests."""
    path, pattern = vocabulary()
    encoded = bpe.encode(table(spark, folder, "documents", "doc_id", "text"), path, pattern)
    decoded = bpe.decode(encoded.select("doc_id", "ids"), path, pattern)
    return decoded.select(
        "doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents hold, within a fifth of their words."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return decontaminate.find_items(docs, table(spark, folder, "benchmark", "item_id", "text"))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents whose sets of 4-word shingles have a Jaccard similarity of 0.8."""
    return neardup.classes(table(spark, folder, "documents", "doc_id", "text"), words=4, percent=80)


def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 best vectors for each vector whose id is divisible by 100."""
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding")
    return search.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM v
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.c * c.c) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
  GROUP BY ALL
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

BLOCK_RULES = [("net", "/"), ("example.com", "/de/")]
ALLOW_RULES = [("example.net", "/en/"), ("org", "/fr/")]
# Words that, alone or between hyphens in a label, put a host on the list of unwanted hosts.
UNWANTED = ["adult", "ads", "bets", "casino", "pills", "spam", "warez", "xxx"]
_UNWANTED = rf"(^|[.-])({'|'.join(UNWANTED)})([.-]|$)"


def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = table(spark, folder, "pages", "page_id", "url")
    block = spark.createDataFrame(BLOCK_RULES, "host string, path string")
    allow = spark.createDataFrame(ALLOW_RULES, "host string, path string")
    judged = urls.judge(pages, block, allow, F.col("host").rlike(_UNWANTED))
    return judged.select("page_id", "host", "path", "rule", "verdict")


URLS_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
    END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '{_UNWANTED}') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut for filling in the middle, and its text again, as digests."""
    cut = fim.transform(fim.index(table(spark, folder, "documents", "doc_id", "text")))
    output, form = F.col("fim.output"), F.col("fim.form")
    return cut.select(
        "doc_id", F.col("rank_index.n").alias("n"), form.alias("form"), F.col("fim.prefix_chars").alias("prefix_chars"),
        F.col("fim.middle_chars").alias("middle_chars"), F.sha2(output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored(output, form).cast("binary"), 256).alias("restored_sha256"),
    )


FIM_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
    sha256('42:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents
), d AS (
  SELECT doc_id, text, tokens, len(tokens) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(tokens) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(tokens) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR h IS NULL OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT *, array_to_string(tokens[1:least(x, y)], '') AS prefix,
    array_to_string(tokens[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(tokens[greatest(x, y) + 1:], '') AS suffix
  FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    found = mixing.sample(table(spark, folder, "documents", "doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
    coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS digest
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS HUGEINT) AS everything,
    CAST(coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS before,
    CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS ahead
  FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, 2 * source_size, source NULLS LAST)
), c AS (
  SELECT *, (everything * 3 - before * 2) * weight >= CAST(cap AS HUGEINT) * 2 * ahead AS capped FROM o
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    CAST(everything * 3 - (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * 2 AS DOUBLE) * weight
      / ((sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) * 2) END AS target
  FROM c
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 1099511627776) AS HUGEINT) ELSE 0 END AS expected,
    CAST('0x' || substr(md5('42:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 10) AS HUGEINT) AS start
  FROM t
), r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.expected, e.start,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.digest, d.doc_id) AS HUGEINT) AS rank
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * ((rank * expected + start) // 1099511627776 - ((rank - 1) * expected + start) // 1099511627776) AS BIGINT) AS taken
FROM r
"""


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    return phrases.collocations(table(spark, folder, "documents", "text", "lang"))


COLLOCATIONS_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p
), i AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS nth FROM w
), g AS (
  SELECT lang, ws[nth] AS w1, ws[nth + 1] AS w2, ws[nth + 2] AS w3 FROM i
), f1 AS (
  SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL
), f2 AS (
  SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang
), longer AS (
  SELECT lang, w1, w2, max(f) AS most FROM (
    SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2 AS w1, w3 AS w2, f FROM f3
  ) GROUP BY ALL
), twos AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
    LEFT JOIN longer m ON m.lang = f2.lang AND m.w1 = f2.w1 AND m.w2 = f2.w2
  WHERE 100 * coalesce(m.most, 0) < 50 * f2.f
), threes AS (
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x.f AS l1, q.f AS r1, p.f AS l2, y.f AS r2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
    JOIN f2 p ON p.lang = f3.lang AND p.w1 = f3.w1 AND p.w2 = f3.w2 JOIN f2 q ON q.lang = f3.lang AND q.w1 = f3.w2 AND q.w2 = f3.w3
), cuts AS (
  SELECT lang, phrase, a, l, r, 1 AS k, CAST(a AS HUGEINT) * a * 1000000 // (CAST(l AS HUGEINT) * r) AS score FROM twos
  UNION ALL
  SELECT lang, phrase, a, l1, r1, 1, CAST(a AS HUGEINT) * a * 1000000 // (CAST(l1 AS HUGEINT) * r1) FROM threes
  UNION ALL
  SELECT lang, phrase, a, l2, r2, 2, CAST(a AS HUGEINT) * a * 1000000 // (CAST(l2 AS HUGEINT) * r2) FROM threes
), one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts) WHERE nth = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one
)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n.n,
  CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_secrets, op3_language, op4_substrings, op5_licenses, op6_bpe, op7_decontaminate, op8_near_duplicates, op9_top_k, op10_urls,
              op11_fill_in_middle, op12_mixing, op13_collocations)
}
SQL: dict[str, str] = {
    "op9_top_k": TOP_K_SQL, "op10_urls": URLS_SQL, "op11_fill_in_middle": FIM_SQL, "op12_mixing": MIXING_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
}
