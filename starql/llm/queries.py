"""The registered query of each text operator, with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff_lm import score_texts
from .bpe import bpe_encode
from .common import is_held_out, table
from .decontaminate import contaminated
from .exact_dedup import dedup_report
from .langid import identify_language
from .linkgraph import filter_urls
from .mil_quality import THRESHOLD, score_quality
from .mil_quality import fit as fit_quality
from .minhash_join import jaccard_classes
from .secret_crf import scan_secrets
from .suffix_dedup import remove_repeats


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    return identify_language(docs).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select(F.col("_id").alias("doc_id"), "class_id", "n_links")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = fit_quality(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    scored = score_quality(docs, model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return dedup_report(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    done = bpe_encode(docs, tokenizer_file(), decoded_col="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return contaminated(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = score_texts(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).otherwise(0.0)
    return done.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), mean.alias("mean_log_score"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    runs = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"])), ",")
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), runs.alias("removed"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256
FROM n
"""


#: All pairs over common 5-grams, and classes by transitive closure.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i : array_to_string(t[i:i + 4], ' '))
                                      WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n n1 ON x = n1.doc_id JOIN n n2 ON y = n2.doc_id WHERE k >= 0.8 * (n1.c + n2.c - k)
), r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id, least(d.doc_id, coalesce(m.low, d.doc_id)) AS class_id, CAST(coalesce(q.c, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN (SELECT x, min(y) AS low FROM r GROUP BY x) m ON d.doc_id = m.x LEFT JOIN (SELECT x, count(*) AS c FROM l GROUP BY x) q ON d.doc_id = q.x
"""


#: Every 400-byte window of every text, as hexadecimal digits.
OP10_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM b)),
d AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS first FROM d),
m AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM m GROUP BY doc_id, run),
e AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM r),
c AS (SELECT e.doc_id, sum(hi - lo) AS gone, count(*) AS runs, max(hi) AS last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept,
             string_agg(lo || ':' || hi, ',' ORDER BY lo) AS spans
      FROM e JOIN b ON e.doc_id = b.doc_id GROUP BY e.doc_id)
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256,
       CAST(len(h) // 2 - coalesce(gone, 0) AS BIGINT) AS n_kept, coalesce(spans, '') AS removed
FROM b LEFT JOIN c ON b.doc_id = c.doc_id
"""


#: Counts of 1-, 2- and 3-grams, joined to each occurrence; the occurrence that is scored is taken off n-gram and context.
OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
o AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
n1 AS (SELECT c, count(*) AS n FROM o GROUP BY ALL),
n2 AS (SELECT b, c, count(*) AS n FROM o WHERE b IS NOT NULL GROUP BY ALL),
n3 AS (SELECT a, b, c, count(*) AS n FROM o WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT o.doc_id, CASE WHEN n3.n > 1 THEN ln(n3.n - 1) - ln(h.n - 1)
             WHEN n2.n > 1 THEN ln(n2.n - 1) - ln(g.n - 1) + CASE WHEN o.a IS NULL THEN 0 ELSE ln(0.4) END
             ELSE ln(n1.n) - ln((SELECT sum(n) FROM n1)) + CASE WHEN o.b IS NULL THEN 0 WHEN o.a IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS v
      FROM o JOIN n1 ON o.c = n1.c LEFT JOIN n2 ON o.b = n2.b AND o.c = n2.c LEFT JOIN n3 ON o.a = n3.a AND o.b = n3.b AND o.c = n3.c
      LEFT JOIN n1 g ON o.b = g.c LEFT JOIN n2 h ON o.a = h.b AND o.b = h.c),
r AS (SELECT doc_id, count(*) AS n, sum(v) AS v FROM s GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, round(coalesce(v, 0), 6) AS log_score, round(coalesce(v / n, 0), 6) AS mean_log_score
FROM t LEFT JOIN r ON t.doc_id = r.doc_id
"""


def queries() -> dict:
    found = (op1_secret_scan, op2_language_id, op3_ngram_jaccard_join, op4_url_filter, op5_quality, op6_exact_dedup, op7_decontamination, op8_bpe, op9_lm_scoring, op10_suffix_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op9_lm_scoring": OP9_SQL, "op10_suffix_dedup": OP10_SQL}
