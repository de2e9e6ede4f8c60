"""The operators applied to their whole tables, with production parameters, and SQL to check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodiff.llm import bpe, ftrl, langid, leaks, lines, lm, mtree, near, quality, repeats, tokalign, toxicity, turns, vectors
from chronodiff.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return keep


@query(
    "op2_decontamination",
    r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, len(w[p:p + 9]) AS n, array_to_string(w[p:p + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
spots AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN its USING (doc_id)
""",
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document; the contract's digest columns."""
    found = leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op10_line_dedup",
    r"""
WITH d AS MATERIALIZED (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS MATERIALIZED (
  SELECT doc_id, p, a || chr(10) || b || chr(10) || c AS k
  FROM (SELECT doc_id, p, ls[p + 1] AS a, ls[p + 2] AS b, ls[p + 3] AS c
        FROM (SELECT doc_id, ls, unnest(generate_series(0, len(ls) - 3)) AS p FROM d WHERE len(ls) >= 3))
  WHERE NOT (trim(a, ' ') = '' AND trim(b, ' ') = '' AND trim(c, ' ') = '')),
later AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 2)) AS p FROM later),
l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS p, unnest(ls) AS line FROM d WHERE text IS NOT NULL),
kept AS (
  SELECT l.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.p) FILTER (gone.p IS NULL), '') AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.p = gone.p GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those removed as repeats, and a digest of the text that stays."""
    found = lines.line_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def vocab_file() -> str:
    """The byte-level vocabulary of the contract, as installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; digests of ids and decoded text."""
    found = bpe.encode(table(spark, sf_dir, "documents"), vocab_file(), decode=True)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def _judged(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every text, learned from the labels outside the held-out third."""
    docs, bucket = table(spark, sf_dir, "documents"), ftrl.crc_bucket(F.col("doc_id"), 3)
    model = quality.train(docs, table(spark, sf_dir, "labels").where(bucket != 1), "quality")
    return _judged(quality.score(docs, model), bucket == 1)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every text, learned from the labels outside the held-out fifth."""
    docs, bucket = table(spark, sf_dir, "documents"), ftrl.crc_bucket(F.col("doc_id"), 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(bucket != 0))
    return _judged(toxicity.score(docs, model), bucket == 0)


@query(
    "op5_minhash_near_dedup",
    r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)
""",
)
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups over three-word shingles at 85 of 100."""
    found = near.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents outside the held-out quarter."""
    docs, bucket = table(spark, sf_dir, "documents"), ftrl.crc_bucket(F.col("doc_id"), 4)
    found = langid.identify(docs, langid.train(docs.where(bucket != 2)))
    return found.select("doc_id", (bucket == 2).alias("held_out"), "lang_pred", "score")


@query(
    "op1_embedding_near_dedup",
    """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id WHERE r.root < l.b)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
FROM (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
""",
)
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at a cosine of 0.95; the smallest id of a group is kept."""
    found = vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


@query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-log-likelihood of every text under a network fitted to all of them."""
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs))


@query("op6_suffix_array_dedup")
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that 50-byte passages of earlier documents cover, and a digest of the rest."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with faults put in, what is wrong with each, and a digest of each as repaired."""
    rows = table(spark, sf_dir, "conversations")
    report, repaired = turns.repair(turns.damage(rows))
    found = report.join(turns.digest(repaired).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").withColumnRenamed("conv_id", "r")
    whole = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("r")), "left")
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def piece_file() -> str:
    """The sentencepiece model of the contract, as installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text under two tokenizers, their groups and links, and how common the links are."""
    found = tokalign.align_corpus(table(spark, sf_dir, "documents"), vocab_file(), piece_file())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query(
    "op11_top_k_search",
    """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(e, lambda x: floor(1024 * x)) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""",
)
def op11_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best others, by integer inner product, of every vector whose id is divisible by 100."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
