"""One registered query an operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandspark.llm import (
    chat,
    decontam,
    fingerprint,
    html_text,
    langid,
    line_dedup,
    mixing,
    near_dup,
    periodic_runs,
    quality,
    token_align,
    token_count,
    topk,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: str, by: int):
    """crc32 of an id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(of).cast("string")) % by


@register("op1_mix_sources")
def op1(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register("op2_near_duplicates")
def op2(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL
),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS size FROM lines),
win AS (
  SELECT * FROM (
    SELECT doc_id, pos, least(size, 3) AS size, line AS a,
           lead(line) OVER w AS b, lead(line, 2) OVER w AS c
    FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
  ) WHERE (c IS NOT NULL OR (size < 3 AND pos = 0))
    AND NOT (trim(a) = '' AND coalesce(trim(b), '') = '' AND coalesce(trim(c), '') = '')
),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY size, a, b, c ORDER BY doc_id, pos) AS rn FROM win
  ) WHERE rn > 1
),
covered AS (
  SELECT DISTINCT doc_id, pos + i AS pos FROM later, (VALUES (0), (1), (2)) AS o(i)
),
kept AS (
  SELECT l.doc_id, l.pos, l.line, c.pos IS NOT NULL AS cut
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
)
SELECT d.doc_id, CAST(coalesce(max(k.pos) + 1, 0) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE k.cut) AS BIGINT) AS n_removed,
       CASE WHEN any_value(d.text) IS NOT NULL
            THEN md5(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE NOT k.cut), '')) END AS text_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
GROUP BY d.doc_id
"""


@register("op8_line_dedup", OP8_SQL)
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(F.col(c), "\n", -1))).cast("long")
    given = docs.withColumn("n_lines", count("text")).withColumn("was", F.length("text"))
    cut = line_dedup.dedup_lines(given)
    # a text that is now empty had all its lines cut, unless it was empty before
    left = F.when((F.col("text") == "") & (F.col("was") > 0), 0).otherwise(count("text"))
    return cut.select("doc_id", "n_lines", (F.col("n_lines") - left).alias("n_removed"), F.md5("text").alias("text_md5"))


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
),
item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)
),
found AS (
  SELECT d.doc_id, d.i, d.n, t.item FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.words = t.words
),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(len(w.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN items ON w.doc_id = items.doc_id
"""


@register("op9_decontamination", OP9_SQL)
def op9(spark, sf_dir):
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


@register("op10_language")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.learn(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register("op5_token_counts")
def op5(spark, sf_dir):
    import public_tokenizers

    counted = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@register("op6_quality")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(~held_out)
    model = quality.learn(docs.join(labels, "doc_id"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP3_SQL = """
WITH whole AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
  GROUP BY vec_id
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM scored
) WHERE rn <= 5
"""


@register("op3_top_k", OP3_SQL)
def op3(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@register("op4_main_text")
def op4(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH given AS (
  SELECT conv_id, turn, role = 'assistant' AS reply, replace(coalesce(role, 'user'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
turns AS (
  SELECT *, coalesce(bool_or(reply AND turn IS NULL) OVER c, FALSE) AS last_has_no_number, max(CASE WHEN reply THEN turn END) OVER c AS last,
         first_value(text) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS opening
  FROM given WINDOW c AS (PARTITION BY conv_id)
),
sides AS (
  SELECT conv_id, side, role, turn,
         CASE WHEN side = 'r' AND reply AND (CASE WHEN last_has_no_number THEN turn IS NULL ELSE turn = last END) THEN opening ELSE text END AS text
  FROM turns, (VALUES ('c'), ('r')) AS s(side)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS LAST, role, text) AS i,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line,
         length(role) + 5 AS head, length(role) + length(text) + 13 AS size
  FROM sides
),
cut AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id,
         coalesce(min(CASE WHEN c.role = r.role AND c.text = r.text THEN NULL ELSE coalesce(c.i, r.i) END) - 1, max(c.i)) AS n
  FROM (SELECT * FROM numbered WHERE side = 'c') c FULL JOIN (SELECT * FROM numbered WHERE side = 'r') r
       ON c.conv_id = r.conv_id AND c.i = r.i
  GROUP BY 1
),
placed AS (
  SELECT m.*, k.n, i > k.n AS rest,
         sum(CASE WHEN i > k.n THEN size ELSE 0 END) OVER (PARTITION BY m.conv_id, side ORDER BY i) - size AS pos
  FROM numbered m JOIN cut k ON m.conv_id = k.conv_id
)
SELECT conv_id AS pair_id, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE side = 'c' AND NOT rest), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE side = 'c' AND rest), '') AS chosen,
       coalesce(string_agg(CAST(CAST(pos + head AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + size AS BIGINT) AS VARCHAR), ',' ORDER BY i)
                FILTER (WHERE side = 'c' AND rest AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE side = 'r' AND rest), '') AS rejected,
       coalesce(string_agg(CAST(CAST(pos + head AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + size AS BIGINT) AS VARCHAR), ',' ORDER BY i)
                FILTER (WHERE side = 'r' AND rest AND role = 'assistant'), '') AS rejected_spans,
       count(*) FILTER (WHERE side = 'c' AND rest) > 0 AND count(*) FILTER (WHERE side = 'r' AND rest) > 0 AS usable
FROM placed GROUP BY conv_id
"""


@register("op7_preference_pairs", OP7_SQL)
def op7(spark, sf_dir):
    """Each whole conversation, against the same with an echo of its first turn as last reply; without a reply both are the same."""
    return preference_pairs(table(spark, sf_dir, "conversations"))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    turns = conversations.select("conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    of = Window.partitionBy("conv_id")
    # the order of format_preferences: null numbers last, then role and text
    place = F.struct(F.col("turn").isNull().alias("no_turn"), "turn")
    ordered = F.struct(place.alias("place"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("last", F.max(F.when(F.col("role") == "assistant", place)).over(of)).withColumn("opening", F.min(ordered).over(of)["text"])
    echo = F.when((F.col("role") == "assistant") & place.eqNullSafe(F.col("last")), F.col("opening")).otherwise(F.col("text"))
    pairs = chat.format_preferences(turns, turns.withColumn("text", echo))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["a"].cast("string"), F.lit("-"), s["b"].cast("string"))), ",").alias(c)
    return pairs.select("pair_id", "n_prompt_turns", "prompt", "chosen", spans("chosen_spans"), "rejected", spans("rejected_spans"), "usable")


@register("op11_align_tokenizers")
def op11(spark, sf_dir):
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_align.align_tokenizers(table(spark, sf_dir, "documents"), *paths)


@register("op12_fingerprints")
def op12(spark, sf_dir):
    found = fingerprint.fingerprints_beside_next(table(spark, sf_dir, "documents"))
    own = F.col("sketch")
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_string(own).alias("fingerprint"), fingerprint.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(own, F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(own, F.col("next_sketch")).alias("near_next"),
        fingerprint.containment(own, F.col("edited_sketch")).alias("kept_share"),
        fingerprint.distinct_shingles(own).alias("distinct_estimate"),
    )


@register("op13_periodic_runs")
def op13(spark, sf_dir):
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), edit=periodic_runs.planted)
