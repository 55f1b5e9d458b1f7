"""One query per document operator over the given tables, and the SQL that checks those SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import (
    alignment,
    bpe,
    bwt_dedup,
    context_tree,
    line_dedup,
    lsa_vote,
    packing,
    pii_boost,
    prefix_trie,
    quality_rules,
    secret_automata,
    simhash_golay,
    templates,
    unigram,
)
from tallyflow.llm.common import bucket_of, documents, table

#: Where the tokenizer file is read from, unless a caller gives another path.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(documents(spark, sf_dir))
    failed = F.col("failed")
    base = failed.bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE))) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~quality_rules.rejected(failed)).alias("kept"),
        "failed",
        quality_rules.sole_rule(failed).alias("sole_rule"),
    )


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)
), repeated AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, failed,
       CASE WHEN bit_count(failed) = 1 THEN failed ELSE 0 END::BIGINT AS sole_rule
FROM f
"""

def op5_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    spec = bpe.read_spec(tokenizer)
    encoded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), spec)
    # The decoder gets the ids alone; the text that they came from goes no further.
    decoded = bpe.decode(encoded.select("doc_id", "ids"), spec)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.deduplicated(docs, removed="n_removed_lines").select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_kept_chars"),
        "n_removed_lines",
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP6_SQL = r"""
WITH line AS (
  SELECT doc_id, no, trim(x, e' \t\n\x0b\f\r') AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS no
        FROM documents WHERE text IS NOT NULL)
), spoken AS (
  SELECT doc_id, no, line, row_number() OVER d - 1 AS pos,
         sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER d AS upto,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM line WHERE line <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY no)
), win AS (
  SELECT s.doc_id, s.pos AS a, min(e.pos) AS b
  FROM spoken s JOIN spoken e ON s.doc_id = e.doc_id AND e.pos >= s.pos AND e.upto - s.upto + s.words >= 40
  GROUP BY ALL
), content AS (
  SELECT w.doc_id, w.a, w.b, string_agg(s.line, chr(10) ORDER BY s.pos) AS body
  FROM win w JOIN spoken s ON w.doc_id = s.doc_id AND s.pos BETWEEN w.a AND w.b GROUP BY ALL
), later AS (
  SELECT doc_id, a, b FROM content
  QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, a) > 1
), numbered AS (
  SELECT l.doc_id, x.no AS a, y.no AS b FROM later l
  JOIN spoken x ON x.doc_id = l.doc_id AND x.pos = l.a JOIN spoken y ON y.doc_id = l.doc_id AND y.pos = l.b
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS no FROM numbered
), kept AS (
  SELECT p.doc_id, string_agg(p.x, chr(10) ORDER BY p.no) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS no
        FROM documents WHERE text IS NOT NULL) p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.no = p.no) GROUP BY p.doc_id
), n AS (
  SELECT s.doc_id, count(*) AS n FROM spoken s JOIN gone g USING (doc_id, no) GROUP BY s.doc_id
)
SELECT d.doc_id, length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END)::BIGINT AS n_kept_chars,
       coalesce(n.n, 0)::BIGINT AS n_removed_lines,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_golay.components(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_boost.spans(documents(spark, sf_dir))
    names = F.array(*map(F.lit, pii_boost.NAMES))

    def digest(spans: str):
        part = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])
        return F.array_join(F.transform(spans, part), ",")

    def n(kind: int, name: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{name}")

    return found.select(
        F.col("id").alias("doc_id"),
        *[n(k, name) for k, name in enumerate(pii_boost.BASE)],
        F.sha2(digest("base"), 256).alias("base_sha256"),
        digest("spans").alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


def op3_lsa_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = lsa_vote.fit(docs.where(~held_out), labels)
    return lsa_vote.score(docs, model).select(
        F.col("id").alias("doc_id"),
        F.coalesce(bucket_of(F.col("id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def _digest(spans: str):
    """Lower-case hex of kind:start:end, comma-joined, of an array of spans; and the joined text."""
    part = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, part), ",")


def op4_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_automata.spans(documents(spark, sf_dir))

    def n(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *[n(kind) for kind in secret_automata.BASE],
        F.sha2(_digest("base"), 256).alias("base_sha256"),
        _digest("spans").alias("spans"),
        F.size("added").cast("bigint").alias("n_format"),
    )


def op8_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bwt_dedup.removed(documents(spark, sf_dir))
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["after"] - s["first"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        size.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_windows", "item_windows", "exact")


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 7) == 2, F.lit(False))
    training = docs.where(~held_out)
    tree = context_tree.fit(context_tree.counted(training))
    # Rows of one id and text have one score; ids may repeat.
    keyed = docs.withColumn("th", F.xxhash64("text"))
    scores = context_tree.score(keyed, tree, keep=("doc_id", "th")).dropDuplicates(["doc_id", "th"])
    scores = scores.withColumnsRenamed({"doc_id": "rid", "th": "rth"})
    base = unigram.scored(keyed, training, keep=("doc_id", "th"))
    found = base.join(scores, F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op11_packing(spark: SparkSession, sf_dir: str, tokenizer: str = WORDS) -> DataFrame:
    found = packing.packed(documents(spark, sf_dir), bpe.read_spec(tokenizer), capacity=4096, end=1)
    return found.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str, first: str = TOKENIZER, second: str = PIECES) -> DataFrame:
    found = alignment.alignments(documents(spark, sf_dir), bpe.read_spec(first), alignment.read_model(second))
    return found.select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.col("groups").alias("groups_sha256"),
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii_boost": op2_pii_boost,
    "op3_lsa_vote": op3_lsa_vote,
    "op4_secret_automata": op4_secret_automata,
    "op5_bpe": op5_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash_golay": op7_simhash_golay,
    "op8_bwt_dedup": op8_bwt_dedup,
    "op9_templates": op9_templates,
    "op10_context_tree": op10_context_tree,
    "op11_packing": op11_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_alignment": op13_alignment,
}
SQL = {"op1_quality_rules": OP1_SQL, "op6_line_dedup": OP6_SQL}
