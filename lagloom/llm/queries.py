"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm import sharding
from lagloom.llm.common import documents
from lagloom.llm.query_sql import OP11_SQL, OP12_SQL, OP13_SQL

#: Where the public vocabularies are; an empty value stands for the installed package's folder.
TOKENIZERS = ""
#: The key of pseudonyms where spark.lagloom.pseudonym.key is not set.
DEMONSTRATION_KEY = "demonstration only"


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagloom.llm.katz import score_texts

    return score_texts(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagloom.llm.line_dedup import line_report

    return line_report(documents(spark, sf_dir))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(r.key) FILTER (WHERE r.last_id <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE r.key IS NULL OR r.last_id = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeated r ON k.key = r.key GROUP BY k.doc_id
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagloom.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, and the one it goes to when the first shard is lost."""
    docs = documents(spark, sf_dir)
    now = sharding.place(docs, "doc_id", sharding.lookup_table(spark))
    after = sharding.lookup_table(spark, sharding.SHARDS[1:]).withColumnRenamed("shard", "shard_after_loss")
    return now.join(F.broadcast(after), "slot").select(F.col("key").alias("doc_id"), "slot", "shard", "shard_after_loss")


def _fill_sql(name: str, shards: tuple[str, ...]) -> str:
    names = ", ".join(f"'{s}'" for s in shards)
    h = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
{name}_order AS (SELECT list({{'offset': {h.format("s || '/offset'")} % {sharding.SIZE}, 'skip': {h.format("s || '/skip'")} % ({sharding.SIZE} - 1) + 1}} ORDER BY s) AS o FROM (SELECT unnest([{names}]) AS s)),
{name}_fill AS (
  SELECT 0 AS turn, {sharding.SIZE} AS room, list_transform(range({len(shards)}), lambda x: 0) AS seen, list_transform(range({sharding.SIZE}), lambda x: -1) AS owner
  UNION ALL
  SELECT CASE WHEN free THEN (turn + 1) % {len(shards)} ELSE turn END, room - free::INT, seen[:turn] || [seen[turn + 1] + 1] || seen[turn + 2:],
    CASE WHEN free THEN owner[:slot] || [turn] || owner[slot + 2:] ELSE owner END
  FROM (SELECT *, owner[slot + 1] < 0 AS free FROM (SELECT f.*, ((o[turn + 1].offset + seen[turn + 1] * o[turn + 1].skip) % {sharding.SIZE})::INT AS slot FROM {name}_fill f, {name}_order WHERE room > 0))),
{name} AS (SELECT unnest(range(0, {sharding.SIZE})) AS slot, ([{names}])[unnest(owner) + 1] AS shard FROM {name}_fill WHERE room = 0)"""


OP4_SQL = f"""
WITH RECURSIVE {_fill_sql("now", sharding.SHARDS)},
{_fill_sql("later", sharding.SHARDS[1:])}
SELECT doc_id, d.slot::INT AS slot, now.shard, later.shard AS shard_after_loss
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SIZE} AS slot FROM documents) d
JOIN now ON now.slot = d.slot JOIN later ON later.slot = d.slot
"""


def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagloom.llm.prefix_counts import token_totals

    return token_totals(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), limit=4096)


def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagloom.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagloom.llm.winnow import edit_pairs

    return edit_pairs(documents(spark, sf_dir))


def op8_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagloom.llm.transducer import encode_documents

    return encode_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), digest=True)


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses replaced, under the session's key."""
    from lagloom.llm.pseudonyms import pseudonymize

    done = pseudonymize(documents(spark, sf_dir), spark.conf.get("spark.lagloom.pseudonym.key", DEMONSTRATION_KEY).encode())
    return done.select("doc.doc_id", "n_found", F.array_sort(F.map_keys("kinds")).alias("kinds"), F.col("pseudonyms").alias("text"))


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, word for word or with other numbers, names and units."""
    from lagloom.llm.templates import leaks

    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagloom.llm.suffix_array import remove_repeats

    return remove_repeats(documents(spark, sf_dir), digest=True)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lagloom.llm.variants import spelling_variants

    return spelling_variants(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; a document in five is checked as if its capitals had been lower-cased."""
    from lagloom.llm.merkle import manifest

    id_bytes = F.col("doc_id").cast("string").cast("binary")
    return manifest(documents(spark, sf_dir), tampered=F.coalesce(F.crc32(id_bytes) % 5 == 0, F.lit(False)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz_scores": op1_katz_scores,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_shard_placement": op4_shard_placement,
    "op5_prefix_token_counts": op5_prefix_token_counts,
    "op6_golay_simhash": op6_golay_simhash,
    "op7_winnowing": op7_winnowing,
    "op8_transducer_bpe": op8_transducer_bpe,
    "op9_feistel_pseudonyms": op9_feistel_pseudonyms,
    "op10_template_leaks": op10_template_leaks,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op4_shard_placement": OP4_SQL, "op11_suffix_array_dedup": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
