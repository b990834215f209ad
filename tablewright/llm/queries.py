"""The registered queries of this folder, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.durable import scratch_path
from tablewright.llm import byte_bpe, chat, cover_tree, edit_counts, line_dedup, merkle, mixing, packing, quality, simhash, twins, vantage, variants, warc
from tablewright.llm.common import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages")), path)
    found = warc.resolve(warc.read_archives(spark, path))
    return found.select(
        F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document its number of lines, and which of them repeat an earlier line of the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("mark"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    repeats = line_dedup.repeated_lines(docs).toDF("id", "text_mark", "places")
    joined = lines.join(repeats, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("text_mark")), "left")
    places = F.coalesce("places", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(places).cast("long").alias("n_repeated"), places.alias("repeated_lines"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(docs).select(*names)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its personal data is replaced."""
    docs = edit_counts.redactions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = edit_counts.apply(edit_counts.count(docs))
    return found.select("doc_id", "n_edits", "tokens_before", "tokens_after", "encoded_chars", F.size("leaf_chars").cast("long").alias("n_leaves"))


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = rows.unionByName(spark.createDataFrame(said, rows.schema))
    found = chat.read_back(chat.conversations(chat.linear_tree(rows)))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return found.select(
        F.expr("try_cast(substring_index(root, ':', 1) as long)").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs.where(~mixing.held_out("doc_id")))
    return mixing.score(docs, model).select(
        "doc_id", mixing.held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", "bits_per_byte",
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and whether the root shows that its text was tampered with."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.when(tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], {"text": lowered})


def op12_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors to every twentieth one; factor one, so that none is missed."""
    found = vantage.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.vocabulary(table(spark, sf_dir, "documents"), drop=97))


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_line_dedup, op3_quality_rules, op4_packing, op5_simhash, op6_byte_bpe, op7_edit_counts, op8_reply_trees, op9_context_mixing, op10_cover_tree, op11_merkle, op12_vantage_points, op13_spelling_variants)}
ORACLES = {"op1_warc_revisits": twins.WARC_REVISITS, "op3_quality_rules": twins.QUALITY_RULES, "op8_reply_trees": twins.REPLY_TREES}
ORACLES |= {"op11_merkle": twins.MERKLE, "op12_vantage_points": twins.VANTAGE_POINTS, "op13_spelling_variants": twins.SPELLING_VARIANTS}
