"""The queries of this subpackage, one per operator, and the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import byte_bpe, cross_polytope, importance, line_templates, mixed_language, norm_topk, packing, simhash, soft_mixing, suffix_dedup, turn_repair, url_rules, warc_fixity
from parley.llm.common import table

#: Shares of tokens that op5 and the pipeline aim at.
DOMAIN_WEIGHTS = {"clean": 0.90, "low_quality": 0.08, "toxic": 0.02}
#: The given rules of op3: verdict, and host with path prefix.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Records of one WARC file, and the records that op10's second replica has damaged.
FILE_RECORDS, DAMAGE_EVERY, DAMAGE_AT = 1024, 97, 5

Query = Callable[[SparkSession, str], DataFrame]


def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_templates.counted(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled through the labels of the same id: block if toxic or of low quality."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("toxic").eqNullSafe(1) | F.col("quality").eqNullSafe(0), "block").when(F.coalesce("toxic", "quality").isNotNull(), "allow").alias("label"))
    mined = url_rules.mine(pages.select("page_id", "url").join(labels, "page_id"))
    return url_rules.judge(pages, URL_RULES, mined).drop("url")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash, label) of the documents in the labels table: toxic, low_quality or clean. The hash, null
    for a null text, stands in for the text where rows are only chosen."""
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    content = F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash")
    return docs.select("doc_id", "text", content).join(labels.select("doc_id", label.alias("label")).where("label is not null"), "doc_id")


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = soft_mixing.fit(domain_labels(docs, table(spark, sf_dir, "labels")))
    mixed = soft_mixing.mix(docs, model, DOMAIN_WEIGHTS)
    shares = [F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(model[0])]
    return mixed.select("doc_id", "tokens", "rate", "copies", *shares)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixed_language.train(docs.where(~mixed_language.held_out("doc_id")))
    found = mixed_language.identify(docs, model)
    return found.select("doc_id", mixed_language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = byte_bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokenizer.digest(table(spark, sf_dir, "documents"))


def op9_norm_bucketed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files of FILE_RECORDS ids each, audited against a replica in which every
    DAMAGE_EVERY-th record has one byte changed."""
    pages = table(spark, sf_dir, "pages")
    record = warc_fixity.record_of(F.col("page_id"), F.col("url"), F.col("html"))
    first = pages.where("page_id is not null").select(F.floor(F.col("page_id") / FILE_RECORDS).cast("long").alias("file"), F.col("page_id").alias("ordinal"), record.alias("record"))
    hit = F.col("ordinal") % DAMAGE_EVERY == DAMAGE_AT
    # The last character of the payload's place: X becomes Y, any other X, so the record always changes.
    at = F.length("record") - 6
    other = F.when(F.substring("record", at, F.lit(1)) == "X", "Y").otherwise("X")
    second = first.withColumn("record", F.when(hit, F.overlay("record", other, at)).otherwise(F.col("record")))
    return warc_fixity.audit(first, second).select("file", "ordinal", "start", "stop", "status")


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with planted faults, chosen by the CRC-32 of `conv_id:turn` modulo 20 (nulls: one space): 0 drops the row,
    1 empties its text, 2 removes the text's `.`, `!` and `?`, 3 repeats the row, 4 sets its role to user."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = turn_repair.summary(turn_repair.repair(damaged(turns))).withColumnRenamed("conv_id", "of")
    all_of = turns.select("conv_id").distinct()
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    filled = [F.coalesce(c, F.lit(nothing[c]) if c in nothing else F.lit(0).cast("long")).alias(c) for c in turn_repair.SUMMARY]
    return all_of.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *filled)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, seed=42)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_cross_polytope_ann, op2_line_templates, op3_url_rules, op4_simhash_near_dedup, op5_soft_mixing, op6_language_id, op7_suffix_array_dedup, op8_byte_bpe, op9_norm_bucketed_topk, op10_warc_fixity, op11_turn_repair, op12_importance_resampling, op13_best_fit_packing)}


OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) w from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id vec_id, cast(list_inner_product(q.w, c.w) as bigint) score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 10
"""


OP10_SQL = """
with r as (select page_id // 1024 file, page_id "ordinal_id", 'WARC/1.0'||chr(13)||chr(10)||'WARC-Type: resource'||chr(13)||chr(10)||'WARC-Record-ID: <urn:page:'||page_id||'>'||chr(13)||chr(10)
  ||'WARC-Target-URI: '||coalesce(url,'')||chr(13)||chr(10)||'Content-Type: text/html'||chr(13)||chr(10)||'Content-Length: '||strlen(coalesce(html,''))||repeat(chr(13)||chr(10),2)||coalesce(html,'')||repeat(chr(13)||chr(10),2) rec
  from pages where page_id is not null),
o as (select file, ordinal_id, row_number() over w - 1 "ordinal", sum(strlen(rec)) over (w rows unbounded preceding) stop, strlen(rec) size from r window w as (partition by file order by ordinal_id))
select file, "ordinal", cast(stop - size as bigint) "start", cast(stop as bigint) stop, 'differs' status from o where ordinal_id % 97 = 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_norm_bucketed_topk": OP9_SQL, "op10_warc_fixity": OP10_SQL}
