"""Registered queries of the operators in this package, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import alignment, chat, decontamination, fingerprints, html, language, minhash, mixing, neighbours, resampling, secrets, sharding, suffixes

SHARDS = 8
WEIGHTS = {"clean": 0.80, "low": 0.17, "toxic": 0.03}
DOMAIN = "case when toxic = 1 then 'toxic' when quality = 1 then 'clean' when quality = 0 then 'low' end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)[0]


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    hit = decontamination.hit_words()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.fit(docs, mixing.train(docs, table(spark, sf_dir, "labels"), F.expr(DOMAIN)), WEIGHTS)
    return mixing.apply(docs, mix, carry=["doc_id", "source"])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out()))
    return language.identify(docs, model, carry=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs.select("doc_id", "text"), secrets.train(docs))
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("secrets")).alias("spans"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.maximal(table(spark, sf_dir, "conversations")))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"]).withColumn("n_chars", html.n_chars())


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return (suffixes.remove_repeats(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    alike = lambda other: fingerprints.likeness(F.col("fingerprint"), F.col(other))
    written = lambda c: fingerprints.written(F.col(c))
    return fingerprints.with_edited(table(spark, sf_dir, "documents")).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), written("fingerprint").alias("fingerprint"),
        written("edited_fingerprint").alias("edited_fingerprint"), alike("edited_fingerprint").alias("near_edited"), alike("next.fingerprint").alias("near_next"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (alignment.align_documents(table(spark, sf_dir, "documents"), keep_groups=False)
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")))


Q = {f.__name__: f for f in (op1_embedding_near_dedup, op2_sharding, op3_decontamination, op4_mixing, op5_language, op6_secrets, op7_minhash, op8_chat, op9_html, op10_suffixes,
                               op11_fingerprints, op12_resampling, op13_alignment)}
SQL: dict[str, str] = {
    "op8_chat": """
        with logs as (select conv_id, list(struct_pack(r := coalesce(role, 'unknown'), t := coalesce(text, '')) order by turn, role, text) as turns
                      from conversations group by conv_id),
             one as (select min(conv_id) as conv_id, turns, count(*) as copies from logs group by turns)
        select a.conv_id, len(a.turns) as n_turns, a.copies,
               array_to_string(list_transform(a.turns, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>'), chr(10)) as text
        from one a where not exists (select 1 from one b where b.turns[1] = a.turns[1] and len(b.turns) > len(a.turns) and b.turns[1:len(a.turns)] = a.turns)""",
}
