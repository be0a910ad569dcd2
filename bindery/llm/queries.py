"""The registered queries of this subpackage, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_code, tune
from . import ann, bpe, exact_dedup, fill_middle, hard_negatives, ngram_join, pack, pii, quotes, shard_tree, token_counts, toxicity, warc


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def add(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return fn(tune(spark), lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = Query(run, sql)
        return fn

    return wrap


@add("op9_exact_dedup", exact_dedup.SQL)
def op9(spark, read):
    return exact_dedup.exact_groups(read("documents"), hash_all=True)


def vocabulary() -> str:
    """The public byte-level vocabulary of this installation; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@add("op2_bpe_round_trip")
def op2(spark, read):
    return bpe.round_trip_digests(read("documents"), vocabulary())


@add("op4_packing")
def op4(spark, read):
    return pack.pack_documents(read("documents"), vocabulary())


@add("op8_ngram_jaccard_join")
def op8(spark, read):
    return ngram_join.join_components(read("documents"))


@add("op1_toxicity")
def op1(spark, read):
    scored = toxicity.score(read("documents"), toxicity.train(read("documents"), read("labels")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("toxic").alias("toxic_by_language"))


@add("op10_pii")
def op10(spark, read):
    found = pii.find(read("documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [count(i).alias(f"n_{name}") for i, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listing(F.col("spans")), 256).alias("base_sha256"), pii.listing(F.concat("spans", "more")).alias("spans"), F.size("more").cast("bigint").alias("n_found_by_context"))


@add("op6_nearest_vectors")
def op6(spark, read):
    return ann.nearest(read("embeddings"), F.col("vec_id") % 50 == 0)


@add("op3_warc_derivatives")
def op3(spark, read):
    return warc.derive(warc.responses(read("pages")))


@add("op5_token_counts")
def op5(spark, read):
    # The first identifier behind the vocabulary: no text can hold it.
    return token_counts.counts_of_documents(read("documents"), vocabulary(), 50257)


@add("op7_quote_linking", quotes.SQL)
def op7(spark, read):
    found = quotes.conversations(quotes.mails(read("conversations")))
    digest = F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256)
    path = F.array_join(F.col("path").cast("array<string>"), "/")
    return found.select(F.col("scope").alias("conv_id"), F.col("position").alias("turn"), "parent_id", "root_id", F.col("depth").cast("bigint").alias("depth"), path.alias("reply_path"), digest.alias("text_sha256"))


@add("op11_hard_negatives", hard_negatives.SQL)
def op11(spark, read):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read("embeddings"), F.col("vec_id") % 100 == 0, label)


@add("op12_shard_tree", shard_tree.SQL)
def op12(spark, read):
    return shard_tree.shard_rows(read("documents"), 8)


@add("op13_fill_middle", fill_middle.SQL)
def op13(spark, read):
    return fill_middle.round_trip_digests(read("documents"))
