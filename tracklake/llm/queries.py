"""The registered queries of the corpus operators and their DuckDB texts."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package
from . import ann, bytebpe, dac, hostrules, jaccard, langid, merkle, neardup, packing, sharding, spans, toxicity, whitening
from .common import crc_of_id, stage, table

QUERIES = {}
ORACLES = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, trained on those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs.filter(crc_of_id() % 3 != 1))
    labelled = langid.label_documents(docs.select("doc_id", "text"), net, drop=("text",))
    return labelled.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "lang_pred", "score")


@query
def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of all documents with the verdicts on their hosts."""
    measured = hostrules.document_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    measured = stage(measured.drop("text"), "rules")
    judged = hostrules.apply_verdicts(measured, hostrules.host_verdicts(measured))
    return judged.select("doc_id", *hostrules.MEASURES, "base_failed", "kept", "host_rejected")


ORACLES["op3_host_rules"] = hostrules.oracle()


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents and their bytes decoded again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bytebpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, drop=("text",))
    encoded = encoded.withColumn("n_tokens", (F.length("ids") / 4).cast("long")).withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = bytebpe.decode_documents(encoded, ranks, public_tokenizers.PATTERN, drop=("ids",))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, copies together where they fit."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


@query
def op6_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as directly addressable codes and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tracklake-dac-{uuid.uuid4().hex}"
    dac.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    docs = dac.read_tokens(spark, path)
    return docs.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048,
                                  keep_ids=False)
    return packing.pack(pieces, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32",
                                                      "sequence_id", "offset")


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packed_pieces(table(spark, sf_dir, "documents"))


@query
def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the repeated spans of sentences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.dedup_spans(docs)


@query
def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def toxicity_tagger(spark: SparkSession, sf_dir: str) -> toxicity.Tagger | None:
    """Trained on labelled documents whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter(crc_of_id() % 5 != 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.train(docs.join(labels, "doc_id"))


@query
def op10_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity_tagger(spark, sf_dir), spans=True, drop=("text",))
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted",
                         F.size("toxic_spans").alias("n_spans"))


@query
def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened by the 16 largest components of their covariance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 90 % of their three-word shingles."""
    return jaccard.components(table(spark, sf_dir, "documents"))


ORACLES["op12_jaccard_regions"] = jaccard.oracle()


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents against the manifest of the table, some of them of tampered texts."""
    return merkle.document_proofs(table(spark, sf_dir, "documents"))


ORACLES["op13_merkle_manifest"] = merkle.oracle()
