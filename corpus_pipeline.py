"""A corpus made ready for training: five stages over `documents`, each taking all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import langid, minhash, mixing, pieces, secrets, session

#: Least probability of the predicted language.
CONFIDENCE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null and empty ones too) and those of no clear language; learns from the labelled rows of its own input.

    Without any labelled row nothing is known of any language, and all texts go. Equal texts share their fate; repeated and null ids, and
    all columns, whatever their names, stay as they are. An empty table stays empty.
    """
    session.workers_find_package(spark)
    model = langid.train(docs.where(~langid.held_out()).select("lang", "text"))
    own = {c: f"_{k}" for k, c in enumerate(docs.columns)}  # names that the prediction's cannot clash with; rows carry each text once
    found = langid.predict(docs.toDF(*own.values()), model, own["text"])
    return found.where(f"lang_pred <> 'und' and score >= {CONFIDENCE}").select([F.col(k).alias(c) for c, k in own.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8): that of the least id.

    Empty and null texts link with nothing and stay; rows without an id stay. Rows that repeat id and text stay once (that whose other columns
    come first as JSON); different texts under one id are one document, which stays or goes with all its texts. An empty table stays empty.
    """
    session.workers_find_package(spark)
    found = minhash.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("_kept"), (F.count_if("kept") > 1).alias("_again"))
    aside = session.settle(found.where("not _kept or _again"))  # fewer than stay: only they, and not all texts, move
    ids = aside.select("doc_id")
    may, rest = session.sift(docs, "doc_id", ids)
    out = may.join(ids.hint("merge"), "doc_id", "left_anti").select(docs.columns).unionByName(rest)
    again = aside.where("_kept and _again").select("doc_id")
    if again.isEmpty():
        return out
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] or ["doc_id"]
    rows = session.sift(docs, "doc_id", again)[0].join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_rest"))
    return out.unionByName(rows.select([c if c in ("doc_id", "text") else f"_rest.`{c}`" for c in docs.columns]))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and makes n_chars new; every row stays, null and empty texts as they are, and all other columns."""
    return secrets.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the production weights; a document that is in several epochs comes as often.

    What counts as size of null and empty texts, and how ties of the order fall, is as `mixing` states; columns stay. An empty table stays empty.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text: doc_id, n_tokens, ids, and the hash of the text decoded from them; null texts give nulls, empty ones no ids."""
    session.workers_find_package(spark)
    return pieces.encode(docs).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language id", language), ("near copies", near_copies), ("secrets", mask_secrets), ("mixing", mix), ("pieces", tokens)]

#: SQL has no counterpart of the models; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, session.settle(docs) if k else docs, sf_dir)
    return docs
