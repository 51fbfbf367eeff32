"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, personal data is
replaced, sources are mixed to their target weights, and what is left is packed into sequences.

Each stage works on all that its predecessor kept; all but the last return the columns of ``documents``. Texts
that a stage drops are toxic, or near-duplicates of one that stays; mixing drops what the targets leave out.

Edge cases, for every stage: null text counts as empty; it and the empty text are clean, copies of each other (the
first by id stays, null ids last), without personal data, and never mixed, as they have no words; a null id, source
or language is a value like any other; a text of any length is treated whole; repeated rows are near-duplicates, of
which one stays; ties go to the smaller id, then to a hash of the text; extra columns are carried along whatever
their names, up to the last stage; an empty table stays empty. ``run`` removes each stage's folder once the next
result is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.llm import common, mixing, packing, pii, similar, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group by fingerprints, as op4 has them. No stage: ``drop_similar`` is."""
    return simhash.one_of_each(docs).select(*docs.columns)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts linked by a similarity of 0.8 or more of their five-word shingles."""
    return similar.one_of_each(docs).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.replace_documents(docs, out=None)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_similar),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Tokens, hashes and a trained classifier: not for SQL. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.remove_folder(spark, f"{folder}/{before}")
        before = name
    packed = STAGES[-1][1](spark, docs, sf_dir)  # reads the texts once, for their pieces, which are checkpointed
    common.remove_folder(spark, folder)
    return packed
