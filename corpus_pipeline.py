"""From documents to token files in five stages; each takes and returns frames, written as Parquet in between.

1. language ID: documents without a letter go, and those that raw bytes explain better than any learned language; sure
   predictions become the label of the others
2. near duplicates: one document of each group stays
3. decontamination: documents that hit two or more benchmark items go; from others the hit passages are cut
4. mixing: documents are repeated or left out so that sources meet their target weights
5. token files: written, and read back as one row for each document
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import decontam, dedup, langid, mixing, tokens
from weirflow.llm._shared import maybe_broadcast, new_path, place, renamed, written
from weirflow.llm.queries import tokenizer_file

#: Bits of a raw byte; how many bits in all a text's shortest code must exceed its raw bytes by to be in no learned language; and the score from which a prediction replaces a label.
RAW_BITS, MARGIN, SURE = 8.0, 64, 0.99


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Readable documents. Their ``lang`` becomes the predicted one where it is null, and where the prediction is sure (a score of ``SURE`` or more)."""
    model = langid.fit(langid.training_sample(docs, F.lit(True)))
    _, inner = renamed(docs)
    found = langid.identify(docs, model).toDF(*inner, "lang", "score", "bits")
    text, label = F.col(inner[place(docs, "text")]), inner[place(docs, "lang")]
    known = F.col("lang") != langid.UND if model.languages else F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))
    kept = found.where(known & F.coalesce((F.col("bits") - RAW_BITS) * F.octet_length(text.cast("string")) <= MARGIN, F.lit(True)))
    if model.languages:
        kept = kept.withColumn(label, F.when(F.col(label).isNull() | (F.col("score") >= SURE), F.col("lang")).otherwise(F.col(label)))
    return kept.select(*inner).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the ids that stay; an id stays or goes as a whole. Rows that share an id stay if their texts are no near copies of each other.

    Of one id's rows with equal texts the least by all columns stays, of its near copies the text with the least hash.
    """
    base, inner = renamed(docs)
    i, t = inner[place(docs, "doc_id")], inner[place(docs, "text")]
    found = written(dedup.near_duplicates(docs, shingle=5, percent=80), "components")
    gone = written(found.where("not kept").select(F.col("doc_id").alias(i)).distinct(), "gone")
    kept = base.join(maybe_broadcast(gone, dedup.MOST_IDS), i, "left_anti").select(*inner)
    again = written(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(i)).count().where("count > 1").select(i), "again")
    if again.limit(1).count():
        again = maybe_broadcast(again, dedup.MOST_IDS)
        one = kept.join(again, i, "left_semi").groupBy(i, t).agg(F.min(F.struct(*inner)).alias("row"))
        one = written(one.select("row.*", F.xxhash64(i, t).alias("key")), "same-ids")
        # near copies with other ids have gone, so links are between rows of one id
        alone = dedup.near_duplicates(one.select("key", t), shingle=5, percent=80, id_col="key", text_col=t).where("kept").select(F.col("doc_id").alias("key"))
        kept = kept.join(again, i, "left_anti").select(*inner).unionByName(one.join(alone, "key", "left_semi").select(*inner))
    return kept.toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=8, least_items=2, chars_col="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, cycle=(5, 2, 1), max_repeat=3)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(docs, tokenizer=tokenizer_file(), end_id=0))


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminated), ("mixing to weights", mixed), ("token files", token_files)]
#: Trained models, hashing and a tokenizer decide: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
