"""From raw documents to token digests: toxic texts, near copies and benchmark leaks go, secrets are
blanked, what is left is encoded.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet in the shared folder
and read again by the next one. All but the last return the columns of ``documents``. Rows with a
null doc_id pass decontamination, which decides by id; a null text is never toxic, copied or leaked.
"""

from pyspark.sql import functions as F

from logweave.llm import minhash, secrets, sentencepieces, templates, toxicity
from logweave.session import materialize

TOXIC_FROM = 0.5
SHINGLE = 5


def _free(docs, name):
    """``name``, or a longer one if a column has it."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark, docs, sf_dir):
    """Documents with a toxicity score below ``TOXIC_FROM``; the classifier learns from ``labels``."""
    score = _free(docs, "score")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_score(docs, model, score).where(F.col("text").isNull() | (F.col(score) < TOXIC_FROM)).drop(score)


def drop_near_copies(spark, docs, sf_dir):
    """One row of every group of near copies: that with the smallest doc_id, null last. Rows that share a
    doc_id are documents of their own: equal ones are copies, other texts of the id are not touched."""
    row = _free(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # written, so numbers stay
    found = minhash.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), SHINGLE).select(F.col("doc_id").alias(row), "component_id", "kept")
    groups = found.where("NOT kept").select("component_id").distinct()
    members = found.join(groups, "component_id").join(numbered.select(row, F.col("doc_id").alias("own")), row)
    order = F.struct(F.col("own").isNull(), "own", row)
    first = members.groupBy("component_id").agg(F.min(order)[row].alias("first"))
    gone = members.select("component_id", row).join(first, "component_id").where(F.col(row) != F.col("first")).select(row)
    return numbered.join(gone, row, "left_anti").drop(row)


def drop_leaks(spark, docs, sf_dir):
    """Documents without passages of ``benchmark``."""
    leaks = templates.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti")


def blank_secrets(spark, docs, sf_dir):
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark, docs, sf_dir):
    """Token counts and digests of every document left."""
    import public_tokenizers
    return sentencepieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_copies), ("decontamination", drop_leaks),
          ("secrets", blank_secrets), ("sentencepiece", encode)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
