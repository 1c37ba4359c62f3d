"""A training corpus from documents: reject poor texts, drop copies and near copies, mix the sources, encode.

Each stage takes (spark, docs, sf_dir), works on all rows of the stage before and returns what it
leaves; all but the last return the columns of documents. Texts and ids that are null, empty or
repeated are treated as the operators' docstrings say; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgaudit.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality_classifier
from pkgaudit.llm.common import keep_rows, row_key, stored, table, word_list


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, fitted on the labels that are not held out."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    # Columns by number while the score is among them: theirs may have any names.
    numbered = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    scored = quality_classifier.score_documents(docs.withColumnsRenamed(numbered), *model)
    return scored.filter("score >= 0.5").select(*[F.col(numbered[c]).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in blanks at most, the row of least id."""
    return keep_rows(docs, exact_dedup.dedup_exact(docs).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a Jaccard of 0.8 on five-word shingles, one row of least id; all texts without words."""
    classes = near_dedup.near_classes(docs, size=5)
    # By the component itself: unlinked texts may share an id or have none.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    chosen = classes.groupBy("component").agg(F.min(first).alias("first"))
    return keep_rows(docs, chosen.select("first.doc_id", "first.text_hash"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: each as often as it is taken whole, and once cut to its first words where the mix ends in it.

    A cut text is its words joined by single spaces. Texts without words are in no mix.
    """
    taken, _ = mixing.mix(docs)
    counts = (
        taken.filter("taken > 0").groupBy(row_key(F.col("doc_id"), F.col("text_hash")).alias("key"))
        .agg(F.sum("taken").alias("taken"), F.first("size").alias("size"))
        .withColumn("whole", F.floor(F.col("taken") / F.col("size")).cast("int"))
        .withColumn("rest", (F.col("taken") - F.col("whole") * F.col("size")).cast("int")))
    key = row_key(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))
    mixed = (
        docs.select(key.alias("key"), F.struct(*docs.columns).alias("row")).dropDuplicates(["key"]).join(counts, "key")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0)))))
    cut = F.col("copy") > F.col("whole")
    first_words = F.array_join(F.slice(word_list(F.col("row.text")), F.lit(1), F.col("rest")), " ")
    mixed = mixed.withColumn("text", F.when(cut, first_words).otherwise(F.col("row.text")))
    new = {"text": F.col("text"), "n_chars": F.when(cut, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"])
           if "n_chars" in docs.columns else None}
    return mixed.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, input_ids, n_tokens and the digest of the text decoded from the ids."""
    coded = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), keep=("source",), with_ids=True, kept_tables=0.4)
    return coded.select("doc_id", "source", "input_ids", "n_tokens", "decoded_sha256")


STAGES = [
    ("quality classifier", reject_poor),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

# The classifier's fit and the merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
