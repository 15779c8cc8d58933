"""From raw documents to packed training sequences: each stage reads what the one before it has written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysketch.llm.exact_dedup import exact_duplicates
from tallysketch.llm.language import UNKNOWN, languages, reference_texts
from tallysketch.llm.minhash import FEW, near_duplicates
from tallysketch.llm.packing import pack
from tallysketch.llm.suffix_dedup import without_repeats
from tallysketch.storage import new_folder

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048


#: Rows that go to a Python worker at once: whole texts, so a worker and its JVM hold some megabytes of them, not dozens.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _bounded_batches(spark: SparkSession) -> None:
    """The session's setting stays as it is where it is lower already."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: null texts and texts without a letter go."""
    _bounded_batches(spark)
    texts = reference_texts(docs, F.lit(True), "doc_id", "text", "lang")
    found = languages(docs, texts, keep=tuple(docs.columns)).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[F.col(f"__keep_{place}").alias(name) for place, name in enumerate(docs.columns)])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest."""
    found = exact_duplicates(docs, keep=tuple(docs.columns)).where("kept")
    return found.select(*[F.col("row")[name].alias(name) for name in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows are told apart by numbers of their own, so ids may repeat or be missing (a missing one is the largest)."""
    _bounded_batches(spark)
    folder = new_folder(spark, "numbered")
    docs.withColumn("__row", F.monotonically_increasing_id()).write.parquet(folder)
    numbered = spark.read.parquet(folder)
    folder = new_folder(spark, "near-groups")
    near_duplicates(numbered, 80, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id").write.parquet(folder)
    groups = spark.read.parquet(folder)
    folder = new_folder(spark, "near-copies")
    shared = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    members = groups.join(shared, "component_id").join(numbered.select("__row", "doc_id"), "__row")
    order = F.struct(F.col("doc_id").isNull().alias("__none"), "doc_id", "__row")
    first = members.groupBy("component_id").agg(F.min(order).alias("__first"))
    members.join(first, "component_id").where(F.col("__row") != F.col("__first.__row")).select("__row").write.parquet(folder)
    gone = spark.read.parquet(folder)
    gone = F.broadcast(gone) if gone.count() <= FEW else gone
    return numbered.join(gone, "__row", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that a document with a smaller id has; n_chars is counted anew."""
    _bounded_batches(spark)
    # The old text and its length don't come along.
    found = without_repeats(docs, keep=tuple(name for name in docs.columns if name not in ("text", "n_chars")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return found.select(*[new.get(name, F.col("row")[name]).alias(name) for name in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens in sequences of 2048."""
    import public_tokenizers

    _bounded_batches(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER), CAPACITY)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: No SQL writes the language, near-duplicate and packing stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
