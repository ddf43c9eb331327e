"""A corpus pipeline of five stages, each one of the operators of ``breathmark.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breathmark.llm.language_id import UNDETERMINED, fit_on, held_out, identify_languages
from breathmark.llm.line_dedup import line_dedup
from breathmark.llm.mixing import draw
from breathmark.llm.near_text import keyed, near_texts
from breathmark.llm.packing import pack_documents
from breathmark.llm.queries import tokenizer

#: Least mean probability of a document's language. Half-and-half documents of two languages stay above it.
LEAST_SCORE = 0.4
WEIGHTS, LIMIT, SEED = (1, 2, 3), 3, 7
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows and bytes of a batch that goes to a Python worker: it is held there and, both ways, beside the heap of its executor.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20
#: Words whose ids a packing task remembers: fewer than alone, since executors still hold what earlier stages left.
REMEMBERED = 50_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to BATCH_ROWS and BATCH_BYTES; lower ones stay. No result depends on them."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not size.rstrip("bB").isdigit() or int(size.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letters, or none that the model finds likely.

    Null and empty texts go. The model is fitted on rows with a language; without any, all rows go. Very long texts are judged whole. Each row is judged
    by its text alone, so rows that repeat a text go or stay together. An empty table gives an empty result.
    """
    small_batches(spark)
    model = fit_on(docs, ~held_out("doc_id"), "doc_id", "text", "lang")
    found = identify_languages(docs.select(COLUMNS), model, names=("lang_pred", "lang_score"))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= LEAST_SCORE)).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of three lines that repeat; documents of which nothing stays go.

    A null or empty text has no line to cut and stays as it is. Rows that repeat an id and its text are cut alike; of equal windows the first by (id, place)
    stays, null ids first. Texts of any length are looked at whole. An empty table gives an empty result.
    """
    cut = line_dedup(docs.select(COLUMNS))
    left = (F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(left).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a five-word Jaccard similarity of 0.8 or more one row stays, the first by (id, text's hash).

    A null text counts as empty, and texts without words are one group. Of rows that repeat an id and its text one stays; null ids come last.
    Texts of any length are compared whole. An empty table gives an empty result.
    """
    small_batches(spark)
    docs = docs.select(COLUMNS)
    near = near_texts(docs)
    docs = keyed(docs)
    groups = docs.select("doc_id", "_node").join(near, F.col("_node") == F.col("node"), "left")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_node")
    stays = groups.groupBy(F.coalesce("component", "_node")).agg(F.min(order).alias("_min")).select(F.col("_min.doc_id").alias("_id"), F.col("_min._node").alias("_own"))
    kept = docs.join(stays, (F.col("_node") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    same = Window.partitionBy("_own", "doc_id").orderBy("source", "lang")
    return kept.withColumn("_nr", F.row_number().over(same)).where("_nr = 1").select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, shuffled within shards.

    Sources without words, null ones too, and texts that the mix doesn't take give no row; rows that repeat a document are drawn each on
    its own. An empty table gives an empty result. Texts move once, as copies, whatever their length.
    """
    return draw(docs.select(COLUMNS), WEIGHTS, LIMIT, seed=SEED).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: which document, from where, and where they lie.

    A null or empty text is its end alone. Every row is packed, also one that repeats another; longer ones than a sequence are cut. An empty table gives an
    empty result.
    """
    small_batches(spark)
    return pack_documents(docs, tokenizer("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL can express neither the field nor the fingerprints nor the tokens. Tests hold the line and near-duplicate stages and the packing against brute force,
#: the mixture against its operator, and run() against the stages one by one.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store that a finished stage has read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``, each written to the shared folder and read again."""
    from uuid import uuid4

    from breathmark.llm.common import shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
