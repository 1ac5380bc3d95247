"""A corpus from documents to packed training sequences, in five stages; each is written and read again.

Stages take (spark, docs, sf_dir) and work on all that the stage before kept. All but the last return the
columns of documents.

In every stage a null text counts as an empty one and stays null, an empty table gives an empty result, columns
beyond those of documents are dropped whatever their names, and repeated rows are documents of their own: they
stay or go together, but for the near duplicates, of which repeated rows are one kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithospark.llm import lines, ngram_join, packing, quality, repeats
from lithospark.llm.common import keep, split_likely, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score below this go.
LEAST_QUALITY = 0.3


def _has_word() -> F.Column:
    return F.col("text").rlike(r"[^\x20\x09-\x0D]")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines near an earlier one go; so do documents that lost lines and have no word left."""
    out = lines.line_dedup(docs.select(*COLUMNS), per=lines.PER, exact=True)
    return out.where((F.col("n_removed") == 0) | _has_word()).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least doc_id stays; of repeated rows one."""
    found = keep(ngram_join.jaccard_join(docs), "near")
    dropped = found.where("rid <> class_rid").select("rid")
    again = found.where("rid = class_rid AND n_links > 0").groupBy("rid").count().where("count > 1").select("rid")
    touched = keep(dropped.distinct().withColumn("gone", F.lit(True)).unionByName(again.withColumn("gone", F.lit(False))), "touched")
    maybe, out = split_likely(docs.select(*COLUMNS).withColumn("_rid", ngram_join.row_id()), "_rid", touched.select(F.col("rid").alias("_rid")))
    maybe = maybe.join(touched.select(F.col("rid").alias("_rid"), "gone").hint("merge"), "_rid", "left")
    once = maybe.where("gone IS FALSE").dropDuplicates(["_rid"]).select(*COLUMNS)
    return out.select(*COLUMNS).unionByName(maybe.where("gone IS NULL").select(*COLUMNS)).unionByName(once)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that start anywhere else go; so do documents of which nothing is left."""
    out = repeats.remove_repeats(docs.select(*COLUMNS), repeats.PASSAGE, repeats.PASSAGE_WINDOW, as_text=True, unit="words")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).where((F.col("n_removed") == 0) | _has_word()).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    import public_tokenizers

    pieces = keep(packing.tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the fitted classifier, the tokenizer or the connected components of near duplicates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
