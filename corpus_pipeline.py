"""A training corpus from raw documents: rules, near copies, repeats, benchmarks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again before the next stage; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm import _store
from factorloom.llm.decontaminate import remove_contamination
from factorloom.llm.jaccard_join import keep_one
from factorloom.llm.mixing import WORD, mix_sources
from factorloom.llm.quality import judge
from factorloom.llm.substring_dedup import remove_repeats


def _stage(fn):
    """Scratch tables of the stage before are removed, unless ``docs`` still reads them."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _store.release(spark, "pipeline", docs)
        with _store.tagged("pipeline"):
            return fn(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = fn.__name__, fn.__doc__
    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie far from their language and source go."""
    return judge(docs, with_text=True).where("kept").select(*docs.columns)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least id stays."""
    return keep_one(docs, size=5, percent=80)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that occur elsewhere are cut; texts of which nothing is left go."""
    cut = remove_repeats(docs, window=35, with_text=True)
    cut = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"n_chars": n_chars, "text": F.col("kept_text")}).select(*docs.columns)


@_stage
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a twentieth of the words or more is in benchmark windows go."""
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "documents")


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at its target weights: each document that is taken, with the words taken (repeats counted)."""
    # rows of equal id, source and size are told apart by a number, whichever has which
    cells = ["doc_id", "source", "size"]
    number = F.row_number().over(Window.partitionBy(*cells).orderBy(F.desc("taken")))
    mixed, _ = _store.materialise(mix_sources(docs, (3, 1, 2), 1.5, 2, "mix").withColumn("copy", number).where("taken > 0"), "mixed")
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    sized = sized.withColumn("copy", F.row_number().over(Window.partitionBy(*cells).orderBy("text"))).alias("d")
    m = mixed.alias("m")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.size") == F.col("m.size")) & (F.col("d.copy") == F.col("m.copy"))
    return sized.join(m, same).select(*(F.col(f"d.{c}") for c in docs.columns), "d.size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("mixing", source_mix),
]

#: Robust outliers, components and window repeats have no practical SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = ""
    for k, (_, stage) in enumerate(STAGES):
        docs, path = _store.materialise(stage(spark, docs, sf_dir), f"pipeline-stage{k}")
        if last:
            _store.remove(spark, last)
        last = path
    return docs
