"""From raw documents to sampled token ids in five stages, each written as a table before the next reads it.

As a stage begins, the intermediate tables of those before it go; their results have been written by then. A stage's
result goes when the next one's has been written; what the last one reads goes when the driver ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import minhash, mixing, piece_sampling, quality, repeats
from chronolith.llm.common import discard, materialize, stage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _one_a_document(docs: DataFrame) -> DataFrame:
    """One row of every id that several rows have, the same one in every run. Rows are compared by a digest, so an id that
    very many rows have is settled before the shuffle."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = docs.groupBy("doc_id").agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("row"))
    return least.select("row.*")


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, all columns.

    Null and empty texts have no words and go; a text of any length is judged whole; repeated rows and null ids are
    judged like any other; further columns stay as they are, whatever their names; an empty table gives no rows.
    """
    return quality.keep(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the smallest id, all columns.

    Texts that are null, empty or without words link with nothing and stay, and so do rows with a null id; a text of any
    length is compared whole. Rows that repeat an id count as one document: one of them stays, chosen by a digest of its
    columns, so reruns agree. Further columns stay as they are; an empty table gives no rows.
    """
    ids = minhash.near_duplicates(docs, size=5, percent=80).filter("kept").select(F.col("doc_id").alias("kept_id"))
    kept = materialize(ids, "kept-ids")
    repeated = not kept.filter("kept_id IS NOT NULL").groupBy("kept_id").count().filter("count > 1").isEmpty()
    out = docs.join(kept.distinct(), docs.doc_id.cast("long").eqNullSafe(kept.kept_id), "left_semi")
    if repeated:
        out = _one_a_document(out.filter("doc_id IS NOT NULL")).unionByName(out.filter("doc_id IS NULL"))
    return out


@stage
def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document with a smaller id has; ``n_chars``, if there, follows.

    A character goes only with all its bytes. A null text stays null, an empty one empty, and a text of which all is
    removed is empty; a text of any length is searched whole. Rows that repeat an id never cut each other; a null id
    counts as the largest. All rows and further columns stay; an empty table gives no rows.
    """
    cleaned = repeats.cleaned(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: every document as often as the mix takes it, all columns.

    Null and empty texts have no words and are not taken; a null source is a source of its own, the last in turn; a text
    of any length is taken whole; repeated rows and null ids are mixed like any other; further columns stay as they are;
    an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


@stage
def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text: ``doc_id, n_bytes, round_trip, samples``.

    Rows that repeat an id and a text, as the mix makes them, draw samples of their own by their copy number; null ids
    have a key of their own. Null and empty texts have one empty segmentation; a text of any length is encoded whole; only
    ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    return piece_sampling.encode(piece_sampling.numbered(docs), piece_sampling.model_path(), k=2, copy="copy")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("source_mixing", source_mixing),
    ("piece_encoding", piece_encoding),
]
#: Suffix sorting, sketches and sampling have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
