"""A corpus from raw documents: quality rules, near duplicates, secrets, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept.  All but the
last return the columns of ``docs``.  ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again for the next.

Defined results: a null or empty text fails the quality rules; of documents with equal least id
in a group the first row stays; an empty table gives an empty one; further columns stay with
their rows, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.jaccard_join import jaccard_groups
from sessionlens.llm.mixing import mixed_documents
from sessionlens.llm.packing import packed_documents
from sessionlens.llm.places import with_place
from sessionlens.llm.quality import fit_quality, judged, training_rows
from sessionlens.llm.secret_scan import secret_spans
from sessionlens.llm.tokens import vocabulary
from sessionlens.plans.durable import written

MASK = "[secret]"
WORDS = r"[\x20\x09-\x0D]+"


def _placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with their place, columns numbered so that no name can clash."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return with_place(docs, **dict(zip(names, docs.columns, strict=True))), names


def _named(rows: DataFrame, names: list[str], docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    model = fit_quality(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = judged(docs, model)
    return rows.filter(F.col(f"`{rows.columns[-1]}`.kept")).drop(rows.columns[-1])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group linked by five-word shingles from 0.8."""
    groups = written(jaccard_groups(docs, 5, 80, 100).filter("group_id IS NOT NULL").select("doc_id", "_file", "_row", "group_id"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_file", "_row")
    first = groups.groupBy("group_id").agg(F.min(rank).alias("first"))
    # by place, as one group may hold any share of the rows
    stay = first.select("first._file", "first._row")
    gone = written(groups.select("_file", "_row").join(stay, ["_file", "_row"], "left_anti"))
    rows, names = _placed(docs)
    return _named(rows.join(gone, ["_file", "_row"], "left_anti"), names, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked; ``n_chars`` follows the text."""
    rows, names = _placed(docs)
    column = dict(zip(docs.columns, names, strict=True))
    text = F.col(column["text"])
    found = written(secret_spans(rows.select("_file", "_row", text.alias("text"))))
    rows = rows.join(found, ["_file", "_row"], "left")
    starts = F.transform("spans", lambda s: s["start"])
    ends = F.transform("spans", lambda s: s["end"])
    # the gap before a span begins where all spans before it have ended
    pieces = F.transform(
        starts,
        lambda start, i: F.when(
            start >= F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0)),
            F.concat(
                F.substring(text, F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0)) + 1, start - F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0))),
                F.lit(MASK),
            ),
        ).otherwise(""),
    )
    masked = F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))
    rows = rows.withColumn(column["text"], F.when(F.col("spans").isNull(), text).otherwise(masked))
    if "n_chars" in column:
        changed = F.length(F.col(column["text"])).cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn(column["n_chars"], F.when(F.col("spans").isNull(), F.col(column["n_chars"])).otherwise(changed))
    return _named(rows, names, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a part of one is its first words, joined by
    one space.  Documents the mix takes nothing of are left out."""
    rows, names = _placed(docs)
    column = dict(zip(docs.columns, names, strict=True))
    chosen = rows.select(
        F.col(column["doc_id"]).alias("doc_id"), F.col(column["source"]).alias("source"), F.col(column["text"]).alias("text"), "_file", "_row"
    )
    mix = written(mixed_documents(chosen, carry=("_file", "_row")).filter("taken > 0").select("size", "taken", "_file", "_row"))
    text = F.col(column["text"])
    part = (F.col("taken") % F.col("size")).cast("int")
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    whole = F.array_repeat(text, F.floor(F.col("taken") / F.col("size")).cast("int"))
    texts = F.concat(whole, F.when(part > 0, F.array(F.array_join(F.slice(words, F.lit(1), part), " "))).otherwise(F.array().cast("array<string>")))
    # the mix grows with the documents, so at no size is it broadcast
    out = rows.join(mix.hint("merge"), ["_file", "_row"]).withColumn("_text", F.explode(texts)).withColumn(column["text"], F.col("_text"))
    if "n_chars" in column:
        out = out.withColumn(column["n_chars"], F.length("_text").cast(docs.schema["n_chars"].dataType))
    return _named(out, names, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 tokens."""
    return packed_documents(docs, vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Similarity groups and the quality model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = written(docs)
    return docs
