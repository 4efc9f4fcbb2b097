"""A corpus from documents to training batches: STAGES in order, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huetide.llm.decontaminate import decontaminate
from huetide.llm.frames import table, written
from huetide.llm.language import identify, train_on_documents
from huetide.llm.packing import pack_documents
from huetide.llm.pseudonyms import pseudonymise
from huetide.llm.similar import SEND, similar_documents


#: A text is in a language if that language's score is above all others by this.
MARGIN = 0.015


def _apart(docs: DataFrame) -> tuple[str, ...]:
    """Names for the columns of docs that no operator makes; the text keeps its own."""
    return tuple(c if c == "text" else f"_in_{k}" for k, c in enumerate(docs.columns))


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that one learned language fits better than the others stay; those that none does, or without any letter, go.

    Null and empty texts have no letter and go.  Repeated rows are judged
    alike and stay, as do rows with null doc_id.  Extra columns are carried on;
    one named as a result stays as it came.  An empty table gives no rows.
    """
    model = train_on_documents(docs.select("doc_id", "text", "lang"))
    names = _apart(docs)
    marked = identify(docs.toDF(*names), model, keep=names)
    return marked.where(f"lang_pred <> 'und' and margin >= {MARGIN}").select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id stays, and one row of each doc_id.

    Texts without words are similar to nothing and stay; so do rows with null
    doc_id, which can't be told apart from others.  Of repeated rows of one
    doc_id any one stays.  Extra columns are carried on.  An empty table gives no rows.
    """
    components, _ = similar_documents(docs)
    rows = written(components.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows"), F.min("component_id").alias("_component")), "rows")
    drop = rows.where("doc_id <> _component").select("doc_id")
    again = rows.where("_rows > 1 and doc_id = _component").select("doc_id")
    sent = lambda ids: F.broadcast(ids) if ids.count() <= SEND else ids
    left = docs.join(sent(drop), "doc_id", "left_anti").select(docs.columns)
    if again.isEmpty():
        return left
    again = sent(again)
    one = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one.select(docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window stay, unchanged.

    Null and empty texts hold no window and stay; repeated rows are judged
    alike.  Extra columns are carried on; one with a name of the operator's
    result stays as it came.  An empty table gives no rows.
    """
    names = _apart(docs)
    marked = decontaminate(docs.toDF(*names), table(spark, sf_dir, "benchmark"), keep=names)
    return marked.where("not contaminated").select(*names).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts become pseudonyms, and n_chars follows.

    Null and empty texts stay as they are; repeated rows are treated alike.
    Extra columns are carried on; one named replaced stays as it came.  An
    empty table gives no rows.
    """
    others = [c for c in docs.columns if c != "text"]
    names = {c: f"_in_{k}" for k, c in enumerate(others)}
    out = pseudonymise(docs.select("text", *[F.col(c).alias(n) for c, n in names.items()]), keep=tuple(names.values()))
    changed = F.size("replaced") > 0
    columns = [F.col("text") if c == "text" else F.col(names[c]).alias(c) for c in docs.columns]
    if "n_chars" in names:
        columns[docs.columns.index("n_chars")] = F.when(changed, F.length("text").cast("long")).otherwise(F.col(names["n_chars"])).alias("n_chars")
    return out.select(columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' sequences in batches.

    Null and empty texts have one row without a batch; repeated rows and those
    with null doc_id are sequences of their own; extra columns are dropped.
    An empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [
    ("language ID", language_identification),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("packing", packing),
]

#: Language scores, pseudonyms and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k + 1}")
    return docs
