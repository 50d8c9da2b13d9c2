"""Rows by an id of their own, also where doc_id is missing or comes more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgetrail.llm.common import Stages

#: Ids of texts without one are this large, so that of a group the document with an id is kept.
LEAST = 1 << 62


def identified(docs: DataFrame, stages: Stages) -> tuple[DataFrame, str]:
    """(one row of each doc_id and text, the name of a column that holds an id and is never null).

    The id is doc_id as long, and where that is null a 62-bit hash of the text that is ``LEAST`` or
    more. Of rows that repeat doc_id and text, the one whose other columns come first as JSON stays.
    Only rows with a null or repeated doc_id are shuffled; copies are combined before that.
    """
    name = "_id_"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    docs = docs.withColumn(name, F.col("doc_id").cast("long"))
    many = docs.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    many = stages.cut(many.where("n > 1").select(name), "repeated-ids")
    known, nameless = docs.where(F.col(name).isNotNull()), docs.where(F.col(name).isNull())

    odd = known.join(many, name, "left_semi").unionByName(nameless)
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    others = [c for c in docs.columns if c not in ("doc_id", "text", name)]
    first = F.struct(F.col("text").isNull(), F.to_json(F.struct(F.lit(0).alias("_"), *others)))
    odd = odd.groupBy(F.col(name).alias("known"), digest.alias("digest")).agg(
        F.min_by(F.struct(*docs.columns), first).alias("x")
    )
    made = F.xxhash64("digest").bitwiseAND(LEAST - 1).bitwiseOR(F.lit(LEAST))
    odd = odd.select("x.*", F.coalesce("known", made).alias("made"))
    odd = stages.cut(odd.withColumn(name, F.col("made")).drop("made"), "odd-rows")
    return known.join(many, name, "left_anti").select(*docs.columns).unionByName(odd), name
