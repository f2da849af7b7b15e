"""Edits: an append-only log folded onto results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["job_id", "file_index"]
#: The several names of one field.
FIELD_NAMES = {"text": "extracted_text"}


def collapse(edits: DataFrame) -> DataFrame:
    """(job_id, file_index, field, value, ts): the last edit of each field.

    Late rows count by their own time; of equal times the greatest value wins, so the
    result doesn't depend on the order of arrival. Null values are no edits.
    """
    field = F.col("field")
    for a, b in FIELD_NAMES.items():
        field = F.when(field == a, b).otherwise(field)
    e = edits.where("value IS NOT NULL").withColumn("field", field)
    last = F.max(F.struct("ts", "value")).alias("x")
    return e.groupBy(*KEY, "field").agg(last).select(*KEY, "field", F.col("x.value").alias("value"), F.col("x.ts").alias("ts"))


def apply(results: DataFrame, edits: DataFrame) -> DataFrame:
    """Results with the last edited text, translation and regions; other fields stay.

    A ``regions`` edit is the whole map as JSON, as the workbench saves it; a value that
    is no JSON object changes nothing.
    """
    last = collapse(edits).where("field IN ('extracted_text', 'translation', 'regions')")
    of = lambda name, out: F.max(F.when(F.col("field") == name, F.col("value"))).alias(out)
    wide = last.groupBy(*KEY).agg(of("extracted_text", "new_text"), of("translation", "new_translation"), of("regions", "new_regions"))
    x = results.join(wide, KEY, "left").withColumns({"extracted_text": F.coalesce("new_text", "extracted_text"), "translation": F.coalesce("new_translation", "translation")})
    if "regions" in results.columns:
        x = x.withColumn("regions", F.coalesce(F.from_json("new_regions", "map<string,string>"), "regions"))
    return x.drop("new_text", "new_translation", "new_regions")
