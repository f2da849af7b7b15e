"""Final pages: edits on page lists, lines, and pagination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def page_lists(final_pages: DataFrame) -> DataFrame:
    """(job_id, pages): a job's page texts in order; repeated rows count once."""
    p = final_pages.groupBy("job_id", "page_no").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    return p.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]).alias("pages"))


def insert_after(pages: Column, at: int, text: str = "") -> Column:
    """A new page after position ``at`` (from 1)."""
    return F.when(F.size(pages) < at, F.concat(pages, F.array(F.lit(text)))).otherwise(F.array_insert(pages, at + 1, F.lit(text)))


def delete_at(pages: Column, at: int) -> Column:
    """Without the page at a position; the last page is emptied, never removed."""
    return F.when(F.size(pages) <= 1, F.array(F.lit(""))).otherwise(F.filter(pages, lambda _, i: i != at - 1))


def set_at(pages: Column, at: int, text: Column) -> Column:
    return F.transform(pages, lambda x, i: F.when(i == at - 1, text).otherwise(x))


def lines(final_pages: DataFrame) -> DataFrame:
    """(job_id, page_no, line_no, line): lines from 0, empty ones kept."""
    p = final_pages.select("job_id", "page_no", F.coalesce("text", F.lit("")).alias("text")).distinct()
    return p.select("job_id", "page_no", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def paginate(page_lines: DataFrame, per_page: int = K.PDF_LINES_PER_PAGE) -> DataFrame:
    """Adds ``sheet`` (from 0 within a page) and ``y``: 20, then 5 further down each line."""
    on = F.col("line_no") % per_page
    return page_lines.withColumn("sheet", F.floor(F.col("line_no") / per_page).cast("int")).withColumn("y", (20 + 5 * on).cast("int"))
