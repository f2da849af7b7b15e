"""Scalar functions as column expressions; all stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def basename(path: Column) -> Column:
    """Last part of a path with either kind of separator."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def last4(s: Column) -> Column:
    return F.substring(s, -4, 4)


def display_name(name: Column, job_id: Column) -> Column:
    """A job's name, else the last four characters of its id."""
    return F.coalesce(name, last4(job_id))


def strip(s: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^/.]+$", "")


def processed_name(name: Column) -> Column:
    return F.concat(strip_extension(name), F.lit("_processed.png"))


def model_label(name: Column) -> Column:
    """Before the tag, after the last slash, in capitals."""
    return F.upper(F.element_at(F.split(F.element_at(F.split(name, ":"), 1), "/"), -1))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def number_or(x: Column, default: float) -> Column:
    """A number from text, else the default."""
    return F.coalesce(x.try_cast("double"), F.lit(default))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def template(form: str, /, **cols: Column) -> Column:
    """A ``{name}`` template filled with columns."""
    parts: list[Column] = []
    rest = form
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), cols[name]]
    return F.concat(*parts, F.lit(rest))


def page_choice(raw: Column, size: Column) -> Column:
    """A typed page number held to 1..size; leading digits of other text count."""
    n = F.regexp_extract(raw, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.least(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)), size)


def extract_header(model: Column, body: Column) -> Column:
    return F.concat(template(K.EXTRACT_HEADER, model=model), body)


def target_pixels(dpi: Column) -> Column:
    """Short edge of an A4 page at a resolution."""
    return F.floor(F.lit(K.A4_WIDTH_INCHES) * dpi).cast("int")


def block_size(target: Column) -> Column:
    """Odd threshold block, at least 11."""
    b = F.floor(target / 40).cast("int")
    return F.greatest(b + F.when(b % 2 == 0, 1).otherwise(0), F.lit(11))
