"""Column functions over identifiers, lists in cells, labels, JSON and hashes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ephemeris import col


def lenient_double(x) -> Column:
    """A finite number, or null."""
    v = col(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def lenient_id(*names) -> Column:
    """The first of several columns that reads as a whole number."""
    return F.coalesce(*(lenient_double(n).cast("long") for n in names))


def sectors(x) -> Column:
    """Sorted distinct whole numbers of a list in a cell; other tokens are dropped."""
    parts = F.split(F.regexp_replace(col(x), r"[\[\]]", ""), r"[;,\s]+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda p: p.try_cast("int")), lambda v: v.isNotNull())))


def cohort_key(sector, camera, ccd) -> Column:
    part = lambda c: F.coalesce(col(c).cast("string"), F.lit("unknown"))
    return F.concat(F.lit("s"), part(sector), F.lit("-cam"), part(camera), F.lit("-ccd"), part(ccd))


def safe_name(x) -> Column:
    return F.regexp_replace(col(x), r"[^A-Za-z0-9._-]+", "_")


def export_label(x) -> Column:
    """Words for a slug: spaces for dashes and underscores, a capital in front."""
    words = F.lower(F.regexp_replace(col(x), r"[_\-–—]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))


def row_signature(signature, fallback) -> Column:
    return F.coalesce(col(signature), F.concat(F.lit("legacy:"), F.coalesce(col(fallback), F.lit("unknown"))))


def notes(*said: tuple[Column, str]) -> Column:
    return F.concat_ws("; ", *(F.when(c, F.lit(t)) for c, t in said))


def content_id(*columns, length: int = 20) -> Column:
    """Hash of the columns' canonical JSON, keys in alphabetical order."""
    names = sorted(columns)
    return F.substring(F.sha2(F.to_json(F.struct(*names)), 256), 1, length)


def json_field(payload, path: str, kind: str = "string") -> Column:
    """A field of a JSON document; null where the document or the field can't be read."""
    return F.get_json_object(col(payload), path).try_cast(kind)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def aliased(df: DataFrame, choices: list[str], name: str) -> DataFrame:
    """df with name taken from the first of the choices that it has, whatever their case."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[c.lower()] for c in choices if c.lower() in have), None)
    return df.withColumn(name, F.col(found) if found else F.lit(None).cast("string"))


def transient_error(message) -> Column:
    return F.lower(col(message)).rlike(r"timed? ?out|temporar|connection|reset by peer|unavailable|too many requests|50[234]")
