"""Paths, names, labels and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that count as images, at import and in the file table.
IMPORTED = ("jpg", "jpeg", "png", "webp")
SHOWN = ("jpg", "jpeg", "png", "gif", "webp", "bmp")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def forward(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def folder_and_file(path: Column) -> Column:
    """struct<folder, file> of the last two parts of a path with either slash; null for a single part."""
    parts = F.split(forward(path), "/")
    return F.when(F.size(parts) >= 2, F.struct(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file")))


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[.][^.]*$", 0))


def is_image(name: Column, suffixes: tuple[str, ...] = SHOWN) -> Column:
    return suffix(name).isin(*[f".{s}" for s in suffixes])


def category_or_default(c: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("General")))


def embedding_text(category: Column, entities: Column, description: Column) -> Column:
    return F.format_string("Category: %s. Entities: %s. Description: %s", category, F.array_join(entities, ", "), description)


def cluster_label(i: Column) -> Column:
    return F.concat(F.lit("cluster_"), F.lpad(i.cast("string"), 2, "0"))


def bin_label(j: Column) -> Column:
    """0 -> 0.0-0.1, ... 9 -> 0.9-1.0"""
    return F.concat_ws("-", (j / 10).cast("string"), ((j + 1) / 10).cast("string"))


def relative_age(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp"))) / 60).cast("long")
    hours, days = F.floor(minutes / 60).cast("long"), F.floor(minutes / 1440).cast("long")
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))
    return F.when(days > 0, said(days, "day")).when(hours > 0, said(hours, "hour")).when(minutes > 0, said(minutes, "minute")).otherwise("just now")


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def percentage(x: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(x * 100, places), F.lit("%"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def byte_size(n: Column) -> Column:
    """Powers of 1024 with two places: 1536 -> 1.50 KB."""
    units = ("Bytes", "KB", "MB", "GB")
    out = F.concat(F.format_number(n / float(1024**3), 2), F.lit(" GB"))
    for k in (2, 1, 0):
        out = F.when(n < 1024 ** (k + 1), F.concat(F.format_number(n / float(1024**k), 2), F.lit(f" {units[k]}"))).otherwise(out)
    return F.when(n == 0, "0 Bytes").otherwise(out)


def hex_color(bgr: Column) -> Column:
    """#rrggbb of an array of blue, green, red; gray if it is missing or short."""
    part = lambda i: F.lpad(F.lower(F.hex(F.round(bgr[i]).cast("long"))), 2, "0")
    return F.when(F.size(bgr) >= 3, F.concat(F.lit("#"), part(2), part(1), part(0))).otherwise("#808080")


def score_band(score: Column) -> Column:
    return F.when(score == 0, "none").when(score < 0.4, "low").when(score < 0.7, "medium").otherwise("high")


def shortened(label: Column, over: int = 15, keep: int = 12) -> Column:
    return F.when(F.length(label) > over, F.concat(F.substring(label, 1, keep), F.lit("..."))).otherwise(label)


def absolute_url(path: Column, base: str) -> Column:
    return F.when(path.isNull() | (path == ""), None).when(path.startswith("http://") | path.startswith("https://") | path.startswith("data:"), path).otherwise(F.concat(F.lit(base), F.when(path.startswith("/"), "").otherwise("/"), path))


def page_window(page: Column, pages: Column, width: int = 5) -> Column:
    """Up to `width` page numbers around the current one."""
    first = F.greatest(F.lit(1), F.least(page - width // 2, pages - width + 1))
    return F.sequence(first, F.least(pages, first + width - 1))
