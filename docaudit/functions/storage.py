"""Where a stored copy of a document belongs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions.archive import drop_params, file_name
from docaudit.functions.text import let, percent_decode, strip
from docaudit.functions.urls import url_path

# The default template and the characters no file system takes.
DEFAULT_TEMPLATE = "{root}/{site}/{hash}.pdf"
ILLEGAL_CHARACTERS = r'[<>:"/\\|?*\x00-\x1f]'
MAX_PART_LENGTH = 150


def sanitize(part: Column, max_length: int = MAX_PART_LENGTH) -> Column:
    """Decoded path part without illegal characters or outer blanks and dots.

    It is cut to ``max_length``, since file systems limit names; see ``storage_plan`` for names that meet.
    """
    clean = F.regexp_replace(percent_decode(part), ILLEGAL_CHARACTERS, "_")
    return F.substring(F.btrim(strip(clean), F.lit(".")), 1, max_length)


def storage_filename(url: Column, file_hash: Column) -> Column:
    fallback = F.when(
        F.coalesce(file_hash, F.lit("")) != "",
        F.concat(F.substring(file_hash, 1, 16), F.lit(".pdf")),
    ).otherwise(F.lit("document.pdf"))
    return let(
        sanitize(file_name(drop_params(url_path(url)))),
        lambda name: F.when(F.lower(name).endswith(".pdf"), name).otherwise(fallback),
    )


def storage_folder(url: Column) -> Column:
    """Sanitized folders of the URL path, joined with ``/``."""
    path = F.regexp_replace(drop_params(url_path(url)), r"(?:/\.?)+$", "")
    folders = F.split(F.regexp_extract(path, r"(?s)^/(.*)/[^/]*$", 1), "/")
    kept = F.filter(folders, lambda s: (s != "") & (s != "."))
    return F.array_join(F.filter(F.transform(kept, lambda s: sanitize(s)), lambda s: s != ""), "/")


def storage_path(
    url: Column,
    site: Column,
    file_hash: Column,
    *,
    root: str,
    date: str,
    template: str = DEFAULT_TEMPLATE,
) -> Column:
    """Render the template. ``date`` is a parameter so that reruns give the same path."""
    values = {
        "root": F.lit(root),
        "site": sanitize(site),
        "path": storage_folder(url),
        "filename": storage_filename(url, file_hash),
        "hash": F.when(F.coalesce(file_hash, F.lit("")) != "", file_hash).otherwise("nohash"),
        "date": F.lit(date),
    }
    pieces = [p for p in re.split(r"(\{\w+\})", template) if p]
    rendered = F.concat(
        *[values[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in pieces]
    )
    squeezed = F.regexp_replace(rendered, r"/+(?:\./+)*", "/")
    return F.regexp_replace(squeezed, r"(.)/$", "$1")
