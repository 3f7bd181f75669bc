"""Share pages: find the described document and its direct download URL.

A resolver is an object with a name, a match pattern and column expressions, so
registries of resolvers stay visible to Catalyst.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions.text import let

_SHARE = r"(?i)^https?://(?!\.box\.com/)([a-zA-Z0-9-]*)[a-zA-Z0-9.-]*\.box\.com/s/([a-zA-Z0-9]+)"
_MARKER = "Box.postStreamData"
_SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script\s*>"
_ITEMS = r'(?s)"items":\s*(\[\{.*\}\])'
# A boolean only where the JSON has one: a quoted "false" is not a lock.
_ITEM_SCHEMA = "array<struct<name:string,extension:string,canDownload:boolean,size:bigint>>"

NOT_SHARE = "not a box share url"
NOT_FETCHED = "could not fetch box page"
PARSE_ERROR = "box parse error"
NO_ITEM = "no downloadable pdf item found"
LOCKED = "box file is not downloadable"
NO_RESOLVER = "no resolver"


def share_item_texts(html: Column) -> Column:
    """JSON texts of the item arrays of all marked scripts that have one, in page order.

    Single quotes are dropped before the search, so names lose their apostrophes.
    """
    scripts = F.filter(
        F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1)),
        lambda s: F.contains(s, F.lit(_MARKER)),
    )
    return F.filter(
        F.transform(
            scripts, lambda s: F.regexp_extract(F.replace(s, F.lit("'"), F.lit("")), _ITEMS, 1)
        ),
        lambda s: s != "",
    )


def share_items(html: Column) -> Column:
    """Items of all marked scripts, null without any; a script whose items are no JSON has none."""

    def items(texts: Column) -> Column:
        parsed = F.transform(texts, lambda s: F.from_json(s, _ITEM_SCHEMA))
        return F.when(F.size(texts) > 0, F.flatten(F.filter(parsed, lambda x: x.isNotNull())))

    return let(share_item_texts(html), items)


def first_pdf_item(items: Column) -> Column:
    """First item with the extension pdf in any case, or null."""
    return F.get(F.filter(items, lambda x: F.lower(x["extension"]) == "pdf"), F.lit(0))


@dataclass(frozen=True)
class BoxShares:
    """Share links of the form ``https://<tenant>.box.com/s/<token>``."""

    name: str = "box"

    def matches(self, url: Column) -> Column:
        return F.coalesce(url.rlike(_SHARE), F.lit(False))

    def resolve(self, url: Column, html: Column) -> Column:
        """Struct of pdf_url, filename and error; exactly one of URL and error is set."""
        target = F.regexp_replace(
            url, _SHARE + r"(?s).*$", r"https://$1.app.box.com/public/static/$2.pdf"
        )

        def outcome(parsed: Column) -> Column:
            # Scripts are read in order up to the first with a PDF or with broken items.
            holds = F.filter(parsed, lambda x: x.isNull() | first_pdf_item(x).isNotNull())
            broken = (F.size(holds) > 0) & F.get(holds, F.lit(0)).isNull()
            return let(first_pdf_item(F.get(holds, F.lit(0))), lambda item: result(broken, item))

        def result(broken: Column, item: Column) -> Column:
            error = (
                F.when(~self.matches(url), F.lit(NOT_SHARE))
                .when(html.isNull(), F.lit(NOT_FETCHED))
                .when(broken, F.lit(PARSE_ERROR))
                .when(item.isNull(), F.lit(NO_ITEM))
                .when(~item["canDownload"], F.lit(LOCKED))
            )
            return let(
                error,
                lambda e: F.struct(
                    F.when(e.isNull(), target).alias("pdf_url"),
                    F.when(e.isNull(), item["name"]).alias("filename"),
                    e.alias("error"),
                ),
            )

        return let(
            F.transform(share_item_texts(html), lambda s: F.from_json(s, _ITEM_SCHEMA)), outcome
        )


KNOWN_RESOLVERS = (BoxShares(),)


def enabled_resolvers(names: Sequence[str] | None = None) -> tuple[BoxShares, ...]:
    """The known resolvers in match order; ``None`` or an empty list enables all."""
    return tuple(r for r in KNOWN_RESOLVERS if not names or r.name in names)


def resolver_name(
    url: Column, resolvers: Sequence[BoxShares] = KNOWN_RESOLVERS, enabled: Column | None = None
) -> Column:
    """Name of the first matching resolver, or null. ``enabled`` may name them per row."""
    hits = []
    for r in resolvers:
        hit = r.matches(url)
        if enabled is not None:
            off = F.coalesce(F.size(enabled) > 0, F.lit(False)) & ~F.array_contains(enabled, r.name)
            hit = hit & ~off
        hits.append(F.when(hit, F.lit(r.name)))
    return F.coalesce(*hits, F.lit(None).cast("string"))


def resolve_share(
    url: Column, html: Column, resolvers: Sequence[BoxShares] = KNOWN_RESOLVERS
) -> Column:
    """Resolve with the first matching resolver, else the ``no resolver`` error."""
    none = F.lit(None).cast("string")
    result = F.struct(
        none.alias("pdf_url"), none.alias("filename"), F.lit(NO_RESOLVER).alias("error")
    )
    for r in reversed(resolvers):
        result = F.when(r.matches(url), r.resolve(url, html)).otherwise(result)
    return result
