"""Site configuration stored as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.sources.schemas import SITE_CONFIG

# Defaults of the keys a configuration may leave out.
_DEFAULTS = {
    "scope": "host",
    "max_depth": 0,
    "render_js": False,
    "obey_robots": False,
    "include_external_pdfs": False,
}


def parse_site_config(raw: Column) -> Column:
    """Struct with every configuration field; unknown keys are ignored."""
    parsed = F.from_json(raw, SITE_CONFIG)
    fields = []
    for field in SITE_CONFIG.fields:
        value = parsed[field.name]
        if field.name in ("seeds", "allowed_hosts"):
            value = F.coalesce(value, F.array().cast("array<string>"))
        elif field.name in _DEFAULTS:
            value = F.coalesce(value, F.lit(_DEFAULTS[field.name]))
        fields.append(value.alias(field.name))
    return F.struct(*fields)


def with_config(sites: DataFrame, column: str = "config_json") -> DataFrame:
    return sites.withColumn("config", parse_site_config(F.col(column)))
