"""Table layouts and the alignment of older layouts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    """Schema of ``name type, ...``; unlike a DDL parse it needs no running session."""
    pairs = (column.split() for column in spec.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SITE = _struct(
    "site_id bigint, name string, config_json string, enabled boolean, notes string, owner_id bigint"
)
PDF_FILES = _struct(
    "pdf_id bigint, pdf_url string, parent_url string, site_id bigint, file_hash string, "
    "via_resolver string, offsite boolean, local_path string, scanned_at timestamp, "
    "pdf_404 boolean, parent_404 boolean, archived boolean, removed boolean"
)
PDF_REPORT = _struct(
    "pdf_hash string, violations bigint, failed_checks bigint, tagged boolean, image_only boolean, "
    "text_type string, title_set boolean, language_set boolean, page_count bigint, "
    "has_form boolean, complex_graphic boolean"
)
REPORT_RULE = _struct(
    "pdf_hash string, clause string, test_number string, status string, failed_checks bigint, "
    "specification string, description string"
)
FAILURE = _struct(
    "failure_id bigint, site_id bigint, pdf_id bigint, error_message string, created_at timestamp"
)
SITE_OWNER = _struct("owner_id bigint, owner_key string, label string, notes string")
PERSON = _struct(
    "person_id bigint, employee_id string, full_name string, email string, is_manager boolean"
)
PERSON_OWNER = _struct("person_id bigint, owner_id bigint")

SITE_CONFIG = _struct(
    "seeds array<string>, allowed_hosts array<string>, scope string, max_depth int, "
    "render_js boolean, obey_robots boolean, download_delay double, concurrency int, "
    "resolvers array<string>, include_external_pdfs boolean, storage_template string, "
    "path_prefix string"
)

# The column order of every tabular export.
EXPORT_COLUMNS = [
    "site", "owner", "responsible", "pdf_url", "parent_url", "scanned_at", "offsite",
    "via_resolver", "archived", "removed", "pdf_404", "parent_404", "file_hash", "violations",
    "failed_checks", "tagged", "image_only", "text_type", "title_set", "language_set",
    "page_count", "has_form", "complex_graphic", "classification", "classification_reason",
    "local_path",
]

# Defaults of the columns that older layouts lack.
LAYOUT_DEFAULTS: dict[str, object] = {"complex_graphic": False, "owner_id": None}


def align_schema(
    df: DataFrame, target: T.StructType, defaults: Mapping[str, object] = LAYOUT_DEFAULTS
) -> DataFrame:
    """Bring an older layout to ``target``: missing columns get their default."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(defaults.get(f.name)))
            .cast(f.dataType)
            .alias(f.name)
            for f in target.fields
        ]
    )
