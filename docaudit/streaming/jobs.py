"""Discovery, verification and triage as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.functions.suffixes import DEFAULT_SUFFIXES, SuffixRules
from docaudit.operators.inventory import FILE_KEY, upsert_files
from docaudit.operators.links import absolute_links, classify_links
from docaudit.operators.ordering import last_per_key
from docaudit.operators.resolve import resolve_links
from docaudit.operators.rules import Policy, list_rules, read_rules, rescore, summarize
from docaudit.operators.status import triage_reports
from docaudit.shared import discard, written
from docaudit.sources.policy import RulePolicyTable, TriageProfile, TriageProfileTable
from docaudit.streaming.sinks import start, tables_writer, write_batch


def stream_folder(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    *,
    glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream, in bounded chunks."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def discovery(
    links: DataFrame,
    settings: DataFrame,
    site_of,
    suffixes: SuffixRules = DEFAULT_SUFFIXES,
    once: bool = True,
) -> DataFrame:
    """Stream of discovered PDFs and share links, each (url, parent_url) once.

    A share link has ``action`` share and the resolver's name; its page is resolved when the log is merged.
    ``settings`` is the static crawl settings table, ``site_of`` the site key of a page
    URL. The dedup state holds every pair seen. With ``once`` off the stream is stateless and pairs may repeat;
    :func:`run_bounded_discovery` then compares each batch with the log instead.
    """
    located = absolute_links(links).withColumn("site_id", site_of(F.col("parent_url")))
    found = classify_links(located.join(settings, "site_id"), suffixes).where(F.col("action").isin("pdf", "share"))
    rows = found.select(
        F.col("url").alias("pdf_url"),
        "parent_url",
        "site_id",
        F.when(F.col("action") == "share", F.col("via_resolver")).alias("via_resolver"),
        "offsite",
        "action",
    )
    return rows.dropDuplicates(FILE_KEY) if once else rows


def run_discovery(found: DataFrame, log: str, checkpoint: str, run: int = 0) -> None:
    """Append discovered rows to a log, one partition per batch.

    The log is merged into the inventory by :func:`merge_discovery`, so that no batch has to
    rewrite the inventory.
    """
    start(found, lambda rows, i: write_batch(rows, log, i, run), checkpoint).awaitTermination()


def run_bounded_discovery(found: DataFrame, log: str, checkpoint: str, run: int = 0, buckets: int | None = None) -> None:
    """As :func:`run_discovery`, for ``discovery(once=False)``: nothing is kept between batches but the log.

    The log is bucketed by the pair, so a batch meets it without a shuffle of the log. A batch that runs again does not
    look at its own rows of the first time, and replaces them.
    """
    spark = found.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"log_{uuid.uuid4().hex}"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    spark.sql(
        f"CREATE TABLE {name} ({fields}, run INT, batch BIGINT) USING parquet OPTIONS (path '{log}') "
        f"PARTITIONED BY (run, batch) CLUSTERED BY ({', '.join(FILE_KEY)}) INTO {n} BUCKETS"
    )
    folder = spark._jvm.org.apache.hadoop.fs.Path(log)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    spark.catalog.recoverPartitions(name)  # the batches of earlier runs

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        own = (F.col("run") == run) & (F.col("batch") == batch_id)
        known = session.table(name).where(~own).select(*FILE_KEY)
        fresh = batch.repartition(n, *FILE_KEY).dropDuplicates(FILE_KEY).join(known, FILE_KEY, "left_anti")
        rows = written(fresh.select(*batch.columns), "batch")
        session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        placed = rows.repartition(n, *FILE_KEY).withColumns({"run": F.lit(run), "batch": F.lit(batch_id).cast("bigint")})
        placed.write.insertInto(name, overwrite=True)
        session.catalog.refreshTable(name)
        discard(rows)

    start(found, process, checkpoint).awaitTermination()
    spark.sql(f"DROP TABLE {name}")  # the name only; the log stays


def merge_discovery(
    files: DataFrame, log: DataFrame, snapshots: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Inventory after a discovery log, and the share links that led to no document.

    ``snapshots`` (url, html) has the fetched share pages.
    """
    direct = log.where(F.col("action") == "pdf")
    shares = log.where(F.col("action") == "share").withColumnRenamed("pdf_url", "share_url")
    resolved, failures = resolve_links(shares, snapshots)
    columns = ["pdf_url", "parent_url", "site_id", "via_resolver", "offsite"]
    return upsert_files(files, direct.select(*columns).unionByName(resolved.select(*columns)), now), failures


def run_verification(
    reports: DataFrame, policy: Policy, root: str, checkpoint: str, run: int = 0, order: str | None = None
) -> None:
    """Checker reports in chunks to rule and summary logs; resumable per batch.

    A document that comes several times in a batch counts with its last report by the column ``order``, without one with
    the greatest text. Every validation has a summary
    row, also one without rules, so the summaries say which batch of a document is valid.
    """

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        columns = ["pdf_hash", "report_json", *([order] if order else [])]
        last = last_per_key(batch.select(*columns), ["pdf_hash"], F.col(order) if order else None)
        # Both logs start from the rules: a table of the reports would be parsed for each of them.
        read = written(read_rules(last), "read")
        rules = list_rules(read)
        return {"rules": rules, "summaries": summarize(rules, policy, read)}

    start(reports, tables_writer(split, root, run), checkpoint).awaitTermination()


def latest_by_hash(log: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Rows of the last run and batch that validated each document.

    ``summaries`` is the log with a row for every validation; a log of rules alone does not
    show that a document was found to have none.
    """
    number = F.struct("run", "batch")
    last = (log if summaries is None else summaries).groupBy("pdf_hash").agg(F.max(number).alias("_last"))
    last = last.select("pdf_hash", "_last.run", "_last.batch")
    return log.join(last, ["pdf_hash", "run", "batch"]).drop("run", "batch")


POLICY_VERSIONS = "version bigint, clause string, test_number string, action string"


def add_policy_version(policy: DataFrame, folder: str, version: int) -> None:
    """Store (clause, test_number, action) rows as one version; the same version again replaces itself."""
    rows = policy.select("clause", "test_number", "action")
    rows.write.mode("overwrite").parquet(f"{folder}/version={version}")


def newest_policy(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """Number and rows of the newest version; the files of older ones are not read."""
    versions = spark.read.schema(POLICY_VERSIONS).parquet(folder)
    newest = versions.agg(F.max("version")).first()[0]
    if newest is None:
        return 0, versions.drop("version")
    return newest, versions.where(F.col("version") == newest).drop("version")


def run_versioned_triage(
    reports: DataFrame,
    rules: DataFrame,
    policies: str,
    profile: TriageProfile | TriageProfileTable,
    path: str,
    checkpoint: str,
    run: int = 0,
) -> None:
    """Triage of a report stream under the policy that is newest when a batch starts.

    ``policies`` is the folder of :func:`add_policy_version`. Every batch rescores its reports from the stored rules of its
    own documents and stamps ``policy_version`` on each row. So a changed policy needs no restart, and the
    rows of an older version can be found and put into the stream again. A batch that runs again replaces itself.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version, rows = newest_policy(spark, policies)
        policy = RulePolicyTable.of(rows)
        batch = written(batch, "reports")
        own = written(rules.join(batch.select("pdf_hash").distinct(), "pdf_hash", "left_semi"), "rules")
        triaged = triage_reports(rescore(batch, own, policy), own, policy, profile)
        write_batch(triaged.withColumn("policy_version", F.lit(version).cast("bigint")), path, batch_id, run)
        discard(batch, own, policy.pairs)

    start(reports, process, checkpoint).awaitTermination()


def run_triage(triaged: DataFrame, path: str, checkpoint: str) -> None:
    """Stateless triage of a report stream into an append-only table."""
    (
        triaged.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
