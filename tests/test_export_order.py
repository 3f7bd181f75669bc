"""The ordered export: same rows as the plain one, and contacts that do not travel with every file."""

from pyspark.sql import functions as F

from docaudit.operators import export
from docaudit.operators.export import export_in_order, in_export_order
from docaudit.operators.inventory import export_rows

COLUMNS = ["site", "owner", "responsible", "pdf_url", "parent_url", "file_hash", "violations"]


def _tables(spark, names, emails, per_site):
    contacts = spark.createDataFrame(
        [(i, n, f"o{i}", emails(i)) for i, n in enumerate(names)], "site_id bigint, site string, owner string, responsible string"
    )
    files = spark.range(per_site * (len(names) + 1)).select(  # the last site is unknown
        F.col("id").alias("pdf_id"),
        (F.col("id") / per_site).cast("bigint").alias("site_id"),
        F.concat(F.lit("u"), (F.col("id") * 7919 % per_site).cast("string")).alias("pdf_url"),
        F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("parent_url"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("h"), (F.col("id") % 50).cast("string"))).alias("file_hash"),
    )
    reports = spark.range(40).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("pdf_hash"), F.col("id").alias("violations"))
    return files, contacts, reports


def _shuffled(spark):
    """Bytes that the stages run so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_rows_and_order_are_those_of_the_sorted_export(spark, monkeypatch):
    # Two sites of one name share their ranges; small cuts give every site several.
    for sampled, per_cut in ((4096, 16), (4, 3), (1, 1)):
        monkeypatch.setattr(export, "_SAMPLED", sampled)
        monkeypatch.setattr(export, "_PER_CUT", per_cut)
        tables = _tables(spark, ["b", "a", "b", "c"], lambda i: None if i == 1 else f"e{i}", 300)
        want = in_export_order(export_rows(*tables).select(*COLUMNS)).collect()
        got = export_in_order(*tables).select(*COLUMNS).collect()
        assert len(got) == 1200 and sorted(map(str, got)) == sorted(map(str, want))
        key = [(r["site"], r["pdf_url"], r["parent_url"]) for r in got]
        assert key == [(r["site"], r["pdf_url"], r["parent_url"]) for r in want]


def test_query_does_not_shuffle_contacts_with_every_file(spark, monkeypatch):
    from docaudit.plans import queries_inventory as Q
    from docaudit.plans.registry import QUERIES

    class Fx:
        pass

    names = [f"s{i}" for i in range(3)]
    # Emails that do not compress, as text of random digits.
    text = {i: "".join(r[0] for r in spark.range(400).select(F.sha2((F.col("id") + 1000 * i).cast("string"), 256)).collect()) for i in range(3)}
    fx = Fx()
    fx.files, contacts, fx.reports = _tables(spark, names, text.get, 400)
    fx.files = fx.files.withColumns({c: F.lit(None).cast("string") for c in Q._RAW if c not in (*fx.files.columns, *COLUMNS)})
    monkeypatch.setattr(Q, "_contacts", lambda _: contacts)
    monkeypatch.setattr(Q, "_RAW", COLUMNS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        rows = QUERIES["export_rows"].build(fx)
        assert rows.agg(F.sum(F.length("responsible"))).first()[0] == 3 * 400 * 400 * 64
        rows.write.format("noop").mode("overwrite").save()
        assert _shuffled(spark) - before < 3_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
