from pyspark.sql import functions as F
import json

from docaudit.operators.export import append_failures, write_csv, write_json
from docaudit.sources.files import (
    read_checker_json, read_labelled_set, read_pdf_bytes, read_url_list,
)
from docaudit.sources.schemas import EXPORT_COLUMNS
from docaudit.sources.site_config import with_config


def test_bytes_and_cap(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    (tmp_path / "c.txt").write_bytes(b"no")
    fitting, oversized = read_pdf_bytes(spark, str(tmp_path), max_bytes=50)
    assert [r["path"].rsplit("/", 1)[1] for r in fitting.collect()] == ["a.pdf"]
    assert oversized.collect()[0]["error_message"].endswith("b.pdf: PDF exceeds max_bytes (50)")


def test_labelled_folders(spark, tmp_path):
    root = tmp_path / "eval"
    for folder in ("Good", "auto", "junk"):
        (root / folder).mkdir(parents=True)
        (root / folder / "x.pdf").write_bytes(b"%PDF-")
    (root / "auto" / "deep").mkdir()
    (root / "auto" / "deep" / "y.pdf").write_bytes(b"%PDF-")
    got = {(r["folder"], r["expected"]) for r in read_labelled_set(spark, str(root)).collect()}
    assert got == {("Good", "good_to_go"), ("auto", "fit_for_automated_tagging")}
    assert read_labelled_set(spark, str(tmp_path / "none")).count() == 0


def test_json_and_url_list(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"report": {"jobs": []}}, indent=2))
    assert json.loads(read_checker_json(spark, str(tmp_path / "r.json")).collect()[0]["report_json"]) == {"report": {"jobs": []}}
    (tmp_path / "urls.txt").write_text(" https://a/x.pdf \n\n\t\nhttps://b\n")
    assert [r["url"] for r in read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a/x.pdf", "https://b"]


def test_site_config(spark):
    df = spark.createDataFrame([('{"seeds": ["u"], "max_depth": 3, "old": 1}',), ("{}",)], "config_json string")
    first, second = (r["config"] for r in with_config(df).collect())
    assert (first["seeds"], first["max_depth"], first["scope"], first["resolvers"]) == (["u"], 3, "host", None)
    assert (second["seeds"], second["max_depth"], second["render_js"]) == ([], 0, False)


def test_sinks(spark, tmp_path):
    row = {c: None for c in EXPORT_COLUMNS} | {"site": "hr", "pdf_url": 'https://x/"é,".pdf'}
    rows = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in EXPORT_COLUMNS))
    write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert back.columns == EXPORT_COLUMNS and back.collect()[0]["pdf_url"] == row["pdf_url"]
    write_json(rows, str(tmp_path / "json"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "json").glob("part-*.json"))
    assert "é" in text and list(json.loads(text)) == EXPORT_COLUMNS
    failures = spark.createDataFrame([(1, 2, "m")], "site_id bigint, pdf_id bigint, error_message string")
    append_failures(failures, str(tmp_path / "f"))
    append_failures(failures, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2


def test_cells_with_empty_first_cell_and_line_ends(spark, tmp_path, each):
    from docaudit.sources.files import read_roster_csv, split_cells

    lines = [",x.edu,grp", '"a,""b",,c', ",,", "a", '\ufeff"q",r']
    assert each(lines, split_cells(F.col("x"))) == [["", "x.edu", "grp"], ['a,"b', "", "c"], ["", "", ""], ["a"], ["q", "r"]]
    (tmp_path / "r.csv").write_text('h,i\r\n"two\nlines",c\r\n\n,d,"e ""x\ny"" f"\nlast,row')
    rows = read_roster_csv(spark, str(tmp_path / "r.csv"), multiline=True).orderBy("position").collect()
    assert [r["cells"] for r in rows] == [["h", "i"], ["two\nlines", "c"], ["", "d", 'e "x\ny" f'], ["last", "row"]]


def test_sinks_compress_the_repeated_emails(spark, tmp_path):
    emails = "; ".join(f"p{i}@example.edu" for i in range(60))
    row = {c: None for c in EXPORT_COLUMNS} | {"site": "hr", "responsible": emails}
    data = [tuple((row | {"pdf_url": f'https://x/{i}",é.pdf'}).values()) for i in range(2000)]
    rows = spark.createDataFrame(data, ", ".join(f"{c} string" for c in EXPORT_COLUMNS)).coalesce(1)
    write_csv(rows, str(tmp_path / "csv"), "gzip")
    write_json(rows, str(tmp_path / "json"), "gzip")
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0
    assert spark.read.schema(rows.schema).json(str(tmp_path / "json")).exceptAll(rows).count() == 0
    plain = 2000 * len(emails)
    assert all(sum(p.stat().st_size for p in (tmp_path / d).glob("part-*.gz")) * 10 < plain for d in ("csv", "json"))


def test_roster_query_writes_where_it_reads(spark, tmp_path, monkeypatch):
    import os

    from docaudit.plans import queries_tables as T
    from docaudit.plans.catalog import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.openCostInBytes",)}
    made, path = [], T.new_path
    monkeypatch.setattr(T, "new_path", lambda s, label: made.append(path(s, label)) or made[-1])
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        rows = QUERIES["roster_lines_in_cells"].run(spark, str(tmp_path)).count()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert rows == docs.count()
    assert len([f for f in os.listdir(made[0]) if f.startswith("part-")]) == 6
