from docaudit.operators import ownership as O
from docaudit.sources.files import read_roster_csv

SITE = "site_id bigint, name string, config_json string, enabled boolean, notes string, owner_id bigint"
OWNER = "owner_id bigint, owner_key string, label string, notes string"
PERSON = "person_id bigint, employee_id string, full_name string, email string, is_manager boolean"
PAIR = "person_id bigint, owner_id bigint"


def _config(host):
    return f'{{"seeds": ["https://{host}"], "allowed_hosts": ["{host}"]}}'


def _run(spark, tmp_path, sites=(), owners=(), people=(), pairs=(), **texts):
    rows = {}
    for kind in ("site", "employee", "assignment", "manager"):
        path = None
        if kind in texts:
            file = tmp_path / f"{kind}.csv"
            file.write_text(texts[kind], encoding="utf-8")
            path = str(file)
        rows[f"{kind}_rows"] = read_roster_csv(spark, path)
    site_rows = [(i, n, _config(h), True, None, None) for i, (n, h) in enumerate(sites)]
    return O.import_roster(
        spark.createDataFrame(site_rows, SITE), spark.createDataFrame(list(owners), OWNER),
        spark.createDataFrame(list(people), PERSON), spark.createDataFrame(list(pairs), PAIR), **rows,
    )


def _counts(result):
    return {r["counter"]: r["n"] for r in result.counters.collect()}


def test_full_import(spark, tmp_path):
    r = _run(
        spark, tmp_path, sites=[("web", "web.example.edu")],
        site="﻿www.web.example.edu,GRP\n\n , \n", employee="Full Name,Employee ID,Email\nNo Lan,917,n@x.edu\n",
        manager="Manager ID\n917\n404\n", assignment="GRP,No Lan,917,n@x.edu\nGRP,,555,\n",
    )
    assert _counts(r) == {"owners_created": 1, "people_created": 2, "managers_marked": 1, "memberships_added": 2, "sites_linked": 1}
    people = {p["employee_id"]: (p["full_name"], p["email"], p["is_manager"]) for p in r.people.collect()}
    assert people == {"917": ("No Lan", "n@x.edu", True), "555": ("555", None, False)}
    assert r.site_owners.collect() == [("web", "GRP")]
    assert [tuple(i) for i in r.issues.collect()] == [("warning", "manager 404 not found among people")]


def test_quoted_domains_and_ambiguous_hosts(spark, tmp_path):
    r = _run(
        spark, tmp_path, sites=[("a", "a.e.edu"), ("s1", "x.e.edu"), ("s2", "www.x.e.edu")],
        site='Domain,Security_Group\n"a.e.edu,b.e.edu",G\nx.e.edu,H\n',
    )
    assert _counts(r)["sites_linked"] == 1 and _counts(r)["owners_created"] == 2
    assert sorted(tuple(i) for i in r.issues.collect()) == [("ambiguous", "x.e.edu"), ("unmatched", "b.e.edu")]


def test_reimport_adds_nothing_and_last_row_wins(spark, tmp_path):
    owners = [(1, "A", "Label", "n")]
    people = [(9, "200", "Old", "o@x", True)]
    r = _run(spark, tmp_path, owners=owners, people=people, pairs=[(9, 1)],
             assignment="A,First,200,f@x\nA,Last,200,\n", employee="Emp,200,e@x\n")
    assert _counts(r) == dict.fromkeys(["owners_created", "people_created", "managers_marked", "memberships_added", "sites_linked"], 0)
    assert [tuple(p)[1:] for p in r.people.collect()] == [("200", "Last", None, True)]
    assert [tuple(o) for o in r.owners.collect()] == [(1, "A", "A", None)]


def test_person_in_two_groups(spark, tmp_path):
    r = _run(spark, tmp_path, assignment="A,M P,2005,m@x\nB,M P,2005,m@x\n")
    assert sorted(tuple(p) for p in r.memberships.collect()) == [("2005", "A"), ("2005", "B")]
    assert _counts(r)["people_created"] == 1


def test_missing_files_are_no_ops(spark, tmp_path):
    assert read_roster_csv(spark, None).count() == 0
    assert read_roster_csv(spark, str(tmp_path / "none.csv")).count() == 0
