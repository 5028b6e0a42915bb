"""Readers, writers and the dump ETL on files made here."""

import json
import os
import zipfile

import pytest

from awardsift import schema, sinks, sources
from awardsift.plans.etl import etl_dumps, process_dumps
from awardsift.plans.similarity import run
from awardsift.sources import files

HEADER = ("award_id_piid,award_id_fain,prime_award_base_transaction_description,current_total_value_of_award,total_obligated_amount,"
          "period_of_performance_current_end_date,recipient_name,awarding_agency_name,ignored\n")


def ids(df):
    return sorted(str(r["piid"]) for r in df.collect())


def test_json_envelope_array_and_lines(spark, tmp_path):
    awards = [{"piid": "a", "value": 5, "savings": 1}, {"piid": "Unavailable", "value": "$7"}, {"piid": None}, {"piid": "Charge Card Purchase"}]
    (tmp_path / "envelope.json").write_text(json.dumps({"data": awards}, indent=2))
    (tmp_path / "array.json").write_text(json.dumps(awards))
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, awards)))
    for name, multi in (("envelope.json", True), ("array.json", True), ("lines.jsonl", False)):
        assert ids(sources.read_labeled(spark, str(tmp_path / name), multi_line=multi)) == ["None", "a"]
        every = sources.read_json_awards(spark, str(tmp_path / name), multi_line=multi)
        assert ids(every) == ["Charge Card Purchase", "None", "Unavailable", "a"]
        assert sorted(str(r["value"]) for r in every.collect()) == ["$7", "5", "None", "None"]
    with pytest.raises(Exception):
        sources.read_labeled(spark, str(tmp_path / "missing.json")).count()


def test_csv_encodings_quotes_and_headers(spark, tmp_path):
    (tmp_path / "utf8.csv").write_text('piid,description,value\nu1,"a ""quoted"", text\nover lines",5\nu2,café,6\n', encoding="utf-8")
    (tmp_path / "latin.csv").write_bytes("piid,value,description\nl1,7,café\n".encode("latin1"))
    (tmp_path / "other.csv").write_text("vendor,piid,extra\nv,o1,x\nN/A,o2,NA\n")
    rows = {r["piid"]: r for r in sources.read_csv_awards(spark, str(tmp_path)).collect()}
    assert rows["u1"]["description"] == 'a "quoted", text\nover lines' and rows["u2"]["description"] == "café"
    assert rows["l1"]["description"] == "café" and rows["l1"]["value"] == "7"
    assert rows["o2"]["vendor"] is None and rows["o2"]["extra"] is None
    assert rows["o1"]["vendor"] == "v" and rows["o1"]["extra"] == "x" and rows["o1"]["description"] is None


def test_read_awards_from_directory_files_and_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("piid,description\nc1,x\nc2,y\n")
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"piid": "j1", "description": "z"}]}))
    (tmp_path / "notes.txt").write_text("not an award")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.csv").write_text("piid\ndeep\n")
    folder = str(tmp_path)
    assert ids(sources.read_awards(spark, folder)) == ["c1", "c2", "j1"]
    assert ids(sources.read_awards(spark, f"{folder}/b.json")) == ["j1"]
    assert ids(sources.read_awards(spark, [f"{folder}/a.csv", f"{folder}/gone.csv", f"{folder}/b.json"])) == ["c1", "c2", "j1"]
    assert sources.read_awards(spark, f"{folder}/notes.txt").count() == 0
    assert sources.read_awards(spark, folder, sample_size=2).count() == 2
    assert sources.read_awards(spark, folder, sample_size=20).count() == 3


def test_latest_snapshot(spark, tmp_path):
    assert sources.latest_snapshot(spark, str(tmp_path / "none")) is None
    for age, name in enumerate(["new.json", "old.json", "newest.txt"]):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1_700_000_000 - age, 1_700_000_000 - age))
    assert sources.latest_snapshot(spark, str(tmp_path)).endswith("/new.json")


def test_paged_responses(spark, tmp_path):
    def page(number, items, pages=9):
        body = {"success": True, "result": {"grants": [{"piid": i} for i in items]}, "meta": {"pages": pages}}
        (tmp_path / f"grants_page_{number}.json").write_text(json.dumps(body))

    page(1, ["a", "b"]), page(2, ["c"]), page(3, []), page(4, ["d"])
    assert ids(sources.read_paged(spark, str(tmp_path), "grants", 10)) == ["a", "b", "c"]
    assert ids(sources.read_paged(spark, str(tmp_path), "grants", 1)) == ["a", "b"]
    page(3, ["x"]), page(2, ["c"], pages=2)
    assert ids(sources.read_paged(spark, str(tmp_path), "grants", 10)) == ["a", "b", "c"]


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text if isinstance(text, bytes) else text.encode())


@pytest.fixture()
def dumps(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    _zip(folder / "department_of_energy_contracts_2024-01-01_to_2024-03-31.zip", {
        "one.csv": HEADER + "c1,,first text,10,,2030-01-01,Acme Inc,DOE,x\nc1,,,20,,2031-01-01,Other,DOE,x\nc2,,old,5,,2020-01-01,V,DOE,x\nc3,,bad,5,,soon,V,DOE,x\n",
        "deep/er/two.csv": HEADER + "c1,,second text,15,,2032-05-05,Third,DOE,x\n,,no id,1,,2030-01-01,V,DOE,x\nc4,,day of,1,,2024-06-01,V,DOE,x\n",
        "readme.txt": "no csv",
    })
    _zip(folder / "department_of_energy_grants_2024-01-01_to_2024-03-31.zip", {
        "g.csv": (HEADER + "ignored,g1,café help,1,99.5,2030-01-01,Ünï,DOE,x\n").encode("latin1"),
        "fallback.csv": "award_id_fain,award_description,total_obligated_amount,period_of_performance_end_date\ng2,other words,7,2033-03-03\n",
        "empty.csv": "",
    })
    _zip(folder / "small_business_administration_contracts_2024.zip", {"x.csv": HEADER + "s1,,aid for all,3,,2030-01-01,V,SBA,x\n"})
    _zip(folder / "moon_office_contracts_2024.zip", {"x.csv": HEADER + "m1,,aid,3,,2030-01-01,V,MOON,x\n"})
    _zip(folder / "department_of_energy_2024.zip", {"x.csv": HEADER + "n1,,aid,3,,2030-01-01,V,DOE,x\n"})
    (folder / "department_of_labor_contracts_bad.zip").write_text("this is no archive")
    return str(folder)


def test_dump_listing(spark, dumps):
    assert [r["file_name"] for r in sources.dump_files(spark, dumps, "Department of Energy", "grants").collect()] == [
        "department_of_energy_grants_2024-01-01_to_2024-03-31.zip"]
    parsed = sources.parse_dump_names(sources.list_archives(spark, dumps)).collect()
    assert sorted((r["acronym"], r["award_type"]) for r in parsed) == [
        ("DOE", "contracts"), ("DOE", "grants"), ("DOL", "contracts"), ("SBA", "contracts")]


def test_zipped_rows(spark, dumps):
    rows = sources.read_zipped_csv(spark, sources.dump_files(spark, dumps, "Department of Energy", "contracts"))
    assert rows.count() == 7 and set(schema.RAW_DUMP.names) <= set(rows.columns) and "ignored" not in rows.columns
    assert sorted({r["member"] for r in rows.collect()}) == ["deep/er/two.csv", "one.csv"]
    grants = sources.read_zipped_csv(spark, sources.dump_files(spark, dumps, "Department of Energy", "grants")).collect()
    assert {r["prime_award_base_transaction_description"] for r in grants} == {"café help", None}


def test_dump_etl(spark, dumps):
    got = {r["piid"]: r for r in etl_dumps(spark, dumps, "2024-06-01").collect()}
    assert set(got) == {"c1", "g1", "g2", "s1"}
    c1 = got["c1"]
    assert (c1["value"], str(c1["end_date"])[:10], c1["department"], c1["acronym"]) == (20.0, "2032-05-05", "Department of Energy", "DOE")
    # "first" follows path, member and row: the nested member sorts before the other one.
    assert (c1["description"], c1["vendor"]) == ("second text", "Third")
    assert got["g1"]["description"] == "café help" and got["g1"]["value"] == 99.5
    assert got["g2"]["description"] == "other words" and str(got["g2"]["end_date"])[:10] == "2033-03-03"
    assert set(ids(etl_dumps(spark, dumps, "2024-06-01", ["aid"]))) == {"s1"}
    assert etl_dumps(spark, dumps, "2099-01-01").count() == 0


def test_sinks(spark, dumps, tmp_path):
    awards = etl_dumps(spark, dumps, "2024-06-01")
    out = str(tmp_path / "out")
    sinks.write_awards(awards, f"{out}/processed")
    assert ids(spark.read.parquet(f"{out}/processed/award_type=grants")) == ["g1", "g2"]
    sinks.write_awards(awards, f"{out}/csv", kind="csv")
    assert ids(spark.read.csv(f"{out}/csv", header=True)) == ids(awards)
    scored = spark.createDataFrame(
        [("a", "d,\n\"q\"", 0.5, True, 1), ("b", "e", 0.9, False, 2), ("c", "f", 0.7, True, 3)],
        "piid string, description string, anomaly_score double, for_review boolean, other int")
    folder = sinks.write_predictions(scored, out, "20250401215128")
    assert folder.endswith("anomaly_predictions_20250401215128")
    assert [r["run_ts"] for r in spark.read.parquet(folder).collect()] == ["20250401215128"] * 3
    review = spark.read.csv(sinks.write_review(scored, out), header=True, multiLine=True, escape='"')
    assert review.columns == ["piid", "description", "anomaly_score", "for_review"]
    assert sorted((r["piid"], r["description"]) for r in review.collect()) == [("a", 'd,\n"q"'), ("c", "f")]
    snapshot = sinks.write_snapshot(spark.createDataFrame([("z", 1)], "piid string, savings long"), out, "contracts")
    assert ids(sources.read_labeled(spark, snapshot)) == ids(sources.read_labeled(spark, snapshot, multi_line=False)) == ["z"]
    assert len(snapshot.removesuffix(".json").rsplit("_", 1)[1]) == 14 and sources.latest_snapshot(spark, out).endswith(snapshot.rsplit("/", 1)[1])
    sinks.write_pairs(spark.createDataFrame([(2, 0, 0.99)], "i int, j int, r double"), f"{out}/pairs")
    sinks.write_records(scored, f"{out}/records")
    assert spark.read.json(f"{out}/pairs").count() == 1 and spark.read.json(f"{out}/records").count() == 3
    outputs = spark.createDataFrame([("DOE", "grants", "x"), ("DOE", "contracts", ""), ("VA", "grants", None)], "department string, award_type string, path string")
    sinks.write_summary(outputs, f"{out}/summary")
    assert [r.asDict(True) for r in spark.read.json(f"{out}/summary").collect()] == [{"department": "DOE", "paths": {"grants": "x"}}]


def test_bad_json(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"data": [')
    (tmp_path / "good.json").write_text(json.dumps([{"piid": "g", "savings": 1.5}]))
    assert ids(sources.read_awards(spark, str(tmp_path))) == ["g"]
    assert ids(sources.read_labeled(spark, str(tmp_path / "good.json"))) == ["g"]
    with pytest.raises(Exception):
        sources.read_labeled(spark, str(tmp_path / "bad.json")).collect()


def test_process_dumps(spark, dumps, tmp_path):
    summary = {r["department"]: r["paths"] for r in process_dumps(spark, dumps, str(tmp_path / "out"), "2024-06-01").collect()}
    assert {k: set(v) for k, v in summary.items()} == {"DOE": {"contracts", "grants"}, "SBA": {"contracts"}}
    assert ids(spark.read.parquet(summary["DOE"]["grants"])) == ["g1", "g2"]
    assert spark.read.json(str(tmp_path / "out" / "summary")).count() == 2


def test_run_from_files(spark, tmp_path):
    words = ["support", "training", "software", "road", "bridge"]
    rows = [{"piid": f"p{i}", "description": f"{words[i % 5]} {words[i % 3]}", "value": i * 100, "vendor": f"V{i % 4}", "agency": f"A{i % 2}"} for i in range(60)]
    (tmp_path / "labeled.json").write_text(json.dumps({"data": rows[:40]}))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "new.json").write_text(json.dumps(rows[30:]))
    out = str(tmp_path / "out")
    got = run(spark, str(tmp_path / "labeled.json"), str(tmp_path / "in"), out, text_size=16, n_estimators=10)
    assert ids(got) == sorted(f"p{i}" for i in range(40, 60))
    scores = [r["anomaly_score"] for r in got.collect()]
    assert scores == sorted(scores, reverse=True)
    review = spark.read.csv(f"{out}/anomaly_predictions", header=True)
    assert review.count() == got.where("for_review").count()
    assert set(os.listdir(f"{out}/model")) == {"forest", "params", "scaler", "categories", "labeled_ids"}


def test_json_layout_is_found_per_file(spark, tmp_path):
    """Lines, envelopes and arrays, on one line or several, without being told; no row is lost."""
    rows = [{"piid": f"p{i}", "value": i} for i in range(5)]
    (tmp_path / "lines.json").write_text("\n" + "\n".join(map(json.dumps, rows)) + "\n")
    (tmp_path / "one_line.json").write_text(json.dumps({"data": rows}))
    (tmp_path / "pretty.json").write_text(json.dumps({"data": rows}, indent=2))
    (tmp_path / "array.json").write_text("﻿" + json.dumps(rows, indent=1), encoding="utf-8")
    (tmp_path / "mixed.json").write_text("\n".join([json.dumps({"data": rows[:3]}), json.dumps(rows[3]), json.dumps(rows[4])]))
    for name in ("lines", "one_line", "pretty", "array", "mixed"):
        assert ids(sources.read_labeled(spark, str(tmp_path / f"{name}.json"))) == [f"p{i}" for i in range(5)], name
    assert sources.read_awards(spark, str(tmp_path)).count() == 25


def test_bad_first_line_costs_itself_alone(spark, tmp_path):
    rows = [json.dumps({"piid": f"p{i}"}) for i in range(4)]
    firsts = {"cut": '{"piid": "x", "description": "ab', "open": '{"piid": "x",', "comment": "# exported", "after": '{"piid": "x"}}'}
    for name, first in firsts.items():
        (tmp_path / f"{name}.json").write_text("\n".join([first, *rows]))
        kept = ids(sources.read_awards(spark, str(tmp_path / f"{name}.json")))
        assert kept == ["p0", "p1", "p2", "p3", *["x"] * (name == "after")], name
    assert {r["line"] for r in sources.rejected_awards(spark, str(tmp_path)).collect()} == {firsts[k] for k in ("cut", "open", "comment")}
    with pytest.raises(Exception, match="not a JSON award file"):
        sources.read_labeled(spark, str(tmp_path / "cut.json")).collect()


def test_long_first_lines_are_decided_by_their_brackets(tmp_path):
    long = "x" * 50 + '\\"]}'
    cases = {
        "lines": (json.dumps({"piid": long}) + "\n" + json.dumps({"piid": "b"}), True), "value": ('{"data": [' + json.dumps({"piid": long}) + ",\n" + '{"piid": "b"}]}', False),
        "one": (json.dumps([{"piid": long}]), True),
    }
    for name, (text, by_line) in cases.items():
        (tmp_path / name).write_text(text)
        assert [files.is_by_line(str(tmp_path / name), most) for most in (1 << 26, *range(8, 30))] == [by_line] * 23, name


def test_two_values_never_pass_silently(spark, tmp_path):
    rows = json.dumps({"piid": "a"}, indent=2)
    (tmp_path / "two.json").write_text(rows + "\n" + rows)
    for read in (sources.read_labeled, sources.read_json_awards):
        with pytest.raises(Exception, match="more than one JSON value"):
            read(spark, str(tmp_path / "two.json")).collect()


def test_snapshot_round_trip(spark, tmp_path):
    out = str(tmp_path / "snapshots")
    rows = spark.createDataFrame([(f"p{i}", f"road {i}", i * 10) for i in range(50)], "piid string, description string, value long")
    sinks.write_snapshot(rows.limit(3), out, "contracts", "20250101000000")
    newest = sinks.write_snapshot(rows.repartition(4), out, "contracts", "20250102000000")
    found = sources.latest_snapshot(spark, out)
    assert found.endswith(newest.rsplit("/", 1)[1])
    assert ids(sources.read_labeled(spark, found)) == sorted(f"p{i}" for i in range(50))
    scored = run(spark, found, found, str(tmp_path / "out"), text_size=8, n_estimators=5)
    assert scored.count() == 0  # all of them are labeled


def test_run_loads_or_trains_and_keeps_a_department(spark, tmp_path):
    rows = [{"piid": f"p{i}", "description": f"road {i % 5}", "value": i, "vendor": f"V{i % 3}", "agency": f"Dept {'A' if i % 2 else 'B'}"} for i in range(40)]
    (tmp_path / "labeled.json").write_text(json.dumps({"data": rows[:30]}))
    (tmp_path / "new.json").write_text(json.dumps(rows[20:]))
    paths, out = (str(tmp_path / "labeled.json"), str(tmp_path / "new.json")), str(tmp_path / "out")
    settings = {"text_size": 8, "n_estimators": 5}
    first = run(spark, *paths, f"{out}1", load_from=str(tmp_path / "none"), **settings)
    again = run(spark, str(tmp_path / "gone.json"), paths[1], f"{out}2", load_from=f"{out}1/model")
    assert [r["anomaly_score"] for r in first.collect()] == [r["anomaly_score"] for r in again.collect()] and first.count() == 10
    assert not os.path.exists(f"{out}2/model")
    some = run(spark, *paths, f"{out}3", department="dept a", **settings)
    assert {r["agency"] for r in some.collect()} == {"Dept A"}


def test_dump_selection_and_rejected_archives(spark, dumps, tmp_path):
    assert set(ids(etl_dumps(spark, dumps, "2024-06-01", departments=["department of ENERGY"], award_types=["grants"]))) == {"g1", "g2"}
    members = sources.archive_members(spark, sources.select_dumps(sources.parse_dump_names(sources.list_archives(spark, dumps)), ["Small Business Administration"]))
    assert [r["member"] for r in members.collect()] == ["x.csv"]
    process_dumps(spark, dumps, str(tmp_path / "out"), "2024-06-01")
    rejected = spark.read.json(str(tmp_path / "out" / "rejected")).collect()
    assert len(rejected) == 1 and rejected[0]["path"].endswith("department_of_labor_contracts_bad.zip") and rejected[0]["error"]


def test_dump_amounts(spark, dumps, tmp_path):
    folder = tmp_path / "more"
    folder.mkdir()
    _zip(folder / "department_of_energy_contracts_2024.zip", {"a.csv": HEADER + 'a,,t,"$1,234.50",,2030-01-01,V,DOE,x\nb,,t,12d,,2030-01-01,V,DOE,x\nc,,t,,,2030-01-01,V,DOE,x\n'})
    assert {r["piid"]: r["value"] for r in etl_dumps(spark, str(folder), "2024-01-01").collect()} == {"a": 1234.5, "b": None, "c": None}
