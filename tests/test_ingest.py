"""Import with quarantine: hostile file of FIXTURES.md section 1 and edge cases."""
import datetime as dt
import os
import tempfile
from decimal import Decimal as D

import pytest

from regiopanel.sources import ingest as ING
from tests.seed import seed_governorates

HOSTILE = """governorate_id,month_index,total_visitors
1,2025-01-01,60000
1,2025-01-01,61000
x,2025-02-01,5
2,bad,5
3,2025-02-01,-4
4,2025-02-01,
01,2025-01-01,62000
y,bad,-1
5,2025-1-5,7
2,bad,5
6
"""


def _csv(text, name="f.csv", bom=False):
    d = tempfile.mkdtemp(prefix="rp-import-")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8-sig" if bom else "utf-8") as f:
        f.write(text)
    return p


def test_hostile_visitors_file(spark):
    r = ING.import_csv(spark, _csv(HOSTILE, bom=True), "visitors_monthly")
    s = r["summary"].collect()[0].asDict()
    assert (s["processed_rows"], s["success_rows"], s["error_rows"]) == (11, 5, 6)
    assert (s["duplicates_in_file"], s["negative_values"], s["invalid_months"], s["null_like_values"]) == (2, 1, 3, 1)
    assert s["status"] == "completed_with_errors" and s["message"] == "Imported 5 row(s)"
    loaded = sorted(tuple(x) for x in r["loaded"].collect())
    assert loaded == [(1, dt.date(2025, 1, 1), D("62000.00")), (3, dt.date(2025, 2, 1), D("-4.00")),
                      (5, dt.date(2025, 1, 5), D("7.00"))]
    errs = [(x["row_number"], x["error_message"]) for x in r["errors"].orderBy("row_number").collect()]
    assert [e[0] for e in errs] == [4, 5, 7, 9, 11, 12]
    assert errs[0][1] == "invalid literal for int() with base 10: 'x'"
    assert errs[1][1] == "time data 'bad' does not match format '%Y-%m-%d'"


def test_missing_column_rejects_whole_file(spark):
    with pytest.raises(ING.ImportRejected, match="Missing columns: total_visitors"):
        ING.import_csv(spark, _csv("governorate_id,month_index\n1,2025-01-01\n"), "visitors_monthly")
    with pytest.raises(ING.ImportRejected, match="Unsupported dataset_type"):
        ING.import_csv(spark, _csv("a\n1\n"), "nope")


def test_header_only_file_empties_target(spark):
    r = ING.import_csv(spark, _csv("governorate_id,month_index,total_visitors\n"), "visitors_monthly")
    assert r["loaded"].count() == 0
    s = r["summary"].collect()[0]
    assert (s["processed_rows"], s["status"]) == (0, "completed")


def test_all_rows_bad_and_extra_column(spark):
    r = ING.import_csv(spark, _csv("governorate_id,month_index,total_visitors,note\nq,2025-01-01,1,a\n"
                                   "2,2025-13-01,1,b\n"), "visitors_monthly")
    assert r["loaded"].count() == 0
    s = r["summary"].collect()[0]
    assert (s["error_rows"], s["invalid_months"]) == (2, 1)
    raw = r["errors"].orderBy("row_number").collect()[0]["raw_row_json"]
    assert '"note":"a"' in raw


def test_rooms_beds_negative_counted_once_and_occupancy(spark):
    r = ING.import_csv(spark, _csv("governorate_id,month_index,total_rooms,total_beds\n1,2025-01-01,-1,-2\n"
                                   "1,2025-02-01,3,x\n"), "rooms_beds_monthly")
    s = r["summary"].collect()[0]
    assert (s["negative_values"], s["success_rows"], s["error_rows"]) == (1, 1, 1)
    r = ING.import_csv(spark, _csv("governorate_id,month_index,average_occupancy_rate\n2,2025-01-01,0.71\n"),
                       "hotel_occupancy_monthly")
    assert r["loaded"].collect()[0]["average_occupancy_rate"] == D("0.7100")


def test_unknown_region_is_quarantined(spark):
    gov = seed_governorates(spark)
    r = ING.import_csv(spark, _csv("governorate_id,month_index,total_visitors\n1,2025-01-01,5\n99,2025-01-01,5\n"),
                       "visitors_monthly", governorate=gov)
    assert r["loaded"].count() == 1
    assert "99" in r["errors"].collect()[0]["error_message"]
    assert ING.fk_violations(ING.import_csv(
        spark, _csv("governorate_id,month_index,total_visitors\n99,2025-01-01,5\n"),
        "visitors_monthly")["loaded"], gov).count() == 1


def test_boundaries_import_last_row_wins(spark):
    text = ('governorate_id,governorate_code,governorate_name_en,wkt\n'
            '1,AMM,Amman,"POLYGON((35.80 31.80,36.20 31.80,36.20 31.40,35.80 31.40,35.80 31.80))"\n'
            '1,AM2,Amman2,"MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5),(5.1 5.1,5.2 5.1,5.2 5.2,5.1 5.1)))"\n'
            '2,AQA,Aqaba,"POINT(1 2)"\n'
            '3,XX,Open,"POLYGON((0 0,1 0,1 1,0 1))"\n')
    r = ING.import_csv(spark, _csv(text), "admin_boundaries")
    rows = r["loaded"].collect()
    assert len(rows) == 1 and rows[0]["governorate_code"] == "AM2"
    coords = rows[0]["boundary_coords"]
    assert len(coords) == 2 and len(coords[1]) == 2 and coords[1][1][0] == [5.1, 5.1]
    assert r["summary"].collect()[0]["error_rows"] == 2


def test_row_numbers_across_splits(spark):
    """Record ordinals stay dense and in file order when a file is split."""
    lines = ["governorate_id,month_index,total_visitors"] + [f"{i},2025-01-01,{i}" for i in range(1, 20001)]
    p = _csv("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        raw = ING.read_csv_raw(spark, p, "visitors_monthly")
        assert raw.rdd.getNumPartitions() > 1
        rows = ING.with_line_numbers(raw, raw).select("row_number", "governorate_id").collect()
        ordered = [int(r["governorate_id"]) for r in raw.orderBy("_row").select("governorate_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["row_number"] for r in rows) == list(range(2, 20002))
    assert all(int(r["governorate_id"]) == r["row_number"] - 1 for r in rows)
    assert ordered == list(range(1, 20001))


def test_duplicate_flags_and_ledgers(spark):
    r = ING.import_csv(spark, _csv(HOSTILE), "visitors_monthly")
    flags = ING.with_line_numbers(ING.duplicate_flags(r["typed"], "visitors_monthly"), r["typed"])
    assert [x["row_number"] for x in flags.where("is_duplicate").orderBy("row_number").collect()] == [3, 11]
    job = ING.job_row(r["summary"], 7, "visitors_monthly", "hostile.csv").collect()[0]
    assert (job["import_job_id"], job["status"], job["error_rows"]) == (7, "completed_with_errors", 6)
    led = ING.error_ledger_rows(r["errors"], 7)
    assert [x["row_number"] for x in ING.list_errors(led, 7).collect()] == [4, 5, 7, 9, 11, 12]


def test_multiline_quoted_fields_and_nonfinite(spark):
    text = ('governorate_id,governorate_code,governorate_name_en,wkt\n'
            '1,AMM,"Amman\nCity","POLYGON((0 0,1 0,1 1,0 0))"\n'
            '2,AQA,Aqaba,"POLYGON((0 0,2 0,2 2,0 0))"\n')
    r = ING.import_csv(spark, _csv(text), "admin_boundaries")
    names = {x["governorate_id"]: x["governorate_name_en"] for x in r["loaded"].collect()}
    assert names == {1: "Amman\nCity", 2: "Aqaba"}
    assert r["summary"].collect()[0]["processed_rows"] == 2
    r = ING.import_csv(spark, _csv("governorate_id,month_index,total_visitors\n1,2025-01-01,nan\n"),
                       "visitors_monthly")
    assert r["errors"].collect()[0]["error_message"] == "non-finite value rejected: 'nan'"


def test_hot_duplicate_key(spark):
    """A third of the file on one key: counters and last-row-wins stay exact."""
    lines = ["governorate_id,month_index,total_visitors"]
    for i in range(1, 3001):
        lines.append(f"1,2025-01-01,{i}" if i % 3 == 0 else f"{i},2025-01-01,{i}")
    r = ING.import_csv(spark, _csv("\n".join(lines) + "\n"), "visitors_monthly")
    s = r["summary"].collect()[0]
    assert (s["processed_rows"], s["duplicates_in_file"], s["error_rows"]) == (3000, 1000, 0)  # rows 1 and 3k on key 1
    won = r["loaded"].where("governorate_id = 1").collect()
    assert len(won) == 1 and won[0]["total_visitors"] == D("3000.00")
    assert r["loaded"].count() == 2000


def test_non_ascii_digits_parse_like_python(spark):
    text = "governorate_id,month_index,total_visitors\n٣,٢٠٢٥-٠١-٠١,١٢٣.٥\n４,2025-02-01,７\n٣,bad,1\n"
    r = ING.import_csv(spark, _csv(text), "visitors_monthly")
    got = sorted(tuple(x) for x in r["loaded"].collect())
    assert got == [(3, dt.date(2025, 1, 1), D("123.50")), (4, dt.date(2025, 2, 1), D("7.00"))]
    assert '"governorate_id":"٣"' in r["errors"].collect()[0]["raw_row_json"]


def test_folder_of_files_numbers_per_file(spark):
    d = tempfile.mkdtemp(prefix="rp-folder-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("governorate_id,month_index,total_visitors\n1,2025-01-01,10\nbad,2025-01-01,1\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("governorate_id,month_index,total_visitors\nx,2025-01-01,1\n1,2025-01-01,20\n")
    r = ING.import_csv(spark, d, "visitors_monthly")
    errs = sorted((x["row_number"], x["error_message"][:30]) for x in r["errors"].collect())
    assert [e[0] for e in errs] == [2, 3]                      # numbered within each file
    won = r["loaded"].collect()
    assert len(won) == 1 and won[0]["total_visitors"] == D("20.00")   # b.csv comes after a.csv


def test_python_whitespace_rules(spark):
    text = "governorate_id,month_index,total_visitors,note\n\t12 ,2025-01-01, 5 ,\t\n13,2025-01-01,7,x\n"
    r = ING.import_csv(spark, _csv(text), "visitors_monthly")
    s = r["summary"].collect()[0]
    assert (s["success_rows"], s["null_like_values"]) == (2, 1)      # the tab-only note is blank
    got = sorted((x["governorate_id"], x["total_visitors"]) for x in r["loaded"].collect())
    assert got == [(12, D("5.00")), (13, D("7.00"))]


def test_doubled_quotes_and_differing_headers(spark):
    d = tempfile.mkdtemp(prefix="rp-hdr-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write('governorate_id,governorate_code,governorate_name_en,wkt\n1,A,"Al ""X"" Gov","POLYGON((0 0,1 0,1 1,0 0))"\n')
    got = ING.import_csv(spark, os.path.join(d, "a.csv"), "admin_boundaries")["loaded"].collect()
    assert got[0]["governorate_name_en"] == 'Al "X" Gov'
    e = tempfile.mkdtemp(prefix="rp-hdr-")
    for name, head in (("1.csv", "total_rooms,total_beds"), ("2.csv", "total_beds,total_rooms")):
        with open(os.path.join(e, name), "w") as f:
            f.write(f"governorate_id,month_index,{head}\n1,2026-01-01,10,20\n")
    with open(os.path.join(e, "3.csv"), "w") as f:
        f.write('note,month_index,governorate_id,total_beds,total_rooms\n"a\nb",2026-02-01,1,7,8\n,2026-02-01,x,7,8\n')
    r = ING.import_csv(spark, e, "rooms_beds_monthly")
    assert sorted(tuple(x) for x in r["loaded"].collect()) == [    # columns go by each file's header
        (1, dt.date(2026, 1, 1), D("20.00"), D("10.00")), (1, dt.date(2026, 2, 1), D("8.00"), D("7.00"))]
    bad = r["errors"].collect()
    assert [(x.row_number, x.raw_row_json) for x in bad] == [
        (3, '{"note":"","month_index":"2026-02-01","governorate_id":"x","total_beds":"7","total_rooms":"8"}')]
    with open(os.path.join(e, "4.csv"), "w") as f:
        f.write("governorate_id,month_index,total_beds\n1,2026-01-01,10\n")
    with pytest.raises(ING.ImportRejected, match="Missing columns: total_rooms"):
        ING.import_csv(spark, e, "rooms_beds_monthly")
