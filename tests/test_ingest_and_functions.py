"""Raw pipe files, tolerant parsing, alias contract, scalar edge cases."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from loanlens.functions import scalar as X
from loanlens.operators import snapshot as snap
from loanlens.sources import ingest as I


def _line(loan, month, orig="012019", status="0", upb="1000", rate="4.5"):
    f = [""] * I.COMBINED_WIDTH
    f[1], f[2], f[7], f[9], f[11], f[12], f[13] = loan, month, rate, "200000", upb, "360", orig
    f[19], f[22], f[23], f[26], f[27], f[29], f[30] = "80", "30", "700", "P", "SF", "P", "CA"
    f[39], f[41] = status, "N"
    return "|".join(f)


def test_combined_pipe_files(spark):
    d = tempfile.mkdtemp(prefix="loanlens-test-")
    lines = []
    for m in range(1, 19):
        mon = f"{(m % 12) + 1:02d}{2019 + m // 12}"
        status = "XX" if (m == 3) else ("3" if m > 6 else "0")
        upb = "" if m == 6 else str(1000 - m)
        lines.append(_line("L1", mon, status=status, upb=upb))
        lines.append(_line("L2", mon + " ", status="0"))           # trailing blank still parses
    with open(os.path.join(d, "2019Q1.csv"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    raw = I.read_combined(spark, [os.path.join(d, "2019Q1.csv")])
    panel = I.typed_panel(raw)
    rows = panel.filter("loan_id = 'L1'").collect()
    assert sum(r["current_delinquency_status"] is None for r in rows) == 1          # 'XX' -> NULL
    assert sum(r["current_actual_upb"] is None for r in rows) == 1                  # blank -> NULL
    assert panel.filter("loan_id = 'L2'").filter(F.col("reporting_month").isNull()).count() == 0
    out = {r["loan_id"]: r for r in snap.build_snapshot(panel).collect()}
    assert "L1" not in out                      # an 'XX' month in 1-6 leaves only 5 history rows
    assert out["L2"]["bad_12m_90dpd"] == 0
    assert raw.select("source_file").first()[0] == "2019Q1.csv"


def test_latest_balance_skips_null(spark):
    rows = []
    for m in range(1, 19):
        upb = None if m == 6 else float(1000 - m)
        rows.append(("A", dt.date(2019 + (m // 12), (m % 12) + 1, 1), upb, 0))
    p = spark.createDataFrame(rows, "loan_id string, reporting_month date, current_actual_upb double, "
                                    "current_delinquency_status int")
    p = (p.withColumn("origination_date", F.lit(dt.date(2019, 1, 1)))
          .withColumn("modification_flag", F.lit("N")))
    for c in snap.NUMERIC_STATICS:
        p = p.withColumn(c, F.lit(0.0))
    for c in snap.STRING_STATICS:
        p = p.withColumn(c, F.lit(None).cast("string"))
    r = snap.build_snapshot(p).first()
    assert r["hist_latest_upb"] == 1000 - 5                  # month 6 is NULL -> month 5 wins
    assert r["hist_upb_to_original_upb"] is None             # zero original balance
    assert r["loan_purpose"] is None                         # SQL mode keeps categorical NULL


def test_header_and_positional_extracts(spark):
    d = tempfile.mkdtemp(prefix="loanlens-test-")
    headed = os.path.join(d, "orig.csv")
    with open(headed, "w") as fh:
        fh.write("Loan Identifier,ORIG_DATE,Original UPB,Original LTV,FICO,Purpose\n")
        fh.write("A,012019,100000,80,700,\nA,022019,120000,85,710,P\n")
    o = I.normalize_origination(I.read_delimited(spark, headed, I.ACQUISITION_POSITIONAL)).collect()
    assert len(o) == 1 and o[0]["original_upb"] == 120000.0 and o[0]["origination_date"] == dt.date(2019, 2, 1)
    bad = os.path.join(d, "bad.csv")
    with open(bad, "w") as fh:
        fh.write("loan_id,origination_date\nA,012019\n")
    with pytest.raises(ValueError, match="required fields not found"):
        I.normalize_origination(I.read_delimited(spark, bad, I.ACQUISITION_POSITIONAL))
    pos = os.path.join(d, "perf.txt")
    with open(pos, "w") as fh:
        f = [""] * 47
        f[1], f[2], f[11], f[39] = "A", "022019", "990", "0"
        fh.write("|".join(f) + "\n")
    p = I.normalize_performance(I.read_delimited(spark, pos, I.PERFORMANCE_POSITIONAL))
    assert "extra_field_46" in p.columns and p.first()["modification_flag"] == "Unknown"
    assert I.header_key("  Loan Identifier ") == "loan_identifier"


def test_scalar_edges(spark):
    df = spark.createDataFrame([("3.7", dt.date(2020, 1, 31), None), ("XX", dt.date(2020, 8, 31), 12.0)],
                               "t string, d date, x double")
    r = df.select(X.try_int("t").alias("i"), X.add_months("d", 1).alias("m"),
                  X.clip("x", -2, 10).alias("c"), X.quarter_label("d").alias("q"),
                  X.psi_status(F.lit(0.10)).alias("s1"), X.psi_status(F.lit(0.25)).alias("s2")).collect()
    assert r[0]["i"] == 4 and r[1]["i"] is None
    assert r[0]["m"] == dt.date(2020, 2, 29)              # month-end clamp
    assert r[0]["c"] is None and r[1]["c"] == 10.0         # NULL stays NULL
    assert r[0]["q"] == "2020Q1" and r[1]["q"] == "2020Q3"
    assert r[0]["s1"] == "review" and r[0]["s2"] == "alert"


def test_file_order_goes_by_full_path_and_folder(spark, tmp_path):
    for i, name in enumerate(["y1/perf.csv", "y2/perf.csv"]):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(_line("A", "022019", upb=str(100 + i)) + "\n")
    (tmp_path / "dir +x").mkdir()
    for i, name in enumerate(["a.csv", "b.csv"]):
        (tmp_path / "dir +x" / name).write_text(_line("A", "022019", upb=str(200 + i)) + "\n")
    at = lambda *names: [str(tmp_path / n) for n in names]
    for paths, want in ((at("y1/perf.csv", "y2/perf.csv"), 101.0), (at("y2/perf.csv", "y1/perf.csv"), 100.0), (at("dir +x"), 201.0),
                        (at("dir +x", "y1/perf.csv"), 100.0)):
        panel = I.typed_panel(I.read_combined(spark, paths))
        assert I.dedupe_last(panel, ["loan_id", "reporting_month"]).first()["current_actual_upb"] == want


def test_ragged_files_lose_no_field(spark, tmp_path):
    (tmp_path / "p.txt").write_text("|".join(["x"] * 45) + "\n" + "|".join(["y"] * 50) + "\n")
    got = I.read_delimited(spark, str(tmp_path / "p.txt"), I.PERFORMANCE_POSITIONAL)
    assert "extra_field_49" in got.columns and got.filter("extra_field_49 = 'y'").count() == 1
    (tmp_path / "c.csv").write_text(_line("A", "022019") + "|more|fields\n" + _line("B", "022019") + "\n")
    raw = I.read_combined(spark, [str(tmp_path / "c.csv")], keep_malformed=True)
    assert raw.filter("malformed_line is not null").select("_c1").collect()[0][0] == "A"
    with pytest.raises(ValueError, match="no delimiter"):
        (tmp_path / "one.csv").write_text("loan\n1\n")
        I.read_delimited(spark, str(tmp_path / "one.csv"), I.PERFORMANCE_POSITIONAL)


def test_best_spelling_takes_the_name(spark):
    df = spark.createDataFrame([("a", "b", "c")], "fico string, credit_score string, note string")
    got = I.resolve_aliases(df, I.Contract({"borrower_credit_score": ["borrower_credit_score", "credit_score", "fico"]}))
    assert got.columns == ["fico", "borrower_credit_score", "note"] and got.first()["borrower_credit_score"] == "b"
    df = spark.createDataFrame([("new", "old")], "monthly_reporting_period string, reporting_month string")
    got = I.resolve_aliases(df, I.Contract({"reporting_month": ["monthly_reporting_period", "reporting_month"]}, ["reporting_month"]))
    assert got.columns == ["reporting_month"] and got.first()[0] == "new"
