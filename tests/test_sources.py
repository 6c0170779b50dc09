"""File sources, sinks, manifest, top-k and the analysis document."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.operators import clean as C
from ledgerlens.operators import report as RP
from ledgerlens.plans.topk import group_top_k
from ledgerlens.sources import files as FS
from ledgerlens.sources import tables as TB
from ledgerlens.sources.xlsx import first_sheet_rows


def _write_xlsx(path, rows):
    """Minimal workbook: shared strings for text, numbers inline."""
    strings, cells = [], []
    for r, row in enumerate(rows, start=1):
        out = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, str):
                strings.append(v)
                out.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
            elif v is not None:
                out.append(f'<c r="{ref}"><v>{v}</v></c>')
        cells.append(f'<row r="{r}">{"".join(out)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(cells)}</sheetData></worksheet>')


def test_xlsx_reader(spark, tmp_path):
    rows = [["Date", "Product", "Sales"], ["2024-01-01", "A", 10], ["2024-01-02", None, 2.5]]
    _write_xlsx(tmp_path / "a.xlsx", rows)
    _write_xlsx(tmp_path / "b.xlsx", rows[:2])
    assert first_sheet_rows((tmp_path / "a.xlsx").read_bytes())[2] == ["2024-01-02", None, "2.5"]
    df = FS.read_upload(spark, str(tmp_path) + "/*.xlsx", "xlsx")
    assert df.columns == ["Date", "Product", "Sales"] and df.count() == 3
    clean, roles = C.clean_sales(df)
    assert roles.revenue_col == "Sales" and sorted(r.Revenue for r in clean.collect()) == [2.5, 10.0, 10.0]


def test_dispatch_rejects_unknown(spark):
    with pytest.raises(ValueError):
        FS.read_upload(spark, "/tmp/whatever.txt")


def test_manifest_and_csv_roundtrip(spark, tmp_path):
    out = str(tmp_path / "csv")
    raw = TB.raw_orders(spark, SF_SMALL)
    raw.repartition(3).write.option("header", True).csv(out)
    back = FS.read_upload(spark, out, "csv")
    man = FS.ingest_manifest(back).collect()
    assert sum(r.rows for r in man) == raw.count() and len(man) == 3
    assert man[0].columns == raw.columns
    FS.write_cleaned(C.clean_sales(back)[0], str(tmp_path / "pq"), fmt="parquet", partition_by_month=True)
    assert spark.read.parquet(str(tmp_path / "pq")).where("part_year = 1996").count() > 0


def test_group_top_k_matches_window(spark):
    df = spark.createDataFrame([(k % 3, float(v)) for k in range(300) for v in [k * 7 % 101]], "g int, v double")
    got = group_top_k(df, ["g"], [F.col("v").desc()], 4)
    for g in range(3):
        vals = sorted((r.v for r in df.where(F.col("g") == g).collect()), reverse=True)[:4]
        assert [r.v for r in got.where(F.col("g") == g).orderBy("rank").collect()] == vals
    assert group_top_k(df, [], [F.col("v")], 2).count() == 2


def test_analysis_document(spark):
    clean, roles = C.clean_sales(TB.sales(spark, SF_SMALL))
    doc = RP.analysis_document(clean, roles, ["Region"])
    rows = doc.collect()
    assert len(rows) == 5
    d = json.loads(rows[0].document)
    assert set(d) >= {"kpis", "summary", "insights", "sample_rows", "schema"}
    assert len(d["sample_rows"]) == 10 and d["schema"]["date_col"] == "order_date"
    whole = RP.analysis_document(clean, roles).collect()
    assert len(whole) == 1 and json.loads(whole[0].document)["kpis"]["total_records"] == clean.count()


def test_materialize_cleaned(spark, tmp_path):
    clean = C.clean_sales(TB.sales(spark, SF_SMALL))[0]
    back = FS.materialize_cleaned(clean, str(tmp_path / "clean"))
    assert back.count() == clean.count() and set(back.columns) == set(clean.columns)


def test_user_files(spark, tmp_path):
    from ledgerlens.operators import users as US
    out = str(tmp_path / "up")
    TB.raw_orders(spark, SF_SMALL).repartition(2).write.option("header", True).csv(out)
    man = FS.ingest_manifest(FS.read_upload(spark, out, "csv"))
    names = [r.filename for r in man.collect()]
    uploads = spark.createDataFrame([(n, 1) for n in names], "filename string, user_id bigint")
    got = US.user_files(man, uploads, TB.users(spark, SF_SMALL)).collect()
    assert len(got) == 2 and got[0].meta["columns"].startswith("order_id,invoice_date")
