"""Register CSV, amenities and sinks."""

import datetime as dt
import json

from pyspark.sql import functions as F

from dwellspark.sources import amenities, register, sinks

HEADER = "Date of Sale (dd/mm/yyyy),Address,Postal Code,County,Price (€),Not Full Market Price,VAT Exclusive,Description of Property,Property Size Description"


def test_read_register_csv(spark, tmp_path):
    text = "﻿" + HEADER + '\n01/02/2020,"No. 1 Main St., Town",,Cork,"€1,234.50",No,Yes,House,\n' \
        "2020-03-04, 2 Rd ,D04 XY12,Dublin,500000,YES,No,House,x\nbad,3 Rd,,Cork,1,No,No,,\n05/06/2020,4 Rd,,Cork,n/a,No,No,,\n"
    (tmp_path / "r.csv").write_text(text, encoding="utf-8")
    valid, rejects = register.read_register_csv(spark, str(tmp_path / "r.csv"))
    rows = {r["address"]: r for r in valid.collect()}
    assert rows["No. 1 Main St., Town"]["sale_date"] == dt.date(2020, 2, 1)
    assert float(rows["No. 1 Main St., Town"]["price"]) == 1234.5 and rows["No. 1 Main St., Town"]["vat_exclusive"]
    assert rows["2 Rd"]["eircode"] == "D04 XY12" and rows["2 Rd"]["not_full_market_price"]
    assert {r["reject_reason"] for r in rejects.collect()} == {"no date", "no price"}


def test_damaged_headers_and_code_page(spark, tmp_path):
    line = HEADER.replace("€", "\u0080") + "\n01/02/2020,1 Rd,,Cork,\u008099.00,No,No,,\n"
    (tmp_path / "r.csv").write_bytes(line.encode("latin-1"))
    valid, _ = register.read_register_csv(spark, str(tmp_path / "r.csv"), encoding="windows-1252")
    assert float(valid.first()["price"]) == 99.0
    assert register.resolve_headers(["Price (?)", "Eircode"])["price_raw"] == ["Price (?)"]


def test_read_amenities(spark):
    t = spark.createDataFrame([("Stop A", "Luas Green Line", "near shops", "and a park", "53.3", "-6.2"), (None, "x", None, None, "53", "-6"), ("Far", "x", None, None, "10", "10")],
                              "`Infrastructure Name` string, Category string, Description string, `Unnamed: 6` string, Latitude string, Longitude string")
    s = spark.createDataFrame([("School B", "Primary", "Primary", "53.4", "-6.3")], "`School Name` string, Category string, Level string, Latitude string, Longitude string")
    valid, skipped = amenities.read_amenities(t, s)
    assert {r["name"]: r["description"] for r in valid.collect()} == {"Stop A": "near shops, and a park", "School B": None}
    assert skipped.count() == 2


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("main-street", 3)], "slug string, total_transactions long")
    sinks.write_street_documents(pages, str(tmp_path / "streets"))
    doc = next((tmp_path / "streets" / "slug_key=main-street").glob("*.json")).read_text()
    assert json.loads(doc) == {"slug": "main-street", "total_transactions": 3}
    sinks.write_worklist_csv(pages, str(tmp_path / "list"))
    back = spark.read.option("header", True).csv(str(tmp_path / "list"))
    assert back.columns == ["slug", "total_transactions", "new_latitude", "new_longitude"]
    assert back.first()["new_latitude"] is None


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    """Swapped, renamed and missing columns, a file without a header, one header in the middle of a folder's files."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + '\n01/02/2020,"1 Rd, Town",D01 AB12,Cork,"€1,000.00",No,No,House,\n', encoding="utf-8")
    (folder / "b.csv").write_text("﻿Price (EUR),Address,Eircode,Date of Sale,County\n2000,2 Rd,,2020-03-04,Dublin\n3000,3 Rd,A65 F4E2,05/03/2020,Galway\n", encoding="utf-8")
    (folder / "c.csv").write_text("County,Postal Code,Eircode,Address,Date of Sale (dd/mm/yyyy),Price\nMayo,F12 X1Y2,,4 Rd,06/03/2020,4000\n", encoding="utf-8")
    (folder / "d.csv").write_text("no,header,here\n", encoding="utf-8")
    valid, rejects = register.read_register_csv(spark, str(folder))
    got = sorted((r.address, str(r.sale_date), r.county, r.eircode, float(r.price)) for r in valid.collect())
    assert got == [("1 Rd, Town", "2020-02-01", "Cork", "D01 AB12", 1000.0), ("2 Rd", "2020-03-04", "Dublin", None, 2000.0),
                   ("3 Rd", "2020-03-05", "Galway", "A65 F4E2", 3000.0), ("4 Rd", "2020-03-06", "Mayo", "F12 X1Y2", 4000.0)]
    assert rejects.count() == 1
    lines = register.csv_lines(spark.readStream, str(folder))
    seen = []
    q = lines.writeStream.foreachBatch(lambda b, i: seen.extend(r.address_raw for r in register.bind_headers(b).collect())).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen, key=str) == ["1 Rd, Town", "2 Rd", "3 Rd", "4 Rd", None]
