"""Sources and whole jobs on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from deedlink.operators.enrich import ENRICHMENT_COLUMNS
from deedlink.operators.validate import broken_laws, missing_columns, validate_outputs
from deedlink.plans.coords import build_coordinates
from deedlink.plans.county import COUNTY_COLUMNS, build_county
from deedlink.plans.refresh import RefreshPaths, run_refresh
from deedlink.sources.coordinates import county_points, enrichment_points
from deedlink.sources.files import merge_report, read_extract, read_header, read_report, write_csv
from deedlink.sources.listings import list_exports, read_listings, read_lines

AS_OF = dt.date(2026, 3, 20)


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_extract_scan(spark, tmp_path):
    path = put(tmp_path, "x.csv", 'APN,"Address, Seattle", n ,q\n1,"a, b", 7 ,"Quoted ""Name"""\n\n2,c\n3,d,8,e,too many\n')
    assert read_header(spark, path) == ["APN", "Address, Seattle", "n", "q"]
    df = read_extract(spark, path, ["q", "n", "Address, Seattle", "missing"])
    got = rows(df.orderBy("ord"), "q", "n", "`Address, Seattle`", "missing")
    assert got == [('Quoted "Name"', "7", "a, b", None), (None, None, "c", None), ("e", "8", "d", None)]


COORDS = (
    "Major,Minor,LATITUDE,centroid_lon\n1,2,47.5,-122.1\n000001,0002,47.6,-122.2\n3,4,50,-122\n5,6,47,-123.7\n,7,47,-122\n9,9,1-2,-122\n"
)


def test_three_coordinate_readings(spark, tmp_path):
    path = put(tmp_path, "gis.csv", COORDS)
    assert rows(build_coordinates(spark, path), "major", "minor", "parcelNbr", "lat", "lon") == [("000001", "0002", "0000010002", "47.5", "-122.1")]
    assert rows(county_points(spark, path), "parcel", "lat", "lon") == [("0000010002", 47.6, -122.2)]
    plain = put(tmp_path, "c.csv", "major,minor,lat,lng\n1,2,47.5,-122.1\n1,2,47.6,-122.2\n5,6,47,-123.7\n,7,47,-122\n")
    assert sorted(rows(enrichment_points(spark, plain), "parcel", "lat", "lon")) == [
        ("0000000007", "47", "-122"), ("0000010002", "47.6", "-122.2"), ("0000050006", "47", "-123.7"),
    ]
    pin = put(tmp_path, "pin.csv", "apn,lat,lon\n991234567890,47.5,-122\n123456789,47.5,-122\n")
    assert rows(build_coordinates(spark, pin), "parcelNbr") == [("1234567890",)]
    bad = put(tmp_path, "bad.csv", "apn,x\n1,2\n")
    with pytest.raises(ValueError):
        build_coordinates(spark, bad)
    with pytest.raises(FileNotFoundError):
        build_coordinates(spark, str(tmp_path / "none.csv"))
    assert county_points(spark, None).count() == 0 and enrichment_points(spark, bad).count() == 0


PARCEL = """Major,Minor,DistrictName,Area,SubArea,SqFtLot,CurrentZoning,PresentUse
100000,0001,SEATTLE,10,5,4000,LR2,2
100000,0001,Seattle,11,6,5000,SF,2
100000,0002,KENT,12,7,1,X,2
100000,0003,seattle,11,6,,,2
100000,0004,SEATTLE,13,Madrona,700,NC,2
"""
ACCOUNT = """Major,Minor,AddrLine,CityState,ZipCode,ApprLandVal,ApprImpsVal
100000,0001,12 Mail St,SEATTLE WA,98107,"500,000",1
100000,0001,PO BOX 1,KENT WA,98030,500001,0
100000,0002,5 Lake St,SEATTLE WA,98101,100,200
100000,0003,7 Other St,KENT WA,98030,900000,0
100000,0004,PO BOX 9,KENT WA,98030,800000,0
100000,0005,1 Zero St,SEATTLE WA,98103,0,0
100000,0006,9 Out St,KENT WA,98030,10,0
"""
SALE = """Major,Minor,SalePrice,DocumentDate,ExciseTaxNbr,PropertyType
100000,0001,900000,03/20/2026,E1,11
100000,0001,850000,3/20/2025,E2,
100000,0001,850000,3/19/2025,E3,11
100000,0002,0,1/5/2026,,99
100000,0003,700000,12/31/2025,E5,1
100000,0004,600000,2/2/2026,E6,11
100000,0005,600000,2/2/2026,E7,11
100000,0006,600000,2/2/2026,E8,11
100000,0004,600000,bad,E9,11
"""
BUILDING = """Major,Minor,Bedrooms,BathFullCount,Bath3qtrCount,BathHalfCount,SqFtTotLiving,YrBuilt,Address,ZipCode,BuildingNumber,Fraction,DirectionPrefix,StreetName,StreetType,DirectionSuffix
100000,0001,3,1,1,1,2000,1990,,,,,,,,
100000,0001,2,1,0,0,1000,1980,12 SITE ST  98107,98107,12,,,SITE,ST,
100000,0001,4,2,0,0,900,1970,14 SITE ST 98107,,14,,,SITE,ST,
100000,0003,1,1,0,0,500,1950,44 FAR RD,98030,44,,,FAR,RD,
100000,0004,1,1,0,0,500,1950,,98101,77,,N,LAKE,ST,
"""
LOOKUP = """LUType,LUItem,LUDescription
1,011,Old name
1,11,Single family
2,1,Wrong kind
1,0,No code
"""
POINTS = "major,minor,parcelNbr,lat,lon\n100000,0001,1000000001,47.5,-122.25\n"


def county_files(folder):
    return {
        "parcel": put(folder, "parcel.csv", PARCEL),
        "account": put(folder, "account.csv", ACCOUNT),
        "sale": put(folder, "sale.csv", SALE),
        "building": put(folder, "building.csv", BUILDING),
        "lookup": put(folder, "lookup.csv", LOOKUP),
        "coords": put(folder, "coords.csv", POINTS),
    }


def test_county_build(spark, tmp_path):
    table = build_county(spark, county_files(tmp_path), AS_OF).orderBy("ord")
    assert table.columns == [*COUNTY_COLUMNS, "ord"]
    got = {r.id: r for r in table.collect()}
    assert list(got) == ["E1", "E2", "1000000002", "E5", "E6"]
    e1 = got["E1"]
    # the account with the larger value wins, its building is the first with an address, the last parcel row counts
    assert (e1.assessedValue, e1.listPriceAtPending, e1.closePrice) == ("500001", "500001", "900000")
    assert (e1.address, e1.addressSource, e1.zip) == ("12 SITE ST, Seattle 98107", "SITUS_PROXY", "98107")
    assert (e1.beds, e1.baths, e1.sqft, e1.yearBuilt) == ("2", "1.00", "1000", "1980")
    assert (e1.area, e1.subArea, e1.sqFtLot, e1.zoning, e1.districtName) == ("11", "6", "5000", "SF", "Seattle")
    assert (e1.type, e1.typeCode, e1.neighborhood) == ("Single family", "11", "Ballard")
    assert (e1.lat, e1.lon, e1.saleDate, e1.dataMode) == ("47.5", "-122.25", "2026-03-20", "PUBLIC_PROXY")
    assert (got["E2"].type, got["E2"].typeCode, got["E2"].saleDate) == ("No code", None, "2025-03-20")
    outside = got["1000000002"]
    assert (outside.type, outside.neighborhood, outside.districtName, outside.area) == ("Type 99", "Downtown", "Seattle", None)
    assert (outside.address, outside.addressSource, outside.zip) == ("5 Lake St, SEATTLE WA 98101", "MAILING_STREET", "98101")
    # a site address outside the city gives way to the mailing street, which is not trusted outside either
    assert (got["E5"].addressSource, got["E5"].address) == ("PARCEL_FALLBACK", "Parcel 100000-0003 (Seattle property address unavailable)")
    assert (got["E5"].type, got["E5"].neighborhood, got["E5"].zip) == ("Type 1", "Ballard", None)
    assert (got["E6"].neighborhood, got["E6"].addressSource, got["E6"].baths) == ("Madrona", "PARCEL_FALLBACK", "1.00")


def test_required_and_optional_sources(spark, tmp_path):
    files = county_files(tmp_path)
    with pytest.raises(FileNotFoundError):
        build_county(spark, {**files, "sale": str(tmp_path / "none.csv")}, AS_OF)
    few = build_county(spark, {"account": files["account"], "sale": files["sale"]}, AS_OF)
    got = {r.id: r for r in few.collect()}
    assert set(got) == {"E1", "E2", "1000000002"} and got["E1"].sqft == "0" and got["E1"].type == "Type 11"


HEAD = "Listing Number,Street Number,Street Name,Street Suffix,Unit,City,State,Zip Code,Status,APN,Listing Date,Pending Date,Contractual Date,Selling Date,Listing Price,Original Price,Selling Price,DOM,CDOM,Bedrooms,Style Code,Status"
EXPORT_A = f"""Sold And Stats (9)
{HEAD}
L1,12,Site,St,,Seattle,WA,98107,Sold,1000000001,1/10/2026,1/14/2026,,3/1/2026 12:00:00 AM,"$880,000",890000,903000,4,4,3,,x
L2,77,N Lake,Street,,Seattle,WA,98101,Active,,3/1/2026,,,,500000,500000,,20,20,,32 - Townhouse,x

L3,9,Nowhere,Rd,,Seattle,WA,98101,Pending,,2/1/2026,,,,500000,500000,,20,20,,,x
,,,,,,,,Sold,1000000009,,,,,,,,,,,,
"""
EXPORT_B = """Listing Number,Status,Listing Date,Pending Date,Contractual Date,Selling Date,Listing Price,Original Price,Selling Price,DOM,CDOM,APN
L1,Pending,1/10/2026,,,,880000,890000,,2,2,
L4,Pending,1/2/2026,1/20/2026,,,650000,650000,,0,0,1000000004
L5,Sold,1/2/2025,1/20/2025,,1/25/2026,100000,110000,120000,18,,2222220001
L6,Sold,1/2/2026,,,3/20/2026,880000,,900000,12,12,1000000001
L7,Sold,1/2/2026,,,,880000,,900000,12,12,1000000001
"""


@pytest.fixture
def exports(tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    put(folder, "Central Stats.csv", EXPORT_A)
    put(folder, "QA.CSV", EXPORT_B)
    put(folder, ".hidden.csv", "x")
    return folder


def test_listing_scan(spark, exports):
    assert list_exports(spark, str(exports)) == ["Central Stats.csv", "QA.CSV"]
    lines = read_lines(spark, str(exports)).filter(F.col("file") == "QA.CSV").orderBy("row")
    assert [r.row for r in lines.collect()] == list(range(6))
    df = read_listings(spark, str(exports)).orderBy("ord")
    got = df.collect()
    assert [r.listingNumber for r in got] == ["L1", "L2", "L3", "L1", "L4", "L5", "L6", "L7"]
    first = got[0]
    assert first.uid == "Central Stats.csv|L1|1000000001|Sold|2026-03-01|903000|0"
    assert (first.region, first.status, first.isClosed, first.listingPrice) == ("Central Seattle", "Sold", True, 880000)
    assert (first.mlsAddress, first.addressKeyExact) == ("12 Site St, Seattle WA 98107", "12 SITE ST|98107")
    assert got[1].addressKeyNoUnit == "77 N LAKE ST|98101"
    assert got[4].region == "QA Magnolia" and got[4].domRaw == "0"


def test_positions_hold_across_blocks_of_a_file(spark, tmp_path):
    put(tmp_path, "_a.csv", "".join(f"{i},{'x' * (i % 50)}\n" + "\n" * (i % 3) for i in range(3000)))
    put(tmp_path, "b.csv", "".join(f"{i}\n" for i in range(10)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "4096")
        lines = read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        got = lines.collect()
    finally:
        spark.conf.set(name, before)
    assert len(got) == 3010 and all(int(r.value.split(",")[0]) == r.row for r in got)


def test_listing_header_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_listings(spark, str(tmp_path / "none"))
    put(tmp_path, "a.csv", "title\nno header here\n")
    put(tmp_path, "b.csv", "Listing Number,Status,DOM\n1,Sold,3\n")
    with pytest.raises(ValueError, match="header row in realtor file: a.csv.*b.csv missing required columns: Listing Date"):
        read_listings(spark, str(tmp_path))


def test_refresh_end_to_end(spark, tmp_path, exports):
    files = county_files(tmp_path)
    paths = RefreshPaths(
        realtor_dir=str(exports), county_out=str(tmp_path / "county"), enriched_out=str(tmp_path / "enriched"),
        report=str(tmp_path / "report"), **files,
    )
    result = run_refresh(spark, paths, AS_OF)
    assert result.status == "pass" and result.counts["modes"] == {"PUBLIC_PROXY": 3, "MLS_ENRICHED": 5}
    report = read_report(spark, paths.report)
    c = report["counts"]
    assert (c["mlsRowsParsed"], c["mlsRowsAfterDedupe"], c["mlsDuplicateRowsCollapsed"]) == (8, 7, 1)
    assert (c["mlsClosedRows"], c["mlsOpenStatusRows"], c["mlsActiveRows"]) == (3, 2, 1)
    assert (c["matchedCountyRows"], c["countyRowsEnrichedWithListingStub"], c["mlsOnlySoldRowsAdded"], c["mlsOnlyOpenRowsAdded"], c["knownSalesSkipped"]) == (1, 1, 2, 1, 0)
    assert report["apnResolution"] == {"directApn": 5, "previousListingNumber": 0, "resBldgExact": 1, "accountExact": 0, "resBldgNoUnit": 0, "accountNoUnit": 0, "unresolved": 1}
    assert report["validation"]["status"] == "pass"
    out = spark.read.parquet(paths.enriched_out).orderBy("part", "row_position")
    assert [c for c in out.columns if c in ENRICHMENT_COLUMNS] == ENRICHMENT_COLUMNS
    got = out.collect()
    by_id = {r.id: r for r in got}
    # the sale of the same day and price takes L6 although L1 comes first in the file
    e1 = by_id["E1"]
    assert (e1.mlsListingNumber, e1.mlsJoinMethod, e1.mlsDateLagDays, e1.closePrice) == ("L6", "APN_PRICE_DATE_WINDOW", "0", "900000")
    assert (e1.saleToListRatio, e1.bidUpAmount, e1.bidUpPct, e1.hotMarketTag) == ("1.0227", "20000", "0.0227", None)
    assert (e1.address, e1.addressSource) == ("12 SITE ST, Seattle 98107", "SITUS_PROXY")
    e6 = by_id["E6"]
    assert (e6.mlsListingNumber, e6.mlsJoinMethod, e6.mlsDateLagDays, e6.mlsStatus) == ("L4", "APN_LISTING_STUB", "13", "Pending")
    assert (e6.closePrice, e6.listPriceAtPending, e6.mlsDOM, e6.mlsDaysToPending, e6.mlsDaysPendingToSale) == ("600000", "650000", "0", "18", "13")
    assert by_id["E2"].mlsStatus is None and by_id["E2"].dataMode == "PUBLIC_PROXY"
    sold = [r for r in got if r.mlsJoinMethod == "MLS_SOLD_NOT_IN_COUNTY"]
    assert sorted(r.mlsListingNumber for r in sold) == ["L1", "L5"]
    assert {r.id for r in sold} == {"mls-only-L1-1000000001-2026-03-01-1", "mls-only-L5-2222220001-2026-01-25-2"}
    l1 = next(r for r in sold if r.mlsListingNumber == "L1")
    assert (l1.beds, l1.neighborhood, l1.typeCode, l1.lat, l1.hotMarketTag, l1.mlsDaysToPending) == ("3", "Ballard", "11", "47.5", "ULTRA_HOT_<=5D", "4")
    l5 = next(r for r in sold if r.mlsListingNumber == "L5")
    assert (l5.neighborhood, l5.type, l5.addressSource, l5.mlsCDOM, l5.saleToOriginalListRatio) == ("QA Magnolia", "Single Family", "MLS_ADDRESS", None, "1.0909")
    opened = [r for r in got if r.mlsJoinMethod == "MLS_STATUS_OPEN"]
    assert [r.id for r in opened] == ["mls-open-L2-1000000004-1"]
    assert (opened[0].address, opened[0].saleDate, opened[0].closePrice, opened[0].bidUpAmount, opened[0].neighborhood) == ("77 N Lake Street, Seattle WA 98101", None, None, None, "Madrona")
    # a second run with the first output as lookup, and the stages one by one
    import dataclasses

    again = dataclasses.replace(paths, previous=paths.enriched_out, enriched_out=str(tmp_path / "enriched2"))
    assert run_refresh(spark, again, AS_OF, skip_county=True).status == "pass"
    # L2 has no parcel of its own; this time the last output knows it
    assert read_report(spark, paths.report)["apnResolution"]["previousListingNumber"] == 1
    assert run_refresh(spark, again, AS_OF, report_only=True).status == "pass"


def test_csv_sink_reads_back(spark, tmp_path):
    df = spark.createDataFrame([('a,"b"', None, ""), (" x ", "1", "é")], "p string, q string, r string")
    write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text(encoding="utf-8")
    assert text == 'p,q,r\n"a,""b""",,\n x ,1,é\n'


def test_report_merge(spark, tmp_path):
    path = str(tmp_path / "r")
    merge_report(spark, "validation", {"status": "fail"}, path)
    merge_report(spark, "counts", {"n": 1}, path)
    assert merge_report(spark, "validation", {"status": "pass"}, path) == {"validation": {"status": "pass"}, "counts": {"n": 1}}
    broken = tmp_path / "b"
    broken.mkdir()
    (broken / "part-0.txt").write_text("{not json")
    assert read_report(spark, str(broken)) == {}
    assert json.dumps(read_report(spark, path))


def test_validation_rules(spark):
    assert missing_columns(["id", "address", "closePrice", "type"], ["id", "type", "saleDate"]) == ["saleDate"]
    names = ["dataMode", "id", "address", "major", "minor", "parcelNbr", "saleDate", "listPriceAtPending", "closePrice", "mlsStatus", "mlsListingPrice", "mlsOriginalPrice", "mlsDOM", "mlsCDOM", "saleToListRatio", "saleToOriginalListRatio", "bidUpAmount", "bidUpPct"]

    def enriched(*values):
        data = [tuple({**dict.fromkeys(names), **v}[n] for n in names) for v in values]
        return spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))

    county = spark.createDataFrame([("1", "a", "t", "5")], "id string, address string, type string, closePrice string")
    active = dict(dataMode="MLS_ENRICHED", mlsStatus=" active", closePrice="")
    v = validate_outputs(county, enriched(active), 0)
    assert v.status == "fail" and len(v.errors) == 1 and len(v.warnings) == 2
    v = validate_outputs(county, enriched({**active, "listPriceAtPending": "$5"}, {"closePrice": "7", "dataMode": "MLS_ENRICHED"}), 1)
    assert v.status == "pass" and v.counts["mlsActiveRows"] == 1 and v.counts["mlsSoldRows"] == 1
    v = validate_outputs(county, enriched({"dataMode": ""}), 1)
    assert v.errors == ["No enriched rows found."] and v.counts["modes"] == {"UNKNOWN": 1}
    assert validate_outputs(None, county, 1).errors == ["Missing output: county"]
    assert "missing columns" in validate_outputs(county, county, 1).errors[0]


def test_published_counters_obey_the_laws():
    counters = dict(
        mlsRowsParsed=4789, mlsRowsAfterDedupe=4377, mlsDuplicateRowsCollapsed=412, mlsRowsWithResolvedApn=4106,
        mlsRowsMissingApn=271, mlsClosedRows=3374, mlsOpenStatusRows=732, baseRows=16156, matchedCountyRows=2695,
        countyRowsEnrichedWithListingStub=22, mlsOnlySoldRowsAdded=679, mlsOnlyOpenRowsAdded=710, knownSalesSkipped=0,
        outputRows=17545, directApn=3776, previousListingNumber=0, resBldgExact=243, accountExact=68, resBldgNoUnit=11,
        accountNoUnit=8, unresolved=271,
    )
    assert broken_laws(counters) == []
    assert broken_laws({**counters, "mlsOpenStatusRows": 731}) == ["open"]
