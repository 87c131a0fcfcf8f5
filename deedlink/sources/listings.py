"""Realtor exports: a directory of files with title lines, different headers and repeated header names."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from deedlink.functions.address import address_key, listing_display_address, listing_street
from deedlink.functions.dates import iso_text, lenient_date
from deedlink.functions.keys import parcel_number
from deedlink.functions.numbers import parse_integer, parse_number
from deedlink.functions.presence import first_text, null_to_blank, trimmed
from deedlink.functions.text import (
    approval_text,
    boolean_text,
    integer_text,
    region_from_name,
    squeezed,
    status_text,
    zip5,
)
from deedlink.operators.dedupe import OWN_PARCEL
from deedlink.session import cut_lineage, shared_folder
from deedlink.sources.files import path_exists

#: Names that mark the header line, and names every export must have.
HEADER_MARKS = ["Listing Number", "Status"]
REQUIRED_LISTING_COLUMNS = [
    "Status", "Listing Date", "Pending Date", "Contractual Date", "Selling Date", "Listing Price", "Original Price",
    "Selling Price", "DOM", "CDOM",
]
#: Further names an export may have.
OPTIONAL_LISTING_COLUMNS = [
    "Listing Number", "Listing Number (2)", "APN", "Street Number", "Street Direction", "Street Name", "Street Suffix",
    "Street Post Direction", "Unit", "City", "State", "Zip Code", "Style Code", "Subdivision", "Bedrooms", "Bathrooms",
    "Square Footage", "Square Footage Finished", "Year Built", "Parking Type", "Parking Covered Total", "Taxes Annual",
    "Building Condition", "View", "Bank Or Real Estate Owned", "Third Party Approval Required",
    "New Construction State", "Square Footage Source",
]
EXPORT_FILES = "*.[cC][sS][vV]"
VISIBLE = "visible"
#: Rows of one file stay below 2**40, so file rank and row position fit into one long.
ROW_BITS = 40


def list_exports(spark: SparkSession, directory: str) -> list[str]:
    """Names of the export files, sorted; empty when there is no such directory."""
    if not path_exists(spark, directory):
        return []
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, EXPORT_FILES))]
    return sorted(n for n in names if not n.startswith("."))


def _escaped(name: str) -> str:
    """A file name as a path pattern that stands for itself."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in name)


def _visible_copies(spark: SparkSession, directory: str, names: list[str]) -> str | None:
    """A new shared folder with the files ``names`` under names that begin with ``VISIBLE``; None if there are none.

    Spark's readers leave out a file whose name begins with an underscore even where it is named. Hadoop copies such files
    a buffer at a time; they are named by hand, not written by jobs.
    """
    if not names:
        return None
    path, util = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.hadoop.fs.FileUtil
    conf, folder = spark._jsc.hadoopConfiguration(), f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}"
    for name in names:
        # through a parent path, so that no character of the name is taken for a scheme
        source, target = path(path(directory), f"./{name}"), path(path(folder), f"./{VISIBLE}{name}")
        if not util.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf):
            raise OSError(f"{name} could not be copied")
    return folder


def read_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines that are not blank as (file, row, value); ``row`` is the dense 0-based position inside the file.

    Numbers come from the running id of the scan, shifted by the sizes of the blocks before; the shift table has one
    row per block of a file. The lines are written out first so that both uses see the same ids.
    """
    names = list_exports(spark, directory)
    paths = [f"{directory.rstrip('/')}/{_escaped(name)}" for name in names if not name.startswith("_")]
    copies = _visible_copies(spark, directory, [name for name in names if name.startswith("_")])
    if copies:
        paths.append(copies)
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    copied = F.col("_metadata.file_path").contains(copies.rsplit("/", 1)[1]) if copies else F.lit(False)
    scanned = (
        spark.read.text(paths)
        .select(
            "value",
            # the name comes URL-encoded, a plus sign in it does not stand for a blank
            F.when(copied, F.substring(name, len(VISIBLE) + 1, 1 << 30)).otherwise(name).alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .filter(trimmed("value") != "")
        .withColumn("id", F.monotonically_increasing_id())
    )
    scanned = cut_lineage(scanned)
    if copies:
        path = spark._jvm.org.apache.hadoop.fs.Path(copies)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        scanned.groupBy("file", "block")
        .agg(F.min("id").alias("start"), F.count(F.lit(1)).alias("n"))
        .withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
    )
    row = F.col("id") - F.col("start") + F.col("shift")
    # a row per block of a file, so the lines need not be shuffled to meet them
    return scanned.join(F.broadcast(blocks), ["file", "block"]).select("file", row.alias("row"), "value")


def _parsed(value: Column, width: int) -> Column:
    """One line as a struct of text cells c0, c1, ..., by Spark's own CSV parser; cells that a line lacks are null."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(value, schema, {"escape": '"', "maxColumns": str(max(width, 512) * 2)})


def _cells(value: Column, width: int) -> Column:
    """One line as an array of trimmed text cells; for few lines, see ``cells_of_lines``."""
    # bound to a variable, the parsed line is made once; named in every cell, it would be made once a cell
    lines = F.transform(F.array(_parsed(value, width)), lambda p: F.array(*[trimmed(null_to_blank(p[f"c{i}"])) for i in range(width)]))
    return F.get(lines, F.lit(0))


def numbered(cells: Column) -> Column:
    """Second and later uses of a header name get `` (2)``, `` (3)``, ..."""

    def name(cell: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice(cells, 1, i + 1), lambda other: other == cell))
        return F.when(n > 1, F.concat(cell, F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(cell)

    return F.transform(cells, name)


def marked_lines(lines: DataFrame) -> DataFrame:
    """The lines that hold all header marks somewhere, which a header does."""
    return lines.filter(reduce(and_, [F.col("value").contains(mark) for mark in HEADER_MARKS]))


def find_headers(lines: DataFrame, width: int, marked: DataFrame | None = None) -> DataFrame:
    """(file, header_row, names, last_row): the first line of each file that holds all header marks as cells.

    ``marked``: the marked lines of ``lines``, where they are known already.
    """
    has_marks = reduce(and_, [F.col("value").contains(mark) for mark in HEADER_MARKS])
    heads = F.filter(F.array(_cells(F.col("value"), width)), lambda c: reduce(and_, [F.array_contains(c, mark) for mark in HEADER_MARKS]))
    # the test stands inside the value too: Spark may look for a missing value before it filters, and would cut every line
    head = F.when(has_marks, F.get(F.transform(heads, lambda c: F.struct(F.col("row").alias("header_row"), c.alias("cells"))), F.lit(0)))
    marked = marked_lines(lines) if marked is None else marked
    heads = marked.select("file", head.alias("head")).groupBy("file").agg(F.min("head").alias("head")).select("file", "head.*")
    ends = lines.groupBy("file").agg(F.max("row").alias("last_row"))
    return ends.join(heads, "file", "left").withColumn("names", numbered(F.col("cells"))).drop("cells")


def header_problems(headers: DataFrame) -> list[str]:
    """What is wrong with the headers, one text per file (there is one header per file)."""
    missing = F.array_except(F.array(*[F.lit(c) for c in REQUIRED_LISTING_COLUMNS]), F.col("names"))
    no_header = F.col("header_row").isNull() | (F.col("header_row") >= F.col("last_row"))
    rows = (
        headers.filter(F.col("last_row") >= 1)
        .select("file", no_header.alias("no_header"), F.array_join(missing, ", ").alias("missing"))
        .filter(F.col("no_header") | (F.col("missing") != ""))
        .orderBy("file")
        .collect()
    )
    return [
        f"Could not find header row in realtor file: {r.file}"
        if r.no_header
        else f"Realtor file {r.file} missing required columns: {r.missing}"
        for r in rows
    ]


def header_width(marked: DataFrame) -> int:
    """Widest of the marked lines, which may be headers, in cells."""
    width = marked.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))))).first()[0]
    return (width or 0) + 1


def spread(lines: DataFrame) -> DataFrame:
    """``lines`` in as many partitions as tasks can run at least; a small table may come in a few splits, and cutting takes its time a line."""
    tasks = lines.sparkSession.sparkContext.defaultParallelism
    return lines.repartition(tasks, "file", "row") if lines.rdd.getNumPartitions() < tasks else lines


def read_listing_cells(spark: SparkSession, directory: str) -> DataFrame:
    """All export rows as text under the known column names, with ``file``, ``rowIndex`` and ``ord``."""
    if not list_exports(spark, directory):
        raise FileNotFoundError(f"No realtor CSV files found in {directory}")
    return cells_of_lines(read_lines(spark, directory))


def cells_of_lines(lines: DataFrame) -> DataFrame:
    """As ``read_listing_cells``, from lines as (file, row, value); ``row`` orders the lines of a file."""
    # one look through the lines for both uses
    marked = cut_lineage(marked_lines(lines))
    width = header_width(marked)
    headers = cut_lineage(find_headers(lines, width, marked))
    problems = header_problems(headers)
    if problems:
        raise ValueError("; ".join(problems))
    # one row per file, so this window sees as many rows as there are files
    ranked = headers.filter(F.col("last_row") >= 1).withColumn("file_rank", F.row_number().over(Window.orderBy("file")))
    names = dict.fromkeys([*REQUIRED_LISTING_COLUMNS, *OPTIONAL_LISTING_COLUMNS])
    places = F.array(*[(F.nullif(F.array_position("names", n), F.lit(0)) - 1).cast("int") for n in names])
    ranked = ranked.withColumn("places", places).drop("names", "last_row")
    # the driver lists the files, so a row per file is small however many lines a file has
    rows = spread(lines).join(F.broadcast(ranked), "file").filter(F.col("row") > F.col("header_row"))
    place = F.shiftleft(F.col("file_rank").cast("long"), ROW_BITS) + F.col("row")
    fits = (F.col("row") < (1 << ROW_BITS)) & (F.col("file_rank") < (1 << (63 - ROW_BITS)))
    rows = rows.select(
        "file",
        (F.col("row") - F.col("header_row") - 1).alias("rowIndex"),
        F.when(fits, place).otherwise(F.raise_error(F.lit("too many files or rows for one order")).cast("long")).alias("ord"),
        "places",
        # a generator's columns are made once a row: filters on cells aren't moved below it, where they would parse the line again.
        # Nothing but the parser stands in it, since Spark interprets it and would work out the types of what stands there for every row
        F.inline_outer(F.array(_parsed(F.col("value"), width))),
    )
    cells = F.array(*[null_to_blank(f"c{i}") for i in range(width)])
    rows = rows.select("file", "rowIndex", "ord", "places", cells.alias("cells"))
    return rows.select("file", "rowIndex", "ord", *[trimmed(F.get("cells", F.col("places")[i])).alias(n) for i, n in enumerate(names)])


def typed_listings(cells: DataFrame) -> DataFrame:
    """Normalised, typed listing rows; rows without a listing number are dropped."""
    text = lambda n: trimmed(null_to_blank(n))
    street = ["Street Number", "Street Direction", "Street Name", "Street Suffix", "Street Post Direction"]
    listed = cells.withColumn("listingNumber", trimmed(first_text("Listing Number", "Listing Number (2)")))
    listed = listed.filter(F.coalesce(F.col("listingNumber"), F.lit("")) != "")
    # two narrow steps instead of one wide projection: generated code stays below the limit of the compiler
    names = ["listingDate", "pendingDate", "contractualDate", "sellingDate"]
    sources = ["Listing Date", "Pending Date", "Contractual Date", "Selling Date"]
    listed = listed.withColumns({n: lenient_date(c) for n, c in zip(names, sources)})
    listed = listed.withColumns({"status": status_text("Status"), "region": region_from_name("file")})
    parsed = listed.select(
        "file",
        "rowIndex",
        "ord",
        "region",
        "status",
        parcel_number("APN").alias("apn"),
        "listingNumber",
        *names,
        parse_integer("Listing Price").alias("listingPrice"),
        parse_integer("Selling Price").alias("sellingPrice"),
        parse_integer("Original Price").alias("originalPrice"),
        text("DOM").alias("domRaw"),
        text("CDOM").alias("cdomRaw"),
        parse_integer("DOM").alias("dom"),
        parse_integer("CDOM").alias("cdom"),
        text("Style Code").alias("styleCode"),
        text("Subdivision").alias("subdivision"),
        parse_integer("Bedrooms").alias("beds"),
        parse_number("Bathrooms").alias("baths"),
        parse_integer(first_text("Square Footage", "Square Footage Finished")).alias("sqft"),
        parse_integer("Year Built").alias("yearBuilt"),
        text("City").alias("city"),
        text("State").alias("state"),
        zip5("Zip Code").alias("zip"),
        listing_display_address(*street, "Unit", "City", "State", "Zip Code").alias("mlsAddress"),
        address_key(listing_street(*street, unit="Unit"), "Zip Code").alias("addressKeyExact"),
        address_key(listing_street(*street), "Zip Code").alias("addressKeyNoUnit"),
        squeezed("Parking Type").alias("parkingType"),
        integer_text("Parking Covered Total").alias("parkingCoveredTotal"),
        integer_text("Taxes Annual").alias("taxesAnnual"),
        squeezed("Building Condition").alias("buildingCondition"),
        squeezed("View").alias("view"),
        boolean_text("Bank Or Real Estate Owned").alias("bankOwned"),
        approval_text("Third Party Approval Required").alias("thirdPartyApprovalRequired"),
        squeezed("New Construction State").alias("newConstructionState"),
        squeezed("Square Footage Source").alias("squareFootageSource"),
    )
    return parsed.withColumns(
        {
            "uid": provenance_id("file", "listingNumber", "apn", "status", iso_text("sellingDate"), "sellingPrice", "rowIndex"),
            "isClosed": is_closed("status", "sellingDate", "sellingPrice"),
            "apnResolutionMethod": F.when(F.col("apn").isNotNull(), OWN_PARCEL),
        }
    )


def provenance_id(*parts: Column | str) -> Column:
    """All parts with a bar between them; a missing part leaves its place empty."""
    return F.concat_ws("|", *[null_to_blank((F.col(p) if isinstance(p, str) else p).cast("string")) for p in parts])


def is_closed(status: str, day: str, price: str) -> Column:
    """The status says sold or closed, or there is a selling date and a price."""
    return F.coalesce(F.lower(status).rlike("sold|closed"), F.lit(False)) | (
        F.col(day).isNotNull() & F.coalesce(F.col(price) > 0, F.lit(False))
    )


def read_listings(spark: SparkSession, directory: str) -> DataFrame:
    return typed_listings(read_listing_cells(spark, directory))


