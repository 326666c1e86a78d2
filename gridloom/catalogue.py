"""Queries that run the engine's operators on the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cases, facade, scratch
from .functions import columns as C
from .functions import values as V
from .operators import transforms as X
from .plans.headers import HeaderPaths
from .registry import ORACLES, QUERIES, Query
from .registry import query as _query
from .rowid import ROW_ID, with_row_id
from .sources import metadata

__all__ = ["cases", "oracle_sql", "queries"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored(df: DataFrame, kind: str, order_by: str, before: bytes = b"", **options) -> str:
    """Write the rows in order as a document in the scratch folder."""
    path = f"{scratch.scratch_folder(df.sparkSession)}/rows.{kind}"
    if before:
        return scratch.put(df.sparkSession, path, before + facade.write_bytes(with_row_id(df, order_by), kind, bom=False, **options))
    return facade.write(with_row_id(df, order_by), path, **options)


def _typed(df: DataFrame, **types: str) -> DataFrame:
    return df.transform(X.cast(types))


def _ints(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("int") for n in names})


# CSV


@_query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write and read back as text."""
    nation = _table(spark, sf_dir, "nation")
    return facade.read(spark, _stored(nation, "csv", "n_nationkey", headers=nation.columns), assoc=True)


@_query("SELECT c_name, c_custkey::VARCHAR AS c_custkey FROM customer")
def csv_select_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, H7: selected columns in another order."""
    customer = _table(spark, sf_dir, "customer")
    return facade.read(spark, _stored(customer, "csv", "c_custkey", headers=customer.columns), assoc=True, columns=["c_name", "c_custkey"], required_columns=["c_custkey"])


@_query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def csv_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases after a normalizer."""
    customer = _table(spark, sf_dir, "customer")
    path = _stored(customer.withColumnsRenamed({"c_custkey": " C_CustKey ", "c_name": "C_Name"}).select(" C_CustKey ", "C_Name"), "csv", " C_CustKey ", headers=[" C_CustKey ", "C_Name"])
    return facade.read(spark, path, assoc=True, header_normalizer=lambda s: s.strip().lower(), aliases={"c_custkey": "id", "c_name": "name"})


@_query("SELECT c_custkey AS k, c_name AS n, c_acctbal AS b FROM customer")
def csv_injected_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: a file without header takes given names."""
    path = _stored(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "csv", "c_custkey")
    return _typed(facade.read(spark, path, assoc=True, headers=["k", "n", "b"]), k="int", b="float")


@_query("SELECT n_nationkey::VARCHAR AS _c0, n_name AS _c1, n_regionkey::VARCHAR AS _c2 FROM nation")
def csv_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain mode: columns by position, format by content."""
    content = facade.write_bytes(with_row_id(_table(spark, sf_dir, "nation"), "n_nationkey"), "csv")
    return facade.read_bytes(spark, content)


@_query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation ORDER BY nation.n_nationkey LIMIT 5 OFFSET 3")
def csv_offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: data rows skipped and limited."""
    nation = _table(spark, sf_dir, "nation")
    return facade.read(spark, _stored(nation, "csv", "n_nationkey", headers=nation.columns), assoc=True, offset=3, limit=5)


@_query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_header_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header found below a preamble."""
    nation = _table(spark, sf_dir, "nation")
    path = _stored(nation, "csv", "n_nationkey", before=b"Nations - 2026\r\nGenerated\r\n\r\n", headers=nation.columns)
    return facade.read(spark, path, assoc=True, header_offset="auto", required_columns=["n_name"])


@_query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_header_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header after two records."""
    nation = _table(spark, sf_dir, "nation")
    return facade.read(spark, _stored(nation, "csv", "n_nationkey", before=b"Skip me\r\nAnd me\r\n", headers=nation.columns), assoc=True, header_offset=2)


@_query("SELECT s_suppkey AS id, s_name AS name, s_nationkey::BIGINT AS nation, s_acctbal AS balance FROM supplier")
def csv_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two header rows, nested columns, and their leaves again."""
    supplier = _table(spark, sf_dir, "supplier")
    nested = supplier.select(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).alias("Identity"), F.struct(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")).alias("Meta"))
    path = f"{scratch.scratch_folder(spark)}/rows.csv"
    numbered = with_row_id(nested, "Identity.id")
    facade.write(numbered, path, headers={"Identity": ["id", "name"], "Meta": ["nation", "balance"]})
    back = facade.read(spark, path, assoc=True, header_rows=2)
    leaves = HeaderPaths.of_frame(back).flatten(back).toDF("id", "name", "nation", "balance")
    return _typed(leaves, id="int", nation="int", balance="float")


@_query("SELECT doc_id, text FROM documents")
def csv_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-16 with a byte order mark; texts hold quotes and line breaks."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = _stored(docs, "csv", "doc_id", headers=["doc_id", "text"], bom="utf-16-le", output_encoding="utf-16-le")
    return _typed(facade.read(spark, path, assoc=True), doc_id="int")


@_query("SELECT n_nationkey::VARCHAR AS k, concat('Ré', n_name, 'ñ') AS v FROM nation")
def csv_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin-1 found by its bytes."""
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("Ré"), "n_name", F.lit("ñ")).alias("v"))
    path = _stored(rows, "csv", "k", headers=["k", "v"], bom=False, output_encoding="iso-8859-1")
    return facade.read(spark, path, assoc=True, input_encoding="auto", output_encoding="UTF-8")


@_query("SELECT * FROM (VALUES ('1', 'John', NULL), ('2', 'Jane', 'jane@example.com')) t(id, name, email)")
def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short rows are padded, long ones cut."""
    return facade.read_bytes(spark, b"id,name,email\n1,John\n2,Jane,jane@example.com,extra", "csv", assoc=True)


@_query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def csv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 for large files: parts written by executors and read in splits."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    folder = facade.write_parts(lines, f"{scratch.scratch_folder(spark)}/parts", "csv", bom=False, eol="\n")
    back = facade.read(spark, folder, format="csv", assoc=True, headers=lines.columns, columns=lines.columns[:5], separator=",")
    return _ints(_typed(back, l_orderkey="int", l_linenumber="int", l_quantity="float", l_extendedprice="float"), "l_linenumber")


@_query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_comment) - 1 AS _row_id, l_orderkey AS k, l_linenumber AS n, l_comment AS c FROM (SELECT l_orderkey, l_linenumber, l_linestatus || ', \"' || l_partkey || '\"' AS l_comment FROM lineitem)")
def csv_large_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of any size, read by many tasks, rows numbered as they stand in it; quotes and separators in cells."""
    said = F.concat(F.col("l_linestatus"), F.lit(', "'), F.col("l_partkey"), F.lit('"'))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), said.alias("c"))
    path = f"{scratch.scratch_folder(spark)}/lines.csv"
    facade.write(with_row_id(lines, ["k", "n", "c"]), path, headers=lines.columns)
    return _ints(_typed(facade.read(spark, path, assoc=True, row_id=True), k="int", n="int"), "n")


# workbooks


@_query("SELECT * FROM orders")
def xlsx_roundtrip_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cells there and back."""
    return facade.read(spark, _stored(_table(spark, sf_dir, "orders"), "xlsx", "o_orderkey", assoc=True), assoc=True, stringify_values=False)


@_query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders")
def xlsx_roundtrip_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as text."""
    columns = ["o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    return facade.read(spark, _stored(_table(spark, sf_dir, "orders"), "xlsx", "o_orderkey", assoc=True), assoc=True, columns=columns)


@_query("SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def xlsx_shared_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared strings, with widths, bold header, frozen pane, filter and protection."""
    path = _stored(_table(spark, sf_dir, "part"), "xlsx", "p_partkey", assoc=True, shared_strings=True, auto_width=True, bold_headers=True, freeze_pane="A2", autofilter="A1:F1", sheet_protection="secret", sheet="Parts")
    return facade.read(spark, path, assoc=True, stringify_values=False, sheet="Parts")


@_query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice, l_returnflag, l_shipdate FROM lineitem")
def xlsx_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11-W12 for large frames: a folder of workbooks, written by executors and read as one frame."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    folder = facade.write_parts(lines, f"{scratch.scratch_folder(spark)}/books", "xlsx", rows=20_000, assoc=True)
    return facade.read(spark, folder, format="xlsx", assoc=True, stringify_values=False)


@_query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def ods_roundtrip_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cells there and back."""
    return facade.read(spark, _stored(_table(spark, sf_dir, "supplier"), "ods", "s_suppkey", assoc=True), assoc=True, stringify_values=False)


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderstatus FROM orders")
def ods_roundtrip_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical values as text."""
    back = facade.read(spark, _stored(_table(spark, sf_dir, "orders"), "ods", "o_orderkey", assoc=True), assoc=True, columns=["o_orderkey", "o_orderdate", "o_orderstatus"])
    return _typed(back, o_orderkey="int")


@_query("SELECT event_id, event_type = 'purchase' AS bought, ts AS seen FROM events")
def ods_dates_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans and date-times with microseconds."""
    events = _table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "purchase").alias("bought"), F.col("ts").alias("seen"))
    return facade.read(spark, _stored(events, "ods", "event_id", assoc=True), assoc=True, stringify_values=False)


@_query("SELECT 0::INTEGER AS position, 'Regions' AS sheet")
def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of a workbook."""
    return metadata.sheet_frame(spark, _stored(_table(spark, sf_dir, "region"), "xlsx", "r_regionkey", sheet="Regions"))


@_query("SELECT 'ods' AS format, 'Regions' AS title, 'Test' AS subject, 'Ann' AS creator, 'a,b' AS keywords, 'All of them' AS description, NULL AS category, 'en-US' AS language, 1::INTEGER AS n_sheets")
def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document properties there and back."""
    path = _stored(_table(spark, sf_dir, "region"), "ods", "r_regionkey", meta={"title": "Regions", "subject": "Test", "creator": "Ann", "keywords": "a,b", "description": "All of them"})
    return metadata.properties_frame(spark, path)


# transforms


@_query("SELECT event_id, event_type AS t FROM events")
def t_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space and NUL stripped."""
    return _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" \t\x00"), "event_type", F.lit("\x0b\n ")).alias("t")).transform(X.trim())


@_query("SELECT event_id, coalesce(CASE WHEN value > 100 THEN user_id::VARCHAR END, '-') AS u, coalesce(CASE WHEN value < 50 THEN event_type END, '-') AS t FROM events")
def t_null_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null cells as a text."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 100, F.col("user_id")).alias("u"), F.when(F.col("value") < 50, F.col("event_type")).alias("t"))
    return rows.transform(X.null_as("-")).withColumn("event_id", F.col("event_id").cast("long"))


@_query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'Y' ELSE 'N' END AS clicked FROM events")
def t_bool_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans as two texts."""
    return _table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "click").alias("clicked")).transform(X.bool_as("Y", "N"))


@_query("SELECT c_custkey, upper(c_name) AS c_name, upper(c_mktsegment) AS c_mktsegment FROM customer")
def t_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell by an expression."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return rows.transform(X.map_cells(lambda c, name: c if name == "c_custkey" else F.upper(c)))


@_query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS n, c_name || '#' || (row_number() OVER (ORDER BY c_custkey) - 1) AS label FROM customer")
def t_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its index."""
    rows = with_row_id(_table(spark, sf_dir, "customer"), "c_custkey")
    return rows.transform(X.map_rows(lambda df, i: [i.alias("n"), F.concat("c_name", F.lit("#"), i.cast("string")).alias("label")])).drop(ROW_ID)


@_query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS n, lower(s_name) AS name FROM supplier")
def t_map_rows_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 with an opaque function, on Arrow batches."""
    rows = with_row_id(_table(spark, sf_dir, "supplier"), "s_suppkey")
    return rows.transform(X.map_rows(lambda row, i: {"n": i, "name": row["s_name"].lower()}, "n long, name string")).drop(ROW_ID)


@_query("SELECT * FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def t_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a predicate; the scan gets it."""
    return _table(spark, sf_dir, "customer").transform(X.filter_rows((F.col("c_acctbal") > 0) & (F.col("c_mktsegment") == "BUILDING")))


@_query("SELECT * FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer) WHERE n % 3 = 0")
def t_filter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by their index before filtering."""
    return with_row_id(_table(spark, sf_dir, "customer"), "c_custkey").transform(X.filter_rows(lambda i: i % 3 == 0)).withColumnRenamed(ROW_ID, "n")


@_query("SELECT event_id, trunc(value)::BIGINT AS value FROM events")
def t_cast_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to integer, towards zero."""
    return _typed(_table(spark, sf_dir, "events").select("event_id", F.col("value").cast("string").alias("value")), value="int")


@_query("SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE value END AS value FROM events")
def t_cast_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to double, 0 where it is none."""
    text = F.when(F.col("event_type") == "click", "n/a").otherwise(F.concat(F.lit(" +"), F.col("value").cast("string")))
    return _typed(_table(spark, sf_dir, "events").select("event_id", text.alias("value")), value="float")


@_query("SELECT event_id, event_type IN ('view', 'click', 'signup') AS flag FROM events")
def t_cast_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to booleans."""
    words = F.create_map(*[F.lit(x) for x in ("view", "Yes", "click", " on ", "signup", "TRUE", "purchase", "off", "error", "t")])
    return _typed(_table(spark, sf_dir, "events").select("event_id", words[F.col("event_type")].alias("flag")), flag="bool")


@_query("SELECT o_orderkey, o_orderdate AS day, o_orderdate + INTERVAL 12 HOUR AS noon FROM orders")
def t_cast_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text to civil timestamps."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd'T12:00:00Z'").alias("noon"))
    return _typed(rows, day="date", noon="?date")


@_query("SELECT event_id, CASE WHEN event_type <> 'click' THEN trunc(value)::BIGINT END AS i, CASE WHEN event_type <> 'click' THEN value END AS f FROM events")
def t_cast_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nullable types give null for what is blank or does not fit."""
    text = lambda bad: F.when(F.col("event_type") == "click", bad).otherwise(F.col("value").cast("string"))
    return _typed(_table(spark, sf_dir, "events").select("event_id", text("").alias("i"), text("12x").alias("f")), i="?int", f="?float")


@_query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def t_cast_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict casts of valid data."""
    rows = with_row_id(_table(spark, sf_dir, "orders"), "o_orderkey").select(ROW_ID, *[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_totalprice")], F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    return rows.transform(X.cast_strict({"o_orderkey": "int", "o_totalprice": "float", "o_orderdate": "date"})).drop(ROW_ID)


@_query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk, o_orderkey FROM orders")
def t_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of a thousand rows."""
    chunks = with_row_id(_table(spark, sf_dir, "orders"), "o_orderkey").transform(X.chunk(1000))
    return chunks.select("chunk", F.explode("rows").alias("r")).select("chunk", "r.o_orderkey")


@_query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n, o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000)")
def t_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of rows, numbered anew."""
    rows = with_row_id(_table(spark, sf_dir, "orders"), "o_orderkey").transform(X.slice_rows(1000, 500))
    return rows.select(F.col(ROW_ID).alias("n"), "o_orderkey")


# functions


@_query("SELECT event_id, date_diff('day', DATE '1899-12-30', ts::DATE) + (extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60 + extract('second' FROM ts) + (extract('microseconds' FROM ts) % 1000000) / 1000000) / 86400 AS serial FROM events")
def excel_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V6: civil time to serial."""
    return _table(spark, sf_dir, "events").select("event_id", C.timestamp_to_serial(F.col("ts")).alias("serial"))


@_query("SELECT o_orderkey, o_orderdate AS there FROM orders")
def excel_serial_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: serial to civil time, there and back."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.serial_to_timestamp(C.timestamp_to_serial(F.col("o_orderdate"))).alias("there"))


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') || ' 06:00:00' AS moment FROM orders")
def serial_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: serials as text."""
    serial = C.timestamp_to_serial(F.col("o_orderdate"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.serial_to_text(serial.cast("long").cast("string")).alias("day"), C.serial_to_text((serial + 0.25).cast("decimal(12,2)").cast("string")).alias("moment"))


@_query("SELECT event_id, strftime(ts, '%H:%M:%S') || CASE WHEN extract('microseconds' FROM ts) % 1000000 > 0 THEN strftime(ts, '.%f') ELSE '' END AS clock FROM events")
def time_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: times of day."""
    micro = F.date_format("ts", "SSSSSS").cast("long")
    return _table(spark, sf_dir, "events").select("event_id", C.format_time(F.hour("ts"), F.minute("ts"), F.second("ts"), micro).alias("clock"))


@_query("SELECT l_orderkey, l_linenumber, printf('%02d:%02d:00', ((l_quantity::BIGINT * 25) // 60) % 24, (l_quantity::BIGINT * 25) % 60) AS clock FROM lineitem")
def day_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, V5: fractions of a day to times."""
    fraction = C.time_to_fraction(F.lit(0), F.col("l_quantity").cast("long") * 25, F.lit(0), F.lit(0))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.fraction_to_time(fraction).alias("clock"))


@_query("SELECT l_orderkey, l_linenumber, printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS span FROM (SELECT *, l_quantity::BIGINT * 3661 AS s FROM lineitem)")
def duration_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations as text."""
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.format_duration(F.col("l_quantity").cast("long") * 3_661_000_000).alias("span"))


@_query("SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * 3661 * 1000000 AS us, printf('PT%dH%dM%dS', s // 3600, s // 60 % 60, s % 60) AS iso FROM (SELECT *, l_quantity::BIGINT * 3661 AS s FROM lineitem)")
def iso_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO durations written and parsed."""
    iso = C.format_iso_duration(F.col("l_quantity").cast("long") * 3_661_000_000)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.parse_iso_duration(iso).alias("us"), iso.alias("iso"))


@_query("SELECT o_orderkey, o_orderdate + INTERVAL 30 MINUTE AS at, NULL::TIMESTAMP AS bad FROM orders")
def iso_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: strict ISO dates; an offset is checked and dropped."""
    at, bad = F.date_format("o_orderdate", "yyyy-MM-dd'T00:30:00+02:00'"), F.date_format("o_orderdate", "yyyy-'13'-dd")
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.parse_iso_date(at).alias("at"), C.parse_iso_date(bad).alias("bad"))


@_query(r"SELECT event_id, user_id, v, regexp_full_match(v, '-?(0|[1-9][0-9]*)(\.[0-9]+)?') AND length(ltrim(replace(replace(v, '-', ''), '.', ''), '0')) <= 15 AS ok FROM (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN '00' || user_id WHEN 'click' THEN user_id || '0000000000000000' WHEN 'error' THEN '-' || user_id || '.50' ELSE user_id::VARCHAR END AS v FROM events)")
def numeric_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts may be written as numbers."""
    user = F.col("user_id").cast("string")
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("00"), user)).when(F.col("event_type") == "click", F.concat(user, F.lit("0" * 16))).when(F.col("event_type") == "error", F.concat(F.lit("-"), user, F.lit(".50"))).otherwise(user)
    return _table(spark, sf_dir, "events").select("event_id", "user_id", text.alias("v"), C.is_numeric_cell(text).alias("ok"))


@_query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS as_long, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::DOUBLE ELSE p_retailprice END AS as_double FROM part")
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer literals and other numbers."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lit("+"), F.col("p_retailprice").cast("string")))
    return _table(spark, sf_dir, "part").select("p_partkey", C.parse_number(text).alias("n")).select("p_partkey", "n.*")


_CLASSES = {
    "General": "number", "0": "number", "#,##0.00": "number", '"$"#,##0.00': "number", "0%": "number", "0.00E+00": "number", '"year" 0': "number", r"0 \h": "number", "0;[Red]0": "number",
    "yyyy-mm-dd": "date", "dd/mm/yyyy": "date", "[$-409]yyyy-mm-dd": "date", "ww": "date", "m/d/yy": "date", "yyyy-mm-dd hh:mm": "datetime", "yyyy-mm-dd hh:mm:ss": "datetime",
    "hh:mm:ss": "time", "h:mm AM/PM": "time", "h:mm:ss.000": "time", "[h]:mm:ss": "duration", "[mm]:ss": "duration",
}


@_query("SELECT r_regionkey, code, class FROM region, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _CLASSES.items()) + ") t(code, class)")
def classify_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What number formats show."""
    codes = F.array(*[F.lit(c) for c in _CLASSES])
    rows = _table(spark, sf_dir, "region").select("r_regionkey", F.explode(codes).alias("code"))
    return rows.withColumn("class", C.classify_format(F.col("code")))


@_query(
    """SELECT * FROM (VALUES (0, 'General', 'number'), (1, '0', 'number'), (2, '0.00', 'number'), (3, '#,##0', 'number'), (4, '#,##0.00', 'number'),
    (5, '$#,##0_);($#,##0)', 'number'), (6, '$#,##0_);[Red]($#,##0)', 'number'), (7, '$#,##0.00_);($#,##0.00)', 'number'), (8, '$#,##0.00_);[Red]($#,##0.00)', 'number'),
    (9, '0%', 'number'), (10, '0.00%', 'number'), (11, '0.00E+00', 'number'), (12, '# ?/?', 'number'), (13, '# ??/??', 'number'),
    (14, 'm/d/yyyy', 'date'), (15, 'd-mmm-yy', 'date'), (16, 'd-mmm', 'date'), (17, 'mmm-yy', 'date'),
    (18, 'h:mm AM/PM', 'time'), (19, 'h:mm:ss AM/PM', 'time'), (20, 'h:mm', 'time'), (21, 'h:mm:ss', 'time'), (22, 'm/d/yyyy h:mm', 'datetime'),
    (27, '[$-404]e/m/d', 'date'), (30, 'm/d/yy', 'date'), (36, '[$-404]e/m/d', 'date'), (37, '#,##0 ;(#,##0)', 'number'), (38, '#,##0 ;[Red](#,##0)', 'number'),
    (39, '#,##0.00;(#,##0.00)', 'number'), (40, '#,##0.00;[Red](#,##0.00)', 'number'), (41, '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)', 'number'),
    (42, '_($* #,##0_);_($* (#,##0);_($* "-"_);_(@_)', 'number'), (43, '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)', 'number'),
    (44, '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)', 'number'), (45, 'mm:ss', 'time'), (46, '[h]:mm:ss', 'duration'), (47, 'mm:ss.0', 'time'), (48, '##0.0E+0', 'number'), (49, '@', 'number'),
    (50, '[$-404]e/m/d', 'date'), (57, '[$-404]e/m/d', 'date'), (59, 't0', 'number'), (60, 't0.00', 'number'), (61, 't#,##0', 'number'), (62, 't#,##0.00', 'number'),
    (67, 't0%', 'number'), (68, 't0.00%', 'number'), (69, 't# ?/?', 'number'), (70, 't# ??/??', 'number')) t(id, code, class)"""
)
def built_in_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number formats that have an id only."""
    rows = spark.createDataFrame(sorted(V.BUILT_IN_FORMATS.items()), "id int, code string")
    return rows.withColumn("class", C.classify_format(F.col("code")))


@_query("SELECT o_orderkey, (o_orderkey * 1000003) / 1000000 / 86400 AS days, (CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END) || (k // 8)::VARCHAR || ':' || lpad((k % 8 * 15 // 2)::VARCHAR, 2, '0') || ':' || CASE WHEN k % 2 = 1 THEN '30' ELSE '00' END AS shown FROM (SELECT o_orderkey, o_orderkey + 1 AS k FROM orders)")
def duration_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations as days, and days as duration text beyond a day and below zero (a count of 7.5 minutes: 192 to a day)."""
    key = F.col("o_orderkey")
    days = (key + 1).cast("double") / 192 * F.when(key % 2 == 0, -1).otherwise(1)
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.duration_to_serial(key * 1_000_003).alias("days"), C.serial_to_duration(days).alias("shown"))


@_query("SELECT p_partkey, chr((65 + p_partkey % 26)::INTEGER) || (p_size + 1)::VARCHAR AS relative, '$' || chr((65 + p_partkey % 26)::INTEGER) || '$' || (p_size + 1)::VARCHAR AS absolute FROM part")
def cell_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of cells."""
    row, column = F.col("p_size"), F.col("p_partkey") % 26
    return _table(spark, sf_dir, "part").select("p_partkey", C.cell_address(row, column).alias("relative"), C.cell_address(row, column, absolute=True).alias("absolute"))


@_query("SELECT p_partkey, CASE WHEN k < 26 THEN chr(65 + k) WHEN k < 702 THEN chr(65 + (k - 26) // 26) || chr(65 + k % 26) ELSE chr(65 + (k - 702) // 676) || chr(65 + ((k - 702) // 26) % 26) || chr(65 + (k - 702) % 26) END AS letters, (k + 1)::INTEGER AS back FROM (SELECT p_partkey, (p_partkey % 16384)::INTEGER AS k FROM part)")
def column_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column numbers and letters."""
    letters = C.column_letters(F.col("p_partkey") % 16384 + 1)
    return _table(spark, sf_dir, "part").select("p_partkey", letters.alias("letters"), C.column_index(letters).alias("back"))


@_query("SELECT doc_id, CASE WHEN t[1] IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || t ELSE t END AS t FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '=' || text WHEN 1 THEN '@' || text WHEN 2 THEN chr(9) || text ELSE text END AS t FROM documents)")
def formula_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a spreadsheet might run."""
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("="), "text")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("@"), "text")).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("\t"), "text")).otherwise(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", C.escape_formula(text).alias("t"))


@_query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe FROM pages")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text for XML."""
    return _table(spark, sf_dir, "pages").select("page_id", C.escape_xml(F.col("html")).alias("safe"))


@_query("SELECT event_id, CASE WHEN ts = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t, user_id::VARCHAR AS u, CASE WHEN event_type = 'view' THEN '1' ELSE '0' END AS b FROM events")
def stringify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all types as text."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("t"), F.col("user_id").alias("u"), (F.col("event_type") == "view").alias("b"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.withColumns({n: C.stringify(F.col(n), kinds[n]) for n in ("t", "u", "b")})


@_query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE chr(9) END AS separator FROM nation")
def detect_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The separator of a sample."""
    sep = F.element_at(F.array(*[F.lit(s) for s in (",", ";", "|", "\t")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    sample = F.concat(F.lit('"a, b;c,,"'), sep, F.col("n_name"), sep, F.lit("x\r\n1"), sep, F.lit("2"), sep, F.lit("3"))
    return _table(spark, sf_dir, "nation").select("n_nationkey", C.detect_separator(sample).alias("separator"))
