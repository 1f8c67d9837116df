"""Records from files and databases: (batch_no, origin, index, field_order, fields, declared_type)."""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "batch_no int, origin string, index bigint, field_order array<string>, fields map<string,string>, declared_type string"
_ROWS = "file string, index bigint, field_order array<string>, fields map<string,string>"


def decode(data: bytes) -> str:
    """UTF-8 with or without a mark, UTF-16 by its mark, else Windows-1252, where undefined bytes are replaced."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def flatten(value, prefix: str = "") -> Iterator[tuple[str, str]]:
    """Dotted keys of a JSON value: list places count as keys, nulls are left out, other values are text."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flatten(v, f"{prefix}.{k}" if prefix else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from flatten(v, f"{prefix}.{i}" if prefix else str(i))
    elif value is not None:
        yield prefix or "value", value if isinstance(value, str) else json.dumps(value)


def _rows_of(document) -> list:
    if isinstance(document, list):
        return document
    if isinstance(document, dict):
        return next((v for v in document.values() if isinstance(v, list)), [document])
    return [document]


def csv_rows(text: str, delimiter: str) -> Iterator[dict[str, str]]:
    """Rows under a trimmed header: cells trimmed, empty ones left out, surplus ones called col_j."""
    rows = csv.reader(io.StringIO(text), delimiter=delimiter)
    header = [h.strip() for h in next(rows, [])]
    for cells in rows:
        yield {(header[j] if j < len(header) else f"col_{j}"): c.strip() for j, c in enumerate(cells) if c.strip()}


def _binary(kind: str):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                text = decode(bytes(data))
                if kind in ("csv", "tsv"):
                    found = csv_rows(text, "\t" if kind == "tsv" else ",")
                else:
                    found = (dict(flatten(r)) for r in _rows_of(json.loads(text)))
                rows = [(path, i, list(r), r) for i, r in enumerate(found)]
                yield pd.DataFrame(rows, columns=["file", "index", "field_order", "fields"])

    return run


def _lines(batches):
    import pandas as pd

    for pdf in batches:
        rows = []
        for path, i, line in zip(pdf["file"], pdf["index"], pdf["value"]):
            r = dict(flatten(json.loads(line)))  # a bad line fails the load
            rows.append((path, i, list(r), r))
        yield pd.DataFrame(rows, columns=["file", "index", "field_order", "fields"])


def _as_records(rows: DataFrame, batch_no: int, declared: str | None) -> DataFrame:
    return rows.select(F.lit(batch_no).alias("batch_no"), F.col("file").alias("origin"), "index", "field_order", "fields", F.lit(declared).cast("string").alias("declared_type"))


def read_delimited(spark: SparkSession, path: str, batch_no: int = 0, declared: str | None = None) -> DataFrame:
    """CSV or TSV files, a file in a task: rows may be ragged and encodings differ, which Spark's own reader can't mend."""
    kind = "tsv" if path.lower().endswith(".tsv") else "csv"
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _as_records(files.mapInPandas(_binary(kind), _ROWS), batch_no, declared)


def read_delimited_splittable(spark: SparkSession, path: str, batch_no: int = 0, declared: str | None = None, delimiter: str = ",") -> DataFrame:
    """Large, regular UTF-8 files: Spark's own reader splits them; numbers give the order within the load."""
    df = spark.read.option("header", True).option("sep", delimiter).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    cols = df.columns
    cells = F.array(*(F.struct(F.lit(c.strip()).alias("key"), F.trim(F.col(f"`{c}`")).alias("value")) for c in cols))
    fields = F.map_from_entries(F.filter(cells, lambda e: F.coalesce(e["value"] != "", F.lit(False))))
    rows = df.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("index"), fields.alias("fields"))
    return _as_records(rows.select("file", "index", F.map_keys("fields").alias("field_order"), "fields"), batch_no, declared)


def read_json_document(spark: SparkSession, path: str, batch_no: int = 0, declared: str | None = None) -> DataFrame:
    """A JSON or GeoJSON document: a list's rows, else those of the first list in an object, else the object itself."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _as_records(files.mapInPandas(_binary("json"), _ROWS), batch_no, declared)


def read_json_lines(spark: SparkSession, path: str, batch_no: int = 0, declared: str | None = None) -> DataFrame:
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("index"), "value").where(F.trim("value") != "")
    return _as_records(lines.mapInPandas(_lines, _ROWS), batch_no, declared)


def read_manifest(spark: SparkSession, path: str, batch_no: int = 0, declared: str | None = None) -> DataFrame:
    """A fetch plan {server, tool, arguments, records_path, description}: one record that says so; nothing is fetched."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    get = lambda k: F.get_json_object("t", f"$.{k}")
    values = F.array(*(F.struct(F.lit(k).alias("key"), get(s).alias("value")) for k, s in (("mcp_server", "server"), ("mcp_tool", "tool"), ("mcp_arguments", "arguments"), ("records_path", "records_path"), ("description", "description"))))
    fields = F.map_from_entries(F.filter(values, lambda e: e["value"].isNotNull()))
    rows = files.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("index"), fields.alias("fields"))
    return _as_records(rows.select("file", "index", F.map_keys("fields").alias("field_order"), "fields"), batch_no, declared)


def read_table(df: DataFrame, origin: str, index: str, batch_no: int = 0, declared: str | None = None) -> DataFrame:
    """A table's rows as records, every value as text; index is a numeric column that tells rows apart."""
    cols = [c for c in df.columns]
    cells = F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols))
    fields = F.map_from_entries(F.filter(cells, lambda e: F.coalesce(e["value"] != "", F.lit(False))))
    rows = df.select(F.lit(origin).alias("file"), F.col(index).cast("long").alias("index"), fields.alias("fields"))
    return _as_records(rows.select("file", "index", F.map_keys("fields").alias("field_order"), "fields"), batch_no, declared)


READERS = {"csv": read_delimited, "tsv": read_delimited, "json": read_json_document, "geojson": read_json_document, "ndjson": read_json_lines, "jsonl": read_json_lines, "yaml": read_manifest, "yml": read_manifest, "mcp": read_manifest, "toml": read_manifest}


def read_source(spark: SparkSession, path: str, batch_no: int = 0, declared: str | None = None) -> DataFrame:
    """Records of a path by its extension."""
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    if ext not in READERS:
        raise ValueError(f"no reader for .{ext}")
    return READERS[ext](spark, path, batch_no, declared)


def read_jdbc(spark: SparkSession, url: str, query: str, index: str, **options: str) -> DataFrame:
    """Records of a database query, by the JDBC driver that the session has for the URL."""
    return read_table(spark.read.format("jdbc").options(url=url, query=query, **options).load(), url, index)


def max_records(records: DataFrame, most: int) -> DataFrame:
    """The first records in order."""
    return records.orderBy("batch_no", "index").limit(most)


def fill_placeholders(template: str, values: dict[str, str]) -> str:
    for k, v in values.items():
        template = template.replace("{" + k + "}", v)
    return template


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feed groups (source, category, severity, kind, values, ord) of a JSON file or a folder of them, in the order of their
    paths: a file holds one group or a list. Files that aren't JSON, or hold something else, are left out."""
    group = "struct<source:string,category:string,severity:string,kind:string,values:array<string>>"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    many = F.from_json("t", f"array<{group}>")  # a single object is read as a list of one
    rows = files.select("path", F.posexplode(many).alias("pos", "g")).where("g.source IS NOT NULL AND g.category IS NOT NULL AND g.values IS NOT NULL")
    return rows.select("g.*", F.struct("path", "pos").alias("ord"))


def profile_source(spark: SparkSession, path: str, sample: int = 400) -> DataFrame:
    """One row for each column of a file's records: row_count and the column's profile over its first rows."""
    from ..operators.extract import profile_columns

    records = read_source(spark, path)
    cells = records.select(F.col("index").alias("row"), F.posexplode("field_order").alias("pos", "name"), "fields").select("row", "pos", "name", F.try_element_at("fields", F.col("name")).alias("value"))
    count = records.agg(F.count(F.lit(1)).alias("row_count"))
    return profile_columns(cells, sample).crossJoin(F.broadcast(count))


def source_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(type, files) of a folder, media counted by type."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"image": "jpg jpeg png gif bmp webp tiff heic", "video": "mp4 mov avi mkv webm", "audio": "mp3 wav ogg flac m4a", "table": "csv tsv json jsonl ndjson geojson parquet", "document": "pdf doc docx txt md"}
    of = F.create_map(*(F.lit(x) for k, v in kinds.items() for e in v.split() for x in (e, k)))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.groupBy(F.coalesce(F.try_element_at(of, ext), F.lit("other")).alias("type")).agg(F.count(F.lit(1)).alias("files"))


def catalog(spark: SparkSession) -> DataFrame:
    """Templates of sources by discipline."""
    rows = [("osint", "Certificate transparency", "rest"), ("osint", "Domain registration", "rest"), ("osint", "Internet scan", "rest"), ("osint", "News feed", "rest"), ("geoint", "Aircraft positions", "rest"), ("geoint", "Map features", "rest"), ("geoint", "GeoJSON", "file"), ("sigint", "Call records", "file"), ("sigint", "Network flows", "file"), ("humint", "Report intake", "file"), ("humint", "Case management", "database"), ("humint", "Report service", "rest")]
    return spark.createDataFrame(rows, "discipline string, name string, via string")
