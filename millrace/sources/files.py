"""Readers and writers of files, by format and by extension."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import col

#: Fixed: tokens that count as null in text files.
NULL_TOKENS = ("", "NA", "N/A", "null", "NULL", "None")
#: Inference order; thousands separators are allowed in numbers.
_KINDS = (("int", r"^[+-]?\d{1,3}(,\d{3})*$|^[+-]?\d+$"), ("bigint", None), ("double", None), ("boolean", r"(?i)^(true|false)$"), ("timestamp_ntz", None))


class ConnectorMissing(RuntimeError):
    """The connector's jar is not on the class path."""


# csv -------------------------------------------------------------------------


def infer_types(df: DataFrame, sample_rows: int | None = 100) -> dict[str, str]:
    """int, bigint, double, boolean, timestamp_ntz or string for string columns; all-null is string. One aggregate over the sample."""
    part = df.limit(sample_rows) if sample_rows else df
    aggs = []
    for c in df.columns:
        plain = F.regexp_replace(col(c), r"(?<=\d),(?=\d{3}(\D|$))", "")
        for kind, pattern in _KINDS:
            ok = plain.try_cast(kind).isNotNull()
            if pattern:
                ok = ok & col(c).rlike(pattern)
            if kind == "double":
                ok = ok & plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
            aggs.append((F.count(col(c)) == F.count_if(ok)).alias(f"{c}\0{kind}"))
        aggs.append(F.count(col(c)).alias(f"{c}\0n"))
    row = part.agg(*aggs).first().asDict()
    out = {}
    for c in df.columns:
        out[c] = next((k for k, _ in _KINDS if row[f"{c}\0n"] and row[f"{c}\0{k}"]), "string")
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Strings to typed columns; what does not fit becomes null."""
    made = {}
    for c, kind in types.items():
        if kind in ("int", "bigint", "double", "float"):
            made[c] = F.regexp_replace(col(c), r"(?<=\d),(?=\d{3}(\D|$))", "").try_cast(kind)
        elif kind != "string":
            made[c] = col(c).try_cast(kind)
    return df.withColumns(made)


def read_csv(spark: SparkSession, path: str | Sequence[str], *, sep: str = ",", header: bool = True, quote: str = '"', comment: str | None = None, encoding: str = "UTF-8", multi_line: bool = False, null_tokens: Sequence[str] = NULL_TOKENS, schema: T.StructType | None = None, types: dict[str, str] | None = None, sample_rows: int | None = 100, date_format: str | None = None, skip_rows: int = 0) -> DataFrame:
    """Comma separated text (``.gz`` too). Without schema or types they are inferred from ``sample_rows`` rows."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("sep", sep).option("header", header).option("quote", quote).option("encoding", encoding).option("multiLine", multi_line).option("escape", quote)
    if comment:
        reader = reader.option("comment", comment)
    if date_format:
        reader = reader.option("timestampNTZFormat", date_format)
    if skip_rows:
        lines = spark.read.text(paths, wholetext=False).withColumn("__i", F.monotonically_increasing_id())
        kept = lines.where(F.col("__i") >= skip_rows).orderBy("__i").select("value")
        text = kept.rdd.map(lambda r: r[0])
        df = reader.csv(text)
    elif schema is not None:
        return reader.schema(schema).csv(paths)
    else:
        df = reader.csv(paths)
    if not header:
        df = df.toDF(*[f"Column{i}" for i in range(len(df.columns))])
    df = df.select(*[F.when(~col(c).isin(list(null_tokens)), col(c)).alias(c) for c in df.columns])
    return apply_types(df, types if types is not None else infer_types(df, sample_rows))


def read_many(spark: SparkSession, paths: Sequence[str], **options) -> tuple[DataFrame | None, dict[str, str]]:
    """(all readable files as one frame by column name, what went wrong with each of the others)."""
    from pyspark.errors import PySparkException

    from ..operators.joins import concat_rows

    frames, failed = [], {}
    for p in paths:
        try:
            frames.append(read_csv(spark, p, **options))
        except PySparkException as e:
            failed[p] = str(e).splitlines()[0]
    return (concat_rows(*frames) if frames else None), failed


def read_chunked(spark: SparkSession, path: str, rows: int, **options) -> DataFrame:
    """The file's rows with ``chunk``, the 0-based number of their run of ``rows`` rows in file order."""
    from ..ordering import POSITION, with_position, with_row_id

    at = with_position(with_row_id(read_csv(spark, path, **options), "__line"), ["__line"])
    return at.withColumn("chunk", F.floor(F.col(POSITION) / rows)).drop("__line", POSITION)


def write_csv(df: DataFrame, path: str, *, sep: str = ",", header: bool = True, null_value: str = "", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).option("nullValue", null_value).option("escape", '"').csv(path)


# json ------------------------------------------------------------------------


def read_json(spark: SparkSession, path: str | Sequence[str], *, orient: str = "records", schema=None) -> DataFrame:
    """orient: 'lines', 'records' (an array of objects) or 'columns' (an object of arrays)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if orient == "lines":
        return reader.json(path)
    if orient == "records":
        return reader.option("multiLine", True).json(path)
    wide = spark.read.option("multiLine", True).json(path)
    return wide.select(F.explode(F.arrays_zip(*map(col, wide.columns))).alias("r")).select("r.*")


def nested_as_text(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as their JSON text."""
    return df.select(*[(F.to_json(col(f.name)) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else col(f.name)).alias(f.name) for f in df.schema.fields])


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def json_text(df: DataFrame, orient: str = "records") -> str:
    """A small frame as one JSON text."""
    import json

    rows = [json.loads(r) for r in df.toJSON().collect()]
    if orient == "records":
        return json.dumps([{c: r.get(c) for c in df.columns} for r in rows])
    return json.dumps({c: [r.get(c) for r in rows] for c in df.columns})


# parquet, orc, avro, arrow ------------------------------------------------------


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*map(col, columns)) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """With ``partition_by`` rows are dealt by those keys and a salt, so that a hot value is not one file of one task."""
    if partition_by:
        df = df.repartition(*map(col, partition_by), (F.pmod(F.xxhash64(*map(col, df.columns)), F.lit(8))))
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def write_orc(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).orc(path)


def _connector(f, name: str):
    try:
        return f()
    except Exception as e:
        if "Failed to find data source" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e) or "AVRO" in str(e).upper() and "not found" in str(e):
            raise ConnectorMissing(f"the {name} connector is not on the class path") from e
        raise


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    return _connector(lambda: spark.read.format("avro").load(path), "avro")


def write_avro(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _connector(lambda: df.write.mode(mode).format("avro").save(path), "avro")


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files (one, or a folder of them), parsed on the executors; the schema is that of the shortest."""
    files = spark.read.format("binaryFile").load(path)
    least = files.agg(F.min("length")).first()[0]
    if least is None:
        raise FileNotFoundError(path)
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    first = files.where(F.col("length") == least).select("content").first()
    schema = from_arrow_schema(pa.ipc.open_file(pa.BufferReader(bytes(first["content"]))).schema)

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                f = pa.ipc.open_file(x.as_buffer())
                for i in range(f.num_record_batches):
                    yield f.get_batch(i)

    return files.select("content").mapInArrow(run, schema)


def arrow_bytes(df: DataFrame) -> bytes:
    """A small frame as an Arrow IPC file."""
    import pyarrow as pa

    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


#: Fixed: the end of every Arrow IPC file, and bytes of rows in one.
_ARROW_END, _ARROW_FILE = "ARROW1", 16 << 20


def write_arrow(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of Arrow IPC files, written by the executors; the first has no rows, so that there always is a schema.

    Spark's text writer makes each row a file, as bytes, and puts the last six (the same in all Arrow files) after it as its
    line separator.
    """
    import pyarrow as pa

    def packed(held):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, held[0].schema) as out:
            for batch in held:
                out.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()[: -len(_ARROW_END)]], pa.binary())], names=["value"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= _ARROW_FILE:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    head = df.sparkSession.range(0, 1, 1, 1).select(F.lit(arrow_bytes(df.limit(0))[: -len(_ARROW_END)]).alias("value"))
    rows = head.unionAll(df.mapInArrow(run, "value binary")).select(F.col("value").cast("string"))
    rows.write.mode(mode).option("lineSep", _ARROW_END).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


# excel -------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _hadoop_file(spark: SparkSession, path: str):
    """(file system, path); a local one without the checksum file beside, which edits by other programs would belie."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), where


def _write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file at a Hadoop path, by the driver; one that is there is replaced."""
    fs, where = _hadoop_file(spark, path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)  # with its checksums
    out = fs.create(where, True)
    try:
        for i in range(0, len(content), 1 << 20):
            out.write(bytearray(content[i : i + (1 << 20)]))
    finally:
        out.close()


def _read_bytes(path: str, spark: SparkSession | None = None) -> bytes:
    """A file of a Hadoop path, in the driver; without a session, a local one."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        with open(path, "rb") as f:
            return f.read()
    fs, where = _hadoop_file(spark, path)
    source = fs.open(where)
    try:
        return b"".join(iter(lambda: bytes(source.readNBytes(1 << 20)), b""))
    finally:
        source.close()


def _sheets(book: zipfile.ZipFile) -> list[str]:
    return [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets", _NS)]


def list_sheets(path: str) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(_read_bytes(path))) as z:
        return _sheets(z)


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, header: bool = True) -> DataFrame:
    """A sheet of an .xlsx file (driver side: workbooks are small), types inferred."""
    with zipfile.ZipFile(io.BytesIO(_read_bytes(path, spark))) as z:
        names = _sheets(z)
        number = names.index(sheet) + 1 if sheet else 1
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        grid = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{number}.xml")).iter(f"{{{_NS['m']}}}row"):
            cells = {}
            for i, c in enumerate(row):
                at = _column_number(c.get("r")) if c.get("r") else i
                v = c.find("m:v", _NS)
                kind = c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else ("true" if v.text == "1" else "false") if kind == "b" else v.text
            grid.append(cells)
    width = max((max(c, default=-1) for c in grid), default=-1) + 1
    rows = [[c.get(i) for i in range(width)] for c in grid]
    names = [x if x is not None else f"Column{i}" for i, x in enumerate(rows.pop(0))] if header and rows else [f"Column{i}" for i in range(width)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return apply_types(df, infer_types(df, None))


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1", max_rows: int = 1_048_575) -> None:
    """A small frame as an .xlsx file; more rows than a sheet holds is an error."""
    from xml.sax.saxutils import escape

    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("too many rows for a sheet")

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [df.columns, *rows])
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = _NS["m"], _NS["r"]
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    _write_bytes(df.sparkSession, path, book.getvalue())


# html tables ---------------------------------------------------------------------


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[tuple[bool, list[str]]]] = []
        self.open: list[list] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif self.open and tag == "tr":
            self.open[-1].append([False, []])
        elif self.open and tag in ("td", "th") and self.open[-1]:
            self.cell = []
            self.open[-1][-1][0] |= tag == "th"

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1][1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def parse_tables(html: str) -> list[tuple[list[str], list[list[str]]]]:
    """(header, rows) of each table: the header is the first row with th cells, else the first row."""
    p = _Tables()
    p.feed(html or "")
    p.close()
    out = []
    for t in p.tables:
        rows = [r for r in t if r[1]]
        at = next((i for i, r in enumerate(rows) if r[0]), 0)
        out.append((rows[at][1] if rows else [], [r[1] for i, r in enumerate(rows) if i != at]))
    return out


def html_tables(df: DataFrame, html_col: str, keys: Sequence[str]) -> DataFrame:
    """(keys, table_no, row_no, header, cells) of all tables in an html column, parsed in Arrow batches."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, html in enumerate(batch.column(len(keys)).to_pylist()):
                for t, (header, body) in enumerate(parse_tables(html)):
                    rows += [(i, t, r, header, cells) for r, cells in enumerate(body)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            take = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(len(keys))), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.list_(pa.string()))], names=[*keys, "table_no", "row_no", "header", "cells"])

    return df.select(*map(col, keys), col(html_col)).mapInArrow(run, f"{kinds}, table_no int, row_no int, header array<string>, cells array<string>")


def read_html(spark: SparkSession, html: str) -> list[DataFrame]:
    """All tables of one html text, as frames with inferred types."""
    out = []
    for header, rows in parse_tables(html):
        width = max([len(header), *map(len, rows)])
        names = [*header, *[f"Column{i}" for i in range(len(header), width)]]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.createDataFrame([[*r, *[None] * (width - len(r))] for r in rows], schema)
        out.append(apply_types(df, infer_types(df, None)))
    return out


# by extension ----------------------------------------------------------------------


def _kind(path: str) -> str:
    name = path.rstrip("/").lower()
    for end, kind in ((".csv", "csv"), (".csv.gz", "csv"), (".tsv", "tsv"), (".tsv.gz", "tsv"), (".jsonl", "jsonl"), (".json", "json"), (".parquet", "parquet"), (".arrow", "arrow"), (".ipc", "arrow"), (".xlsx", "xlsx"), (".avro", "avro"), (".orc", "orc")):
        if name.endswith(end):
            return kind
    raise ValueError(f"unknown extension: {path}")


def load(spark: SparkSession, path: str) -> DataFrame:
    kind = _kind(path)
    readers = {"csv": read_csv, "tsv": lambda s, p: read_csv(s, p, sep="\t"), "jsonl": lambda s, p: read_json(s, p, orient="lines"), "json": read_json, "parquet": read_parquet, "arrow": read_arrow, "xlsx": read_excel, "avro": read_avro, "orc": read_orc}
    return readers[kind](spark, path)


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    kind = _kind(path)
    if kind == "arrow":
        write_arrow(df, path, mode)
    elif kind == "xlsx":
        write_excel(df, path)
    else:
        {"csv": write_csv, "tsv": lambda d, p, mode: write_csv(d, p, sep="\t", mode=mode), "jsonl": write_json_lines, "json": write_json_lines, "parquet": lambda d, p, mode: write_parquet(d, p, mode=mode), "avro": write_avro, "orc": write_orc}[kind](df, path, mode=mode)


def cloud_uri(provider: str, container: str, key: str, account: str | None = None) -> str:
    """The Hadoop URI of an object in a bucket or container."""
    if provider == "s3":
        return f"s3a://{container}/{key}"
    if provider == "gcs":
        return f"gs://{container}/{key}"
    if provider == "azure":
        if not account:
            raise ValueError("azure needs an account")
        return f"abfss://{container}@{account}.dfs.core.windows.net/{key}"
    raise ValueError(provider)
