"""Frames from Python values, and small frames back to Python values."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession


def from_dict(spark: SparkSession, data: dict[str, Sequence], schema: str | None = None) -> DataFrame:
    lengths = {len(v) for v in data.values()}
    if len(lengths) > 1:
        raise ValueError("columns differ in length")
    return spark.createDataFrame(list(zip(*data.values(), strict=True)), schema or list(data))


def from_matrix(spark: SparkSession, matrix, names: Sequence[str] | None = None) -> DataFrame:
    """A double column for each matrix column."""
    rows = [[float(x) for x in r] for r in matrix]
    width = len(rows[0]) if rows else len(names or ())
    cols = list(names or [f"col{i}" for i in range(width)])
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols))


def from_tuples(spark: SparkSession, names: Sequence[str], rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), list(names))


def from_records(spark: SparkSession, records: Iterable) -> DataFrame:
    """Dataclass instances, mappings or Rows."""
    made = [Row(**(dataclasses.asdict(r) if dataclasses.is_dataclass(r) else dict(r) if not isinstance(r, Row) else r.asDict())) for r in records]
    return spark.createDataFrame(made)


def to_dict(df: DataFrame, orient: str = "list"):
    """'list', 'dict' (by row number), 'split' or 'records'; for small frames."""
    rows = df.collect()
    if orient == "records":
        return [r.asDict() for r in rows]
    if orient == "list":
        return {c: [r[c] for r in rows] for c in df.columns}
    if orient == "dict":
        return {c: {i: r[c] for i, r in enumerate(rows)} for c in df.columns}
    if orient == "split":
        return {"columns": df.columns, "index": list(range(len(rows))), "data": [list(r) for r in rows]}
    raise ValueError(orient)


def to_records(df: DataFrame, kind: type) -> list:
    """Instances of a dataclass, fields by column name."""
    names = [f.name for f in dataclasses.fields(kind)]
    return [kind(**{n: r[n] for n in names}) for r in df.select(*names).collect()]


def iter_rows(df: DataFrame) -> Iterator[tuple[int, Row]]:
    """Rows one partition at a time."""
    yield from enumerate(df.toLocalIterator(prefetchPartitions=True))


def iter_batches(df: DataFrame, n: int) -> Iterator[list[Row]]:
    part: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        part.append(row)
        if len(part) == n:
            yield part
            part = []
    if part:
        yield part


def _shown(df: DataFrame, n: int) -> tuple[list[str], list[list[str]]]:
    return df.columns, [["" if v is None else str(v) for v in r] for r in df.limit(n).collect()]


def to_markdown(df: DataFrame, n: int = 20) -> str:
    cols, rows = _shown(df, n)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(cols), line(["---"] * len(cols)), *map(line, rows)])


def to_html(df: DataFrame, n: int = 20) -> str:
    from html import escape

    cols, rows = _shown(df, n)
    head = "".join(f"<th>{escape(c)}</th>" for c in cols)
    body = "".join("<tr>" + "".join(f"<td>{escape(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def to_latex(df: DataFrame, n: int = 20) -> str:
    cols, rows = _shown(df, n)
    esc = lambda s: "".join("\\" + c if c in "&%$#_{}" else c for c in s)
    line = lambda cells: " & ".join(map(esc, cells)) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(cols) + "}", line(cols), r"\hline", *map(line, rows), r"\end{tabular}"])
