"""Sinks: CSV with byte-order mark, JSON reports, validated atomic files, XML rows."""

from __future__ import annotations

import csv
import json
import os
import tempfile
from collections.abc import Callable, Iterable, Mapping, Sequence
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_file(path: str | Path, pieces: Iterable[str], validate: Callable[[Path], Sequence[str]] = lambda _: ()) -> None:
    """Write beside the target, flush to disk, validate what was written, then take its place.

    Problems that validate() reports leave the old file as it is and raise.
    """
    target = Path(path)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            out.writelines(pieces)
            out.flush()
            os.fsync(out.fileno())
        if problems := list(validate(Path(name))):
            raise ValueError("; ".join(problems))
        os.replace(name, target)
    finally:
        Path(name).unlink(missing_ok=True)


class _Lines(list):
    write = list.append


def csv_pieces(rows: DataFrame, columns: Sequence[str] | None = None, end: str = "\n", mark: bool = True) -> Iterable[str]:
    """Rows as CSV text, a record at a time: one byte-order mark, nested cells as JSON, null as empty."""
    names = list(columns or rows.columns)
    nested = [n for n, k in rows.dtypes if n in names and k.startswith(("array", "struct", "map"))]
    flat = rows.select(*[F.to_json(n).alias(n) if n in nested else n for n in names])
    lines = _Lines()
    writer = csv.writer(lines, lineterminator=end)
    writer.writerow(names)
    if mark:
        lines[0] = "﻿" + lines[0]
    yield lines.pop()
    for row in flat.toLocalIterator(prefetchPartitions=True):
        writer.writerow(["" if v is None else v for v in row])
        yield lines.pop()


def write_csv(rows: DataFrame, path: str | Path, **options) -> None:
    replace_file(path, csv_pieces(rows, **options))


def write_json_report(report: Mapping, path: str | Path) -> None:
    """A report with sorted keys, whole or not at all."""
    replace_file(path, [json.dumps(report, ensure_ascii=False, sort_keys=True, indent=2, default=str), "\n"])


def without_secrets(rows: DataFrame, words: Sequence[str] = ("password", "secret", "token", "session", "cookie", "credential")) -> DataFrame:
    """rows without the columns whose names speak of secrets."""
    return rows.select(*[c for c in rows.columns if not any(w in c.lower() for w in words)])


def product_sheets(products: DataFrame, children: Mapping[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """The workbook as named tables: products, and each child table for those products, in order."""
    ids = products.select(key)
    return {"products": products.orderBy(key), **{n: c.join(ids, key, "left_semi").orderBy(*[x for x in (key, "position") if x in c.columns]) for n, c in children.items()}}


def xml_rows(rows: DataFrame, tag: str = "product") -> DataFrame:
    """Each row, nested arrays and all, as one XML element."""
    return rows.select(F.to_xml(F.struct(*rows.columns), {"rowTag": tag}).alias("xml"))


def import_payload(rows: DataFrame, elements: Mapping[str, str], blockers: Sequence[str], root: str = "updates", item: str = "update", key: str = "id") -> Iterable[str]:
    """Updates as XML text, a row at a time in numeric order of the key, only when nothing blocks them.

    elements: element name by column, in the order given; absent values have no element; row values are escaped.
    """
    if blockers:
        raise ValueError("; ".join(blockers))
    number = F.expr(f"try_cast({key} AS DECIMAL(38,0))")
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<{root} create_new="false">\n'
    for row in rows.select(key, *[F.col(c).cast("string").alias(c) for c in elements]).orderBy(number.asc_nulls_last(), key).toLocalIterator(prefetchPartitions=True):
        yield f"<{item}><{key}>{escape(str(row[key]))}</{key}>" + "".join(f"<{tag}>{escape(row[c])}</{tag}>" for c, tag in elements.items() if row[c] is not None) + f"</{item}>\n"
    yield f"</{root}>\n"


def write_dataset(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A table version on the shared store."""
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
