"""Catalogue files: CSV with the columns isbn, title and author in any order."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import saved
from ..shipping import ship

COLUMNS = ("isbn", "title", "author")
#: A larger file isn't a catalogue; uploads are held to it.
MOST_BYTES = 2 * 1024 * 1024
# The messages of reports; names in braces stand for a file's values.
MESSAGES = {
    "empty": "The CSV is empty.",
    "open quote": "The CSV contains an unclosed quoted field.",
    "unknown": "Unknown columns: {}.",
    "missing": "Missing columns: {}.",
    "duplicate": "Duplicate columns: {}.",
    "width": "Expected {} columns but found {}.",
    "no books": "The CSV contains no books.",
}


def csv_records(text: str) -> list[list[str]]:
    """Records of fields. A quote anywhere opens or closes a quoted stretch, and two in a row inside one stand for a quote; fields and stretches have any length."""
    stretches = text.split('"')
    records, record, field, quoted, i = [], [], [], False, 0
    while True:
        if quoted:
            field.append(stretches[i])
        else:
            for piece in re.split(r"(,|\r\n|\r|\n)", stretches[i]):
                if piece in (",", "\r\n", "\r", "\n"):
                    record.append("".join(field))
                    field = []
                    if piece != ",":
                        records.append(record)
                        record = []
                elif piece:
                    field.append(piece)
        i += 1
        if i == len(stretches):
            break
        if quoted and not stretches[i] and i + 1 < len(stretches):
            field.append('"')
            i += 1
        else:
            quoted = not quoted
    if quoted:
        raise ValueError(MESSAGES["open quote"])
    if record or any(field):
        records.append([*record, "".join(field)])
    return records


def parse_catalog(content: bytes) -> tuple[list[tuple[int, str, str, str]], list[tuple[int, str, str]]]:
    """Rows (record number with the header as 1, isbn, title, author) and errors (record number, field, message) of one file."""
    if len(content) > MOST_BYTES:
        return [], [(1, "file", "The file is larger than 2 MiB.")]
    try:
        records = csv_records(content.decode("utf-8"))
    except ValueError as e:  # not UTF-8, or a quote that doesn't end
        return [], [(1, "file", str(e))]
    if not records:
        return [], [(1, "file", MESSAGES["empty"])]
    records[0][0] = records[0][0].lstrip("\ufeff")
    header = [v.strip().lower() for v in records[0]]
    known = dict.fromkeys(header)
    wrong = [("unknown", [h for h in known if h not in COLUMNS]), ("missing", [c for c in COLUMNS if c not in known]),
        ("duplicate", [h for h in known if header.count(h) > 1])]
    if errors := [(1, "header", MESSAGES[what].format(", ".join(names))) for what, names in wrong if names]:
        return [], errors
    rows = []
    for number, values in enumerate(records[1:], 2):
        if not any(v.strip() for v in values):
            continue
        if len(values) != len(header):
            errors.append((number, "row", MESSAGES["width"].format(len(header), len(values))))
            continue
        rows.append((number, *(values[header.index(c)].strip() for c in COLUMNS)))
    if not rows:
        errors.append((1, "file", MESSAGES["no books"]))
    return rows, errors


def read_catalog_csv(spark: SparkSession, path: str, pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of all files under a path whose name fits the pattern; rows: file, row, isbn, title, author; errors: file, row, field, message.

    A file is a row of work and is read and parsed once; what is found is written to the shared folder.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def parsed(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                rows, errors = parse_catalog(c)
                found = [(p, r[0], *r[1:], None, None) for r in rows] + [(p, n, None, None, None, field, message) for n, field, message in errors]
                yield pd.DataFrame(found, columns=["file", "row", *COLUMNS, "field", "message"]).astype({"row": "int32"})

    both = saved(files.mapInPandas(parsed, "file string, row int, isbn string, title string, author string, field string, message string"), "catalog-records")
    good = F.col("message").isNull()
    return both.where(good).drop("field", "message"), both.where(~good).select("file", "row", "field", "message")
