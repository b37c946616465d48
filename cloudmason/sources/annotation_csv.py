"""Annotation files: discovery, and reading many files at once with unknown encoding, separator and columns."""

from __future__ import annotations

import csv
import io
import os
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmason.functions import text as X

# Name endings of annotation files, encodings in the order of trial, and column names by meaning.
ENDINGS = [".csv", "_annotations.csv", "_metadata.csv", "_descriptions.csv"]
ENCODINGS = ["utf-8-sig", "utf-8", "cp1252", "latin-1"]
LABEL_COLUMNS = ["semantic_label", "class_semantic_label", "semantic_class_label", "label", "class", "classe", "object_class", "element_class", "type", "tipo"]
CENTRE_COLUMNS = {c: [f"global_box_center_{c}", f"box_center_{c}", f"bbox_center_{c}", c, f"center_{c}", f"c{c}"] for c in "xyz"}
SCHEMA = "source_csv string, source_row int, attrs map<string,string>"


def find_annotations(cloud: str, explicit: str | None = None) -> str | None:
    """The annotation file of a point cloud: the explicit one, which must exist, else the first of the usual names."""
    if explicit:
        if not os.path.exists(explicit):
            raise FileNotFoundError(explicit)
        return explicit
    stem = os.path.splitext(cloud)[0]
    return next((stem + e for e in ENDINGS if os.path.exists(stem + e)), None)


def header_name(name: str) -> str:
    folded = unicodedata.normalize("NFKD", name.strip().lower())
    return re.sub(r"[^0-9a-z]+", "_", "".join(c for c in folded if not unicodedata.combining(c))).strip("_")


def decode(content: bytes) -> str:
    for e in ENCODINGS:
        try:
            return content.decode(e)
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def rows_of(content: bytes) -> Iterator[tuple[int, dict[str, str]]]:
    """(source row, non-empty cells by column) of one file; a record quoted into a single field is taken apart."""
    text = decode(content)
    first = text.split("\n", 1)[0]
    sep = max(",;\t|", key=first.count)
    lines = csv.reader(io.StringIO(text), delimiter=sep)
    names = [header_name(n) for n in next(lines, [])]
    for k, cells in enumerate(lines):
        if len(names) > 1 and cells and "," in cells[0] and not any(c.strip() for c in cells[1:]):
            inner = next(csv.reader([cells[0]]))
            cells = inner if len(inner) == len(names) else cells
        yield k + 2, {n: c.strip() for n, c in zip(names, cells, strict=False) if c.strip()}


def read_annotation_files(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA of all rows of all files under path; files are read in parallel, each by one task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(rows_of(content))
                yield pd.DataFrame({"source_csv": [name] * len(rows), "source_row": pd.Series([r for r, _ in rows], dtype="int32"), "attrs": [a for _, a in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SCHEMA)


def annotation_rows(read: DataFrame) -> DataFrame:
    """source_csv, source_row, semantic_label, global_box_center_x..z and attrs; of several columns of one meaning the first
    non-empty one counts."""
    first = lambda names: X.first_value(*(F.col("attrs")[n] for n in names))
    return read.select("source_csv", "source_row", first(LABEL_COLUMNS).alias("semantic_label"), *(X.decimal(first(CENTRE_COLUMNS[c])).alias(f"global_box_center_{c}") for c in "xyz"), "attrs")
