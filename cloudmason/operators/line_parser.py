"""Rows that fail to parse: typed rows and rejects from raw CSV lines, by patterns generated from each file's header.

For each header layout one anchored pattern describes a whole valid row. Lines that miss it run through the patterns of
the row's growing field prefixes (first field, first two fields, ...); the first prefix that does not match names the
broken field, and the kind of prefix (structure alone, or structure and values) gives the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudmason.functions.frames import plain

# The two documented column layouts, the coordinate columns and the error texts of spreadsheet programs.
TEXT_FIELDS = ["semantic_label", "description", "historical_description", "material_description", "material", "typology", "function", "notes"]
CENTRE_FIELDS = ["global_box_center_x", "global_box_center_y", "global_box_center_z"]
SHEET_ERRORS = ["#N/A", "#NAME?", "#REF!", "#VALUE!", "#DIV/0!", "#NUM!", "#NULL!", "#GETTING_DATA", "#SPILL!", "#CALC!"]
SEPARATORS = [",", ";", "\t", "|"]
#: Control characters other than tab, line feed and carriage return.
CONTROL = "\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f"
#: Copies of a header row, so that lines of one large file do not meet in one task.
SALTS = 16

OUT_SCHEMA = (
    "line_id long, source_csv string, source_row int, reason string, broken_field string, "
    + ", ".join(f"{c} string" for c in TEXT_FIELDS)
    + ", "
    + ", ".join(f"{c} double" for c in CENTRE_FIELDS)
    + ", other_fields map<string,string>"
)


class RowPattern:
    """The patterns of one header layout: columns and separator."""

    def __init__(self, header: str):
        header = header.removeprefix("﻿").rstrip("\r\n")
        self.separator = max(SEPARATORS, key=header.count)
        self.columns = [c.strip().strip('"').strip().lower() for c in header.split(self.separator)]
        sep = re.escape(self.separator)
        quoted, bare = '"[^"]*+(?:""[^"]*+)*+"', f'[^"{sep}]*+'
        end = f"(?={sep}|\\Z)"
        errors = "|".join(map(re.escape, SHEET_ERRORS))
        cell = f"(?:{quoted}|{bare}){end}"
        number = r"\s*(?:[+-]?[0-9]+(?:[.,][0-9]+)?)?\s*"
        plain_number = r"\s*(?:[+-]?[0-9]+(?:[.,][0-9]+)?)?\s*" if self.separator != "," else r"\s*(?:[+-]?[0-9]+(?:\.[0-9]+)?)?\s*"
        good_quoted, good_bare = f'"[^"{CONTROL}]*+(?:""[^"{CONTROL}]*+)*+"', f'[^"{sep}{CONTROL}]*+'
        good_text = f'(?!"?\\s*(?:{errors})\\s*"?{end})(?:{good_quoted}|{good_bare}){end}'
        good_centre = f'(?:"{number}"|{plain_number}){end}'
        values = [good_centre if c in CENTRE_FIELDS else good_text for c in self.columns]
        flags = re.DOTALL | re.IGNORECASE
        self.row = re.compile(sep.join(values) + "\\Z", flags)
        self.structure = re.compile(f"{cell}(?:{sep}{cell})*\\Z", flags)
        self.cell = re.compile(f"({quoted}|{bare})(?:{sep}|\\Z)", flags)
        self.cell_prefix = [re.compile(sep.join([cell] * k), flags) for k in range(1, len(values) + 1)]
        self.value_prefix = [re.compile(sep.join(values[:k]), flags) for k in range(1, len(values) + 1)]
        self.whole_quoted = re.compile(f"{quoted}\\Z", flags)

    def first_broken(self, prefixes: list[re.Pattern], line: str) -> str | None:
        """The column of the shortest field prefix that the line does not match."""
        return next((c for c, p in zip(self.columns, prefixes, strict=True) if not p.match(line)), None)

    def cells(self, line: str) -> list[str]:
        found, at = [], 0
        while True:
            m = self.cell.match(line, at)
            text = m.group(1)
            found.append(text[1:-1].replace('""', '"') if text[:1] == '"' else text)
            if m.end() == m.end(1):
                return found
            at = m.end()

    def read(self, line: str | None) -> tuple[str | None, str | None, list[str] | None]:
        """(reason, broken field, cells): no reason for a valid row, no cells for a broken one."""
        if line is None:
            return "column_count", self.columns[0], None
        line = line[:-1] if line.endswith("\r") else line
        if len(self.columns) > 1 and self.whole_quoted.match(line):
            inner = line[1:-1].replace('""', '"')
            if self.structure.match(inner) and len(self.cells(inner)) == len(self.columns):
                line = inner
        if self.row.match(line):
            return None, None, self.cells(line)
        if not self.structure.match(line):
            return "quoting", self.first_broken(self.cell_prefix, line) or self.columns[-1], None
        n = len(self.cells(line))
        if n != len(self.columns):
            return "column_count", self.columns[min(n, len(self.columns) - 1)], None
        return "invalid_value", self.first_broken(self.value_prefix, line), None


@lru_cache(maxsize=4096)
def row_pattern(header: str) -> RowPattern:
    return RowPattern(header)


def _number(text: str | None) -> float | None:
    text = (text or "").strip()
    return float(text.replace(",", ".")) if text else None


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = {c: [] for c in ["reason", "broken_field", *TEXT_FIELDS, *CENTRE_FIELDS, "other_fields"]}
        for header, line in zip(batch["header"], batch["raw"], strict=True):
            if header is None:
                reason, broken, cells, columns = "no_header", None, None, []
            else:
                pattern = row_pattern(header)
                reason, broken, cells = pattern.read(line)
                columns = pattern.columns
            row = dict(zip(columns, cells, strict=True)) if cells is not None else {}
            out["reason"].append(reason)
            out["broken_field"].append(broken)
            for c in TEXT_FIELDS:
                out[c].append(row.pop(c, None))
            for c in CENTRE_FIELDS:
                out[c].append(_number(row.pop(c, None)))
            out["other_fields"].append(row)
        frame = pd.DataFrame(out)
        frame.insert(0, "line_id", batch["line_id"].array)
        frame.insert(1, "source_csv", batch["source_csv"].array)
        frame.insert(2, "source_row", batch["source_row"].astype("Int32").array)
        frame[CENTRE_FIELDS] = frame[CENTRE_FIELDS].astype("Float64")
        yield plain(frame)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Every data line of every file, either typed (reason null) or with the reason why it cannot be loaded.

    lines: line_id, source_csv, source_row (1 = header) and raw_line; further columns are ignored, whatever their names.
    Result: OUT_SCHEMA; columns of a header beyond the documented ones go to other_fields. Defined cases: a null raw_line
    is a record without cells (column_count); a null source_row is a data line; lines of a file without a header row, or
    with a null source_csv, get no_header; of several header rows of one file the one with the smallest line_id counts;
    repeated lines are each judged by themselves; an empty table gives an empty result.
    """
    lines = lines.select("line_id", "source_csv", F.col("source_row").cast("int").alias("source_row"), F.col("raw_line").alias("raw"))
    headers = (
        lines.filter((F.col("source_row") == 1) & F.col("raw").isNotNull() & F.col("source_csv").isNotNull())
        .groupBy("source_csv")
        .agg(F.min_by("raw", "line_id").alias("header"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    data = lines.filter(F.col("source_row").isNull() | (F.col("source_row") != 1)).withColumn("salt", F.pmod(F.xxhash64("line_id"), F.lit(SALTS)).cast("int"))
    return data.join(headers, ["source_csv", "salt"], "left").select("line_id", "source_csv", "source_row", "raw", "header").mapInPandas(_parse, OUT_SCHEMA)


def valid_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason", "broken_field")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "source_csv", "source_row", "reason", "broken_field")
