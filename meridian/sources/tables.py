"""Point tables: FF10 (bare or in a zip), CSV and JSON. One task decodes one file."""

from __future__ import annotations

import csv as csv_lib
import fnmatch
import io
import math
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import objects
from .errors import NoSuchVariable

_MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
# The columns of the point layout; the numeric ones are listed after them.
FF10_POINT = """COUNTRY_CD REGION_CD TRIBAL_CODE FACILITY_ID UNIT_ID REL_POINT_ID PROCESS_ID AGY_FACILITY_ID AGY_UNIT_ID AGY_REL_POINT_ID
AGY_PROCESS_ID SCC POLID ANN_VALUE ANN_PCT_RED FACILITY_NAME ERPTYPE STKHGT STKDIAM STKTEMP STKFLOW STKVEL NAICS LONGITUDE LATITUDE LL_DATUM
HORIZ_COLL_MTHD DESIGN_CAPACITY DESIGN_CAPACITY_UNITS REG_CODES FAC_SOURCE_TYPE UNIT_TYPE_CODE CONTROL_IDS CONTROL_MEASURES CURRENT_COST
CUMULATIVE_COST PROJECTION_FACTOR SUBMITTER_FAC_ID CALC_METHOD DATA_SET_ID FACIL_CATEGORY_CODE ORIS_FACILITY_CODE ORIS_BOILER_ID IPM_YN
CALC_YEAR DATE_UPDATED FUG_HEIGHT FUG_WIDTH_XDIM FUG_LENGTH_YDIM FUG_ANGLE ZIPCODE ANNUAL_AVG_HOURS_PER_YEAR""".split() + [f"{m}_VALUE" for m in _MONTHS] + [f"{m}_PCTRED" for m in _MONTHS] + ["COMMENT"]
FF10_NUMERIC = set("""ANN_VALUE ANN_PCT_RED STKHGT STKDIAM STKTEMP STKFLOW STKVEL LONGITUDE LATITUDE DESIGN_CAPACITY CURRENT_COST CUMULATIVE_COST
PROJECTION_FACTOR FUG_HEIGHT FUG_WIDTH_XDIM FUG_LENGTH_YDIM FUG_ANGLE ANNUAL_AVG_HOURS_PER_YEAR""".split()) | {f"{m}_{k}" for m in _MONTHS for k in ("VALUE", "PCTRED")}


def select_members(names: list[str], members=None, member_glob: str | None = None) -> list[str]:
    """The union of named and matching members, in byte order; folders never; what is absent or matches nothing is an error."""
    real = [n for n in names if not n.endswith("/")]
    if absent := sorted(set(members or []) - set(real)):
        raise ValueError(f"no members {absent}; present: {real}")
    found = set(members or [])
    if member_glob is not None:
        hits = {n for n in real if fnmatch.fnmatchcase(n, member_glob)}
        if not hits:
            raise ValueError(f"nothing matches {member_glob!r}; present: {real}")
        found |= hits
    if not members and member_glob is None:
        found = set(real)
    if not found:
        raise ValueError("no members")
    return sorted(found, key=lambda n: n.encode())


def _chosen(variables, present) -> list[str]:
    if variables is None:
        return list(present)
    if absent := set(variables) - set(present):
        raise NoSuchVariable(absent, present)
    return list(variables)


def ff10(spark: SparkSession, path, member=None, members=None, member_glob=None, skip_header_row: bool = False, numeric_columns=None, delimiter: str = ",", comment: str = "#", variables=None) -> DataFrame:
    """path, member, index and the 77 columns of the point layout (or `variables` of them): numeric ones blank to NaN, all others text."""
    if member is not None and (members or member_glob):
        raise ValueError("member excludes members and member_glob")
    wanted = [member] if member is not None else members
    numeric = FF10_NUMERIC if numeric_columns is None else set(_chosen(numeric_columns, FF10_POINT))
    names = _chosen(variables, FF10_POINT)

    def decode(batches):
        for pdf in batches:
            for path_, raw in zip(pdf["path"], pdf["content"]):
                raw = bytes(raw)
                if zipfile.is_zipfile(io.BytesIO(raw)):
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        parts = [(n, z.read(n)) for n in select_members(z.namelist(), wanted, member_glob)]
                else:
                    parts = [("", raw)]
                index = 0
                for name, body in parts:
                    lines = [x for x in body.decode("utf-8").splitlines() if x.strip() and not x.lstrip().startswith(comment)]
                    if skip_header_row:
                        if not lines or next(csv_lib.reader(lines[:1], delimiter=delimiter))[0].strip().lower() != "country_cd":
                            raise ValueError(f"{path_} {name}: no header row")
                        lines = lines[1:]
                    rows = list(csv_lib.reader(lines, delimiter=delimiter))
                    for r in rows:
                        if len(r) != len(FF10_POINT):
                            raise ValueError(f"{path_} {name}: {len(r)} fields, not {len(FF10_POINT)}")
                    out = pd.DataFrame(rows, columns=FF10_POINT, dtype=object)[names]
                    for c in names:
                        if c in numeric:
                            out[c] = [float(x) if x.strip() else math.nan for x in out[c]]
                    out.insert(0, "index", np.arange(index, index + len(out)))
                    out.insert(0, "member", name)
                    out.insert(0, "path", path_)
                    index += len(out)
                    yield out

    return objects.with_nan(objects.contents(spark, path).mapInPandas(decode, "path string, member string, index long, " + ", ".join(f"{c} {'double' if c in numeric else 'string'}" for c in names)))


def _csv_rows(raw: bytes, delimiter: str, header_row: int) -> tuple[list[str], list[list[str]]]:
    """Header and rows of a file; empty rows are dropped before the header is counted. A file without rows has no header."""
    rows = [r for r in csv_lib.reader(io.StringIO(raw.decode(), newline=""), delimiter=delimiter) if r]
    return (rows[header_row], rows[header_row + 1 :]) if len(rows) > header_row else ([], [])


def csv_header(path: str, delimiter: str = ",", header_row: int = 0) -> list[str]:
    """The header of one file, from its beginning; empty if it has none."""
    size, total = 1 << 16, objects.size(path, "") or 0
    while True:
        raw = objects.get_range(path, "", 0, min(size, total)) if total else b""
        rows = [r for r in csv_lib.reader(io.StringIO(raw.decode("utf-8", "ignore"), newline=""), delimiter=delimiter) if r]
        if len(rows) > header_row + 1 or size >= total:  # a row after it shows that it is whole
            return rows[header_row] if len(rows) > header_row else []
        size *= 16


def csv_points(spark: SparkSession, path, numeric_columns=None, delimiter: str = ",", header_row: int = 0, variables=None) -> DataFrame:
    """path, index and the columns of the files' headers: declared ones as double (anything else there is an error), others text.

    Every file is read by its own header, whose columns may stand in any order; a file with other columns than the first is an error and
    one without rows gives none. Without a declaration, columns whose every value in all files is a number are doubles.
    """
    head = next((h for p in objects.files(spark, path) if (h := csv_header(p, delimiter, header_row))), [])
    if absent := set(numeric_columns or []) - set(head):
        raise NoSuchVariable(absent, head)
    names = _chosen(variables, head)
    declared = [c for c in numeric_columns or [] if c in names]

    def decode(batches):
        for pdf in batches:
            for path_, raw in zip(pdf["path"], pdf["content"]):
                own, rows = _csv_rows(bytes(raw), delimiter, header_row)
                if own and sorted(own) != sorted(head):
                    raise ValueError(f"{path_}: columns {own}, in the first file {head}")
                if bad := next((r for r in rows if len(r) != len(own)), None):
                    raise ValueError(f"{path_}: {len(bad)} fields, not {len(own)}")
                out = pd.DataFrame(rows, columns=own, dtype=object)[names] if own else pd.DataFrame({c: [] for c in names}, dtype=object)
                for c in declared:
                    out[c] = out[c].astype("f8")
                out.insert(0, "index", np.arange(len(out)))
                out.insert(0, "path", path_)
                yield out

    df = objects.contents(spark, path).mapInPandas(decode, ", ".join(["path string", "index long", *[f"`{c}` {'double' if c in declared else 'string'}" for c in names]]))
    if numeric_columns is not None or not names:
        return df
    found = df.agg(*[F.bool_and(F.col(f"`{c}`").try_cast("double").isNotNull()).alias(f"c{k}") for k, c in enumerate(names)]).first()
    return df.select("path", "index", *[(F.col(f"`{c}`").cast("double") if found[k] else F.col(f"`{c}`")).alias(c) for k, c in enumerate(names)])


def json_points(spark: SparkSession, path, schema, variables=None) -> DataFrame:
    out = spark.read.schema(schema).json(path)
    return out if variables is None else out.select(*[F.col(f"`{c}`") for c in _chosen(variables, out.columns)])
