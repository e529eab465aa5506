"""Two data sources of their own, read in partitions: members of zip archives, and ranges of row ids of a SQLite table.

``register(spark)`` makes the formats "zipped_csv" and "sqlite_rows" known. Only asked columns are parsed, and comparisons with constants are pushed down (Spark's setting
``spark.sql.python.filterPushdown.enabled``, which ``register`` turns on): a date range opens just the members that fall into it, and SQLite's own filter takes
the others. Both libraries need a path that they can open and seek, so paths are those of a file system that driver and executors share.
"""

from __future__ import annotations

import csv
import datetime
import glob
import io
import os
import re
import sqlite3
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from .staging import for_workers

BATCH = 8192
#: How a member's name tells its date: the last run of eight digits, or day, month's name and year together.
_DATES = ((r"(\d{8})(?!.*\d{8})", "%Y%m%d"), (r"(?i)(\d{2}[a-z]{3}\d{4})", "%d%b%Y"))
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def register(spark: SparkSession) -> None:
    for_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZippedCsv, SqliteRows):
        spark.dataSource.register(source)


def date_of(name: str) -> datetime.date | None:
    for pattern, form in _DATES:
        for found in re.findall(pattern, os.path.basename(name)):
            try:
                return datetime.datetime.strptime(found, form).date()
            except ValueError:
                continue
    return None


def _compare(sign: str, a, b) -> bool:
    return {"=": a == b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[sign]


@dataclass
class Member(InputPartition):
    archive: str
    name: str
    date: datetime.date | None


class ZippedCsv(DataSource):
    """Options: path (a pattern), column_date (the column that holds a member's date, "date"), first_only ("true": one member an archive). With a schema, its columns are looked up by name, case and blanks aside, and one that a member lacks is null;
    without one, all columns are those of the first member's header, as strings, and the date. Cells are trimmed; blank and "-" are null, and so are numbers that don't parse. An archive that can't be opened gives no rows unless strict is "true"."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> StructType:
        for m in ZippedReader(StructType(), self.options).partitions():
            with zipfile.ZipFile(m.archive) as z, z.open(m.name) as f:
                header = next(csv.reader(io.TextIOWrapper(f, "utf-8", "replace")), [])
            return StructType([StructField(self.options.get("column_date", "date"), DateType()), *(StructField(c.strip(), StringType()) for c in header if c.strip())])
        raise FileNotFoundError(f"no member under {self.options['path']}")

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZippedReader(schema, self.options)


class ZippedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.date, self.first, self.strict = options.get("column_date", "date"), options.get("first_only", "false") == "true", options.get("strict", "false") == "true"
        self.wanted: list[tuple[str, datetime.date]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _SIGNS and f.attribute == (self.date,) and isinstance(f.value, datetime.date):
                self.wanted.append((_SIGNS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Member]:
        """One for each member that falls into the dates; only names are looked at."""
        out = []
        for archive in sorted(glob.glob(self.path)):
            try:
                with zipfile.ZipFile(archive) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
            except (zipfile.BadZipFile, OSError):
                if self.strict:
                    raise
                continue
            for n in names[:1] if self.first else names:
                day = date_of(n) or date_of(archive)
                if all(day is not None and _compare(sign, day, value) for sign, value in self.wanted):
                    out.append(Member(archive, n, day))
        return out

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        if part is None:
            return
        with zipfile.ZipFile(part.archive) as z, z.open(part.name) as f:
            rows = csv.reader(io.TextIOWrapper(f, "utf-8", "replace"))
            at = {c.strip().upper(): k for k, c in enumerate(next(rows, []))}
            place = [None if c.name == self.date else at.get(c.name.strip().upper(), -1) for c in kinds]
            held: list[list[str]] = []

            def batch() -> pa.RecordBatch:
                cols = []
                for c, k in zip(kinds, place):
                    if k is None:
                        cols.append(pa.array([part.date] * len(held), c.type))
                        continue
                    cells = [x[k].strip() if 0 <= k < len(x) else "" for x in held]
                    cols.append(pa.array([_cell(v, c.type) for v in cells], c.type))
                return pa.RecordBatch.from_arrays(cols, schema=kinds)

            for x in rows:
                if any(v.strip() for v in x):
                    held.append(x)
                if len(held) >= BATCH:
                    yield batch()
                    held.clear()
            if held:
                yield batch()


def _cell(v: str, kind: pa.DataType):
    if v in ("", "-"):
        return None
    if pa.types.is_string(kind):
        return v
    try:
        return int(v) if pa.types.is_integer(kind) else float(v)
    except ValueError:
        return None


@dataclass
class Rows(InputPartition):
    low: int
    high: int


class SqliteRows(DataSource):
    """Options: path, table, partitions ("8"), snapshot (a shared folder: a consistent copy is taken there first, as a live database may be written to). A database that isn't there has no rows; its schema has to be given then."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> StructType:
        with _opened(self.options["path"]) as db:
            kinds = {"INT": LongType(), "REA": DoubleType(), "FLO": DoubleType(), "DOU": DoubleType()}
            return StructType([StructField(name, kinds.get(str(kind).upper()[:3], StringType())) for _, name, kind, *_ in db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})")])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _opened:
    """A connection that can only read, and that is closed."""

    def __init__(self, path: str):
        self.db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def __enter__(self) -> sqlite3.Connection:
        return self.db

    def __exit__(self, *_: object) -> None:
        self.db.close()


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.table, self.many = schema, options["table"], int(options.get("partitions", "8"))
        self.path, self.snapshot = options["path"], options.get("snapshot")
        self.where: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _SIGNS and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.where.append((f.attribute[0], _SIGNS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Rows]:
        if not os.path.exists(self.path):
            return []
        if self.snapshot:
            os.makedirs(self.snapshot, exist_ok=True)
            copy = os.path.join(self.snapshot, f"{os.path.basename(self.path)}.{os.getpid()}.{id(self)}.db")
            with _opened(self.path) as db:
                to = sqlite3.connect(copy)
                db.backup(to)
                to.close()
            self.path = copy
        with _opened(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.many)
        return [Rows(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        if part is None:
            return
        tests = "".join(f" AND {_quoted(c)} {sign} ?" for c, sign, _ in self.where)
        with _opened(self.path) as db:
            found = db.execute(f"SELECT {', '.join(_quoted(c.name) for c in kinds)} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?{tests}", (part.low, part.high, *(v for *_, v in self.where)))
            while rows := found.fetchmany(BATCH):
                cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([_typed(v, c.type) for v in col], c.type) for col, c in zip(cols, kinds)], schema=kinds)


def _typed(v, kind: pa.DataType):
    """A value of SQLite, which holds any type in any column, as one of the column's; null where it can't be."""
    if v is None or isinstance(v, bytes):
        return None
    if pa.types.is_string(kind):
        return str(v)
    try:
        return int(v) if pa.types.is_integer(kind) else float(v)
    except ValueError:
        return None
