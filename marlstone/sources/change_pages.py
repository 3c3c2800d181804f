"""A paged change feed as a Spark data source: batch and stream, with the cursor as stream offset."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq bigint, page_no bigint, partition_key string, external_id string, provider_revision string, operation string, policy_id string, ordinal bigint"
_ARROW = {name: {"bigint": "int64"}.get(kind, kind) for name, kind in map(str.split, SCHEMA.split(", "))}
_STORED = ["seq", "page_no", "ref", "operation", "policy_id", "provider_order"]
#: Before the first page; a row without a page number is taken in from here, ahead of all numbered pages.
_START = -(1 << 63)
#: Bytes of the columns read that a task takes: a share of all of them within these bounds, in whole row groups.
_LEAST, _MOST, _SHARES = 1 << 20, 1 << 25, 64
#: A row group of more rows is dealt to up to _CUTS tasks, each reading it up to the end of its own rows.
_CUT_ROWS, _CUTS = 1 << 18, 4


class _Group(NamedTuple):
    """Rows of a row group: its least and greatest page, None where its footer doesn't tell them, and the bytes of the columns read."""

    fragment: object
    rows: tuple[int, int]
    pages: tuple[int, int] | None
    size: int

    def meets(self, low: int, high: int) -> bool:
        return self.pages is None or self.pages[0] < high and low <= self.pages[1]


def _groups(dataset) -> list[_Group]:
    """The row groups of a dataset in the files' order. Only footers are read."""
    found = []
    for fragment in dataset.get_fragments():
        for n in range(fragment.metadata.num_row_groups):
            group, pages, size = fragment.metadata.row_group(n), None, 0
            for column in map(group.column, range(group.num_columns)):
                if column.path_in_schema.split(".")[0] in _STORED:
                    size += column.total_compressed_size
                s = column.statistics if column.path_in_schema == "page_no" else None
                if s is not None and s.has_null_count and s.null_count == group.num_rows:
                    pages = _START, _START
                elif s is not None and s.has_null_count and s.has_min_max:
                    pages = _START if s.null_count else s.min, s.max
            if group.num_rows:
                found.append(_Group(fragment.subset(row_group_ids=[n]), (0, group.num_rows), pages, size))
    return found


def _end(path: str) -> int:
    """The offset after all pages there are. The page column is read only where footers don't bound it."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    end = _START
    for group in _groups(ds.dataset(path)):
        last = group.pages[1] if group.pages else pc.max(group.fragment.to_table(columns=["page_no"])["page_no"]).as_py()
        end = max(end, _START + 1 if last is None else last + 1)
    return end


def _cut(group: _Group) -> list[_Group]:
    """A large row group in parts of about as many rows each."""
    high = group.rows[1]
    n = min(max(high // _CUT_ROWS, 1), _CUTS)
    return [group._replace(rows=(high * i // n, high * (i + 1) // n), size=group.size if n == 1 else _MOST) for i in range(n)]


def _shares(groups: list[_Group], per_task: int | None) -> list[list[_Group]]:
    """Row groups by task, by their bytes; with ``per_task`` also one task for so many pages, row groups staying whole."""
    most = min(max(sum(g.size for g in groups) // _SHARES, _LEAST), _MOST)
    shares: list[list[_Group]] = []
    used = held = 0
    for group in groups:
        pages = group.pages[1] - group.pages[0] + 1 if group.pages else 0
        if not shares or used + group.size > most or per_task and held + pages > per_task:
            shares.append([])
            used = held = 0
        shares[-1].append(group)
        used, held = used + group.size, held + pages
    return shares


def _partitions(path: str, per_task: int | None, low: int | None = None, high: int | None = None) -> list[InputPartition]:
    """Tasks over the row groups that hold pages low..high - 1, or over all of them."""
    import pyarrow.dataset as ds

    dataset = ds.dataset(path)
    shares = _shares([part for g in _groups(dataset) if low is None or g.meets(low, high) for part in _cut(g)], per_task)
    return [InputPartition((low, high, dataset.schema, [(g.fragment, *g.rows) for g in share])) for share in shares or [[]]]


def _batches(low: int | None, high: int | None, schema, parts: list[tuple]) -> Iterator:
    """Changes of the pages low..high - 1, or all, as record batches. ``parts``: row group, first row, row after the last."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for fragment, begin, end in parts:
        at = 0
        for whole in fragment.to_batches(schema=schema, columns=_STORED, batch_size=1 << 14, batch_readahead=2, use_threads=False):
            b = whole.slice(max(begin - at, 0), max(min(end - at, whole.num_rows) - max(begin - at, 0), 0))
            at += whole.num_rows
            if low is not None:
                page = b["page_no"]
                wanted = pc.and_(pc.greater_equal(page, low), pc.less(page, high))
                b = b.filter(pc.fill_null(wanted, low == _START))
            if b.num_rows:
                ref = [pc.struct_field(b["ref"], name) for name in ("partition_key", "external_id", "provider_revision")]
                columns = [b["seq"], b["page_no"], *ref, b["operation"], b["policy_id"], pc.struct_field(b["provider_order"], "ordinal")]
                yield pa.RecordBatch.from_arrays([c.cast(kind) for c, kind in zip(columns, _ARROW.values(), strict=True)], names=list(_ARROW))
            if at >= end:
                break


class _Pages(DataSourceReader):
    def __init__(self, path: str, per_task: int | None):
        self.path, self.per_task = path, per_task

    def partitions(self):
        return _partitions(self.path, self.per_task)

    def read(self, partition) -> Iterator:
        return _batches(*partition.value)


class _Stream(DataSourceStreamReader):
    """The offset is the number before which all pages are taken in; tasks read the row groups that hold theirs."""

    def __init__(self, path: str, per_task: int | None):
        self.path, self.per_task = path, per_task

    def initialOffset(self) -> dict:
        return {"page": _START}

    def latestOffset(self) -> dict:
        return {"page": _end(self.path)}

    def partitions(self, start: dict, end: dict):
        return _partitions(self.path, self.per_task, start["page"], end["page"])

    def read(self, partition) -> Iterator:
        return _batches(*partition.value)

    def commit(self, end: dict) -> None:
        """Nothing to release: pages stay with the provider."""


class ChangePages(DataSource):
    """``spark.read.format("change_pages").option("path", ...)``, and ``readStream`` alike; option ``pages_per_task``."""

    @classmethod
    def name(cls) -> str:
        return "change_pages"

    def schema(self) -> str:
        return SCHEMA

    def _per_task(self) -> int | None:
        pages = self.options.get("pages_per_task")
        return pages and int(pages)

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options["path"], self._per_task())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self._per_task())


def register(spark: SparkSession) -> None:
    """Makes the format known. Its code is sent by value, as the planner's Python does not see files sent along."""
    register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ChangePages)


class ProviderError(Exception):
    """``kind``: throttled, transient, not_found, denied, invalid or permanent."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message)
        self.kind = kind


def with_retries(call: Callable, attempts: int = 4, wait: Callable[[float], None] | None = None):
    """Repeats throttled and transient calls with doubled waits; other errors pass at once."""
    import time

    for n in range(attempts):
        try:
            return call()
        except ProviderError as e:
            if e.kind not in ("throttled", "transient") or n == attempts - 1:
                raise
            (wait or time.sleep)(0.5 * 2**n)
