"""Landed pages of the vendors' interfaces as a Spark source, batch and stream.

A fetcher lands the pages that it gets from a provider as ``<folder>/<provider>/000000001.json``
and so on.  A page is a JSON object with ``tenant_id``, ``fetched_at``, ``payload`` (what the vendor
sent), ``cursor`` (what the page was asked for with, null for the first) and ``next_cursor``.
Pages are read in order, whatever the order they land in: a page that has not landed
yet ends what can be read for now, and one that was not asked for with what the page before it gave is
an error.

    spark.dataSource.register(pages.VendorPages)
    spark.read.format("vendor_pages").option("path", folder).load()
    spark.readStream.format("vendor_pages").option("path", folder).load()

A stream's offset is how many pages of each provider were read.  It lies in the query's
checkpoint, so each page is read once, restarts included.  The driver lists file names only; tasks read
the pages, a run of them each.  Any folder that pyarrow's file systems open will do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from convoy import schema

#: Pages that one task reads.
TASK_PAGES = 64


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def file_name(number: int) -> str:
    return f"{number:09d}.json"


def landed(folder: str) -> dict[str, int]:
    """How many pages of each provider can be read: all up to the first that is missing."""
    from pyarrow import fs

    store, path = _store(folder)
    out = {}
    for place in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if place.type == fs.FileType.Directory:
            names, n = {f.base_name for f in store.get_file_info(fs.FileSelector(place.path))}, 0
            while file_name(n + 1) in names:
                n += 1
            out[place.base_name] = n
    return out


@dataclass
class Pages(InputPartition):
    """A run of a provider's pages, by number; the last one included."""

    provider: str
    first: int
    last: int


def runs(start: dict[str, int], end: dict[str, int]) -> list[Pages]:
    return [Pages(p, k + 1, min(k + TASK_PAGES, n)) for p, n in sorted(end.items()) for k in range(start.get(p, 0), n, TASK_PAGES)]


def records(folder: str, part: Pages) -> Iterator[tuple]:
    from datetime import UTC, datetime

    store, path = _store(folder)

    def page(number: int) -> dict:
        with store.open_input_stream(f"{path}/{part.provider}/{file_name(number)}") as f:
            return json.loads(f.read())

    due = page(part.first - 1).get("next_cursor") if part.first > 1 else None
    for number in range(part.first, part.last + 1):
        found = page(number)
        if found.get("cursor") != due:
            raise ValueError(f"page {number} of {part.provider} was asked for with {found.get('cursor')!r}, not with {due!r}")
        due, at = found.get("next_cursor"), found.get("fetched_at")
        when = datetime.fromisoformat(at) if at else None
        yield found.get("tenant_id"), part.provider, when if when is None or when.tzinfo else when.replace(tzinfo=UTC), json.dumps(found.get("payload"))


class VendorPages(DataSource):
    """Raw records (see ``schema.RAW``), one for each landed page."""

    @classmethod
    def name(cls) -> str:
        return "vendor_pages"

    def schema(self) -> StructType:
        return schema.RAW

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["path"])


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Pages]:
        return runs({}, landed(self.folder))

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        return iter(()) if partition is None else records(self.folder, partition)  # None: there are no partitions


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return landed(self.folder)

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return runs(start, end)

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        return iter(()) if partition is None else records(self.folder, partition)  # None: there are no partitions
