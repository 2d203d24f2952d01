"""Saved pages of a source as a data source of Spark: ``spark.read.format("listings")`` and ``spark.readStream.format("listings")``.

A folder holds sitemaps (``sitemaps/*.xml``, named so that later ones sort
later) and saved pages (``pages/``, a file for each address: the SHA-1 of the
address with ``.html`` or ``.html.gz``). A sitemap is a partition: the driver
sees the names of sitemaps only, tasks read the addresses. Years and addresses
are asked for by options, so a page that is not wanted is never opened. As a
stream, the offset is the name of the last sitemap that was read.

Filters are not pushed down by Spark: this version (4.1) keeps the filters that
were pushed for one query of a DataFrame for the next query of the same one,
which then misses rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "sitemap string, place int, url string, year int, html string"
LOCATION = re.compile(r"<loc>([^<]+)</loc>")
#: Without the option ``year``: a year of four digits in the address, the last one if there are several.
YEAR = r"^(?:.*\D)?((?:19|20)\d\d)(?!\d)"


@dataclass
class Sitemap(InputPartition):
    """A stored sitemap by its name."""

    name: str


def _files(path: str):
    """The file system of a path, local or by any URI that Arrow knows, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9+.-]+://", path) else (fs.LocalFileSystem(), path)


def sitemaps(path: str) -> list[str]:
    """The names of a folder's sitemaps in order."""
    from pyarrow import fs

    files, at = _files(path)
    found = files.get_file_info(fs.FileSelector(f"{at}/sitemaps", allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".xml"))


def page_name(url: str) -> str:
    return hashlib.sha1(url.encode()).hexdigest()


def read_page(path: str, url: str) -> str | None:
    """A saved page; null if there is none."""
    files, at = _files(path)
    for ending in (".html", ".html.gz"):
        name = f"{at}/pages/{page_name(url)}{ending}"
        if files.get_file_info(name).is_file:
            with files.open_input_file(name) as f:
                data = f.read()
            return (gzip.decompress(data) if ending.endswith("gz") else data).decode("utf-8", "replace")
    return None


class _Reading:
    """What batch and stream have in common: the options, and the rows of a sitemap."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("listings need a path")
        self.path, self.year = options["path"].rstrip("/"), re.compile(options.get("year", YEAR))
        self.since, self.until = (int(options[x]) if x in options else None for x in ("since", "until"))
        self.starts = options.get("starts", "")

    def rows(self, part: Sitemap | None) -> Iterator[tuple]:
        if part is None:  # what Spark asks for if there are no partitions
            return
        files, at = _files(self.path)
        with files.open_input_file(f"{at}/sitemaps/{part.name}") as f:
            xml = f.read().decode("utf-8", "replace")
        for place, url in enumerate(u.strip() for u in LOCATION.findall(xml)):
            m = self.year.search(url)
            year = int(m[1]) if m else None
            early = year is not None and self.since is not None and year < self.since
            late = year is not None and self.until is not None and year > self.until
            if not early and not late and url.startswith(self.starts):
                yield part.name, place, url, year, read_page(self.path, url)


class ListingReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Sitemap]:
        return [Sitemap(n) for n in sitemaps(self.path)]

    def read(self, partition: Sitemap) -> Iterator[tuple]:
        return self.rows(partition)


class ListingStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max(sitemaps(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[Sitemap]:
        return [Sitemap(n) for n in sitemaps(self.path) if start["after"] < n <= end["after"]]

    def read(self, partition: Sitemap) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Listings(DataSource):
    """Rows of :data:`SCHEMA`: an address of a sitemap, its place there from 0, its year, and the saved page.

    ``year`` is null if the address has none, ``html`` if no page was saved.
    Options: ``path``; ``year``, a pattern whose first group is an address's
    year; ``since`` and ``until``, the first and last year of interest, with
    those addresses that have none; ``starts``, what addresses begin with. Repeated addresses give repeated rows; a folder without sitemaps
    gives none; a sitemap that is no XML has no addresses.
    """

    @classmethod
    def name(cls) -> str:
        return "listings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> ListingStream:  # noqa: N802
        return ListingStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Listings)
