"""Managed tables with versions, and refreshing them from sources: all or nothing, and the same again gives the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.changes import upsert
from tessella.operators.constraints import unique_violations

from .formats import SourceDef, read_source


class Conflict(RuntimeError):
    """Another writer was first; nothing was changed."""


class VersionedTable:
    """A folder of Parquet parts and, for each version, a manifest that lists the parts it consists of.

    A write puts its rows into a part of its own, whose name no other writer has; then it claims the next version, which is one exclusive create, so that
    of several writers from one version one gets it and the others raise Conflict; then its manifest appears, by a rename. Readers see whole versions only,
    and a write that fails leaves the table as it was. A writer that dies between claim and manifest blocks further writes until recover().
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """The current version; 0 if there is none."""
        return max((int(x) for x in self._names("_manifests") if x.isdigit()), default=0)

    def parts(self, version: int | None = None) -> list[str]:
        """The parts of a version."""
        n = self.version() if version is None else version
        if not n:
            return []
        stream = self._fs.open(self._path(f"{self.path}/_manifests/{n}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        parts = self.parts(version)
        if not parts:
            raise ValueError(f"{self.path} has no version")
        return self.spark.read.parquet(*[f"{self.path}/parts/{p}" for p in parts])

    def write(self, df: DataFrame, base: int | None = None) -> int:
        """df as the next version after base (the version that df was made from; the current one by default)."""
        return self._commit(df, [], self.version() if base is None else base)

    def append(self, df: DataFrame, base: int | None = None) -> int:
        """The rows of base and those of df, of which only the latter are written."""
        base = self.version() if base is None else base
        return self._commit(df, self.parts(base), base)

    def _commit(self, df: DataFrame, had: list[str], base: int) -> int:
        own, n = uuid.uuid4().hex, base + 1
        try:
            df.write.parquet(f"{self.path}/parts/{own}")
            try:
                self._fs.create(self._path(f"{self.path}/_claims/{n}"), False).close()  # exclusive
            except Exception as e:
                raise Conflict(f"{self.path}: version {n} is another writer's") from e
        except Exception:
            self._fs.delete(self._path(f"{self.path}/parts/{own}"), True)
            raise
        to = self._path(f"{self.path}/_manifests/.{own}")
        out = self._fs.create(to, False)
        out.write("\n".join([*had, own]).encode())
        out.close()
        self._fs.rename(to, self._path(f"{self.path}/_manifests/{n}"))
        return n

    def recover(self) -> None:
        """Give claims without a manifest free again. Only for tables that nobody writes at the moment."""
        done = set(self._names("_manifests"))
        for n in self._names("_claims"):
            if n not in done:
                self._fs.delete(self._path(f"{self.path}/_claims/{n}"), False)

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)

    def collect_garbage(self, keep: int = 2) -> None:
        """Delete versions but the last `keep`, and the parts that only they had. Parts that no version has may be a running writer's and stay."""
        versions = sorted(int(x) for x in self._names("_manifests") if x.isdigit())
        live = {p for n in versions[-keep:] for p in self.parts(n)}
        for n in versions[:-keep]:
            for p in set(self.parts(n)) - live:
                self._fs.delete(self._path(f"{self.path}/parts/{p}"), True)
            self._fs.delete(self._path(f"{self.path}/_manifests/{n}"), False)


def _upserted(table: VersionedTable, rows: DataFrame, source: SourceDef) -> int:
    if unique_violations(rows, [source.key]).head(1):
        raise ValueError(f"{source.name}: a key comes twice")
    base = table.version()
    return table.write(upsert(table.read(base), rows, source.key) if base else rows, base)


def refresh(table: VersionedTable, source: SourceDef, path: str) -> int:
    """Upsert a source's rows by key into a table. A cell that does not fit, or a key that comes twice, aborts it all. Rows gone from the source stay."""
    return _upserted(table, read_source(table.spark, source, path), source)


def pages(fetch: Callable[[str], dict], first: str, next_url: Callable[[dict], str | None], max_pages: int = 1000, max_bytes: int = 512 << 20) -> Iterator[dict]:
    """Pages of a paginated source, from a driver-side fetch that gives {"url", "body", ...}. A loop, too many pages or too many bytes raise."""
    seen, url, total = set(), first, 0
    while url:
        if url in seen:
            raise ValueError(f"page {url} comes twice")
        if len(seen) >= max_pages:
            raise ValueError(f"more than {max_pages} pages")
        seen.add(url)
        page = fetch(url)
        total += len(page["body"])
        if total > max_bytes:
            raise ValueError(f"more than {max_bytes} bytes")
        yield page
        after = next_url(page)
        url = urljoin(url, after) if after else None


def next_json(path: str) -> Callable[[dict], str | None]:
    """The next page's address at a dotted path of the body."""
    import json

    def find(page: dict) -> str | None:
        at = json.loads(page["body"])
        for p in path.split("."):
            at = at.get(p) if isinstance(at, dict) else None
        return at or None

    return find


def next_link(page: dict) -> str | None:
    """The next page's address in a Link header."""
    for part in page.get("link", "").split(","):
        address, _, rest = part.partition(";")
        if 'rel="next"' in rest:
            return address.strip().strip("<>")
    return None


def cursor_json(path: str, param: str, base: str) -> Callable[[dict], str | None]:
    """The next page's address from a cursor in the body."""
    from urllib.parse import quote

    found = next_json(path)
    return lambda page: f"{base}{'&' if '?' in base else '?'}{param}={quote(str(c), safe='')}" if (c := found(page)) else None


def refresh_pages(table: VersionedTable, source: SourceDef, bodies: Iterator[dict], folder: str) -> int:
    """Refresh from fetched pages: each body goes, as it comes, into a file of a folder that executors share; then through the same reader."""
    spark = table.spark
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for i, page in enumerate(bodies):  # one page at a time is on the driver
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/page-{i:06d}"), False)
        out.write(page["body"].encode() if isinstance(page["body"], str) else page["body"])
        out.close()
    return refresh(table, source, folder)
