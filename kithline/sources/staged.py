"""Staged feed files as a Spark data source, read at once or as a stream.

A source is {name, type, path}: rss (RSS or Atom files), json ({articles: [{url, title, seendate}]}) or
web (nothing to read); path is a file or a folder of files, on any file system that pyarrow knows.  Files are
decoded in the tasks; topics, texts and times are left to Column functions (see feeds).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from kithline.shipping import ship

FORMAT = "kithline_feeds"
RAW = "source string, type string, source_ordinal int, file string, entry int, title string, url string, body string, published string, error string"
RSS_ENTRIES, FILES_PER_TASK = 30, 64


class Files(InputPartition):
    """Some files of one source; error: why there are none."""

    def __init__(self, ordinal: int, source: dict, files: list[str], error: str | None = None) -> None:
        self.ordinal, self.source, self.files, self.error = ordinal, source, files, error


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(source: dict) -> list[str]:
    """The files of a source in the order of their names, without hidden ones and those of no bytes; OSError if the path is not there."""
    from pyarrow import fs

    system, path = _open(source["path"])
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(source["path"])
    if info.type == fs.FileType.File:
        return [info.path]
    found = system.get_file_info(fs.FileSelector(path))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.size != 0 and not f.base_name.startswith(("_", ".")))


def _rss(stream) -> Iterator[tuple]:
    """(title, url, body, published) of the first entries; an element that holds the full text goes before a summary."""
    count = 0
    for _, item in ElementTree.iterparse(stream):
        local = item.tag.rpartition("}")[2]
        if local not in ("item", "entry"):
            continue
        own: dict[str, str] = {}
        for child in item:
            key = child.tag.rpartition("}")[2]
            value = child.get("href") if key == "link" and child.get("href") else "".join(child.itertext())
            own.setdefault(key, value.strip())
        first = lambda *keys: next((own[k] for k in keys if own.get(k)), None)
        yield own.get("title"), own.get("link"), first("encoded", "content", "description", "summary"), first("pubDate", "published", "updated", "date")
        item.clear()
        count += 1
        if count == RSS_ENTRIES:
            return


def _json(stream) -> Iterator[tuple]:
    found = json.load(stream)
    for a in (found.get("articles") if isinstance(found, dict) else None) or []:
        text = lambda k, a=a: a[k] if isinstance(a.get(k), str) else None
        yield text("title"), text("url"), None, text("seendate")


DECODERS = {"rss": _rss, "json": _json}


def decoded(part: Files) -> Iterator[tuple]:
    """The entries of a partition's files.  What goes wrong is a row with the error; entries before it stay."""
    source = part.source
    head = (source["name"], source["type"], part.ordinal)
    if part.error is not None:
        yield (*head, None, None, None, None, None, None, part.error)
    for file in part.files:
        try:
            system, _ = _open(source["path"])
            with system.open_input_stream(file) as stream:
                for i, (title, url, body, published) in enumerate(DECODERS[source["type"]](stream)):
                    yield (*head, file, i, title, url, body, published, None)
        except (OSError, ValueError, ElementTree.ParseError) as e:
            yield (*head, file, None, None, None, None, None, f"{type(e).__name__}: {e}")


def _tasks(ordinal: int, source: dict, files: list[str]) -> list[Files]:
    return [Files(ordinal, source, files[i:i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)]


class _Batch(DataSourceReader):
    def __init__(self, sources: list[dict]) -> None:
        self.sources = sources

    def partitions(self) -> list[Files]:
        out = []
        for i, s in enumerate(self.sources):
            if s["type"] == "web":
                continue
            if s["type"] not in DECODERS:
                out.append(Files(i, s, [], f"ValueError: unknown type {s['type']}"))
                continue
            try:
                out += _tasks(i, s, listed(s))
            except OSError as e:
                out.append(Files(i, s, [], f"{type(e).__name__}: {e}"))
        return out or [Files(-1, {"name": "", "type": "web", "path": ""}, [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return decoded(partition)


class _Stream(DataSourceStreamReader):
    """The offset is the last file of each source, by name."""

    def __init__(self, sources: list[dict]) -> None:
        self.sources = {s["name"]: (i, s) for i, s in enumerate(sources) if s["type"] in DECODERS}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for name, (_, s) in self.sources.items():
            try:
                files = listed(s)
            except OSError:  # not staged yet
                continue
            if files:
                out[name] = files[-1]
        return out

    def partitions(self, start: dict, end: dict) -> list[Files]:
        out = []
        for name, last in end.items():
            if name in self.sources and start.get(name) != last:
                i, s = self.sources[name]
                out += _tasks(i, s, [f for f in listed(s) if start.get(name, "") < f <= last])
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        return decoded(partition)


class StagedFeeds(DataSource):
    """spark.read.format("kithline_feeds").option("sources", json of [{name, type, path}])

    Names of sources are distinct.  As a stream, a file is read once, when it is listed behind the files read
    before: names must ascend with time, and a file must be whole when it gets its name.  Of a source that is
    not there yet a stream reads nothing, a batch gives a row with the error.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RAW

    def _sources(self) -> list[dict]:
        found = json.loads(self.options.get("sources", "[]"))
        if len({s["name"] for s in found}) < len(found):
            raise ValueError("names of sources are not distinct")
        return found

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._sources())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self._sources())


def raw_entries(spark: SparkSession, sources: list[dict], stream: bool = False) -> DataFrame:
    """The entries of all sources as they are staged (see RAW), and rows with an error where one could not be read."""
    ship(spark)
    spark.dataSource.register(StagedFeeds)
    read = spark.readStream if stream else spark.read
    return read.format(FORMAT).option("sources", json.dumps(sources)).load()
