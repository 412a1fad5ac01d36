"""Documents and replies in files, as Spark data sources.

``document_source`` gives a batch source: a partition for each file, what the parser finds in it in the order structure, text,
figures, tables, and a row with the error for a file that it cannot read. ``ReplySource`` gives a stream of replies, one file
each, with the last file's name as its offset. Files are reached by path or by any address that Arrow's file systems know.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quire.sources.extract import stream_reply

#: The order in which a document's parts come.
PARTS = ("structure", "text", "figure", "table")
DOCUMENT = "path string, ordinal int, kind string, page int, content string, error string"
REPLY = "name string, body string"


def _listed(path: str) -> list[str]:
    """All files at or below ``path``, by name; hidden ones and those that a writer has not finished are left out."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return []
    found = system.get_file_info(fs.FileSelector(at, recursive=True)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
    below = lambda f: f.path[len(at) :].strip("/").split("/")
    return sorted(f.path for f in found if f.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in below(f)))


def _content(root: str, path: str) -> bytes:
    from pyarrow import fs

    system = fs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else fs.LocalFileSystem()
    with system.open_input_stream(path) as f:
        return f.read()


@dataclass
class OneFile(InputPartition):
    path: str


def document_source(parse: Callable[[str, bytes], Iterator[dict]], short_name: str = "document_files") -> type[DataSource]:
    """A data source to register; ``parse(path, bytes)`` yields rows with kind (see PARTS), page and content, in any order."""

    class Reader(DataSourceReader):
        def __init__(self, root: str):
            self.root = root

        def partitions(self) -> list[InputPartition]:
            return [OneFile(p) for p in _listed(self.root)]

        def read(self, partition: OneFile | None) -> Iterator[tuple]:
            if partition is None:  # no files
                return
            try:
                rows = sorted(parse(partition.path, _content(self.root, partition.path)), key=lambda r: (PARTS.index(r["kind"]), r["page"]))
            except Exception as e:  # a bad file is a row, not a failed job
                yield partition.path, 0, None, None, None, f"{type(e).__name__}: {e}"
                return
            for n, r in enumerate(rows):
                yield partition.path, n, r["kind"], r["page"], r["content"], None

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return DOCUMENT

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["path"])

    return Documents


class ReplySource(DataSource):
    """A stream of name and body of reply files; the names of later replies must be greater than those of earlier ones."""

    @classmethod
    def name(cls) -> str:
        return "reply_files"

    def schema(self) -> str:
        return REPLY

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Replies(self.options["path"])


class _Replies(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {"name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"name": max(_listed(self.root), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [OneFile(p) for p in _listed(self.root) if start["name"] < p <= end["name"]]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        yield partition.path.rpartition("/")[2], _content(self.root, partition.path).decode("utf-8", "replace")


def reply_text(body: Column) -> Column:
    """The text of a reply: of an event stream its content deltas, of a plain JSON reply its first choice; null where neither has any."""
    whole = F.when(F.try_parse_json(body).isNotNull(), F.get_json_object(body, "$.choices[0].message.content"))
    return F.coalesce(whole, F.nullif(stream_reply(body), F.lit("")))
