"""Texts of millions of documents in a bounded number of files, as a Spark data source.

Every task writes one bundle, its documents' texts one after another, and beside it an index of where each begins. What the
tasks report becomes the manifest, which is put in place last: a reader sees the bundles that a manifest names and no others, so
a write that fails leaves nothing to be seen, and an overwrite shows either the old documents or the new ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "document_id string, text string"
MANIFEST = "manifest.json"


def _system(path: str):
    """The file system of ``path`` and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Bundle(WriterCommitMessage, InputPartition):
    """A file of documents whose ids lie between ``first`` and ``last``."""

    name: str
    documents: int
    size: int
    first: str
    last: str


def manifest(path: str) -> list[Bundle]:
    """The bundles at ``path``; none before the first write."""
    from pyarrow import fs

    system, at = _system(path)
    if system.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(f"{at}/{MANIFEST}") as f:
        return [Bundle(**b) for b in json.loads(f.read())]


def _removed(system, files: list[str]) -> None:
    from pyarrow import fs

    for f in files:
        if system.get_file_info(f).type != fs.FileType.NotFound:
            system.delete_file(f)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> Bundle:
        system, at = _system(self.path)
        system.create_dir(at, recursive=True)
        name, n, end, ids = f"part-{uuid.uuid4().hex}", 0, 0, ["", ""]
        try:
            with system.open_output_stream(f"{at}/{name}.txt") as texts, system.open_output_stream(f"{at}/{name}.idx") as index:
                for row in iterator:
                    key, text = row["document_id"] or "", (row["text"] or "").encode()
                    texts.write(text)
                    index.write((json.dumps([key, end, len(text)]) + "\n").encode())
                    ids = [key if not n else min(ids[0], key), max(ids[1], key)]
                    n, end = n + 1, end + len(text)
        except BaseException:
            _removed(system, [f"{at}/{name}.txt", f"{at}/{name}.idx"])
            raise
        if not n:
            _removed(system, [f"{at}/{name}.txt", f"{at}/{name}.idx"])
        return Bundle(name, n, end, *ids)

    def commit(self, messages: list[Bundle | None]) -> None:
        system, at = _system(self.path)
        system.create_dir(at, recursive=True)
        old = manifest(self.path)
        kept = sorted([*([] if self.overwrite else old), *(m for m in messages if m and m.documents)], key=lambda b: (b.first, b.name))
        with system.open_output_stream(f"{at}/_{MANIFEST}") as f:
            f.write(json.dumps([asdict(b) for b in kept]).encode())
        system.move(f"{at}/_{MANIFEST}", f"{at}/{MANIFEST}")
        if self.overwrite:
            self._remove(old)

    def abort(self, messages: list[Bundle | None]) -> None:
        self._remove([m for m in messages if m])

    def _remove(self, bundles: list[Bundle]) -> None:
        system, at = _system(self.path)
        _removed(system, [f"{at}/{b.name}{kind}" for b in bundles for kind in (".txt", ".idx")])


def _documents(path: str, bundle: Bundle, wanted: str | None = None) -> Iterator[tuple[str, str]]:
    system, at = _system(path)
    with system.open_input_stream(f"{at}/{bundle.name}.idx") as f:
        places = [json.loads(line) for line in f.read().splitlines()]
    with system.open_input_file(f"{at}/{bundle.name}.txt") as f:
        for key, start, length in places:
            if wanted is None or key == wanted:
                f.seek(start)
                yield key, f.read(length).decode()


def lookup(path: str, document_id: str) -> list[str]:
    """The texts of one document: only the bundles whose ids enclose it are opened, and only its bytes are read."""
    return [t for b in manifest(path) if b.first <= document_id <= b.last for _, t in _documents(path, b, document_id)]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return list(manifest(self.path))

    def read(self, partition: Bundle | None) -> Iterator[tuple[str, str]]:
        if partition is not None:
            yield from _documents(self.path, partition)


class DocumentBundles(DataSource):
    """document_id and text; null ids and texts are written as empty ones."""

    @classmethod
    def name(cls) -> str:
        return "document_bundles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def write_documents(df: DataFrame, column: str, path: str, files: int = 200, mode: str = "overwrite") -> None:
    """Write document_id and ``column`` in at most ``files`` bundles, by ranges of document_id, so that a look-up opens few."""
    df.sparkSession.dataSource.register(DocumentBundles)
    rows = df.selectExpr("document_id", f"`{column}` AS text").repartitionByRange(files, "document_id").sortWithinPartitions("document_id")
    rows.write.format("document_bundles").option("path", path).mode(mode).save()
