"""Notes as a data source: one file per note under its own path, in folders of kind and state.

``spark.read.format("notes").load(root)`` gives a corpus (path, kind, folder_state, text), path relative to root;
``corpus.write.format("notes").mode("append").save(root)`` writes it back under the same paths, so links between
notes still resolve. A filter on kind, folder_state or path decides from the paths alone which files
are read at all. The driver lists paths, as Spark does for any file source; texts are read in the executors,
FILES of them a partition, each file of a task by itself.

root is a path or an address of a file system that pyarrow knows. Writing is idempotent: a task writes each note
beside its place and renames it there, so a task that runs again ends in the same files; a job that fails
takes back what its finished tasks have written. Paths that lead out of root are refused. Null text is an empty file.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from trailnote.sources.templates import KINDS, STATES

#: Notes that one partition reads.
FILES = 1000
_SCHEMA = "path string, kind string, folder_state string, text string"


def _opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def located(path: str) -> tuple[str, str | None]:
    """(kind, state) of a note's path: the plain form of what notes.located tells of a column."""
    plain = re.sub(r"(^|/)(?:kind|state)=", r"\1", path)
    kind = next((k for _, k, folder in KINDS if re.search(rf"(?:^|/){folder}/", plain)), None)
    if kind is None and re.search(r"(?:^|/)learning/", plain):
        name = re.search(r"([^/]+)\.\w+$", plain)
        kind = "learning_" + (name[1].replace("-", "_") if name else "")
    state = re.search(rf"/({'|'.join(STATES)})/", plain)
    return kind or "other", state[1] if state else None


@dataclass
class _Slice(InputPartition):
    """Paths of one folder of kind and state."""

    kind: str
    state: str | None
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root, self.wanted = root, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what paths can tell: equality, membership and beginnings of path, kind and folder_state."""
        for f in filters:
            column = getattr(f, "attribute", ("",))
            known = len(column) == 1 and column[0] in ("path", "kind", "folder_state")
            if known and isinstance(f, (EqualTo, EqualNullSafe)):
                self.wanted.append((column[0], lambda v, x=f.value: v is not None and v == x))
            elif known and isinstance(f, In):
                self.wanted.append((column[0], lambda v, x=frozenset(f.value): v is not None and v in x))
            elif known and isinstance(f, StringStartsWith):
                self.wanted.append((column[0], lambda v, x=f.value: v is not None and v.startswith(x)))
            elif known and isinstance(f, IsNotNull):
                self.wanted.append((column[0], lambda v: v is not None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, base = _opened(self.root)
        groups: dict[tuple[str, str | None], list[str]] = {}
        for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
            path = posixpath.relpath(info.path, base)
            if info.type != fs.FileType.File or not path.endswith((".md", ".txt")) or any(p.startswith(("_", ".")) for p in path.split("/")):
                continue
            kind, state = located(path)
            told = {"path": path, "kind": kind, "folder_state": state}
            if all(ok(told[c]) for c, ok in self.wanted):
                groups.setdefault((kind, state), []).append(path)
        found = [_Slice(kind, state, sorted(paths)[i : i + FILES]) for (kind, state), paths in sorted(groups.items(), key=str) for i in range(0, len(paths), FILES)]
        # Spark asks an empty list of partitions to be read as one of its own.
        return found or [_Slice("other", None, [])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        files, base = _opened(self.root)
        for path in partition.paths:
            with files.open_input_stream(f"{base}/{path}") as stream:
                yield path, partition.kind, partition.state, stream.read().decode("utf-8", "replace")


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, root: str, names: list[str], overwrite: bool) -> None:
        self.root, self.names, self.overwrite = root, names, overwrite

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, base = _opened(self.root)
        path_at, text_at, done, made = self.names.index("path"), self.names.index("text"), [], set()
        for row in iterator:
            path = row[path_at]
            if not path or path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"not a path below the root: {path!r}")
            folder = posixpath.dirname(f"{base}/{path}")
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            beside = f"{folder}/.{posixpath.basename(path)}.{uuid.uuid4().hex}"
            with files.open_output_stream(beside) as stream:
                stream.write((row[text_at] or "").encode())
            files.move(beside, f"{base}/{path}")
            done.append(path)
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = _opened(self.root)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = _opened(self.root)
        for message in messages:
            for path in message.paths if message else ():
                files.delete_file(f"{base}/{path}")


class NoteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("notes are appended; a note of the same path is replaced")
        return _Writer(self.options["path"], schema.fieldNames(), overwrite)


def register_notes(spark: SparkSession) -> None:
    """Makes the format "notes" known to the session and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NoteFiles)


def read_note_files(spark: SparkSession, root: str) -> DataFrame:
    register_notes(spark)
    return spark.read.format("notes").load(root)


def write_note_files(notes: DataFrame, root: str) -> None:
    """notes (path, text, ...) as files below root; the paths stay what they are."""
    register_notes(notes.sparkSession)
    notes.select("path", "text").write.format("notes").mode("append").save(root)
