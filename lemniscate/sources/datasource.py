"""Collections of many small files as data sources: ``spark.read.format("formula_pages").load(root)``.

``formula_pages`` gives formula_id, formula, ord of ``<root>/<folder>/Articles/*.html``
(every math element of a page), ``formula_tuples`` gives formula_id and tuples of
``<root>/<folder>/*`` (one formula a file, one tuple a line).  Both also write
rows (folder, file, content), one file a row.  A collection of another layout is
a :class:`Collection` of its own, with its schema, files and rows.

Planning lists folders only.  Each folder is read by ``parts`` tasks, which list
its files and share them by the hash of their names, so a folder may hold most
of the collection.  Filters on formula_id (equal, in, starting with) say which
files can hold a formula; the others are not opened.  Spark applies every filter
again to the rows.

Paths are those of pyarrow's file systems (local, HDFS and the usual object
stores), which the driver and all executors have to reach.

Cases: a root that is missing is an error, a folder without pages is empty; an
empty file has no rows; files whose name starts with a dot are not read; what
isn't UTF-8 is replaced; of rows written under one name the last to be finished
stays; rows without a folder or file are not written, a null content is an empty
file, other columns are ignored; a name with a slash is an error.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from lemniscate.sources.readers import MATH

#: Tasks that read a folder.
PARTS = 4
_MATH = re.compile(MATH, re.ASCII)
_PREFIX = re.compile(r"(</?)(?!mws:qvar)\w+:(?=\w)", re.ASCII)


def _located(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    return system, where.rstrip("/")


def _listed(system: Any, path: str, missing: bool = False) -> list[Any]:
    from pyarrow import fs

    return system.get_file_info(fs.FileSelector(path, allow_not_found=missing))


@dataclass
class Part(InputPartition):
    """Every ``of``-th file of a folder, by the hash of its name."""

    folder: str
    number: int
    of: int


class Collection(DataSource):
    """A collection in folders of files; subclasses say which files those are and what rows they hold."""

    #: Where in a folder the files are, and what their names end with.
    inner, ending = "", ""

    @classmethod
    def formula(cls, name: str) -> str:
        """What the ids of a file's formulas start with."""
        raise NotImplementedError

    @classmethod
    def rows(cls, name: str, content: str) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema: StructType) -> CollectionReader:
        return CollectionReader(type(self), self.options["path"], int(self.options.get("parts", PARTS)))

    def writer(self, schema: StructType, overwrite: bool) -> CollectionWriter:
        if overwrite:
            raise ValueError("files are added to a collection; write with mode append")
        if missing := {"folder", "file", "content"} - {*schema.names}:
            raise ValueError(f"a collection is written from folder, file and content; there is no {', '.join(sorted(missing))}")
        return CollectionWriter(self.options["path"], self.inner)


class CollectionReader(DataSourceReader):
    def __init__(self, collection: type[Collection], path: str, parts: int) -> None:
        self.collection, self.path, self.parts = collection, path, max(1, parts)
        self.asked: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.asked = [f for f in filters if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("formula_id",)]
        # Whether a file holds the formula shows in its rows only.
        return filters

    def partitions(self) -> list[Part]:
        system, where = _located(self.path)
        folders = sorted(x.path for x in _listed(system, where) if not x.is_file)
        return [Part(f, n, self.parts) for f in folders for n in range(self.parts)]

    def wanted(self, name: str) -> bool:
        """Whether the file can hold a formula that all filters ask for."""
        start = self.collection.formula(name)

        def holds(f: Filter) -> bool:
            if isinstance(f, StringStartsWith):
                return start.startswith(f.value) or f.value.startswith(start)
            return any(v is not None and v.startswith(start) for v in (f.value if isinstance(f, In) else [f.value]))

        return all(holds(f) for f in self.asked)

    def names(self, part: Part) -> Iterator[str]:
        """Paths of the files that a task opens."""
        system, _ = _located(self.path)
        for x in _listed(system, part.folder + self.collection.inner, missing=True):
            name = x.base_name
            mine = x.is_file and not name.startswith(".") and name.endswith(self.collection.ending) and zlib.crc32(name.encode()) % part.of == part.number
            if mine and self.wanted(name):
                yield x.path

    def read(self, part: Part) -> Iterator[tuple]:
        system, _ = _located(self.path)
        for path in self.names(part):
            with system.open_input_stream(path) as f:
                content = f.read().decode("utf-8", "replace")
            yield from self.collection.rows(path.rpartition("/")[2], content)


class CollectionWriter(DataSourceWriter):
    """A file appears under its name when it is complete, so a task that runs twice leaves the same files."""

    def __init__(self, path: str, inner: str) -> None:
        self.path, self.inner = path, inner

    def write(self, iterator: Iterator[Any]) -> WriterCommitMessage:
        system, where = _located(self.path)
        made: set[str] = set()
        for row in iterator:
            if row["folder"] is None or row["file"] is None:
                continue
            if any("/" in x or x in ("", ".", "..") for x in (row["folder"], row["file"])):
                raise ValueError(f"not the name of a folder and a file: {row['folder']}, {row['file']}")
            folder = f"{where}/{row['folder']}{self.inner}"
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            unfinished = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(unfinished) as f:
                f.write((row["content"] or "").encode())
            system.move(unfinished, f"{folder}/{row['file']}")
        return WriterCommitMessage()


class FormulaPages(Collection):
    inner, ending = "/Articles", ".html"

    @classmethod
    def name(cls) -> str:
        return "formula_pages"

    def schema(self) -> str:
        return "formula_id string, formula string, ord int"

    @classmethod
    def formula(cls, name: str) -> str:
        stem = name.removesuffix(".html")
        return unicodedata.normalize("NFKD", stem).encode("ascii", "ignore").decode() + ":"

    @classmethod
    def rows(cls, name: str, content: str) -> Iterator[tuple]:
        start = cls.formula(name)
        for n, found in enumerate(_MATH.finditer(content)):
            yield f"{start}{n}", _PREFIX.sub(r"\1", found[0]), n


class FormulaTuples(Collection):
    @classmethod
    def name(cls) -> str:
        return "formula_tuples"

    def schema(self) -> str:
        return "formula_id string, tuples array<string>"

    @classmethod
    def formula(cls, name: str) -> str:
        stem, dot, _ = name.rpartition(".")
        return stem if dot else name

    @classmethod
    def rows(cls, name: str, content: str) -> Iterator[tuple]:
        lines = re.split("\r?\n", content)
        if content:
            yield cls.formula(name), [x for x in lines if x.strip(" ")]


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let it push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FormulaPages, FormulaTuples):
        spark.dataSource.register(source)
