"""Configuration in YAML as Spark tables: `spark.read.format("outlets_yaml")` and `spark.read.format("gazetteer_yaml")`.

`register(spark)` makes both formats known to a session. Each file is a split of its own, read and parsed by an executor. An entry that is no good
is a row too, with `problem` saying why and the other columns null, so that one slip loses neither the file nor itself. Scalars are text, as
written: `no` is a country, not a truth value; only `null`, `~` and nothing are null.

The data sources read paths that Arrow can open. `parse_text` does the same for the texts of files from any store that Spark reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from newslens.schemas import GAZETTEER_ROW, OUTLET

# Top entries of the two kinds of file.
SOURCES, KINDS = "sources", ("countries", "companies", "keywords")

Rows = Iterator[tuple]


def _loaded(text: str) -> object:
    """The document, with every scalar as text but for null."""
    try:
        import yaml
    except ImportError as missing:
        raise ImportError("YAML files need the package PyYAML; JSON files do not") from missing

    class Texts(yaml.SafeLoader):
        yaml_implicit_resolvers = {
            first: [(tag, form) for tag, form in known if tag.endswith((":null", ":merge"))] for first, known in yaml.SafeLoader.yaml_implicit_resolvers.items()
        }

    try:
        return yaml.load(text, Texts)  # noqa: S506 (a safe loader)
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise ValueError(f"line {mark.line + 1}: {e.problem}" if mark else str(e)) from e


def _bad(width: int, problem: str) -> tuple:
    return (*[None] * width, problem)


def outlet_rows(text: str) -> Rows:
    """Outlets of one file, in order: the fields of `OUTLET` and the problem, if there is one. Unknown fields are left out."""
    names = OUTLET.fieldNames()
    try:
        document = _loaded(text)
    except ValueError as e:
        yield _bad(len(names), str(e))
        return
    if document is None:
        return
    entries = document.get(SOURCES) if isinstance(document, dict) else None
    if entries is None and isinstance(document, dict) and SOURCES in document:
        return
    if not isinstance(entries, list):
        yield _bad(len(names), f"no list of {SOURCES}")
        return
    seen = set()
    for i, entry in enumerate(entries, 1):
        if not isinstance(entry, dict):
            yield _bad(len(names), f"entry {i}: no fields")
            continue
        nested = [n for n in names if isinstance(entry.get(n), (list, dict))]
        key = entry.get("id")
        if nested:
            yield _bad(len(names), f"entry {i}: {nested[0]} is no text")
        elif not key:
            yield _bad(len(names), f"entry {i}: no id")
        elif key in seen:
            yield _bad(len(names), f"entry {i}: id {key} again")
        else:
            seen.add(key)
            yield (*[entry.get(n) for n in names], None)


def gazetteer_rows(text: str) -> Rows:
    """(kind, term, problem) of one file."""
    try:
        document = _loaded(text)
    except ValueError as e:
        yield _bad(2, str(e))
        return
    if document is not None and not isinstance(document, dict):
        yield _bad(2, "no lists of terms")
        return
    for kind in KINDS:
        terms = (document or {}).get(kind)
        if terms is not None and not isinstance(terms, list):
            yield _bad(2, f"{kind}: no list")
            continue
        for i, term in enumerate(terms or [], 1):
            yield (kind, term, None) if isinstance(term, str) and term else _bad(2, f"{kind} {i}: no term")


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, path: str, parse: Callable[[str], Rows]):
        self.path, self.parse = path, parse

    def partitions(self) -> list[File]:
        from pyarrow import fs

        system, path = _open(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == fs.FileType.File:
            return [File(path)]
        inside = system.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda f: f.base_name.startswith((".", "_"))
        return [File(f.path) for f in sorted(inside, key=lambda f: f.path) if f.type == fs.FileType.File and not hidden(f)]

    def read(self, partition: File) -> Rows:
        system, _ = _open(self.path)
        with system.open_input_stream(partition.path) as stream:
            yield from self.parse(stream.read().decode("utf-8-sig"))


class OutletsYaml(DataSource):
    """Outlets with the fields of `OUTLET`, and `problem`."""

    @classmethod
    def name(cls) -> str:
        return "outlets_yaml"

    def schema(self):
        return ", ".join(f"{n} string" for n in [*OUTLET.fieldNames(), "problem"])

    def reader(self, schema):
        return Reader(self.options["path"], outlet_rows)


class GazetteerYaml(DataSource):
    """Terms of a dictionary: kind, term, and `problem`."""

    @classmethod
    def name(cls) -> str:
        return "gazetteer_yaml"

    def schema(self):
        return GAZETTEER_ROW

    def reader(self, schema):
        return Reader(self.options["path"], gazetteer_rows)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OutletsYaml)
    spark.dataSource.register(GazetteerYaml)


def parse_text(files: DataFrame, parse: Callable[[str], Rows], schema: str, text: str = "value") -> DataFrame:
    """Rows of files that Spark has read as whole texts, one per row of `files`."""
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches):
        for batch in batches:
            found = [r for t in batch.column(0).to_pylist() for r in parse((t or "").removeprefix("﻿"))]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return files.select(F.col(text)).mapInArrow(rows, schema)


def is_yaml(path: str) -> bool:
    return path.endswith((".yaml", ".yml"))
