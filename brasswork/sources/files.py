"""Files by name: a sink that publishes whole files when the job commits, listings made by tasks, and a stream of new files.

The classes are made inside functions, so that tasks get their code with them and need no package of ours.
Stores are those that pyarrow knows (local, S3, GCS, HDFS, ...); a path without a scheme is local.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

LISTED = "path string, modificationTime timestamp, length long"
FILES = "path string, modificationTime timestamp, length long, content binary"


def _store_of():
    def store_of(uri: str):
        """A store, the path in it, and what stands before that path in the names that Spark gives."""
        from pyarrow import fs

        if "://" not in uri and not uri.startswith("file:"):
            return fs.LocalFileSystem(), uri.rstrip("/"), "file:"
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + uri[5:].strip("/"), "file:"
        store, path = fs.FileSystem.from_uri(uri)
        return store, path.rstrip("/"), uri.rstrip("/").removesuffix(path.rstrip("/"))

    return store_of


def named_files() -> type[DataSource]:
    """Sink `named_files`: a file for each (name, content) row, under the option `base`.

    A task writes into a folder of its own attempt; when all tasks are done, the files of the attempts that count are moved to their names, each
    at once. So no reader ever sees a part of a file, a failed job leaves none, and a job that runs again gives the same
    files. With `existing` = keep, names that are there already stay as they are.
    """
    store_of = _store_of()

    class Written(WriterCommitMessage):
        def __init__(self, folder: str):
            self.folder = folder

    class Writer(DataSourceWriter):
        def __init__(self, base: str, keep: bool):
            import uuid

            self.base, self.keep, self.attempts = base, keep, f"_attempts-{uuid.uuid4().hex}"
            store, root, _ = store_of(base)
            store.create_dir(f"{root}/{self.attempts}", recursive=True)

        def write(self, rows: Iterator) -> WriterCommitMessage:
            import uuid

            store, root, _ = store_of(self.base)
            # Each level by itself: a task that outlives its failed job finds the job's folder gone, and makes nothing in its place.
            folder, made = f"{root}/{self.attempts}/{uuid.uuid4().hex}", set()
            store.create_dir(folder, recursive=False)
            for r in rows:
                parts = r["name"].split("/")
                if any(p in ("", ".", "..") for p in parts):
                    raise ValueError(f"not the name of a file: {r['name']!r}")
                for k in range(1, len(parts)):
                    place = "/".join([folder, *parts[:k]])
                    if place not in made:
                        store.create_dir(place, recursive=False)
                        made.add(place)
                content = r["content"]
                place = "/".join([folder, *parts[:-1]])
                with store.open_output_stream(f"{place}/{parts[-1]}") as f:
                    f.write(content.encode() if isinstance(content, str) else bytes(content))
            return Written(folder)

        def commit(self, messages: list) -> None:
            from concurrent.futures import ThreadPoolExecutor

            from pyarrow import fs

            store, root, _ = store_of(self.base)
            made: set[str] = set()

            def publish(path: str, name: str) -> None:
                if not self.keep or store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    store.move(path, f"{root}/{name}")

            with ThreadPoolExecutor(16) as pool:
                for folder in [m.folder for m in messages if m is not None]:
                    found = [i.path for i in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File]
                    names = [p[len(folder) + 1 :] for p in found]
                    for place in {f"{root}/{n}".rsplit("/", 1)[0] for n in names} - made:
                        store.create_dir(place, recursive=True)
                        made.add(place)
                    list(pool.map(publish, found, names))
            self._clear()

        def abort(self, messages: list) -> None:
            self._clear()

        def _clear(self) -> None:
            from pyarrow import fs

            import time

            store, root, _ = store_of(self.base)
            for last in (False,) * 9 + (True,):
                if store.get_file_info(f"{root}/{self.attempts}").type == fs.FileType.NotFound:
                    return
                try:
                    store.delete_dir(f"{root}/{self.attempts}")
                except OSError:
                    # Tasks of a failed job may still write there until they are stopped.
                    if last:
                        raise
                    time.sleep(0.3)

    class NamedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "named_files"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return Writer(self.options["base"], self.options.get("existing") == "keep")

    return NamedFiles


def write(rows: DataFrame, base: str, keep: bool = False) -> None:
    """Write (name, content) rows as files under `base`, all or none."""
    rows.sparkSession.dataSource.register(named_files())
    rows.select("name", "content").write.format("named_files").mode("append").option("base", base).option("existing", "keep" if keep else "replace").save()


def write_records(df: DataFrame, key: str, base: str) -> None:
    """One JSON file for each record, named by its id; nulls are kept."""
    write(df.select(F.concat(key, F.lit(".json")).alias("name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("content")), base)


def listed(folders: DataFrame) -> DataFrame:
    """path, modificationTime and length of the files in each of the folders (a column `folder`), or of a file named there.

    A task lists a folder, without opening a file; folders inside it, hidden names and what isn't there give no rows.
    """
    store_of = _store_of()

    def run(batches: Iterator) -> Iterator:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                store, path, before = store_of(folder)
                info = store.get_file_info(path)
                if info.type == fs.FileType.Directory:
                    found = store.get_file_info(fs.FileSelector(path))
                else:
                    found = [info]
                rows = [(before + i.path, i.mtime, i.size) for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._"]
                for k in range(0, len(rows), 10_000):
                    kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + 10_000]], t) for c, t in enumerate(kinds)], ["path", "modificationTime", "length"])

    return folders.select("folder").mapInArrow(run, LISTED)


def listing(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """The files of one folder (or a file itself) with a name that ends so."""
    return listed(spark.range(1).select(F.lit(folder).alias("folder"))).where(F.col("path").endswith(suffix))


def canonical(path: Column) -> Column:
    """A path as listings name it: one without a scheme is local."""
    return F.when(path.contains("://") & ~path.startswith("file:"), path).otherwise(F.concat(F.lit("file:/"), F.ltrim(F.regexp_replace(path, "^file:", ""), F.lit("/"))))


def missing(paths: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path isn't a file: the folders they name are listed by tasks, a folder each, and met by one anti-join."""
    (own, held) = ("_canonical", "_there")
    named = paths.withColumn(own, canonical(F.col(column)))
    folders = named.select(F.regexp_replace(own, "/[^/]*$", "").alias("folder")).distinct()
    there = listed(folders).select(F.col("path").alias(held))
    return named.join(there, F.col(own) == F.col(held), "left_anti").drop(own)


def landing_files() -> type[DataSource]:
    """Stream `landing_files`: the files of the option `landing`, empty ones too, as they come.

    New names are written to a log (the option `log`, beside the query's checkpoint), an entry a batch; an offset is the number of an entry,
    so a batch that runs again has the same files, whatever came later and whatever its time says.
    """
    store_of = _store_of()

    class Some(InputPartition):
        def __init__(self, paths: list[str]):
            self.paths = paths

    class Reader(DataSourceStreamReader):
        #: Files of a task.
        EACH = 64

        def __init__(self, landing: str, log: str):
            self.landing, self.log, self.seen, self.last = landing, log, None, 0

        def _entry(self, n: int) -> list[str]:
            import json

            store, root, _ = store_of(self.log)
            with store.open_input_file(f"{root}/{n}.json") as f:
                return json.loads(f.read())

        def _load(self) -> None:
            from pyarrow import fs

            if self.seen is None:
                store, root, _ = store_of(self.log)
                store.create_dir(root, recursive=True)
                names = [i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".json")]
                self.last = max([0, *(int(n[:-5]) for n in names)])
                self.seen = {p for n in range(1, self.last + 1) for p in self._entry(n)}

        def initialOffset(self) -> dict:
            return {"entry": 0}

        def latestOffset(self) -> dict:
            import json

            from pyarrow import fs

            self._load()
            store, path, _ = store_of(self.landing)
            found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
            new = sorted(i.path for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._" and i.path not in self.seen)
            if new:
                logs, root, _ = store_of(self.log)
                with logs.open_output_stream(f"{root}/{self.last + 1}.part") as f:
                    f.write(json.dumps(new).encode())
                logs.move(f"{root}/{self.last + 1}.part", f"{root}/{self.last + 1}.json")
                self.seen.update(new)
                self.last += 1
            return {"entry": self.last}

        def partitions(self, start: dict, end: dict) -> list:
            paths = [p for n in range(start["entry"] + 1, end["entry"] + 1) for p in self._entry(n)]
            return [Some(paths[k : k + self.EACH]) for k in range(0, len(paths), self.EACH)] or [Some([])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            store, _, before = store_of(self.landing)
            for path in partition.paths:
                info = store.get_file_info(path)
                with store.open_input_file(path) as f:
                    content = f.read()
                yield before + path, info.mtime, len(content), content

        def commit(self, end: dict) -> None:
            pass

    class LandingFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "landing_files"

        def schema(self) -> str:
            return FILES

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(self.options["landing"], self.options["log"])

    return LandingFiles


def stream(spark: SparkSession, landing: str, log: str) -> DataFrame:
    """The files of a folder as they come: path, modificationTime, length, content."""
    spark.dataSource.register(landing_files())
    return spark.readStream.format("landing_files").option("landing", landing).option("log", log).load()


def texts(rows: DataFrame, column: str, into: str) -> DataFrame:
    """Adds the text of the file that a column names: read by the row's task, bad bytes replaced, null where there's no name or no such file."""
    store_of = _store_of()
    schema = StructType([*rows.schema.fields, StructField(into, StringType())])

    def read(path: str | None) -> str | None:
        from pyarrow import fs

        if not path:
            return None
        store, own, _ = store_of(path)
        if store.get_file_info(own).type != fs.FileType.File:
            return None
        with store.open_input_file(own) as f:
            return f.read().decode("utf-8", "replace")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            # Few at a time, so that a batch of long texts stays small.
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = pa.array([read(p) for p in part.column(column).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, into])

    return rows.mapInArrow(run, schema)
