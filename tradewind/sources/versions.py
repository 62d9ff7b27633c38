"""Versions of a dataset: the files that belong to it, published in one step.

``<directory>/<table>/commit=<id>/[<column>=<value>/]*.parquet`` are data files, never changed.
``<directory>/versions/files-<id>`` lists all files of a version, and the tiny file
``<directory>/versions/<number>`` names that list. Creating the latter is what publishes: a reader
takes the highest number and keeps to the files listed there, so it sees all of a commit or nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A data file: its table, its partition (such as ``month=2001-08-01``, or empty) and its path
#: within the dataset.
FILES = "table_name string, part string, file string"


@dataclass(frozen=True)
class Version:
    """A published state of a dataset; its tables are read from the files that it lists."""

    spark: SparkSession
    directory: str
    number: int
    listing: str

    @cached_property
    def files(self) -> list[tuple[str, str, str]]:
        """All data files: table, partition, path. Their list, like Spark's own of the files of a
        query, is held by the driver."""
        listed = self.spark.read.schema(FILES).parquet(f"{self.directory}/versions/{self.listing}")
        return [tuple(r) for r in listed.collect()]

    @property
    def tables(self) -> set[str]:
        return {name for name, _, _ in self.files}

    def read(self, name: str, schema: T.StructType, parts: Iterable[str] | None = None) -> DataFrame:
        """A table of this version; with ``parts``, only what lies in these partitions: files of
        others are neither listed nor opened."""
        chosen = None if parts is None else set(parts)
        files = [
            file
            for table, part, file in self.files
            if table == name and file and (chosen is None or part in chosen)
        ]
        return read_files(self.spark, self.directory, name, schema, files)


def read_files(
    spark: SparkSession, directory: str, name: str, schema: T.StructType, files: Sequence[str]
) -> DataFrame:
    """The named files of a table; an empty table if there are none."""
    if not files:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{directory}/{name}")
    return reader.parquet(*[f"{directory}/{f}" for f in files]).select(*schema.names)


def _versions_folder(spark: SparkSession, directory: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/versions")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def latest(spark: SparkSession, directory: str) -> Version | None:
    """The version published last, if any."""
    files, folder = _versions_folder(spark, directory)
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    if not (numbers := [int(n) for n in names if n.isdigit()]):
        return None
    number = max(numbers)
    listing = spark.read.text(f"{directory}/versions/{number:08d}").first().value
    return Version(spark, directory, number, listing)


class VersionConflict(RuntimeError):
    """Another commit has published a version meanwhile."""


class Commit:
    """Tables written towards the next version; nothing of them is seen before :meth:`publish`.

    ``base`` is the version that this one adds to; None begins anew, whatever is there.
    """

    def __init__(self, spark: SparkSession, directory: str, base: Version | None = None):
        self.spark, self.directory, self.base = spark, directory, base
        self.id = uuid.uuid4().hex
        self.added: list[tuple[str, str, str]] = []
        #: What the write of each table observed: ``rows``, and ``null_keys`` of its key columns.
        self.metrics: dict[str, dict[str, int]] = {}

    def write(
        self,
        name: str,
        df: DataFrame,
        key: Sequence[str] = (),
        partition_by: str | None = None,
        sort_by: Sequence[str] = (),
    ) -> DataFrame:
        """Write ``df`` as files of table ``name`` and return what was written.

        With ``partition_by`` its rows are dealt out by that column, a large partition over
        several tasks. Rows and incomplete keys are counted on the way.
        """
        incomplete = F.lit(False)
        for column in key:
            incomplete = incomplete | F.col(column).isNull()
        if partition_by:
            df = df.hint("rebalance", partition_by)
        if sort_by or partition_by:
            df = df.sortWithinPartitions(*([partition_by] if partition_by else []), *sort_by)
        observed = Observation()
        counted = df.observe(
            observed,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(incomplete).alias("null_keys"),
        )
        path = f"{self.directory}/{name}/commit={self.id}"
        writer = counted.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        self.metrics[name] = dict(observed.get)
        own = [] if not self.metrics[name]["rows"] else self.spark.read.schema(df.schema).parquet(path).inputFiles()
        files = [f"{name}/commit={self.id}/{unquote(f).rpartition(f'commit={self.id}/')[2]}" for f in own]
        self.added += [(name, _part(f), f) for f in files] or [(name, "", "")]
        return read_files(self.spark, self.directory, name, df.schema, files)

    def publish(self) -> Version:
        """Make the written tables, with the files of the base version, the latest version."""
        number = self.base.number if self.base else getattr(latest(self.spark, self.directory), "number", 0)
        number += 1
        listing = f"files-{self.id}"
        files = [*(self.base.files if self.base else []), *self.added]
        listed = self.spark.createDataFrame(files, FILES)
        listed.coalesce(1).write.parquet(f"{self.directory}/versions/{listing}")
        system, folder = _versions_folder(self.spark, self.directory)
        pointer = self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:08d}")
        conflict = VersionConflict(f"version {number} of {self.directory} was published meanwhile")
        if system.exists(pointer):
            raise conflict
        try:
            out = system.create(pointer, False)  # an error if the file is there by now
        except Py4JJavaError as error:
            raise (conflict if system.exists(pointer) else error) from error
        out.writeBytes(listing)
        out.close()
        return Version(self.spark, self.directory, number, listing)


def _part(file: str) -> str:
    found = re.search(r"/commit=[^/]+/(\w+=[^/]*)/", file)
    return found[1] if found else ""

