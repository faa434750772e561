"""A sink of files with an all-or-nothing commit: df.write.format("crestline_files").save(folder), and its manifest as a table.

Rows are files: `name` (may have folders in it), `data` binary or string, and optional `sidecar` text that
becomes <name without its ending>_quality.txt beside it. Rows without data write nothing but their sidecar. The manifest has a row a file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter
from pyspark.sql.types import StructType

from crestline.sources.stores import MANIFEST, Staged, StagedFiles

FORMAT = "crestline_files"
MANIFEST_SCHEMA = "file string, bytes long, crc32 long"
#: What follows a file's name in its sidecar's (fixed value).
SIDECAR = "_quality.txt"


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        wrong = {"name", "data"} - set(schema.fieldNames())
        if wrong or "path" not in self.options:
            raise ValueError(f"files are written from the columns name and data into a path; missing: {sorted(wrong) or 'path'}")
        return FilesWriter(self.options["path"], overwrite)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.files = StagedFiles(path, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        def contents() -> Iterator[tuple[str, list[bytes], str]]:
            for b in iterator:
                names = b.schema.names
                beside = b.column("sidecar") if "sidecar" in names else [None] * b.num_rows
                for name, data, text in zip(b.column("name"), b.column("data"), beside, strict=True):
                    name = name.as_py()
                    if name is None:
                        continue
                    for file, x in ((name, data.as_py()), (f"{name.rpartition('.')[0] or name}{SIDECAR}", text and text.as_py())):
                        if x is not None:
                            x = x.encode() if isinstance(x, str) else x
                            yield file, [x], json.dumps({"file": file, "bytes": len(x), "crc32": zlib.crc32(x)})

        return self.files.write(contents())

    def commit(self, messages: list) -> None:
        self.files.commit(messages)

    def abort(self, messages: list) -> None:
        self.files.abort(messages)


def write_files(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write rows (name, data, and sidecar if there is one) as files; a failed job leaves nothing. `mode` is error, append or overwrite.

    With error, a folder with committed files in it is an error before anything runs.
    """
    spark = df.sparkSession
    spark.dataSource.register(Files)
    if mode == "error" and _exists(spark, f"{path}/_SUCCESS"):
        raise FileExistsError(path)
    columns = [c for c in ("name", "data", "sidecar") if c in df.columns]
    df.select(*columns).write.format(FORMAT).mode("overwrite" if mode == "overwrite" else "append").save(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, crc32 of every committed file."""
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/{MANIFEST}").select(F.col("file"), "bytes", "crc32") if _exists(spark, f"{path}/{MANIFEST}") else spark.createDataFrame([], MANIFEST_SCHEMA)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
