"""A sink of one file per document that is there as a whole or not at all.

``df.write.format("document_files").option("path", folder).mode("append").save()`` after
`register`. Rows have doc_id, content (text or bytes) and, if the column is there, verified.
Tasks write into a folder beside the target, each attempt into one of its own; the driver removes
attempts that didn't count and renames the folder, one step however many documents there are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        missing = {"doc_id", "content"} - set(schema.names)
        if missing or overwrite:
            raise ValueError(f"columns {sorted(missing)} are missing" if missing else "documents are never overwritten: append to a new folder")
        return Writer(self.options["path"].rstrip("/"), "verified" in schema.names)


class Writer(DataSourceWriter):
    def __init__(self, path: str, gated: bool):
        self.path, self.gated, self.staging = path, gated, f"{path}.writing-{uuid.uuid4().hex}"
        system, target = self._at(path)
        if system.get_file_info(target).type.name != "NotFound":
            raise ValueError(f"{path} is there already")

    @staticmethod
    def _at(path: str) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[Row]) -> Written:
        """Files of one attempt, in 256 folders by the digest of their names. A row that isn't
        verified or has no doc_id refuses the whole write."""
        attempt = f"part-{uuid.uuid4().hex}"
        system, target = self._at(f"{self.staging}/{attempt}")
        n, made = 0, set()
        for row in iterator:
            if row["doc_id"] is None or (self.gated and row["verified"] is not True):
                raise ValueError(f"document {row['doc_id']} isn't verified")
            name, content = str(row["doc_id"]), row["content"]
            folder = f"{target}/{hashlib.sha256(name.encode()).hexdigest()[:2]}"
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{folder}/{quote(name, safe='')}.txt") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            n += 1
        return Written(attempt, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, staging = self._at(self.staging)
        system.create_dir(staging, recursive=True)
        counted = {m.folder for m in messages if m}
        for found in system.get_file_info(fs.FileSelector(staging)):
            if found.base_name not in counted:
                system.delete_dir(found.path)
        system.move(staging, self._at(self.path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        system, staging = self._at(self.staging)
        if system.get_file_info(staging).type.name != "NotFound":
            system.delete_dir(staging)


def register(spark: SparkSession) -> None:
    from ..shipping import ship

    ship(spark)
    spark.dataSource.register(DocumentFiles)
