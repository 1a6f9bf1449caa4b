"""A table that appears whole or not at all, as a sink and a source.

    spark.dataSource.register(Artifact)
    df.write.format("artifact").mode("overwrite").save(path)
    stream.writeStream.format("artifact").option("checkpointLocation", c).start(path)
    spark.read.format("artifact").load(path)

A write puts its files into a folder of its own. Tasks report name, rows, size and hash of what
they have written; the commit writes a manifest that lists them, and a rename makes it the artifact's. Until
then readers see the old artifact or none; a failed write is removed, and files of tasks that died are in no
manifest. A stream's batch is appended once: the manifest holds the number of the last. ``clean`` removes what no
manifest lists. Option ``verify`` makes a read compare hashes; sizes are always compared.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from marlstone.sources.growing import opened

MANIFEST = "manifest.json"
READ = 1 << 22


@dataclass
class Written(WriterCommitMessage):
    """A task's file, or none if it had no rows."""

    file: str | None
    rows: int = 0
    size: int = 0
    sha256: str = ""


def manifest_of(path: str) -> dict | None:
    """The artifact's manifest; null if there is none."""
    system, own = opened(path)
    if system.get_file_info(f"{own}/{MANIFEST}").type != arrow_fs.FileType.File:
        return None
    with system.open_input_stream(f"{own}/{MANIFEST}") as f:
        return json.loads(f.read())


def file_hash(system: arrow_fs.FileSystem, path: str) -> str:
    h = hashlib.sha256()
    with system.open_input_stream(path, compression=None) as f:
        while part := f.read(READ):
            h.update(part)
    return h.hexdigest()


def clean(path: str) -> int:
    """Remove folders that the manifest does not list, when nothing writes or reads them; returns how many."""
    system, own = opened(path)
    listed = {f["file"].split("/")[0] for f in (manifest_of(path) or {"files": []})["files"]}
    old = [x.path for x in system.get_file_info(arrow_fs.FileSelector(own, allow_not_found=True)) if x.type == arrow_fs.FileType.Directory and x.base_name.startswith("data-") and x.base_name not in listed]
    for folder in old:
        system.delete_dir(folder)
    return len(old)


class _Writing:
    """What batch and stream writers share."""

    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite, self.folder = path, schema, overwrite, f"data-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """In a task: one file of its rows. A failed task removes it."""
        system, own = opened(self.path)
        name, rows, sink = f"{self.folder}/part-{uuid.uuid4().hex}.parquet", 0, None
        system.create_dir(f"{own}/{self.folder}", recursive=True)
        try:
            for batch in iterator:
                if batch.num_rows:
                    sink = sink or pq.ParquetWriter(system.open_output_stream(f"{own}/{name}"), batch.schema)
                    sink.write_batch(batch)
                    rows += batch.num_rows
        except BaseException:
            if sink:
                sink.close()
                system.delete_file(f"{own}/{name}")
            raise
        if sink is None:
            return Written(None)
        sink.close()
        return Written(name, rows, system.get_file_info(f"{own}/{name}").size, file_hash(system, f"{own}/{name}"))

    def committed(self, messages: list[Written | None], folder: str, batch: int | None = None) -> None:
        """The manifest of all files, put in place by a rename."""
        system, own = opened(self.path)
        old = manifest_of(self.path) or {"files": [], "version": 0}
        kept = [] if self.overwrite else old["files"]
        if kept and old["schema"] != self.schema.jsonValue():
            raise ValueError(f"{self.path}: other columns than the artifact's")
        files = [*kept, *[{"file": m.file, "rows": m.rows, "size": m.size, "sha256": m.sha256} for m in messages if m and m.file]]
        new = {"status": "complete", "version": old["version"] + 1, "schema": self.schema.jsonValue(), "rows": sum(f["rows"] for f in files), "files": files, "batch": batch}
        system.create_dir(own, recursive=True)
        staged = f"{own}/_{MANIFEST}-{folder}"
        with system.open_output_stream(staged) as f:
            f.write(json.dumps(new, sort_keys=True).encode())
        system.move(staged, f"{own}/{MANIFEST}")

    def removed(self, messages: list[Written | None], whole: bool) -> None:
        """What a failed write has left."""
        system, own = opened(self.path)
        if whole and system.get_file_info(f"{own}/{self.folder}").type == arrow_fs.FileType.Directory:
            system.delete_dir(f"{own}/{self.folder}")
        for m in messages:
            if not whole and m and m.file:
                system.delete_file(f"{own}/{m.file}")


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.own = _Writing(path, schema, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.own.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.own.committed(messages, self.own.folder)

    def abort(self, messages: list[Written | None]) -> None:
        self.own.removed(messages, whole=True)


class StreamWriter(DataSourceStreamArrowWriter):
    """Batches are appended; one that was committed before a restart is not appended again."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.own = _Writing(path, schema, overwrite=False)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.own.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        done = (manifest_of(self.own.path) or {}).get("batch")
        if done is not None and batchId <= done:
            self.own.removed(messages, whole=False)
        else:
            self.own.committed(messages, f"{self.own.folder}-{batchId}", batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.own.removed(messages, whole=False)


class ArtifactFile(InputPartition):
    def __init__(self, file: dict) -> None:
        self.file = file


class ArtifactReader(DataSourceReader):
    def __init__(self, path: str, verify: bool) -> None:
        self.path, self.verify = path, verify
        if manifest_of(path) is None:
            raise FileNotFoundError(f"{path}: no complete artifact")

    def partitions(self) -> list[ArtifactFile]:
        return [ArtifactFile(f) for f in manifest_of(self.path)["files"]] or [ArtifactFile({})]

    def read(self, partition: ArtifactFile) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, own = opened(self.path)
        at = f"{own}/{partition.file['file']}"
        if system.get_file_info(at).size != partition.file["size"] or self.verify and file_hash(system, at) != partition.file["sha256"]:
            raise ValueError(f"{at} is not what the manifest lists")
        with system.open_input_file(at) as f:
            yield from pq.ParquetFile(f).iter_batches()


class Artifact(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "artifact"

    def schema(self) -> StructType:
        found = manifest_of(self.options["path"])
        if found is None:
            raise FileNotFoundError(f"{self.options['path']}: no complete artifact")
        return StructType.fromJson(found["schema"])

    def reader(self, schema: StructType) -> ArtifactReader:
        return ArtifactReader(self.options["path"], self.options.get("verify", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options["path"], schema)
