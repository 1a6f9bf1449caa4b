"""Artifact tables with manifests: written whole, readable only once complete."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import remove

MANIFEST = (
    "kind string, path string, folder string, at long, status string, data_size long, data_sha256 string, n_rows_in long, n_rows_out long, n_rows_expected long, "
    "config_hash string, inputs map<string,string>, superseded boolean, written_at timestamp"
)
READ_BYTES = 1 << 22


class Store:
    """Artifacts below one root.

    Each write goes to a folder of its own; a manifest row "running" voids the artifact first, and the row
    that names the folder, its size and its hash is appended when the data is complete. So a failed
    write leaves no artifact, readers of the old data are not disturbed, and of two writers the later
    row wins. Rows are ordered by time, then folder.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        spark.createDataFrame([], MANIFEST).write.mode("append").json(f"{self.root}/_manifests")  # there from the start

    def path(self, kind: str, name: str) -> str:
        whole = f"{self.root}/{kind}/{name}"
        if ".." in f"{kind}/{name}".split("/") or name.startswith("/"):
            raise ValueError(f"outside the store: {kind}/{name}")
        return whole

    @property
    def manifests(self) -> DataFrame:
        """The latest row of each artifact; ``version`` counts how often it was completed."""
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/_manifests")
        rest = [c for c in rows.columns if c not in ("kind", "path")]
        latest = F.max_by(F.struct(*rest), F.struct("at", "folder")).alias("m")
        return rows.groupBy("kind", "path").agg(latest, F.count_if(F.col("status") == "complete").alias("version")).select("kind", "path", "version", "m.*")

    def _append(self, **row) -> None:
        values = {"status": "complete", "superseded": False, "at": time.time_ns()} | row
        names = [x.strip().split(" ")[0] for x in MANIFEST.split(", ")]
        one = self.spark.createDataFrame([tuple(values.get(n) for n in names)], MANIFEST).withColumn("written_at", F.current_timestamp())
        one.coalesce(1).write.mode("append").json(f"{self.root}/_manifests")

    def _manifest(self, kind: str, name: str):
        return self.manifests.where((F.col("kind") == kind) & (F.col("path") == name)).first()

    def _committed(self, kind: str, name: str, write, **row) -> None:
        """Void the artifact, write its data to a new folder, check it, and append its manifest."""
        folder = f"{self.path(kind, name)}/{uuid.uuid4().hex}"
        self._append(kind=kind, path=name, folder=folder, status="running")
        try:
            told = write(folder)
            self._append(kind=kind, path=name, folder=folder, data_size=self._size(folder), data_sha256=self._hash(folder), **told, **row)
        except BaseException:
            remove(self.spark, folder)
            raise

    def write(self, kind: str, name: str, table: DataFrame, expected: int | None = None, inputs: list[tuple[str, str]] | None = None, config_hash: str | None = None, n_rows_in: int | None = None) -> DataFrame:
        """Write a table and its manifest; rows out must be the rows expected. Returns the table as read."""
        known = {f"{k}/{p}": self.digest(k, p) for k, p in inputs or []}

        def data(folder: str) -> dict:
            table.write.parquet(folder)
            n = self.spark.read.parquet(folder).count()
            if expected is not None and n != expected:
                raise ValueError(f"{kind}/{name}: {n} rows written, {expected} expected")
            return {"n_rows_out": n}

        self._committed(kind, name, data, n_rows_in=n_rows_in, n_rows_expected=expected, config_hash=config_hash, inputs=known)
        return self.read(kind, name)

    def _size(self, folder: str) -> int:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.getContentSummary(where).getLength() if files.exists(where) else -1

    def exists(self, kind: str, name: str) -> bool:
        """A complete manifest, and the data of the size that it says."""
        m = self._manifest(kind, name)
        return m is not None and m.status == "complete" and m.data_size == self._size(m.folder)

    def _require(self, kind: str, name: str) -> str:
        if not self.exists(kind, name):
            raise FileNotFoundError(f"{kind}/{name}: no complete artifact")
        return self._manifest(kind, name).folder

    def read(self, kind: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self._require(kind, name))

    def count(self, kind: str, name: str) -> int:
        """From the footers: no column is read."""
        return self.read(kind, name).count()

    def write_document(self, kind: str, name: str, document: dict) -> None:
        one = self.spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string")

        def data(folder: str) -> dict:
            one.coalesce(1).write.text(folder)
            return {"n_rows_out": 1}

        self._committed(kind, name, data)

    def read_document(self, kind: str, name: str) -> dict:
        return json.loads(self.spark.read.text(self._require(kind, name)).first()[0])

    def supersede(self, kind: str, name: str) -> None:
        """Flag an artifact; its data stays as it is."""
        old = self._manifest(kind, name)
        if old is None or old.status != "complete":
            raise FileNotFoundError(f"{kind}/{name}")
        self._append(**{k: v for k, v in old.asDict().items() if k not in ("version", "at", "written_at")} | {"superseded": True})

    def clean(self, kind: str, name: str) -> None:
        """Remove the data of an artifact's earlier writes, once nothing reads them any more."""
        now = self._require(kind, name)
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/_manifests").where((F.col("kind") == kind) & (F.col("path") == name))
        for r in rows.where(F.col("folder") != now).select("folder").distinct().collect():
            remove(self.spark, r.folder)

    def _hash(self, folder: str) -> str:
        """One hash over the files' own, in their order; files are read as streams, by tasks."""

        def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"h": [_file_hash(p) for p in b["path"]]})

        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path")
        found = files.mapInPandas(hashed, "h string")
        return found.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256)).first()[0]  # a hash per file

    def digest(self, kind: str, name: str) -> str:
        """The data's hash, computed anew."""
        return self._hash(self._require(kind, name))

    def verify(self, kind: str, name: str, digest: str | None = None) -> bool:
        """The data is there and has the hash of its manifest, or the one given."""
        return self.exists(kind, name) and self.digest(kind, name) == (digest or self._manifest(kind, name).data_sha256)

    def missing(self, planned: DataFrame) -> DataFrame:
        """Planned (kind, path) without a complete artifact."""
        return planned.join(self.manifests.where("status = 'complete' and not superseded"), ["kind", "path"], "left_anti")


def _file_hash(path: str) -> str:
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    system, own = arrow_fs.FileSystem.from_uri(uri)
    h = hashlib.sha256()
    with system.open_input_stream(own, compression=None) as f:
        while part := f.read(READ_BYTES):
            h.update(part)
    return h.hexdigest()


def append_json_lines(table: DataFrame, path: str) -> None:
    table.write.mode("append").json(path)


def latex(table: DataFrame, caption: str, most: int = 1000) -> str:
    """A small report table as LaTeX; more than ``most`` rows raise."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report table")
    escape = lambda x: "" if x is None else "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}", "\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}.get(c, c) for c in str(x))
    body = [" & ".join(escape(x) for x in row) + r" \\" for row in [table.columns, *rows]]
    return "\n".join([r"\begin{table}", rf"\caption{{{escape(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(table.columns)}}}", r"\toprule", body[0], r"\midrule", *body[1:], r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def write_report_table(table: DataFrame, folder: str, name: str, caption: str) -> str:
    """CSV beside the returned LaTeX."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    return latex(table, caption)
