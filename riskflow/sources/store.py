"""Versioned store for fitted objects (S6-S9): a manifest is the commit point.

    <root>/versions/<id>/...     what one save wrote; never changed afterwards
    <root>/manifests/<n>.json    version n: its id; written under another name, then renamed, which fails if n exists

A save that dies leaves a folder that no manifest names, so readers keep the version before. Readers take the newest manifest, or
the version that they pin. All access goes through the Hadoop file system of the path.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, folder = self._fs(), self._path("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict:
        stream = self._fs().open(self._path("manifests", f"{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def folder(self, version: int | None = None) -> str:
        """The folder of a committed version, of the newest one by default. A root without manifests that has files of its own is
        a folder saved before there were versions."""
        known = self.versions()
        if version is None:
            if not known:
                if self._fs().exists(self._path("versions")) or not self._fs().exists(self._path()):
                    raise FileNotFoundError(f"nothing has been committed to {self.root}")
                return self.root
            version = known[-1]
        elif version not in known:
            raise FileNotFoundError(f"version {version} is not in {self.root}; committed ones: {known}")
        return f"{self.root}/versions/{self._manifest(version)['id']}"

    def save(self, write: Callable[[str], None]) -> int:
        """Let `write(folder)` fill a new folder, then commit it; returns the version number."""
        ident = uuid.uuid4().hex
        write(f"{self.root}/versions/{ident}")
        return self._commit({"id": ident})

    def _commit(self, manifest: dict) -> int:
        hadoop = self._jvm.org.apache.hadoop.fs
        fs = self._fs()
        fs.mkdirs(self._path("manifests"))
        draft = self._path("manifests", f"_{manifest['id']}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = hadoop.FileContext.getFileContext(fs.makeQualified(self._path()).toUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        never_over[0] = getattr(hadoop, "Options$Rename").NONE
        version = (self.versions() or [0])[-1] + 1
        while True:                   # another writer may take a number first
            try:
                context.rename(fs.makeQualified(draft), fs.makeQualified(self._path("manifests", f"{version}.json")), never_over)
                return version
            except Exception:  # noqa: BLE001
                if version not in self.versions():
                    raise
                version = self.versions()[-1] + 1

    def prune(self, keep: int = 2) -> list[int]:
        """Forget all but the newest `keep` versions, and folders that no manifest names; returns the versions that went.
        Not to be called while a save is running."""
        fs, known = self._fs(), self.versions()
        gone, kept = known[:max(len(known) - keep, 0)], known[max(len(known) - keep, 0):]
        ids = {self._manifest(v)["id"] for v in kept}
        for v in gone:
            fs.delete(self._path("manifests", f"{v}.json"), False)
        folder = self._path("versions")
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            if f.getPath().getName() not in ids:
                fs.delete(f.getPath(), True)
        return gone
