"""Monthly results kept under all their parameters.

A month is stored once for each set of parameters (dates, source, columns, ...):

    root/month=2001-07-31/params=<digest>/attempt-<id>/part-...    written first
    root/month=2001-07-31/params=<digest>/commit.json              written last

The commit record holds the month, the parameters, the attempt it commits and
its rows.  A month without one does not exist: what a failed run left behind is
never read, and the month is built again in a folder of its own.  The record is
put in place by a rename that fails where one is there already, so of two runs that
build the same month at the same time one commits; the other removes its files
and reads those of the first.  (The rename is atomic on HDFS and alike; on a store
without atomic renames, runs of the same month should not overlap.)
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORD = "commit.json"


class MonthStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # -- files -------------------------------------------------------------------------

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def _read(self, path: str) -> dict | None:
        fs, at = self._at(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _put(self, path: str, record: dict) -> bool:
        """Write a whole file beside ``path``, then give it that name; False where the name is taken."""
        fs, aside = self._at(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(record, sort_keys=True, indent=1).encode()))
        out.close()
        options = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(options, 1)
        never_over[0] = options.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        try:
            files.rename(aside, self._at(path)[1], never_over)
            return True
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(getattr(e, "java_exception", e)):
                return False
            raise

    # -- months ------------------------------------------------------------------------

    def folder(self, month, params: Mapping[str, object]) -> str:
        text = json.dumps(dict(params), sort_keys=True, default=str)
        return f"{self.root}/month={month}/params={hashlib.sha256(text.encode()).hexdigest()[:32]}"

    def record(self, month, params: Mapping[str, object]) -> dict | None:
        """The commit record, or None where the month was never completed under these parameters."""
        return self._read(f"{self.folder(month, params)}/{RECORD}")

    def read(self, month, params: Mapping[str, object]) -> DataFrame | None:
        found = self.record(month, params)
        return self.spark.read.parquet(f"{self.folder(month, params)}/{found['attempt']}") if found else None

    def build(self, month, params: Mapping[str, object], df: DataFrame) -> DataFrame:
        """Write ``df`` as the month and commit it; where another run was first, its rows are the month."""
        folder, attempt = self.folder(month, params), f"attempt-{uuid.uuid4().hex}"
        rows = Observation()
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(f"{folder}/{attempt}")
        params = json.loads(json.dumps(dict(params), default=str))
        record = {"month": str(month), "params": params, "attempt": attempt, "rows": rows.get["n"], "schema": json.loads(df.schema.json())}
        if not self._put(f"{folder}/{RECORD}", record):
            fs, own = self._at(f"{folder}/{attempt}")
            fs.delete(own, True)
        return self.read(month, params)

    def read_or_build(self, month, params: Mapping[str, object], builder: Callable[[], DataFrame]) -> DataFrame:
        found = self.read(month, params)
        return found if found is not None else self.build(month, params, builder())

    def months(self) -> list[dict]:
        """The records of all committed months."""
        fs, top = self._at(f"{self.root}/month=*/params=*/{RECORD}")
        found = [self._read(s.getPath().toString()) for s in fs.globStatus(top) or []]
        return sorted(found, key=lambda r: (r["month"], json.dumps(r["params"], sort_keys=True)))

    def sweep(self, older_than_hours: float = 48.0) -> int:
        """Delete attempts that no record names and that were begun ``older_than_hours`` ago; the number deleted."""
        fs, attempts = self._at(f"{self.root}/month=*/params=*/attempt-*")
        gone = 0
        for status in fs.globStatus(attempts) or []:
            folder = status.getPath().getParent().toString()
            record = self._read(f"{folder}/{RECORD}")
            old = status.getModificationTime() < (time.time() - older_than_hours * 3600) * 1000
            if old and not (record and record["attempt"] == status.getPath().getName()):
                fs.delete(status.getPath(), True)
                gone += 1
        return gone
