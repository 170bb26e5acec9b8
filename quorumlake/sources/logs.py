"""Logs with a manifest: appends in a known sequence, an index of keys, batches that are recognised when they come again.

A log is a folder of Parquet files, one sub-folder an append (``attempt=<id>``), beside

* ``_commits``: one small JSON file per append with its sequence number. What no commit names was never finished; no read sees it.
* ``_keys``: the keys, in folders by the leading bits of their hash. The number of bits follows the number of keys, so a
  folder holds about ``bucket_rows`` keys however large the log is, and a batch opens the folders of its own keys only.

A log has one writer at a time, and any number of readers.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from quorumlake.sources.files import at_path
from quorumlake.sources.schemas import struct
from quorumlake.sources.stores import DuplicateKeys

SEQUENCE, ORDINAL = "_sequence", "_ordinal"  # of the append, and of the row in it
COMMIT = "sequence long, attempt string, n_rows long, batch string, index string, bits int"
MOST_BROADCAST = 500_000  # appends whose ids go to every task, some 100 bytes each
MOST_FOLDERS = 10_000  # of the key index that a batch names one by one; beyond, it reads the index as a whole
FEW_FOLDERS = 64  # where a look at all keys costs less than a wrong guess


@dataclass(frozen=True)
class Commit:
    sequence: int
    attempt: str
    n_rows: int
    batch: str | None = None
    index: str | None = None  # folder of keys in use since this append
    bits: int = 0


@dataclass(frozen=True)
class State:
    last: Commit
    appends: int
    rows: int
    seen: bool


class Log:
    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, on: list[str], bucket_rows: int = 4096):
        self.spark, self.path, self.schema, self.on, self.bucket_rows = spark, path.rstrip("/"), struct(schema), on, bucket_rows

    # the manifest

    def commits(self) -> DataFrame:
        """One row an append, by sequence number."""
        fs, where = at_path(self.spark, f"{self.path}/_commits")
        return self.spark.read.schema(COMMIT).json(where.toString()) if fs.exists(where) else self.spark.createDataFrame([], COMMIT)

    def state(self, batch: str | None = None) -> State:
        """The last append, how many there were and how many rows they have, and whether one of them was ``batch``: one small job."""
        fields = T.StructType.fromDDL(COMMIT).names
        r = self.commits().agg(F.max_by(F.struct(*fields), "sequence").alias("last"), F.count("*").alias("n"), F.sum("n_rows").alias("rows"), F.max(F.col("batch") == F.lit(batch)).alias("seen")).first()
        return State(Commit(**r["last"].asDict()) if r["n"] else Commit(0, "", 0), r["n"], r["rows"] or 0, bool(r["seen"]))

    def last_commit(self) -> Commit:
        return self.state().last

    def _finished(self, state: State, name: str) -> DataFrame:
        done = self.commits().select(F.col("attempt").alias(name), F.col("sequence").alias(SEQUENCE))
        return F.broadcast(done) if state.appends <= MOST_BROADCAST else done

    def _commit(self, commit: Commit) -> None:
        """A file of its own that appears under its name as a whole or not at all."""
        fs, there = at_path(self.spark, f"{self.path}/_commits/{commit.sequence:012d}.json")
        if fs.exists(there):
            raise RuntimeError(f"another writer has made append {commit.sequence}")
        _, draft = at_path(self.spark, f"{self.path}/_commits/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(asdict(commit)).encode() + b"\n"))
        out.close()
        if not fs.rename(draft, there):
            raise RuntimeError(f"append {commit.sequence} could not be committed")

    # reads

    def read(self) -> DataFrame:
        """All rows of finished appends, with the sequence number of their append and their place in it."""
        fields = T.StructType([*self.schema.fields, T.StructField(ORDINAL, T.LongType()), T.StructField("attempt", T.StringType())])
        state = self.state()
        if not state.rows:
            return self.spark.createDataFrame([], T.StructType([*fields.fields[:-1], T.StructField(SEQUENCE, T.LongType())]))
        rows = self.spark.read.schema(fields).parquet(self.path)
        return rows.join(self._finished(state, "attempt"), "attempt").drop("attempt")

    def newest(self) -> DataFrame:
        """One row a key, that of the last append; of those in one append, the last in it."""
        return newest([self])

    # keys

    def _bucket(self, bits: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*self.on), 64 - bits) if bits else F.lit(0).cast("long")

    def _touched(self, keys: DataFrame, bits: int) -> list[int] | None:
        """Folders of the index that the keys fall into. None: about half of them or more, or too many to name, so the index is
        read as a whole; the first keys mostly tell, without a look at the others."""
        bucket, most = keys.select(self._bucket(bits)), min(1 << bits, MOST_FOLDERS)
        if most >= FEW_FOLDERS and 2 * len({r[0] for r in bucket.take(2 * most)}) > most:
            return None
        touched = [r[0] for r in bucket.distinct().limit(MOST_FOLDERS + 1).collect()]
        return touched if len(touched) <= MOST_FOLDERS else None

    def known(self, keys: DataFrame, state: State | None = None) -> DataFrame:
        """Keys of finished appends from the index folders that may hold any of ``keys``: a superset of what they have in common."""
        state = state or self.state()
        at = state.last
        names = [self.schema[k] for k in self.on]
        fields = T.StructType([*names, T.StructField("_attempt", T.StringType())])
        if not at.index:
            return self.spark.createDataFrame([], T.StructType(names))
        base = f"{self.path}/_keys/{at.index}"
        touched = self._touched(keys, at.bits)
        fs, root = at_path(self.spark, base)
        if touched is None:
            paths = [base] if fs.exists(root) else []
        else:
            paths = [p for b in touched if fs.exists((x := at_path(self.spark, f"{base}/b={b}"))[1]) for p in [x[1].toString()]]
        if not paths:
            return self.spark.createDataFrame([], T.StructType(names))
        return self.spark.read.schema(fields).parquet(*paths).join(self._finished(state, "_attempt"), "_attempt", "left_semi").select(self.on)

    def unseen(self, rows: DataFrame, state: State | None = None) -> DataFrame:
        """The rows, one a key, whose key the log doesn't have."""
        once = rows.dropDuplicates(self.on)
        return _matched(once, self.known(rows, state), self.on, "left_anti")

    def present(self, rows: DataFrame) -> DataFrame:
        """The rows whose key the log has."""
        return _matched(rows, self.known(rows), self.on, "left_semi")

    def _index(self, attempt: str, state: State, n: int) -> tuple[str, int]:
        """Add an append's keys to the index. Once folders would hold four times what they should, all keys are dealt anew,
        with more bits; that happens each time their number has grown fourfold, so a key is moved a bounded number of times."""
        total, last = n + state.rows, state.last
        name, bits = last.index, last.bits
        keys = self.spark.read.schema(self.schema).parquet(f"{self.path}/attempt={attempt}").select(*self.on, F.lit(attempt).alias("_attempt"))
        if not name or total > 4 * self.bucket_rows << bits:
            bits = max(0, (total // self.bucket_rows).bit_length())
            name = uuid.uuid4().hex
            if last.index:
                fields = T.StructType([*[self.schema[k] for k in self.on], T.StructField("_attempt", T.StringType())])
                old = self.spark.read.schema(fields).parquet(f"{self.path}/_keys/{last.index}").drop("b")
                keys = keys.unionByName(old.join(self._finished(state, "_attempt"), "_attempt", "left_semi"))
        dealt = keys.withColumn("b", self._bucket(bits)).repartition("b")
        # files are moved by the tasks, not one by one by the driver: what no commit names is never read, so halves do no harm
        dealt.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("b").parquet(f"{self.path}/_keys/{name}")
        return name, bits

    # appends

    def _append(self, rows: DataFrame, batch: str | None, state: State) -> int:
        last = state.last
        attempt, seen = uuid.uuid4().hex, Observation()
        placed = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).withColumn(ORDINAL, F.monotonically_increasing_id())
        placed.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/attempt={attempt}")
        n = seen.get["n"]
        new = Commit(last.sequence + 1, attempt, n, batch, last.index, last.bits)
        if n:
            name, bits = self._index(attempt, state, n)
            new = replace(new, index=name, bits=bits)
        self._commit(new)
        if last.index and new.index != last.index:
            fs, old = at_path(self.spark, f"{self.path}/_keys/{last.index}")
            fs.delete(old, True)
        return n

    def append(self, rows: DataFrame, batch: str | None = None) -> int:
        """Append all rows, also those whose keys are there: ``newest`` tells which counts. Tells how many there were.

        A batch that was committed under the same name before is no work. One that failed half-way left no commit: its
        files are never read, and it is done again as a whole.
        """
        state = self.state(batch)
        return 0 if state.seen else self._append(rows, batch, state)

    def append_unseen(self, rows: DataFrame, batch: str | None = None) -> int:
        """Append the rows with new keys, one a key, and tell how many there were. Reads the index folders of the keys, not the log."""
        state = self.state(batch)
        return 0 if state.seen else self._append(self.unseen(rows, state), batch, state)

    def append_exclusive(self, rows: DataFrame, batch: str | None = None) -> int:
        """Append all rows, or raise if a key is there already or twice among them."""
        twice = rows.groupBy(self.on).count().filter("count > 1").select(self.on).unionByName(self.present(rows.select(self.on)))
        if found := twice.limit(3).collect():
            raise DuplicateKeys(f"keys are in the log or repeated: {found}")
        return self.append(rows, batch)

    def clean(self) -> int:
        """Delete what unfinished appends have left; tells how many there were. For the writer, while it writes nothing."""
        fs, root = at_path(self.spark, self.path)
        done = {r[0] for r in self.commits().select("attempt").collect()}  # one row an append
        left = [s.getPath() for s in (fs.listStatus(root) if fs.exists(root) else []) if (name := s.getPath().getName()).startswith("attempt=") and name.removeprefix("attempt=") not in done]
        for p in left:
            fs.delete(p, True)
        return len(left)


def _matched(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Rows that have a key, or have none; a null in a key equals a null."""
    keys = keys.toDF(*[f"_key_{k}" for k in on])
    return rows.join(keys, reduce(and_, [rows[k].eqNullSafe(keys[f"_key_{k}"]) for k in on]), how)


def newest(logs: list[Log]) -> DataFrame:
    """One row a key of all logs: of the last log that has it, that of its last append, of this the last row. A column that a log
    doesn't have is null there. Only the order is compared, so any column type goes; tasks keep one row a key before the shuffle."""
    on, out = logs[0].on, None
    for k, log in enumerate(logs):
        rows = log.read().withColumn("_log", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    columns = [c for c in out.columns if c not in ("_log", SEQUENCE, ORDINAL)]
    rest = [c for c in columns if c not in on]
    top = F.max_by(F.struct(*rest), F.struct("_log", SEQUENCE, ORDINAL)).alias("_top")
    return out.groupBy(on).agg(top).select(*on, *[F.col("_top")[c].alias(c) for c in rest]).select(columns)
