"""Parquet tables that micro-batches write and that stay right when a batch is written again.

Layout of a table folder:

    log/version=<v>/                  one folder per micro-batch; writing it again replaces it
    folded/upto=<v>/<partitions>/     the log of v's epoch since its last fold, in larger files by date
    merged/upto=<v>/<partitions>/     dates of v's epoch with all rows that its folds up to v have for them
    counts/version=<v>                the row counts of a micro-batch
    counted/upto=<v>/                 those of the batches of a fold
    _epochs/<n>                       marker files: numbers given out to checkpoints

A merge writes only the dates that its folds touch, and a reader takes each date from the newest merge that has it, so
the folders read are as many as there are dates, however often was folded. Folds and merges of a table with a
summary have a sibling (folded_summary, merged_summary) with one row per partition folder and symbol.

A micro-batch is close in time already, so its few files are skipped by their own statistics;
folders by date come with the fold.

A version is one bigint made of the epoch and the batch number. An epoch belongs to a checkpoint:
batch numbers start again at 0 with a new checkpoint, and the higher epoch makes its rows the
newer ones. Readers use only folders whose write has ended (_SUCCESS).
"""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tickloom.functions import time_range, utc_date
from tickloom.operators.latest import newest_version
from tickloom.operators.parse import OK
from tickloom.operators.series import Bound
from tickloom.operators.summary import SUMMARY, summarize
from tickloom.schema import AGGREGATE_KEY, AGGREGATES, STOCKS
from tickloom.sinks import fs

log = logging.getLogger(__name__)

BATCH_BITS = 40

COUNTS = "version long, rows long, faulty long"


def version_of(epoch: int, batch_id: int) -> int:
    return (epoch << BATCH_BITS) | batch_id


def _epoch(version: int) -> int:
    return version >> BATCH_BITS


def _marks(folds: list[int]) -> dict[int, int]:
    """The version that each epoch is folded up to."""
    return {_epoch(f): f for f in sorted(folds)}


def _beyond(versions: list[int], folds: list[int]) -> list[int]:
    """Versions that their epoch's folds do not hold yet."""
    marks = _marks(folds)
    return [v for v in versions if v > marks.get(_epoch(v), -1)]


def _older(versions: list[int], points: list[int]) -> list[int]:
    """Versions that a fold or merge before their epoch's newest has taken in."""
    newest = _marks(points)
    before = _marks([p for p in points if p != newest[_epoch(p)]])
    return [v for v in versions if v <= before.get(_epoch(v), -1)]


def _upto(folder: str) -> int:
    return int(re.match(r"upto=(\d+)", folder).group(1))


def open_epoch(spark: SparkSession, checkpoint: str, table_path: str) -> int:
    """The epoch of a checkpoint folder; a folder that is new gets the next number of the table."""
    known = fs.marker(spark, checkpoint, "_epoch")
    if known is not None:
        return int(known)
    taken = [int(p.rsplit("/", 1)[1]) for p in fs.glob(spark, f"{table_path}/_epochs/*")]
    epoch = max(taken, default=-1) + 1
    while not fs.create(spark, f"{table_path}/_epochs/{epoch}"):
        epoch += 1
    fs.create(spark, f"{checkpoint}/_epoch={epoch}")
    if epoch:
        log.warning(
            "%s: checkpoint %s is new. Messages read again are appended again, and windows that "
            "come out differently replace the earlier ones.",
            table_path,
            checkpoint,
        )
    return epoch


@dataclass(frozen=True)
class LakeTable:
    """A table folder layout.

    `time` is the column that ranges apply to and `date` the folder column made from it.
    `keys` are empty for an append-only table. Folded files are sorted by `cluster` within a date, so that
    one symbol of many lies in few row groups and pages. `summary` makes the partial states of a
    folder's rows; only an append-only table can have one, as states of replaced rows cannot be taken back.
    """

    columns: T.StructType
    time: str
    date: str
    partitions: tuple[str, ...]
    keys: tuple[str, ...] = ()
    cluster: str = "symbol"
    summary: Callable[[DataFrame], DataFrame] | None = None
    summary_columns: T.StructType | None = None

    @property
    def _logged_columns(self) -> T.StructType:
        return T.StructType([*self.columns.fields, T.StructField("version", T.LongType())])

    @property
    def _folded_columns(self) -> T.StructType:
        return T.StructType([*self._logged_columns.fields, T.StructField(self.date, T.DateType())])

    def write_batch(
        self, rows: DataFrame, path: str, version: int, files: int | None = None
    ) -> None:
        """Write one micro-batch, replacing what an earlier try of the same batch left.

        `files` gathers a small batch into that many files.
        """
        if files:
            rows = rows.repartition(files)
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("rows")]
        if "fault" in self.columns.names:
            counts.append(F.count_if(F.col("fault") != OK).alias("faulty"))
        rows = rows.select(self.columns.names).observe(seen, *counts)
        rows.write.mode("overwrite").parquet(f"{path}/log/version={version}")
        line = json.dumps({"version": version, **seen.get})
        fs.put(rows.sparkSession, f"{path}/counts/version={version}", line + "\n")

    def read(
        self,
        spark: SparkSession,
        path: str,
        start: Bound = None,
        end: Bound = None,
    ) -> DataFrame:
        """All rows in a time range with their version; of a keyed table the newest per key."""
        rows = self._rows(spark, path, start, end)
        return newest_version(rows, self.keys) if self.keys else rows

    def _rows(
        self,
        spark: SparkSession,
        path: str,
        start: Bound = None,
        end: Bound = None,
        dates: Callable[[Column], Column] | None = None,
    ) -> DataFrame:
        """Rows of all levels in a time range; `dates` says which UTC dates count."""
        folds, merges = self._folds(spark, path), self._merges(spark, path)
        tail = _beyond(self._versions(spark, path), folds + merges)
        rows = self._folded(spark, path, _beyond(folds, merges)).unionByName(
            self._merged(spark, path, list(self._newest(spark, path, merges).values()))
        )
        rows = time_range(rows, self.time, start, end, self.date)
        logged = time_range(self._log(spark, path, tail), self.time, start, end)
        if dates:
            rows = rows.where(dates(F.col(self.date)))
            logged = logged.where(dates(utc_date(F.col(self.time))))
        return rows.drop(self.date).unionByName(logged)

    def read_summary(self, spark: SparkSession, path: str, dates: Callable[[Column], Column] | None = None) -> DataFrame:
        """The partial states of all rows: those written with folds and merges, and those of the unfolded log.

        A folder whose summary is not there (a fold that was stopped between the two) is summed up from its rows.
        """
        folds, merges = self._folds(spark, path), self._merges(spark, path)
        tail = _beyond(self._versions(spark, path), folds + merges)
        rows = self._log(spark, path, tail).withColumn(self.date, utc_date(F.col(self.time)))
        parts = []
        live = [f"upto={f}" for f in _beyond(folds, merges)]
        for base, folders in (("folded", live), ("merged", list(self._newest(spark, path, merges).values()))):
            done = set(_complete(spark, f"{path}/{base}_summary", "upto"))
            has = {f: _upto(f) in done for f in folders}
            parts.append(_load(spark, f"{path}/{base}_summary", [f for f in folders if has[f]], self.summary_columns))
            rows = rows.unionByName(_load(spark, f"{path}/{base}", [f for f in folders if not has[f]], self._folded_columns))
        parts.append(self.summary(rows).select(self.summary_columns.names))
        out = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return out.where(dates(F.col(self.date))) if dates else out

    def fold(self, spark: SparkSession, path: str) -> int | None:
        """Rewrite the log folders since the last fold as few files per date.

        Batches are in order within an epoch only, so every epoch has its own fold: one that writes
        after a higher epoch was folded is still read and folded. Each logged row is rewritten once,
        however large the table is. A keyed table keeps the newest row per key of those folders.
        Returns the highest version it reaches.
        """
        points = self._folds(spark, path) + self._merges(spark, path)
        versions = _beyond(self._versions(spark, path), points)
        for epoch in sorted({_epoch(v) for v in versions}):
            self._fold_epoch(spark, path, [v for v in versions if _epoch(v) == epoch])
        return max(versions, default=None)

    def _fold_epoch(self, spark: SparkSession, path: str, versions: list[int]) -> None:
        rows = self._log(spark, path, versions)
        if self.keys:
            rows = newest_version(rows, self.keys)
        counted = [f"{path}/counts/version={v}" for v in versions if fs.glob(spark, f"{path}/counts/version={v}")]
        if counted:
            counts = spark.read.schema(COUNTS).json(counted)
            counts.coalesce(1).write.mode("overwrite").json(f"{path}/counted/upto={versions[-1]}")
        self._write(rows.withColumn(self.date, utc_date(F.col(self.time))), path, "folded", versions[-1])

    def _write(self, rows: DataFrame, path: str, base: str, upto: int) -> None:
        """Write a folder of folded rows, then its summary."""
        # Spark sizes the partitions at run time: small dates are joined, a large one is split.
        rows = rows.hint("rebalance", *self.partitions).sortWithinPartitions(*self.partitions, self.cluster, self.time)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*self.partitions)
        # Where a column chunk's dictionary grows too large to tell what it holds, the filter does.
        writer.option(f"parquet.bloom.filter.enabled#{self.cluster}", "true").parquet(f"{path}/{base}/upto={upto}")
        if self.summary:
            spark = rows.sparkSession
            written = _load(spark, f"{path}/{base}", [f"upto={upto}"], self._folded_columns)
            summary = self.summary(written).select(self.summary_columns.names).hint("rebalance", *self.partitions)
            writer = summary.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*self.partitions)
            writer.parquet(f"{path}/{base}_summary/upto={upto}")

    def merge(self, spark: SparkSession, path: str) -> int | None:
        """Rewrite the dates that the folds since the last merge touch, with all rows that their epoch has for them.

        Other dates stay as they are. A merge that was stopped is done again. Returns the highest version it reaches.
        """
        merges = self._merges(spark, path)
        folds = _beyond(self._folds(spark, path), merges)
        for epoch in sorted({_epoch(f) for f in folds}):
            own = [f for f in folds if _epoch(f) == epoch]
            touched = {p for f in own for p in self._partitions(spark, f"{path}/folded/upto={f}")}
            newest = self._newest(spark, path, [m for m in merges if _epoch(m) == epoch])
            held = [folder for (_, p), folder in newest.items() if p in touched]
            rows = self._folded(spark, path, own).unionByName(self._merged(spark, path, held))
            if self.keys:
                rows = newest_version(rows.drop(self.date), self.keys).withColumn(self.date, utc_date(F.col(self.time)))
            self._write(rows, path, "merged", own[-1])
        return max(folds, default=None)

    def batch_counts(self, spark: SparkSession, path: str) -> DataFrame:
        """epoch, batch, rows and faulty (unusable messages) of every micro-batch that was written, each once.

        The counts lie beside the batch's folder under its version: a batch that is written again replaces them,
        and a restarted query goes on with its numbers.
        """
        folded = _complete(spark, f"{path}/counted", "upto")
        counted = [f"{path}/counted/upto={f}" for f in folded]
        counted += [f"{path}/counts/version={v}" for v in _beyond(self._versions(spark, path), folded)]
        counts = spark.read.schema(COUNTS).json(counted) if counted else spark.createDataFrame([], COUNTS)
        version = F.col("version")
        batch = version.bitwiseAND(F.lit((1 << BATCH_BITS) - 1))
        return counts.select(F.shiftright(version, BATCH_BITS).alias("epoch"), batch.alias("batch"), "rows", F.coalesce("faulty", F.lit(0)).alias("faulty"))

    def expire(self, spark: SparkSession, path: str) -> int:
        """Delete log folders, folds and merged dates that newer ones have taken in; returns how many.

        What the newest fold or merge of an epoch has taken in stays for readers that have planned on it.
        """
        folds, merges = self._folds(spark, path), self._merges(spark, path)
        old = [f"log/version={v}" for v in _older(self._versions(spark, path), folds + merges)]
        old += [f"counts/version={v}" for v in _older(self._versions(spark, path), _complete(spark, f"{path}/counted", "upto"))]
        old += [f"{base}/upto={f}" for f in _older(folds, merges) for base in ("folded", "folded_summary")]
        newest = _marks(merges)
        before = [m for m in merges if m != newest[_epoch(m)]]
        live = set(self._newest(spark, path, merges).values()) | set(self._newest(spark, path, before).values())
        for m in merges:
            dates = [f"upto={m}/{p}" for p in self._partitions(spark, f"{path}/merged/upto={m}")]
            gone = [d for d in dates if d not in live]
            if len(gone) == len(dates) and m in before:
                gone = [f"upto={m}"]
            old += [f"{base}/{d}" for d in gone for base in ("merged", "merged_summary")]
        for folder in old:
            fs.delete(spark, f"{path}/{folder}")
        return sum(not f.startswith("counts") and "_summary" not in f for f in old)

    def _versions(self, spark: SparkSession, path: str) -> list[int]:
        return _complete(spark, f"{path}/log", "version")

    def _folds(self, spark: SparkSession, path: str) -> list[int]:
        return _complete(spark, f"{path}/folded", "upto")

    def _merges(self, spark: SparkSession, path: str) -> list[int]:
        return _complete(spark, f"{path}/merged", "upto")

    def _partitions(self, spark: SparkSession, folder: str) -> list[str]:
        """The partition folders in a folder, as paths within it."""
        depth = len(self.partitions)
        found = fs.glob(spark, folder + "".join(f"/{p}=*" for p in self.partitions))
        return ["/".join(p.rsplit("/", depth)[1:]) for p in found]

    def _newest(self, spark: SparkSession, path: str, merges: list[int]) -> dict[tuple[int, str], str]:
        """For each epoch and partition the folder of the newest merge that has it."""
        found = {}
        for m in sorted(merges):
            for p in self._partitions(spark, f"{path}/merged/upto={m}"):
                found[_epoch(m), p] = f"upto={m}/{p}"
        return found

    def _merged(self, spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
        return _load(spark, f"{path}/merged", folders, self._folded_columns)

    def _log(self, spark: SparkSession, path: str, versions: list[int]) -> DataFrame:
        folders = [f"version={v}" for v in versions]
        return _load(spark, f"{path}/log", folders, self._logged_columns)

    def _folded(self, spark: SparkSession, path: str, folds: list[int]) -> DataFrame:
        folders = [f"upto={v}" for v in folds]
        return _load(spark, f"{path}/folded", folders, self._folded_columns)


def _load(spark: SparkSession, base: str, folders: list[str], columns: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], columns)
    paths = (f"{base}/{folder}" for folder in folders)
    reader = spark.read.schema(columns).option("basePath", base)
    return reader.parquet(*paths).select(columns.names)


def _complete(spark: SparkSession, base: str, name: str) -> list[int]:
    found = fs.glob(spark, f"{base}/{name}=*/_SUCCESS")
    return sorted(int(re.search(rf"/{name}=(\d+)/_SUCCESS$", p).group(1)) for p in found)


STOCKS_TABLE = LakeTable(
    columns=T.StructType(
        [
            *STOCKS.fields,
            T.StructField("raw_value", T.BinaryType()),
            T.StructField("fault", T.StringType()),
        ]
    ),
    time="timestamp",
    date="trade_date",
    partitions=("fault", "trade_date"),
    summary=summarize,
    summary_columns=SUMMARY,
)

AGGREGATES_TABLE = LakeTable(
    columns=AGGREGATES,
    time="window_start",
    date="window_date",
    partitions=("window_date",),
    keys=AGGREGATE_KEY,
)


def read_stocks(
    spark: SparkSession,
    path: str,
    start: Bound = None,
    end: Bound = None,
    keep_malformed: bool = False,
) -> DataFrame:
    """The raw table. `keep_malformed` also gives the rows of unusable messages, as far as their
    fields could be read."""
    rows = STOCKS_TABLE.read(spark, path, start, end)
    if not keep_malformed:
        rows = rows.where(F.col("fault") == OK)
    return rows.select(STOCKS.names)


def read_stock_summary(spark: SparkSession, path: str, dates: Callable[[Column], Column] | None = None) -> DataFrame:
    """Partial states of the usable rows, by symbol and UTC date; several rows may be of one symbol and date."""
    return STOCKS_TABLE.read_summary(spark, path, dates).where(F.col("fault") == OK)


def read_stock_days(
    spark: SparkSession, path: str, start: Bound, end: Bound, dates: Callable[[Column], Column]
) -> DataFrame:
    """Usable rows in a time range that lie on some UTC dates."""
    rows = STOCKS_TABLE._rows(spark, path, start, end, dates).where(F.col("fault") == OK)
    return rows.select(STOCKS.names)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Unusable messages with the reason and their bytes."""
    rows = STOCKS_TABLE.read(spark, path).where(F.col("fault") != OK)
    return rows.select("fault", "raw_value", *STOCKS.names)


def read_aggregates(
    spark: SparkSession,
    path: str,
    start: Bound = None,
    end: Bound = None,
) -> DataFrame:
    """The newest state of every window; the range applies to window_start."""
    return AGGREGATES_TABLE.read(spark, path, start, end).select(AGGREGATES.names)
