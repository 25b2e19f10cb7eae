"""A store of experiment runs as a Spark data source: <root>/<dataset>/<strategy>/<model>/ holds a run's metrics.json and CSV logs.

Reading: a run is a partition, its file is opened by the task that reads it, and the options dataset, strategy and model choose folders before anything is listed.
(Filters are not handed to the reader: this Spark keeps a pushed filter with the DataFrame that it was first asked of, and later questions to it would lose rows.)
Writing: each task streams a run's rows into a file of its own in a staging folder; when all tasks are done the driver moves the files of those that were committed to their
names, and drops the staging folder with whatever lost attempts left there. Paths may be of any store that Arrow's file systems know (local, HDFS, S3, ...).
"""

from __future__ import annotations

import csv
import datetime
import decimal
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

RUN = ("dataset", "strategy", "model")
_RUN = "dataset string, strategy string, model string"
#: Columns of each table behind those of its run; files may lack some, which are then null.
TABLES = {
    "metrics": "mae double, rmse double, smape double, mape double, compute_proxy double, n_windows bigint, n_predictions bigint, retrain_total_retrains bigint, retrain_retrain_count bigint, retrain_retrain_rate double, drift_detection_rate double",
    "window_metrics": "entity_id string, window_id bigint, step bigint, timestamp timestamp, mae double, rmse double, smape double, mape double, mean_error double, max_error double, std_error double",
    "drift_log": "timestamp timestamp, step bigint, entity_id string, drift_detected boolean, drift_score double, detector string, retrain_triggered boolean, retrain_reason string",
    "retraining_log": "step bigint, timestamp timestamp, entity_id string, drift_detected boolean, drift_score double, error double, reason string, total_retrains bigint",
}
_ARROW = {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
_STAMPS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", arrow_csv.ISO8601]


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the path on it."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def _file(table: str) -> str:
    return "metrics.json" if table == "metrics" else f"{table}.csv"


def _columns(table: str) -> dict[str, str]:
    return dict(c.split(" ") for c in TABLES[table].split(", "))


@dataclass
class Run(InputPartition):
    dataset: str
    strategy: str
    model: str

    def key(self) -> tuple[str, str, str]:
        return self.dataset, self.strategy, self.model


class _Reader(DataSourceReader):
    def __init__(self, root: str, table: str, wanted: dict[str, list[str]] | None = None) -> None:
        self.root, self.table, self.wanted = root, table, wanted or {}

    def _folders(self, fs: arrow_fs.FileSystem, at: str, level: int) -> Iterator[str]:
        name = RUN[level]
        if name in self.wanted:  # asked by name: nothing is listed
            yield from sorted(set(self.wanted[name]))
            return
        for info in sorted(fs.get_file_info(arrow_fs.FileSelector(at, allow_not_found=True)), key=lambda i: i.path):
            if info.type == arrow_fs.FileType.Directory and not info.base_name.startswith(("_", ".")):
                yield info.base_name

    def partitions(self) -> list[Run]:
        fs, root = _open(self.root)
        runs = [Run(d, s, m) for d in self._folders(fs, root, 0) for s in self._folders(fs, f"{root}/{d}", 1) for m in self._folders(fs, f"{root}/{d}/{s}", 2)]
        found = fs.get_file_info(["/".join((root, *r.key(), _file(self.table))) for r in runs]) if runs else []
        return [r for r, info in zip(runs, found, strict=True) if info.type == arrow_fs.FileType.File]

    def read(self, partition: Run) -> Iterator[Any]:
        if not isinstance(partition, Run):  # a store without runs
            return
        fs, root = _open(self.root)
        columns = _columns(self.table)
        with fs.open_input_stream("/".join((root, *partition.key(), _file(self.table)))) as f:
            data = f.read()
        if self.table == "metrics":
            said = json.loads(data)
            kind = {"double": float, "bigint": int}
            yield (*partition.key(), *[None if said.get(c) is None else kind[t](said[c]) for c, t in columns.items()])
            return
        if not data.strip():
            return
        options = arrow_csv.ConvertOptions(
            column_types={c: _ARROW[t] if t != "timestamp" else pa.timestamp("us") for c, t in columns.items()}, include_columns=list(columns), include_missing_columns=True, timestamp_parsers=_STAMPS,
            strings_can_be_null=True, quoted_strings_can_be_null=False, true_values=["True", "true"], false_values=["False", "false"],
        )
        for batch in arrow_csv.read_csv(io.BytesIO(data), convert_options=options).to_batches():
            names = [pa.array([v] * batch.num_rows, pa.string()) for v in partition.key()]
            yield pa.RecordBatch.from_arrays([*names, *[batch.column(c).cast(_ARROW[t]) for c, t in columns.items()]], [*RUN, *columns])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[tuple[str, str, str], str]]


def _text(v: Any) -> Any:
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    return "" if v is None else repr(v) if isinstance(v, float) else str(v)


class _Writer(DataSourceWriter):
    def __init__(self, root: str, table: str, columns: list[str], overwrite: bool) -> None:
        self.root, self.table, self.columns, self.overwrite = root, table, columns, overwrite
        self.staging = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Any]) -> _Written:
        fs, staging = _open(self.staging)
        at, rest = [self.columns.index(c) for c in RUN], [i for i, c in enumerate(self.columns) if c not in RUN]
        fs.create_dir(staging, recursive=True)
        files, now, out, sheet = [], None, None, None
        try:
            for row in iterator:
                key = tuple(row[i] for i in at)
                if any(k is None or not re.fullmatch(r"[^/_.][^/]*", k) for k in key):
                    raise ValueError(f"{key} cannot be the names of a run")
                if key != now:
                    if out is not None:
                        out.close()
                    now, path = key, f"{staging}/{uuid.uuid4().hex}"
                    files.append((key, path))
                    out = io.TextIOWrapper(fs.open_output_stream(path), encoding="utf-8", newline="")
                    sheet = None if self.table == "metrics" else csv.writer(out)
                    if sheet:
                        sheet.writerow([self.columns[i] for i in rest])
                if sheet:
                    sheet.writerow([_text(row[i]) for i in rest])
                else:
                    plain = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
                    out.write(json.dumps({self.columns[i]: plain(row[i]) for i in rest if row[i] is not None}, indent=2))
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        """Moves the files of all tasks to their names; nothing is moved if a run came in two pieces, or is there already and may not be replaced."""
        fs, root = _open(self.root)
        files = [f for m in messages if m is not None for f in m.files]
        targets = {key: "/".join((root, *key, _file(self.table))) for key, _ in files}
        try:
            if len(targets) < len(files):
                raise ValueError("a run's rows came in several pieces; write_runs() deals them to one task")
            there = [i.path for i in fs.get_file_info(list(targets.values())) if i.type != arrow_fs.FileType.NotFound] if targets else []
            if there and not self.overwrite:
                raise ValueError(f"there already: {there[0]}")
            for key, path in files:
                fs.create_dir("/".join((root, *key)), recursive=True)
                if targets[key] in there:
                    fs.delete_file(targets[key])
                fs.move(path, targets[key])
        finally:
            self._drop()

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        fs, staging = _open(self.staging)
        if fs.get_file_info(staging).type == arrow_fs.FileType.Directory:
            fs.delete_dir(staging)


class RunStore(DataSource):
    """spark.read.format("runs").option("table", ...).load(root), and the same to write; see register()."""

    @classmethod
    def name(cls) -> str:
        return "runs"

    def _table(self) -> str:
        table = self.options.get("table", "metrics")
        if table not in TABLES:
            raise ValueError(f"no table {table!r}; there are {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return f"{_RUN}, {TABLES[self._table()]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._table(), {c: json.loads(self.options[c]) for c in RUN if c in self.options})

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self._table(), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format `runs` known to the session."""
    ship(spark)
    spark.dataSource.register(RunStore)


def read_runs(spark: SparkSession, root: str, table: str = "metrics", **names: str | list[str]) -> DataFrame:
    """A row a run (metrics), window (window_metrics) or log entry (drift_log, retraining_log). A store without runs, or without the table, has no rows.

    names: dataset, strategy or model, one name or several; only their folders are opened.
    """
    if unknown := set(names) - set(RUN):
        raise ValueError(f"no names of a run: {', '.join(sorted(unknown))}")
    register(spark)
    read = spark.read.format("runs").option("table", table)
    for c, v in names.items():
        read = read.option(c, json.dumps([v] if isinstance(v, str) else list(v)))
    return read.load(root)


def write_runs(df: DataFrame, root: str, table: str = "metrics", overwrite: bool = True) -> None:
    """Writes rows of a table, with their run's names, as one file a run; columns that the table has not are left out, rows are in the order of step where there is one.

    A run's rows go to one task, which streams them. With overwrite the given runs are replaced and all others stay; without it a run that is there is an error.
    """
    register(df.sparkSession)
    known = [c for c in (*RUN, *_columns(table)) if c in df.columns]
    order = [c for c in (*RUN, "entity_id", "step", "window_id") if c in known]
    rows = df.select(*known).repartition(*RUN).sortWithinPartitions(*order)
    rows.write.format("runs").option("table", table).mode("overwrite" if overwrite else "append").save(root)


# ---- questions to a store ------------------------------------------------------------------------------------------------------


def single_run(spark: SparkSession, root: str, dataset: str, strategy: str, model: str) -> DataFrame:
    """The metrics row of one run; only its folder is opened."""
    return read_runs(spark, root, dataset=dataset, strategy=strategy, model=model)


def timeline(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """The windows of all runs of a dataset, each with its run's key (strategy_model), for an error chart in order of step."""
    rows = read_runs(spark, root, "window_metrics", dataset=dataset)
    return rows.select(F.concat_ws("_", "strategy", "model").alias("run"), "strategy", "model", "entity_id", "window_id", "step", "timestamp", "mae", "rmse", "smape").orderBy("run", "entity_id", "step")


def log_counts(spark: SparkSession, root: str) -> DataFrame:
    """For each run: drifts found, retrains logged, and those that were not the initial training; 0 where a log is missing."""
    runs = read_runs(spark, root).select(*RUN)
    drifts = read_runs(spark, root, "drift_log").groupBy(*RUN).agg(F.count_if("drift_detected").alias("drift_count"))
    fits = read_runs(spark, root, "retraining_log").groupBy(*RUN).agg(F.count("*").alias("retrain_entries"), F.count_if(F.coalesce("reason", F.lit("")) != "initial_training").alias("retrain_count"))
    joined = runs.join(drifts, list(RUN), "left").join(fits, list(RUN), "left")
    return joined.select(*RUN, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("drift_count", "retrain_entries", "retrain_count")])
