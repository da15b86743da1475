"""Result tables written exactly once.

A table is a folder::

    <path>/data/<layout>/attempt=<id>/...   the rows of one attempt to write one run
    <path>/log/<...>.json                   a commit: run, generation, attempt, layout, rows, schema

A run (a key that the caller names, such as a dataset with a method, or a parameter set) stages its rows
in a folder of its own attempt and then commits that attempt with one small file, which is renamed into place.
Readers take one commit for each run: the highest generation, of those the smallest attempt.  So

* a writer that dies before its commit leaves no row, whatever it staged;
* a retry of a committed run writes nothing; two attempts that both commit count once;
* runs of different keys, also of writers at the same time, never touch each other's files;
* a higher generation replaces the rows of a run, all at once.

Attempts that partition their rows by the same columns share a layout folder, so that runs may differ in it.
Runs without rows count as committed and add none.  Columns that some runs lack are null in their rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.functions import bounded_collect

MANIFEST = "run string, generation long, attempt string, layout string, rows long, schema string"
PRUNED_RUNS = 10_000  # runs whose attempts are a literal partition filter; more are joined


@dataclass(frozen=True)
class Staged:
    attempt: str
    layout: str
    rows: int
    schema: T.StructType


def _fs(spark: SparkSession, path: str):
    """The folder's file system and a function that makes its paths."""
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path


def stage(df: DataFrame, path: str, partition_by=()) -> Staged:
    """Write the rows of an attempt; nobody reads them before ``commit``."""
    attempt, names = uuid.uuid4().hex, list(partition_by)
    layout = "by-" + hashlib.sha256(json.dumps(names).encode()).hexdigest()[:12] if names else "flat"
    folder = f"{path}/data/{layout}/attempt={attempt}"
    df.write.partitionBy(*names).parquet(folder)
    return Staged(attempt, layout, df.sparkSession.read.schema(df.schema).parquet(folder).count(), df.schema)


def commit(spark: SparkSession, path: str, run: str, staged: Staged, generation: int = 0) -> None:
    """Make a staged attempt the rows of a run."""
    fs, at = _fs(spark, path)
    row = {"run": run, "generation": generation, "attempt": staged.attempt, "layout": staged.layout, "rows": staged.rows, "schema": staged.schema.json()}
    key = hashlib.sha256(run.encode()).hexdigest()[:32]
    temporary, final = at(f"{path}/log/_{staged.attempt}"), at(f"{path}/log/{key}.{generation}.{staged.attempt}.json")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(row).encode()))
    out.close()
    # the name is the attempt's own: what is in its place can only be this commit, sent before
    if not fs.rename(temporary, final):
        fs.delete(temporary, False)
        if not fs.exists(final):
            raise OSError(f"could not commit run {run!r} of {path}")


def committed(spark: SparkSession, path: str, run: str, generation: int = 0) -> bool:
    """Whether a run has a commit of this generation or a later one."""
    return bool(manifest(spark, path).where((F.col("run") == run) & (F.col("generation") >= generation)).limit(1).count())


def write(df: DataFrame, path: str, run: str, generation: int = 0, partition_by=()) -> bool:
    """The rows of a run, once: False if the run is committed already, and then nothing is computed."""
    spark = df.sparkSession
    if committed(spark, path, run, generation):
        return False
    commit(spark, path, run, stage(df, path, partition_by), generation)
    return True


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The commit that counts for every run (no rows for a folder without commits)."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(f"{path}/log")):
        return spark.createDataFrame([], MANIFEST)
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    rows = spark.read.schema(MANIFEST).json(f"{path}/log")
    best = rows.groupBy("run").agg(F.min_by(F.struct(*names[1:]), F.struct((-F.col("generation")).alias("g"), "attempt")).alias("c"))
    return best.select("run", "c.*")


def _merged(schemas) -> T.StructType:
    """The fields of several schemas by name; a field of two types is an error."""
    fields: dict = {}
    for text in schemas:
        for f in T.StructType.fromJson(json.loads(text)).fields:
            if fields.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name!r} is {fields[f.name].simpleString()} in one run and {f.dataType.simpleString()} in another")
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def read(spark: SparkSession, path: str, run_column: str | None = None) -> DataFrame:
    """The rows of all committed runs; ``run_column`` adds the name of each row's run."""
    runs = manifest(spark, path)
    kinds = runs.groupBy("layout", "schema").agg(F.max("rows").alias("rows")).collect()  # as many as there are kinds of tables
    if not kinds:
        raise ValueError(f"{path} has no committed run")
    schema = _merged(sorted({r["schema"] for r in kinds}))
    if "attempt" in schema.names or run_column in schema.names:
        raise ValueError("a column of the results is named as the attempt or the run")
    out = spark.createDataFrame([], schema if run_column is None else T.StructType([*schema.fields, T.StructField(run_column, T.StringType())]))
    for layout in sorted({r["layout"] for r in kinds if r["rows"]}):
        out = out.unionByName(_read_layout(spark, path, layout, runs.where((F.col("layout") == layout) & (F.col("rows") > 0)), schema, run_column))
    return out


def _read_layout(spark: SparkSession, path: str, layout: str, runs: DataFrame, schema: T.StructType, run_column: str | None) -> DataFrame:
    known = bounded_collect(runs.select("attempt"), PRUNED_RUNS)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])).parquet(f"{path}/data/{layout}")
    if known is not None:
        rows = rows.where(F.col("attempt").isin([r[0] for r in known]))  # a partition filter
    if run_column is not None:
        rows = rows.join(runs.select("attempt", F.col("run").alias(run_column)), "attempt")
    elif known is None:
        rows = rows.join(runs.select("attempt"), "attempt", "left_semi")
    return rows.select(*[F.col(f"`{n}`") for n in schema.names], *([run_column] if run_column else []))


def vacuum(spark: SparkSession, path: str, older_than: float = 7 * 86_400) -> list[str]:
    """Delete attempts that count for no run and were last touched ``older_than`` seconds ago; returns them.

    The age keeps writers that have not committed yet, and readers of a generation just replaced."""
    import time

    fs, at = _fs(spark, path)
    if not fs.exists(at(f"{path}/data")):
        return []
    limit = (time.time() - older_than) * 1000
    folders = {s.getPath().getName().split("=")[1]: s for layout in fs.listStatus(at(f"{path}/data")) for s in fs.listStatus(layout.getPath())}
    old = [attempt for attempt, s in folders.items() if s.getModificationTime() <= limit]
    alive = {r[0] for r in manifest(spark, path).where(F.col("attempt").isin(old)).select("attempt").collect()} if old else set()
    gone = sorted(set(old) - alive)
    commits = {s.getPath().getName(): s.getPath() for s in fs.listStatus(at(f"{path}/log"))} if fs.exists(at(f"{path}/log")) else {}
    for attempt in gone:
        for name, where in commits.items():  # a commit first, so that none points at a missing folder
            if attempt in name:
                fs.delete(where, False)
        fs.delete(folders[attempt].getPath(), True)
    return gone
