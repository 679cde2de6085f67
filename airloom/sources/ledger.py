"""An archive of slices with a ledger: several are written at once, each counts when its ledger line is there, and reads go by the ledger.

A slice is a folder of its own, so a write that stops leaves files that no ledger line names. The newest line of a slice counts. Slices may
have different columns; what a slice lacks is null.
"""

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "slice string, folder string, columns string, written_us long"


def write_slices(slices: dict, path: str, at_once: int = 4) -> None:
    """Writes ``{name: frame}``, up to ``at_once`` jobs at a time in scheduler pools of their own. If one fails the others still count, and its error is raised."""
    spark = next(iter(slices.values())).sparkSession
    lines, errors = [], []

    def write(name, rows, pool):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"slices-{pool}")
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{path}/slices/{folder}")
        lines.append((name, folder, rows.schema.json(), time.time_ns() // 1000))

    with ThreadPoolExecutor(at_once) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(write), name, rows, k % at_once) for k, (name, rows) in enumerate(slices.items())]
    errors = [e for e in (j.exception() for j in jobs) if e]
    if lines:
        spark.createDataFrame(lines, LEDGER).coalesce(1).write.mode("append").json(f"{path}/ledger")
    if errors:
        raise errors[0]


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The newest ledger line of each slice."""
    lines = spark.read.schema(LEDGER).json(f"{path}/ledger")
    return lines.groupBy("slice").agg(F.max_by(F.struct("folder", "columns"), F.struct("written_us", "folder")).alias("l")).select("slice", "l.*")


def merged(schemas) -> T.StructType:
    """All columns by name, in order of appearance; a column of two types is an error."""
    fields = {}
    for s in schemas:
        for f in s.fields:
            if fields.setdefault(f.name, f).dataType != f.dataType:
                raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()])


def read_slices(spark: SparkSession, path: str, names=None) -> DataFrame:
    """All rows of the listed slices (of those ``names``), with ``slice``."""
    lines = listed(spark, path)
    lines = [r for r in (lines if names is None else lines.filter(F.col("slice").isin(*names))).collect()]  # a line a slice
    if not lines:
        return spark.createDataFrame([], "slice string")
    schema = merged([T.StructType.fromJson(json.loads(r["columns"])) for r in sorted(lines, key=lambda r: r["slice"])])
    rows = spark.read.schema(schema).parquet(*[f"{path}/slices/{r['folder']}" for r in lines])
    name = F.create_map(*[F.lit(x) for r in lines for x in (r["folder"], r["slice"])])
    return rows.withColumn("slice", F.element_at(name, F.regexp_extract("_metadata.file_path", "/slices/([0-9a-f]+)/", 1)))
