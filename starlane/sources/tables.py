"""Writing and reading named tables.

A name -> DataFrame dict is written table by table, each replacing what was
there (create-or-replace), and read back whole.  Tables are Parquet folders
under a base path, or catalog tables when no base path is given.

A table below a base path is a folder of versions.  A write makes a new version
folder and, once that is whole, switches a small manifest (``_current``) to it in one
step.  A reader resolves the manifest once, so a write that fails or is still
running disturbs nobody; the version before the current one is kept for
readers that have begun, and older ones are deleted with the switch.  (Catalog
tables are replaced as the catalog does it.)
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starlane.session import file_content, remove_path, replace_file, run_concurrently, shuffle_partitions

MANIFEST = "_current"
KEPT = 1  # versions kept besides the current one


def _manifest(spark: SparkSession, path: str) -> dict[str, object]:
    content = file_content(spark, f"{path}/{MANIFEST}")
    return json.loads(content) if content else {}


def write_version(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Have ``write`` fill a new version folder of the table at ``path``, make it
    the current one, and return it.  If it fails, the table stays as it was."""
    version = f"v-{uuid.uuid4().hex[:12]}"
    where = f"{path}/{version}"
    try:
        write(where)
    except BaseException:
        remove_path(spark, where)
        raise
    before = _manifest(spark, path)
    older = [before["current"], *before["previous"]] if before else []
    manifest = {"current": version, "previous": older[:KEPT]}
    replace_file(spark, f"{path}/{MANIFEST}", json.dumps(manifest).encode())
    for old in older[KEPT:]:
        remove_path(spark, f"{path}/{old}")
    return where


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the current version of a table, or ``path`` itself if it
    has no versions."""
    found = _manifest(spark, path)
    return f"{path}/{found['current']}" if found else path


def write_tables(tables: dict[str, DataFrame], base: str | None = None) -> dict[str, str]:
    """Write every frame, replacing the previous table of that name.

    Returns name -> location (the version written).  Each write is one distributed job, the jobs
    are submitted together (independent tables); no frame is brought to the
    driver.
    """
    def write(name: str, df: DataFrame) -> str:
        if base is None:
            df.write.mode("overwrite").saveAsTable(name)
            return name
        return write_version(df.sparkSession, f"{base.rstrip('/')}/{name}", df.write.parquet)

    return run_concurrently({n: (lambda n=n, df=df: write(n, df)) for n, df in tables.items()})


def write_keyed(df: DataFrame, table: str, path: str, key: str, placed: bool = False) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``key`` as an external table and read it
    back.  Tables keyed alike join and group on the key without a shuffle;
    each bucket is one file, and there are as many as a shuffle begins with.
    ``placed``: the rows lie by ``key`` already and are written where they are."""
    spark = df.sparkSession
    buckets = shuffle_partitions(spark)
    rows = df if placed else df.repartition(buckets, key)
    writer = rows.write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def keyed_name(path: str) -> str:
    """The catalog name under which a keyed table at ``path`` is opened."""
    return f"starlane_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def open_keyed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """Open a table that ``write_keyed`` wrote, perhaps in an earlier session."""
    table = keyed_name(path)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        by = f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS"
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {by} LOCATION '{path}'")
    return spark.table(table)


def read_table(spark: SparkSession, location: str) -> DataFrame:
    """Read a whole table back (lazy): the current version, or the one named."""
    if "/" in location:
        return spark.read.parquet(current_version(spark, location.rstrip("/")))
    return spark.table(location)


def read_tables(spark: SparkSession, where: dict[str, str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, loc) for name, loc in where.items()}
