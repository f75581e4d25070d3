"""Reading and writing named tables: catalog or files, always with a known schema."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from stayloom.session import delete_path


class TableRegistry:
    """Maps logical names to files or catalog tables.

    ``locations`` values are paths (anything with a slash) or catalog names; ``schemas`` holds DDL strings. A declared
    schema saves the footer-reading job at plan time and fails loudly when the files disagree.
    """

    def __init__(self, spark: SparkSession, locations: Mapping[str, str], schemas: Mapping[str, str] | None = None,
                 fmt: str = "parquet"):
        self.spark = spark
        self.locations = dict(locations)
        self.schemas = dict(schemas or {})
        self.fmt = fmt

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, schemas: Mapping[str, str]) -> TableRegistry:
        return cls(spark, {name: f"{folder}/{name}.parquet" for name in schemas}, schemas)

    def __contains__(self, name: str) -> bool:
        return name in self.locations

    def __getitem__(self, name: str) -> DataFrame:
        location = self.locations[name]
        if "/" not in location:
            return self.spark.table(location)
        reader = self.spark.read.format(self.fmt)
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        return reader.load(location)


def read_sheet(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read a delimited sheet with a header row. The schema is declared, never inferred; empty cells become NULL."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """Write a delimited sheet with a header row; one file per task, so size is no limit."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_clustered(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Write a log sorted by ``columns`` so that filters on them skip row groups (item first, then time, for lab events).

    Ranges are cut over all columns together: one very frequent item still spreads over many files by its time.
    """
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


class StageStore:
    """Stage files of one prediction target: ``<root>/<target>-<stage>``."""

    def __init__(self, spark: SparkSession, root: str, target: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.target = target

    def path(self, stage: str) -> str:
        return f"{self.root}/{self.target}-{stage}"

    def write(self, df: DataFrame, stage: str) -> DataFrame:
        """Write the stage and return it read back, so that later steps start from the files."""
        df.write.mode("overwrite").parquet(self.path(stage))
        return self.spark.read.schema(df.schema).parquet(self.path(stage))

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage))


def refresh_table(df: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Replace the named table by the result of ``df`` (full refresh).

    Each refresh writes a new folder, under the warehouse unless ``location`` names one, and makes a table of it before the
    names are switched; so ``df`` may read the table it replaces, and a job or a switch that fails leaves the old table under its
    name. The folder of the version before is removed last. ``VersionedTables`` switches many tables at once.
    """
    spark = df.sparkSession
    path = location or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    fresh, old = f"{name}_fresh_{uuid.uuid4().hex}", f"{name}_old_{uuid.uuid4().hex}"
    spark.catalog.createTable(fresh, path=path, source="parquet", schema=df.schema)
    before = None
    if spark.catalog.tableExists(name):
        before = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    except Exception:
        if before:
            spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        spark.sql(f"DROP TABLE {fresh}")
        raise
    if before:
        spark.sql(f"DROP TABLE {old}")
        if before.rstrip("/").rsplit("/", 1)[-1] != path.rstrip("/").rsplit("/", 1)[-1]:
            delete_path(spark, before)
    return spark.table(name)
