"""Stored state as records: one JSON text per row of a table, with the table's name and a version.

Records of all tables are one DataFrame, so an export is written and read by any text or Parquet source, in parallel; nothing is one
large document.  An import takes the records of its own table and version only.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import persist

VERSION = "2.0"


def export_records(tables: dict, version=VERSION) -> DataFrame:
    """(table, version, body) of every row of the named tables."""
    parts = [df.select(F.lit(name).alias("table"), F.lit(version).alias("version"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def import_records(records: DataFrame, name: str, schema, version=VERSION) -> DataFrame:
    """The rows of one table; records of another version are not read."""
    own = records.filter((F.col("table") == name) & (F.col("version") == version))
    return own.select(F.from_json("body", schema).alias("r")).select("r.*")


def restored(records: DataFrame, name: str, schema, stored_fingerprint: DataFrame, files: DataFrame) -> DataFrame:
    """A stored table if the corpus still has the stored fingerprint, else no rows."""
    same = stored_fingerprint.select("fingerprint").scalar() == persist.fingerprint(files).scalar()
    return import_records(records, name, schema).filter(same)


def state(files: DataFrame, symbols: DataFrame, workspace: str) -> DataFrame:
    """One row of session-independent state: workspace, numbers of files and symbols, fingerprint."""
    return persist.fingerprint(files).select(F.lit(workspace).alias("workspace"), files.agg(F.count("*")).scalar().alias("file_count"),
                                             symbols.agg(F.count("*")).scalar().alias("symbol_count"), "fingerprint")
