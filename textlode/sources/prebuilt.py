"""Prebuilt lightweight index: JSON in and out."""

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from ..operators import parse, vocabulary

FUNCTION = "array<struct<name:string,line:int>>"
FILE = f"struct<path:string,name:string,ext:string,lines:int,functions:{FUNCTION},keywords:array<string>,content:array<struct<line:int,content:string,lower:string>>>"
DOCUMENT = "struct<path:string,name:string,type:string,text:string,keywords:array<string>,lines:int>"
SCHEMA = f"version string, type string, created string, files map<string,{FILE}>, documents map<string,{DOCUMENT}>"


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)


def stored_files(index: DataFrame) -> DataFrame:
    """Corpus of a full index: stored lines joined back, documents by their text."""
    f = index.select(F.explode("files").alias("path", "f"))
    code = f.filter("f.content is not null").select("path", F.array_join(F.transform("f.content", lambda x: x["content"]), "\n").alias("content"),
                                                    F.substr("f.ext", F.lit(2)).alias("language"))
    docs = index.select(F.explode("documents").alias("path", "d")).filter("d.text is not null") \
        .select("path", F.col("d.text").alias("content"), F.col("d.type").alias("language"))
    return code.unionByName(docs).withColumn("ord", F.col("path"))


def rehydrated(index: DataFrame, disk: DataFrame) -> DataFrame:
    """Corpus of a lightweight index: its paths looked up in files read from disk."""
    f = index.select(F.explode("files").alias("path", "f")).select("path", F.substr("f.ext", F.lit(2)).alias("language"))
    return disk.select("path", "content", "ord").join(f, "path")


def build(files: DataFrame) -> DataFrame:
    """Index rows, one per file, ready for write.json: functions, 50 keywords, line count."""
    fns = parse.line_functions(files).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("functions"))
    kws = vocabulary.file_keywords(files).groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    base = files.select("path", F.substring_index("path", "/", -1).alias("name"), text.line_count(F.col("content")).alias("lines"))
    return base.join(fns, "path", "left").join(kws, "path", "left")


def save(rows: DataFrame, path: str):
    rows.write.mode("overwrite").json(path)
