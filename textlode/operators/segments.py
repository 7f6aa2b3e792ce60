"""A posting index in immutable segments: files are added, replaced and removed without a rebuild.

A segment is a set of Parquet tables that is never changed: its documents and their terms by path, the same terms by term, its document frequencies, and
the learner's weights by path.  Removing a file writes a delete vector (segment, path) and the negative counts of what the file gave its segment, read
from the rows of that path alone.  What the index holds is the newest manifest: a table of segments and deletes.  Sums of frequencies over segments and
deletes are those of a full rebuild; learned weights are computed from such sums, so the vocabulary is learned before any boost is applied.

Compaction writes the live rows of some segments as one and drops their deletes.  A writer that fails leaves folders that no manifest names.
"""

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import index, ordering, vocabulary

_MANIFEST = "v int, segment string, part string, docs long, files long"


@dataclass(frozen=True)
class SegmentedIndex:
    """An index as of one manifest.  ``parts``: (segment, part, docs, files) rows, part null for the segment itself, else a delete's folder."""
    spark: SparkSession
    root: str
    version: int
    parts: tuple

    @property
    def segments(self):
        return [p[0] for p in self.parts if p[1] is None]

    @property
    def n_docs(self):
        return sum(p[2] for p in self.parts)

    @property
    def n_files(self):
        return sum(p[3] for p in self.parts)

    def _read(self, name, folders):
        tables = [self.spark.read.parquet(f"{self.root}/{f}/{name}").withColumn("segment", F.lit(f)) for f in folders]
        return reduce(DataFrame.unionByName, tables) if tables else None

    def deletes(self, segments=None):
        """(segment, path) of files that segments hold no more."""
        own = [self.spark.read.parquet(f"{self.root}/{part}/paths").withColumn("segment", F.lit(s)) for s, part, *_ in self.parts
               if part is not None and (segments is None or s in segments)]
        return reduce(DataFrame.unionByName, own).distinct() if own else None

    def live(self, name, segments=None, only=None) -> DataFrame:
        """Rows of a table that no delete takes away; ``only`` is a filter that reaches the scan."""
        rows = self._read(name, self.segments if segments is None else segments)
        rows = rows if only is None else rows.filter(only)
        gone = self.deletes(segments)
        return rows if gone is None else rows.join(gone, ["segment", "path"], "left_anti")

    def _summed(self, name, keys):
        rows = self._read(name, self.segments + [p[1] for p in self.parts if p[1] is not None])
        sums = [F.sum(c).alias(c) for c in rows.columns if c not in (*keys, "segment")]
        return rows.groupBy(*keys).agg(*sums)

    def documents(self) -> DataFrame:
        return self.live("docs").drop("segment")

    def frequencies(self) -> DataFrame:
        """(term, df): documents that hold each term, from sums of segments' and deletes' counts; no postings are read."""
        return self._summed("counts", ["term"]).filter("df > 0").select("term", "df")

    def learned(self) -> DataFrame:
        """The vocabulary that the learner keeps: (term, freq, df, total_weight, idf, weight)."""
        table = self._summed("weights", ["term"]).filter("df > 0").select("term", F.col("df").alias("freq"), "df", "total_weight")
        return vocabulary.finalize(table, self.n_files)

    def postings(self, terms=None, learned: DataFrame = None) -> DataFrame:
        """(doc_id, doc_type, term, tf, freq) as ``index.postings`` gives for all live documents; ``terms`` are read alone."""
        rows = self.live("postings", only=None if terms is None else F.col("term").isin(*terms))
        freq = index.boosted(F.col("tf"), F.col("doc_type"))
        if learned is not None:
            rows = rows.join(learned.select("term", "weight"), "term", "left")
            freq = freq * F.when(F.col("weight") > 0, 1 + F.log1p("weight") * 0.1).otherwise(F.lit(1.0))
        return rows.select("doc_id", "doc_type", "term", "tf", freq.cast("double").alias("freq"))


def current(spark: SparkSession, root: str) -> SegmentedIndex:
    """The index as its newest manifest has it."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").collect()  # a row for each segment and delete of each version
    newest = max(r.v for r in rows)
    return SegmentedIndex(spark, root, newest, tuple((r.segment, r.part, r.docs, r.files) for r in rows if r.v == newest and r.segment is not None))


def _publish(spark, root, version, parts) -> SegmentedIndex:
    rows = [(version, *p) for p in parts] or [(version, None, None, 0, 0)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return SegmentedIndex(spark, root, version, tuple(parts))


def _entries(lists: DataFrame, value: str, name: str) -> DataFrame:
    """A row for each term of (.., terms, ``value``)."""
    rest = [c for c in lists.columns if c not in ("terms", value)]
    return lists.select(*rest, F.inline_outer(F.arrays_zip(F.col("terms").alias("term"), F.col(value).alias(name)))).filter("term is not null")


def _lists(rows: DataFrame, keys, value: str, name: str) -> DataFrame:
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("term", value))).alias("l"))
    return listed.select(*keys, F.col("l.term").alias("terms"), F.col(f"l.{value}").alias(name))


def _write_segment(docs: DataFrame, files: DataFrame, spark, root) -> tuple:
    """Writes (docs, forward, postings, counts, weights) tables; returns the segment's manifest row.

    The forward tables hold a document's terms as lists.  A document or file that is one row is counted inside it, and each task writes its own, by path.
    """
    name = f"seg-{uuid.uuid4()}"
    at = f"{root}/{name}"
    docs.select("doc_id", "doc_type", "path", "doc_ord").write.parquet(f"{at}/docs")
    keys = ("doc_id", "doc_type", "path")
    if ordering.one_row_each(spark.read.parquet(f"{at}/docs"), *keys):
        index.term_lists(docs.sortWithinPartitions("path"), keys).write.parquet(f"{at}/forward")
    else:
        ordering.stored(_lists(index.term_frequencies(docs, keys), keys, "tf", "tf"), "path", f"{at}/forward")
    if ordering.one_row_each(files, "path"):
        vocabulary.weight_lists(files.sortWithinPartitions("path")).write.parquet(f"{at}/learner")
    else:
        ordering.stored(_lists(vocabulary.document_terms(vocabulary.weighted_terms(files)), ["path"], "weight", "weights"), "path", f"{at}/learner")
    return _finish_segment(spark, root, name)


def _finish_segment(spark, root, name) -> tuple:
    """The tables that follow from a segment's documents and forward tables."""
    at = f"{root}/{name}"
    forward, learner = spark.read.parquet(f"{at}/forward"), spark.read.parquet(f"{at}/learner")
    ordering.stored(_entries(forward, "tf", "tf"), "term", f"{at}/postings")
    _entries(forward, "tf", "tf").groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{at}/counts")
    _entries(learner, "weights", "weight").groupBy("term").agg(F.count("*").alias("df"), F.sum("weight").alias("total_weight")).write.parquet(f"{at}/weights")
    docs = spark.read.parquet(f"{at}/docs").agg(F.count("*"), F.count_distinct("path")).first()
    return name, None, docs[0], docs[1]


def create(files: DataFrame, root: str, feed=index.plain_feed) -> SegmentedIndex:
    """An index of ``files`` (path, content, language, ord) under the new folder ``root``; ``feed`` makes documents of files, with their path."""
    spark = files.sparkSession
    return _publish(spark, root, 1, [_write_segment(feed(files), files, spark, root)])


def remove(ix: SegmentedIndex, paths: DataFrame) -> SegmentedIndex:
    """Without the files ``paths`` (path); those that are not there change nothing."""
    return _publish(ix.spark, ix.root, ix.version + 1, [*ix.parts, *_delete(ix, paths)])


def _delete(ix: SegmentedIndex, paths: DataFrame) -> list:
    """Delete vectors and negative counts of each segment that holds one of the paths; of other segments only the paths are read."""
    spark, out = ix.spark, []
    paths = ordering.cut_lineage(paths.select("path").distinct())
    for segment in ix.segments:
        gone = ordering.cut_lineage(ix.live("docs", [segment]).join(paths, "path", "left_semi").select("path", "doc_id"))
        docs, files = gone.agg(F.count("*"), F.count_distinct("path")).first()
        if not docs:
            continue
        part = f"del-{uuid.uuid4()}"
        own = gone.select("path").distinct()
        own.write.parquet(f"{ix.root}/{part}/paths")
        rows = lambda name: spark.read.parquet(f"{ix.root}/{segment}/{name}").join(own, "path", "left_semi")  # noqa: E731, B023
        _entries(rows("forward"), "tf", "tf").groupBy("term").agg((-F.count("*")).alias("df")).write.parquet(f"{ix.root}/{part}/counts")
        _entries(rows("learner"), "weights", "weight").groupBy("term").agg((-F.count("*")).alias("df"), (-F.sum("weight")).alias("total_weight")).write.parquet(f"{ix.root}/{part}/weights")
        out.append((segment, part, -docs, -files))
    return out


def add(ix: SegmentedIndex, files: DataFrame, feed=index.plain_feed) -> SegmentedIndex:
    """With ``files``; a path that the index has is replaced."""
    gone = _delete(ix, files.select("path"))
    fresh = _write_segment(feed(files), files, ix.spark, ix.root)
    return _publish(ix.spark, ix.root, ix.version + 1, [*ix.parts, *gone, fresh])


def compact(ix: SegmentedIndex, segments=None) -> SegmentedIndex:
    """``segments`` (by default all) become one, without their deleted rows; other segments are not read."""
    chosen = ix.segments if segments is None else list(segments)
    name = f"seg-{uuid.uuid4()}"
    at = f"{ix.root}/{name}"
    ix.live("docs", chosen).drop("segment").write.parquet(f"{at}/docs")
    for table in ("forward", "learner"):
        ordering.stored(ix.live(table, chosen).drop("segment"), "path", f"{at}/{table}")
    rest = [p for p in ix.parts if p[0] not in chosen]
    return _publish(ix.spark, ix.root, ix.version + 1, [*rest, _finish_segment(ix.spark, ix.root, name)])


def smallest(ix: SegmentedIndex, n: int) -> list:
    """The ``n`` segments of fewest live documents: what a merge policy compacts next."""
    live = {}
    for segment, _, docs, _ in ix.parts:
        live[segment] = live.get(segment, 0) + docs
    return sorted(live, key=lambda s: (live[s], s))[:n]
