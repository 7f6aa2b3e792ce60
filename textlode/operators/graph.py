"""Call-graph operators on distinct edges (caller, callee)."""

from pyspark.sql import DataFrame, functions as F

from ..functions import paths, text
from . import ordering


def callers(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter(F.col("callee") == name).select(F.col("caller").alias("name"))


def callees(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter(F.col("caller") == name).select(F.col("callee").alias("name"))


def with_symbol(names: DataFrame, definitions: DataFrame) -> DataFrame:
    """Attach the first definition of each name; names without one stay with nulls."""
    return names.join(first_definitions(definitions), "name", "left")


def first_definitions(definitions: DataFrame) -> DataFrame:
    """(name, file, line, type): the first definition of each name, by ``ord`` where there is one, else by file and line."""
    order = ["ord"] if "ord" in definitions.columns else ["file", "line"]
    return ordering.first_by(definitions, ["name"], order, ["file", "line", "type"])


def first_variant(edges: DataFrame, variants, end: str, other: str) -> DataFrame:
    """Neighbours of the first variant that has any (variants: a query's spellings, in order)."""
    order = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col(end))
    hits = edges.filter(F.col(end).isin(*variants)).select(
        F.col(end).alias("matched_variant"), F.col(other).alias("name"), order.alias("variant_no"))
    best = hits.agg(F.min("variant_no")).scalar()
    return hits.filter(F.col("variant_no") == best).drop("variant_no")


def find_callers(edges: DataFrame, variants, definitions=None) -> DataFrame:
    found = first_variant(edges, variants, "callee", "caller")
    return found if definitions is None else with_symbol(found, definitions)


def find_callees(edges: DataFrame, variants, definitions=None) -> DataFrame:
    found = first_variant(edges, variants, "caller", "callee")
    return found if definitions is None else with_symbol(found, definitions)


def trace(edges: DataFrame, name: str, definitions: DataFrame, sites: DataFrame = None) -> DataFrame:
    """One table of a symbol's own definition, callers, callees and call sites, tagged by role."""
    me = definitions.filter(F.col("name") == name).select(F.lit("symbol").alias("role"), "name", "file", "line", "type")
    out = me
    for role, names in (("caller", callers(edges, name)), ("callee", callees(edges, name))):
        out = out.unionByName(with_symbol(names, definitions).select(F.lit(role).alias("role"), "name", "file", "line", "type"))
    if sites is not None:
        here = ordering.top(sites.filter(F.col("fn") == name), ("ord", "rule", "match_no"), 50)
        out = out.unionByName(here.select(F.lit("call_site").alias("role"), F.col("fn").alias("name"),
                                          F.col("path").alias("file"), "line", F.lit(None).cast("string").alias("type")))
    return out


def caller_of_site(sites: DataFrame, found_callers: DataFrame) -> DataFrame:
    """The first known caller defined in the call site's own file."""
    own = ordering.first_by(found_callers.filter("file is not null"), ["file"], ["line", "name"], ["name", "line"])
    return sites.join(own.select(F.col("file").alias("path"), F.col("name").alias("enclosing_name"),
                                 F.col("line").alias("enclosing_line")), "path", "left")


def neighbourhood(edges: DataFrame, start: str, depth=3) -> DataFrame:
    """Edges met walking down and up from a start, breadth first; edges out of nodes at
    the last depth are still emitted.

    Each round joins the frontier to the edge table and drops visited nodes; lineage is
    cut per round so that the plan stays one join deep and survives lost executors.
    """
    spark = edges.sparkSession
    spec = (("down", "caller", "callee"), ("up", "callee", "caller"))
    visited = frontier = spark.createDataFrame([(start, "down", 0), (start, "up", 0)], "node string, direction string, dist int")
    found = None
    for level in range(depth + 1):
        step = None
        for direction, here, there in spec:
            part = frontier.filter(F.col("direction") == direction) \
                .join(edges, F.col("node") == F.col(here)).select("caller", "callee", "direction", F.col(there).alias("next"))
            step = part if step is None else step.unionByName(part)
        step = ordering.cut_lineage(step)
        layer = step.select("caller", "callee", F.lit(level).alias("depth"))
        found = layer if found is None else found.unionByName(layer)
        fresh = step.select(F.col("next").alias("node"), "direction").distinct() \
            .join(visited.select("node", "direction"), ["node", "direction"], "left_anti") \
            .withColumn("dist", F.lit(level + 1))
        fresh = ordering.cut_lineage(fresh)
        if level == depth or fresh.isEmpty():
            break
        visited, frontier = visited.unionByName(fresh), fresh
    return found.groupBy("caller", "callee").agg(F.min("depth").alias("depth"))


def nodes_of(sub: DataFrame) -> DataFrame:
    return sub.select(F.explode(F.array("caller", "callee")).alias("name")).distinct()


def entry_points(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("caller").alias("name")).agg(F.count("*").alias("call_count"))
    called = edges.select(F.col("callee").alias("name"))
    return out.join(called, "name", "left_anti").join(first_definitions(definitions), "name")


def leaf_functions(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    into = edges.groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("caller_count"))
    calls = edges.select(F.col("caller").alias("name"))
    return into.join(calls, "name", "left_anti").join(first_definitions(definitions), "name")


def call_paths(edges: DataFrame, source: str, target: str, max_depth=10) -> DataFrame:
    """Simple paths from source to target by rounds of edge joins.

    Only nodes that can still reach the target in the remaining steps are extended, so
    dead branches never enter a round; every path is kept.
    """
    spark = edges.sparkSession
    seed = spark.createDataFrame([([source],)], "path array<string>")
    if source == target:
        return seed.withColumn("length", F.lit(1))
    # nodes within k steps of the target, k = 0..max_depth-1
    near = spark.createDataFrame([(target, 0)], "node string, steps int")
    ring = near
    for k in range(1, max_depth):
        ring = edges.join(ring, F.col("callee") == F.col("node")).select(F.col("caller").alias("node")).distinct() \
            .join(near.select("node"), "node", "left_anti").withColumn("steps", F.lit(k))
        ring = ordering.cut_lineage(ring)
        if ring.isEmpty():
            break
        near = near.unionByName(ring)
    near = ordering.cut_lineage(near)
    open_paths, done = seed, None
    for k in range(1, max_depth + 1):
        tail = F.element_at("path", -1)
        grown = open_paths.withColumn("tail", tail).join(edges.select("caller", "callee"), F.col("tail") == F.col("caller")) \
            .filter(~F.array_contains("path", F.col("callee"))) \
            .join(near, F.col("callee") == F.col("node")).filter(F.col("steps") <= max_depth - k) \
            .select(F.array_append("path", F.col("callee")).alias("path"))
        grown = ordering.cut_lineage(grown)
        hit = grown.filter(F.element_at("path", -1) == target)
        done = hit if done is None else done.unionByName(hit)
        open_paths = grown.filter(F.element_at("path", -1) != target)
        if open_paths.isEmpty():
            break
    return done.withColumn("length", F.size("path"))


def degree_stats(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("caller").agg(F.count("*").alias("n"))
    into = edges.groupBy("callee").agg(F.count("*").alias("n"))
    big_in = into.agg(F.max("n").alias("n"), F.max_by("callee", F.struct("n", "callee")).alias("f"))
    return out.agg(F.count("*").alias("functions"), F.sum("n").alias("edges"),
                   (F.sum("n") / F.greatest(F.count("*"), F.lit(1))).alias("avg_out_degree"),
                   F.max("n").alias("max_out_degree"),
                   F.max_by("caller", F.struct("n", "caller")).alias("max_out_function")) \
        .select("*", big_in.select("n").scalar().alias("max_in_degree"), big_in.select("f").scalar().alias("max_in_function"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in a node set (name)."""
    m = members.select("name")
    return edges.join(m.withColumnRenamed("name", "caller"), "caller", "left_semi") \
        .join(m.withColumnRenamed("name", "callee"), "callee", "left_semi").select("caller", "callee")


def mermaid(sub: DataFrame, max_nodes=50, direction="TB") -> DataFrame:
    """Diagram text of the first nodes (by first caller order) and the edges among them."""
    nodes = ordering.top(nodes_of(sub), ("name",), max_nodes)
    kept = induced(sub, nodes)
    boxes = nodes.agg(F.array_sort(F.collect_list(F.concat(F.lit("    "), text.node_id(F.col("name")), F.lit('["'), F.col("name"),
                                                           F.lit('"]')))).alias("l"))
    arrows = kept.agg(F.array_sort(F.collect_list(F.concat(
        F.lit("    "), text.node_id(F.col("caller")), F.lit(" --> "), text.node_id(F.col("callee"))))).alias("l"))
    return boxes.select(F.concat(F.lit(f"graph {direction}\n"), F.array_join("l", "\n"), F.lit("\n"),
                                 F.array_join(arrows.scalar(), "\n")).alias("diagram"))


def node_model(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """Drawing model: degrees, clamped size and a colour slot per file."""
    ends = edges.select(F.col("caller").alias("name"), F.lit(1).alias("out"), F.lit(0).alias("into")) \
        .unionByName(edges.select(F.col("callee").alias("name"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("name").agg(F.sum("out").alias("callees"), F.sum("into").alias("callers"))
    shown = paths.file_name(F.coalesce("file", F.lit("unknown")))
    return with_symbol(nodes, definitions).select(
        "name", shown.alias("file"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("type", F.lit("function")).alias("type"),
        "callees", "callers", F.greatest(F.lit(5), F.least(F.lit(20), 5 + F.col("callees") + F.col("callers"))).alias("size"))


def file_colours(model: DataFrame, colours=15) -> DataFrame:
    """Colour slot per file: files numbered in name order (a table of distinct files)."""
    files = model.groupBy("file").agg(F.count("*").alias("nodes"))
    return ordering.number_rows(files.withColumn("h", F.xxhash64("file")), "h", ["h", "file"], "n") \
        .select("file", (F.col("n") % colours).cast("int").alias("colour"))
