"""Text forms of tables: alignments, graphs, lists of links, ends and blocked reads, JSON, and reports. Parquet is the form between stages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import name_of, node_of
from ..schemas import ALIGNMENT

c = F.col
FIELDS = [x.split()[0] for x in ALIGNMENT.split(", ")]


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of coordinate tables (one file, a folder or a glob): columns split by bars and blanks, headers left out."""
    text = spark.read.text(path).where(r"value rlike '^\\s*[0-9]+\\s+[0-9]+\\s+\\|'")
    x = F.split(F.trim(F.regexp_replace("value", r"\|", " ")), r"\s+")
    kinds = [k.split()[1] for k in ALIGNMENT.split(", ")]
    return text.select(*(x[i].cast(kind).alias(name) for i, (name, kind) in enumerate(zip(FIELDS, kinds, strict=True))))


def write_alignments(aln: DataFrame, path: str) -> None:
    bar = F.lit(" | ")
    row = F.concat(F.concat_ws(" ", "s1", "e1"), bar, F.concat_ws(" ", "s2", "e2"), bar, F.concat_ws(" ", "len1", "len2"), bar, c("idy").cast("string"), bar, F.concat_ws("\t", "ref", "qry"))
    aln.select(row.alias("value")).write.mode("overwrite").text(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, members, overlaps, visited) and edges (src, dst, wt, ord) of lines id;members;overlaps;prev;next;visited, where prev and next are
    lists of node-weight."""
    x = F.split("value", ";")
    longs = lambda t, kind: F.transform(F.filter(F.split(t, ","), lambda v: v != ""), lambda v: v.cast(kind))
    rows = spark.read.text(path).where("trim(value) <> ''").select(x[0].cast("long").alias("id"), longs(x[1], "long").alias("members"), longs(x[2], "int").alias("overlaps"), x[3].alias("prev"), x[4].alias("next"), (x[5] == "1").alias("visited"))
    each = rows.select(c("id").alias("src"), F.posexplode(F.filter(F.split("next", ","), lambda v: v != "")).alias("ord", "e"))
    edges = each.select("src", F.split_part("e", F.lit("-"), F.lit(1)).cast("long").alias("dst"), F.split_part("e", F.lit("-"), F.lit(2)).cast("int").alias("wt"), c("ord").cast("long").alias("ord"))
    return rows.select("id", "members", "overlaps", "visited"), edges


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same lines (value) from nodes and edges."""
    part = lambda key, other, name: edges.groupBy(c(key).alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", other, "wt"))), lambda e: F.concat_ws("-", e[other], e["wt"])), ",").alias(name))
    text = lambda k: F.array_join(F.transform(k, lambda v: v.cast("string")), ",")
    rows = nodes.join(part("dst", "src", "prev"), "id", "left").join(part("src", "dst", "next"), "id", "left")
    none = F.lit("")
    return rows.select(F.concat_ws(";", "id", text("members"), text("overlaps"), F.coalesce("prev", none), F.coalesce("next", none), F.coalesce(c("visited").cast("int").cast("string"), F.lit("0"))).alias("value"))


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """index, connector (null for -1), overlap."""
    rows = spark.read.schema("index long, connector long, overlap int").csv(path)
    return rows.withColumn("connector", F.when(c("connector") != -1, c("connector")))


def read_open_ends(spark: SparkSession, path: str) -> DataFrame:
    """name, no_prev, no_next of lines name,noprev or name,nonext."""
    rows = spark.read.schema("name string, kind string").csv(path)
    return rows.groupBy("name").agg(F.bool_or(c("kind") == "noprev").alias("no_prev"), F.bool_or(c("kind") == "nonext").alias("no_next"))


def read_blocked_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, l1, l2 of lines 12_p;7_d;len;len."""
    rows = spark.read.option("sep", ";").schema("a string, b string, l1 int, l2 int").csv(path)
    return rows.select(node_of("a").alias("src"), node_of("b").alias("dst"), "l1", "l2")


def read_map(spark: SparkSession, path: str, key: str, value: str, kind: str) -> DataFrame:
    """A JSON object as rows (key, value of the given type)."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.explode(F.from_json("value", f"map<string, {kind}>")).alias(key, value))


def write_map(rows: DataFrame, path: str, key: str, value: str) -> None:
    """Rows as JSON lines of one pair each; read with spark.read.json or merged by a reader."""
    rows.select(F.to_json(F.create_map(c(key).cast("string"), c(value))).alias("value")).write.mode("overwrite").text(path)


def scrape_report(spark: SparkSession, path: str) -> DataFrame:
    """file, misassemblies and contigs of assembly reports; null where a line is missing."""
    rows = spark.read.text(path).select(c("_metadata.file_path").alias("file"), "value")
    number = lambda label: F.max(F.regexp_extract("value", rf"^\s*{label}\s+([0-9]+)", 1).try_cast("int"))
    return rows.groupBy("file").agg(number("# misassemblies").alias("misassemblies"), number(r"# contigs \(>= 0 bp\)").alias("contigs"))


def append_log(spark: SparkSession, path: str, row: dict) -> None:
    """One line of a CSV log with a header."""
    text = json.dumps(row)
    kinds = ", ".join(f"{k} string" for k in row)
    spark.range(1).select(F.from_json(F.lit(text), kinds).alias("r")).select("r.*").write.mode("append").option("header", "true").csv(path)


def viewer_edges(edges: DataFrame, contigs: int) -> DataFrame:
    """Edges as lines of names for a graph viewer."""
    return edges.select(F.concat_ws(" ", name_of("src", contigs), name_of("dst", contigs), F.lit("{weight:"), "wt", F.lit("}")).alias("value"))


def joined_pairs(nodes: DataFrame, stage: int, contigs: int) -> DataFrame:
    """(stage, src, dst): neighbouring members of each node, by name."""
    each = nodes.select(F.explode(F.arrays_zip(F.slice("members", F.lit(1), F.size("members") - 1).alias("a"), F.slice("members", F.lit(2), F.greatest(F.size("members") - 1, F.lit(0))).alias("b"))).alias("p"))
    return each.select(F.lit(stage).alias("stage"), name_of("p.a", contigs).alias("src"), name_of("p.b", contigs).alias("dst"))


#: Tables of votes and of segments as CSV with a header.
VOTES = "read string, pos long, kind string, offset int, base string, n long"
SEGMENTS = "contig string, seg_idx int, total double, len int"


def write_table(rows: DataFrame, path: str, schema: str = VOTES) -> None:
    """The columns of schema as CSV with a header."""
    rows.select(*(x.split()[0] for x in schema.split(", "))).write.mode("overwrite").option("header", "true").csv(path)


def read_table(spark: SparkSession, path: str, schema: str = VOTES) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)
