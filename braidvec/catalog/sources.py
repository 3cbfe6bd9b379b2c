"""Queries that write the given tables to files and read them back with the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from braidvec.catalog.common import BINS, long_rows
from braidvec.catalog.registry import query
from braidvec.catalog.sqltext import WITH, map_codebook
from braidvec.operators import codebook as C
from braidvec.operators import encode as E
from braidvec.schema import EncoderConfig, WalkConfig
from braidvec.session import ensure_checkpoint_dir
from braidvec.sources import io


def scratch(t) -> str:
    """A new folder next to the session's checkpoints, reachable by all executors."""
    return f"{ensure_checkpoint_dir(t.spark)}/work-{uuid.uuid4().hex}"


_LINES = "ln AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS line FROM documents)"
_KEY = r"regexp_extract(line, '(\S+)', 1)"
_KEEP = f"{_KEY} <> '' AND NOT contains({_KEY}, '.') AND lower(trim(line)) <> 'smiles'"


@query("read_key_lines", f"WITH {_LINES} SELECT {_KEY} AS key, count(*) AS cnt FROM ln WHERE {_KEEP} GROUP BY ALL")
def _(t):
    folder = scratch(t)
    t.read("documents").select("text").write.text(folder)
    return io.read_key_lines(t.spark, folder).groupBy("key").agg(F.count("*").alias("cnt"))


_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END"


@query("read_splits", f"WITH {_LINES} SELECT {_SPLIT} AS split, {_KEY} AS key, count(*) AS cnt FROM ln WHERE {_KEEP} GROUP BY ALL")
def _(t):
    folder = scratch(t)
    marked = t.read("documents").select("text", F.expr(_SPLIT).alias("split"))
    for name in io.SPLITS:
        marked.filter(F.col("split") == name).select("text").write.text(f"{folder}/{name}_smile.txt")
    return io.read_splits(t.spark, folder).groupBy("split", "key").agg(F.count("*").alias("cnt"))


@query("read_pool_csv", "SELECT c_custkey::VARCHAR AS source, trim(c_name) AS smiles FROM customer WHERE c_custkey % 7 <> 0")
def _(t):
    folder = scratch(t)
    name = F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    rows = t.read("customer").select(name.alias("smiles"), F.col("c_custkey").cast("string").alias("source"))
    rows.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder, header=True)
    return io.read_pool_csv(t.spark, folder)


@query("write_graphs", f"{WITH}, g AS (SELECT graph_id FROM nodes GROUP BY graph_id HAVING graph_id % 10 = 8) SELECT n.graph_id, n.node_id, n.feat, CAST(n.degree AS BIGINT) AS degree FROM idx_nodes n JOIN g USING (graph_id)")
def _(t):
    from braidvec.catalog.common import text
    from braidvec.operators.graphs import degrees

    folder = scratch(t)
    split = F.expr(_SPLIT.replace("doc_id", "graph_id"))
    graphs = t.nodes.select("graph_id").distinct().withColumn("split", split)
    io.write_graphs(folder, graphs, t.nodes, t.bonds)
    _, nodes, edges = io.read_graphs(t.spark, folder, "valid")
    return nodes.join(degrees(nodes, edges), ["graph_id", "node_id"]).select("graph_id", "node_id", text().alias("feat"), "degree")


@query("save_encoder", f"{WITH}, {map_codebook('cb', 180, 16, 42)} SELECT n.graph_id, cb.d, CAST(sum(v) AS BIGINT) AS v FROM idx_nodes n JOIN cb USING (idx) GROUP BY ALL")
def _(t):
    folder = scratch(t)
    cfg = EncoderConfig(bins=BINS, dim=16, depth=2, vsa="MAP", walk=WalkConfig(ks=(2, 6), num_bins=3, boundaries={2: (0.3, 0.5)}, clip=(0.0, 0.5)))
    io.save_encoder(folder, cfg, {"nodes": C.make_codebook(t.spark, BINS, 16, "MAP", 42)}, t.spark)
    loaded, books = io.load_encoder(t.spark, folder, "graph")
    if loaded != cfg:
        raise AssertionError("the configuration changed on its way")
    return long_rows(E.node_terms(t.nodes, books["nodes"]), ["graph_id"], "node_terms", integer=True)


@query("append_new", "SELECT md5(lower(trim(text))) AS key, count(*) > 0 AS present FROM documents GROUP BY ALL")
def _(t):
    folder = scratch(t)
    keys = t.read("documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("key"))
    first = io.append_new(t.spark, folder, keys.filter("doc_id % 2 = 0"), "key")
    second = io.append_new(t.spark, folder, keys, "key")
    again = io.append_new(t.spark, folder, keys, "key")
    if again or first + second != t.spark.read.parquet(folder).count():
        raise AssertionError("a key was appended twice")
    return t.spark.read.parquet(folder).select("key", F.lit(True).alias("present"))


@query("write_report", "SELECT p_type, count(*) AS n, CAST(max(p_retailprice) AS VARCHAR) AS top FROM part GROUP BY ALL")
def _(t):
    folder = scratch(t)
    part = t.read("part")
    summary = part.groupBy("p_type").agg(F.count("*").alias("n"))
    io.write_report(folder, summary, part.select("p_type", "p_retailprice"))
    back = t.spark.read.schema("p_type string, n long").json(f"{folder}/summary")
    detail = t.spark.read.schema("p_type string, price double").csv(f"{folder}/detail", header=True)
    return back.join(detail.groupBy("p_type").agg(F.max("price").cast("string").alias("top")), "p_type")
