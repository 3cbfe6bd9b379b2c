"""Queries that run the given tables through Structured Streaming (one pass over what is there)."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidvec.catalog.algebra import book
from braidvec.catalog.common import BINS, ROWS, r6
from braidvec.catalog.encoding import map_layers
from braidvec.catalog.registry import query
from braidvec.catalog.sources import scratch
from braidvec.catalog.sqltext import WITH, map_codebook, r6 as sql_r6
from braidvec.schema import EncoderConfig
from braidvec.streaming import streams as S


def _table_stream(t, name: str):
    """A table as a file stream, be it one file or a folder of files. The pattern has this one match; a plain path to a single file
    is refused by the stream's search for partitions."""
    return t.spark.readStream.schema(t.read(name).schema).parquet(f"{t.root}/{name}.parque[t]")


def _event_stream(t):
    """The events table as a file stream: each event stands for one numbered draw."""
    return _table_stream(t, "events")


def _graph_stream(t, folder: str):
    nested = S.nested_graphs(t.nodes, t.edges)
    nested.write.parquet(f"{folder}/graphs")
    return t.spark.readStream.schema(nested.schema).parquet(f"{folder}/graphs")


def _finish(t, stream, folder: str, mode: str = "append"):
    S.write_once(stream, folder, mode)
    return t.spark.read.parquet(f"{folder}/out")


_DRAW = "CAST('0x' || substr(md5(concat_ws('|', '{seed}', event_id)), {at}, 13) AS BIGINT)"


@query("stream_pool_samples", f"WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) SELECT e.event_id, p.p_partkey FROM events e JOIN p ON p.pos = {_DRAW.format(seed=5, at=1)} % (SELECT count(*) FROM part)")
def _(t):
    pool, n = S.index_pool(t.read("part").select("p_partkey"), ["p_partkey"])
    out = S.stream_pool_samples(_event_stream(t), pool, n, 5, "event_id")
    return _finish(t, out.select("event_id", "p_partkey"), scratch(t))


@query(
    "mix_streams",
    f"""WITH p AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part), c AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
    e AS (SELECT event_id, CASE WHEN ({_DRAW.format(seed=6, at=1)} + 0.5) / 4503599627370496.0 < 0.8 THEN 'part' ELSE 'customer' END AS source, {_DRAW.format(seed=6, at=14)} AS h FROM events)
    SELECT event_id, source, p.k FROM e JOIN p ON source = 'part' AND p.pos = h % (SELECT count(*) FROM part) UNION ALL SELECT event_id, source, c.k FROM e JOIN c ON source = 'customer' AND c.pos = h % (SELECT count(*) FROM customer)""",
)
def _(t):
    pools = {
        "part": S.index_pool(t.read("part").select(F.col("p_partkey").alias("k")), ["k"]),
        "customer": S.index_pool(t.read("customer").select(F.col("c_custkey").alias("k")), ["k"]),
    }
    out = S.mix_streams(_event_stream(t), pools, {"part": 4.0, "customer": 1.0}, 6, "event_id")
    return _finish(t, out.select("event_id", "source", "k"), scratch(t))


@query("take_steps", "SELECT event_id // 32 AS batch_no, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id < 32 * (SELECT count(*) // 64 FROM events) GROUP BY ALL")
def _(t):
    events = t.read("events")
    steps = events.count() // 64
    return S.take_steps(events, 32, steps, "event_id").groupBy("batch_no").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_EPOCH_STEPS = 8


@query(
    "run_epoch",
    f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos, -(-count(*) OVER () // {_EPOCH_STEPS}) AS size FROM events)
    SELECT pos // size AS batch_no, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, round(sum(value), 4) AS total FROM p GROUP BY ALL""",
)
def _(t):
    """All events in a fixed number of micro-batches."""
    folder, events = scratch(t), t.read("events").select("event_id", "value")
    size = -(-events.count() // _EPOCH_STEPS)

    def step(rows, number):
        sums = rows.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.round(F.sum("value"), 4).alias("total"))
        sums.write.mode("overwrite").parquet(f"{folder}/out/batch_no={number}")

    S.run_epoch(events, ["event_id"], size, folder, step)
    out = t.spark.read.parquet(f"{folder}/out")
    return out.withColumn("batch_no", F.col("batch_no").cast("long"))


@query("run_novel", "SELECT DISTINCT CAST(l_shipdate AS VARCHAR) AS day FROM lineitem WHERE l_shipdate IS NOT NULL AND l_shipdate NOT IN (SELECT o_orderdate FROM orders WHERE o_orderdate IS NOT NULL)")
def _(t):
    """Ship dates on which nothing was ordered, each once, from a stream of several micro-batches."""
    folder = scratch(t)
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("day")
    S.write_key_store(t.read("orders").select(day("o_orderdate")), "day", f"{folder}/store", 16)
    t.read("lineitem").select(day("l_shipdate")).repartition(4).write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema("day string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    S.run_novel(stream, "day", f"{folder}/store", 16, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out").select("day")


_CHECK = f"""{WITH}, s AS (SELECT graph_id, count(*) AS k, bool_or(f0 = 2) AS odd, bool_or(degree > 0) AS has FROM nodes GROUP BY ALL),
ck AS (SELECT graph_id, CASE WHEN k > 8 THEN 'oversized' WHEN odd THEN 'unsupported' WHEN NOT has THEN 'no_edges' ELSE 'valid' END AS reason FROM s)"""


@query("stream_validate", f"{_CHECK} SELECT graph_id, reason FROM ck")
def _(t):
    folder = scratch(t)
    checked = S.stream_validate(_graph_stream(t, folder), 8, [0, 1])
    return _finish(t, checked.select("graph_id", "reason"), folder)


@query("stream_rejections", f"{_CHECK} SELECT reason, count(*) AS cnt FROM ck GROUP BY ALL")
def _(t):
    folder = scratch(t)
    checked = S.stream_validate(_graph_stream(t, folder), 8, [0, 1])
    return _finish(t, S.stream_rejections(checked), folder, "complete")


_UNIT = EncoderConfig(bins=BINS, dim=8, depth=2, vsa="MAP", seed=42, normalize=False)


@query(
    "stream_encode",
    f"""{WITH}, {map_codebook('cb', ROWS, 8, 42)}, {map_layers(2, False)}
    SELECT graph_id, d, CAST(sum(v) AS BIGINT) AS v FROM s0 GROUP BY ALL UNION ALL SELECT graph_id, d + 8, CAST(sum(v) AS BIGINT) FROM alls GROUP BY ALL""",
)
def _(t):
    folder = scratch(t)
    encoded = S.stream_encode(_graph_stream(t, folder), _UNIT, book(t, "MAP", 8))
    out = _finish(t, encoded, folder).select("graph_id", F.posexplode("vector").alias("d", "v"))
    return out.select("graph_id", F.col("d").cast("long").alias("d"), F.rint("v").cast("long").alias("v"))


@query("stream_novel", "SELECT DISTINCT md5(lower(trim(text))) AS key FROM documents WHERE doc_id % 3 <> 0 AND md5(lower(trim(text))) NOT IN (SELECT md5(lower(trim(text))) FROM documents WHERE doc_id % 3 = 0)")
def _(t):
    docs = t.read("documents")
    stream = _table_stream(t, "documents")
    key = F.md5(F.lower(F.trim("text"))).alias("key")
    fresh = S.stream_novel(stream.filter("doc_id % 3 <> 0").select(key), docs.filter("doc_id % 3 = 0").select(key), "key")
    return _finish(t, fresh, scratch(t))


@query(
    "buffer_stats",
    f"""WITH l AS (SELECT event_type, list(value ORDER BY ts, event_id)[-10:] AS tail, min(value) AS min, max(value) AS max, avg(value) AS mean FROM events GROUP BY ALL)
    SELECT event_type, min, max, {sql_r6('mean')} AS mean, round(list_sum(tail), 4) AS last_sum, len(tail) AS last_n, tail[1] AS last_first, {sql_r6('100 * mean / 500')} AS utilization_pct FROM l""",
)
def _(t):
    out = S.buffer_stats(t.read("events"), "event_type", "value", ["ts", "event_id"], 500)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return out.select(
        "event_type", "min", "max", r6("mean").alias("mean"), F.round(total, 4).alias("last_sum"), F.size("samples").cast("long").alias("last_n"),
        F.get("samples", F.lit(0)).alias("last_first"), r6("utilization_pct").alias("utilization_pct"),
    )
