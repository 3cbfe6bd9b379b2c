"""Reading and writing the file formats of the graph collections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidvec.operators.codebook import Codebook, make_codebook
from braidvec.schema import EncoderConfig

SPLITS = ("train", "valid", "test")
HEADER = "smiles"


def read_key_lines(spark: SparkSession, path: str, header: str = HEADER) -> DataFrame:
    """First token of every line: no header line, no blank line, no key with a '.' (disconnected)."""
    lines = spark.read.text(path).filter(F.lower(F.trim("value")) != header)
    keys = lines.select(F.regexp_extract("value", r"(\S+)", 1).alias("key"))
    return keys.filter((F.col("key") != "") & ~F.contains("key", F.lit(".")))


def read_splits(spark: SparkSession, root: str, names: Sequence[str] = SPLITS, pattern: str = "{}_smile.txt") -> DataFrame:
    """Keys of several splits with a ``split`` column; a name outside train, valid and test raises."""
    unknown = [n for n in names if n not in SPLITS]
    if unknown:
        raise ValueError(f"unknown split {unknown}; known: {SPLITS}")
    out = None
    for name in names:
        part = read_key_lines(spark, f"{root}/{pattern.format(name)}").withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def read_pool_csv(spark: SparkSession, path: str, column: str = HEADER) -> DataFrame:
    """CSV with a key column: stripped, empty keys dropped."""
    df = spark.read.csv(path, header=True, multiLine=False)
    if column not in df.columns:
        raise ValueError(f"column {column!r} is missing; found {df.columns}")
    return df.withColumn(column, F.trim(column)).filter(F.col(column).isNotNull() & (F.col(column) != ""))


def write_graphs(root: str, graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
    """Processed-graph cache: three parquet tables, all partitioned by split."""
    graphs.write.mode("overwrite").partitionBy("split").parquet(f"{root}/graphs")
    split_of = graphs.select("graph_id", "split")
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows.join(split_of, "graph_id", "left").write.mode("overwrite").partitionBy("split").parquet(f"{root}/{name}")


def read_graphs(spark: SparkSession, root: str, split: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, nodes, edges), of one split when named; the split filter prunes partitions."""
    if split is not None and split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; known: {SPLITS}")
    graphs, nodes, edges = (spark.read.parquet(f"{root}/{name}") for name in ("graphs", "nodes", "edges"))
    if split is not None:
        graphs, nodes, edges = (df.filter(F.col("split") == split) for df in (graphs, nodes, edges))
    return graphs, nodes.drop("split"), edges.drop("split")


def save_encoder(root: str, cfg: EncoderConfig, codebooks: Mapping[str, Codebook], spark: SparkSession) -> None:
    """Whole configuration as one JSON row, and one parquet table per codebook."""
    row = [(cfg.kind, cfg.to_json(), sorted(codebooks))]
    spark.createDataFrame(row, "kind string, config string, books array<string>").coalesce(1).write.mode("overwrite").json(f"{root}/config")
    for name, book in codebooks.items():
        book.table.write.mode("overwrite").parquet(f"{root}/codebook_{name}")


def load_encoder(spark: SparkSession, root: str, kind: str | None = None) -> tuple[EncoderConfig, dict[str, Codebook]]:
    """Configuration and codebooks; with ``kind`` given, another kind of encoder is rejected."""
    row = spark.read.schema("kind string, config string, books array<string>").json(f"{root}/config").first()
    if kind is not None and row["kind"] != kind:
        raise ValueError(f"the folder holds an encoder of kind {row['kind']!r}, not {kind!r}")
    cfg = EncoderConfig.from_json(row["config"])
    books = {}
    for name in row["books"]:
        table = spark.read.parquet(f"{root}/codebook_{name}")
        bins, dim, _ = _book_shape(cfg, name)
        books[name] = Codebook(table, bins, dim, cfg.vsa, table.count())
    return cfg, books


def _book_shape(cfg: EncoderConfig, name: str) -> tuple[tuple[int, ...], int, int]:
    """(bins, dim, seed) of a codebook of an encoder: ``nodes``, ``full`` or ``member_<i>``."""
    if name == "full":
        return cfg.all_bins(), cfg.members[0][0] if cfg.members else cfg.dim, cfg.seed + 1000
    if name.startswith("member_"):
        i = int(name.removeprefix("member_"))
        return cfg.bins, cfg.members[i][0], cfg.seed + i
    return cfg.bins, cfg.dim, cfg.seed


def encoder_codebooks(spark: SparkSession, cfg: EncoderConfig) -> dict[str, Codebook]:
    """The codebooks an encoder of this configuration uses: ``nodes``, or one ``member_<i>`` for each member of an ensemble with
    its own size and seed, and ``full`` when walk bins are on."""
    names = [f"member_{i}" for i in range(len(cfg.members))] or ["nodes"]
    if cfg.walk is not None:
        names.append("full")
    shapes = {name: _book_shape(cfg, name) for name in names}
    return {name: make_codebook(spark, bins, dim, cfg.vsa, seed) for name, (bins, dim, seed) in shapes.items()}


def append_new(spark: SparkSession, target: str, df: DataFrame, key: str) -> int:
    """Append rows with unseen keys (one per key) to a parquet table; returns how many. The new rows are written once to
    the shared checkpoint folder first, so that a retried task cannot see its own output as already present."""
    from braidvec.session import cut_lineage

    fresh = df.dropDuplicates([key])
    try:
        seen = spark.read.parquet(target).select(key)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        fresh = fresh.join(seen, key, "left_anti")
    fresh = cut_lineage(fresh)
    fresh.write.mode("append").parquet(target)
    return fresh.count()


def write_report(root: str, summary: DataFrame, detail: DataFrame) -> None:
    """Summary as JSON, details as CSV with a header."""
    summary.write.mode("overwrite").json(f"{root}/summary")
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in detail.schema]
    detail.select(*flat).write.mode("overwrite").csv(f"{root}/detail", header=True)
