"""Evaluation aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidvec.functions import vsa as V
from braidvec.operators.stats import moments
from braidvec.plans.skew import order_statistics


def _ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale · a / b, zero on an empty denominator."""
    return F.when(b > 0, F.lit(scale) * a / b).otherwise(0.0)


def _key_counts(samples: DataFrame, reference: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """One row of counts. Keys are counted before the reference is looked at, so frequent keys cost one row each."""
    per_key = samples.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in flags.items()])
    known = reference.select(key).distinct().withColumn("_known", F.lit(True))
    joined = per_key.join(known, key, "left")
    out = []
    for name in flags:
        present = (F.col(name) > 0) & F.col(key).isNotNull()
        out += [
            F.coalesce(F.sum(name), F.lit(0)).alias(f"n_{name}"),
            F.count_if(present).alias(f"unique_{name}"),
            F.count_if(present & F.col("_known").isNull()).alias(f"novel_{name}"),
        ]
    return joined.agg(*out)


def generation_metrics(samples: DataFrame, reference: DataFrame, key: str = "key", valid: str = "valid", n_samples: int | None = None) -> DataFrame:
    """Validity, uniqueness, novelty (over the valid ones) and novel-unique-valid share, all in percent."""
    flags = {"valid": F.col(valid), "all": F.lit(True)}
    c = _key_counts(samples, reference, key, flags)
    n = F.col("n_all") if n_samples is None else F.lit(n_samples)
    return c.select(
        n.alias("n_samples"), "n_valid",
        _ratio(F.col("n_valid"), n, 100.0).alias("validity"),
        _ratio(F.col("unique_valid"), F.col("n_valid"), 100.0).alias("uniqueness"),
        _ratio(F.col("novel_valid"), F.col("n_valid"), 100.0).alias("novelty"),
        _ratio(F.col("novel_valid"), n, 100.0).alias("nuv"),
    )


def optimization_metrics(samples: DataFrame, reference: DataFrame, key: str = "key", valid: str = "valid") -> DataFrame:
    """The same as fractions, with novelty over the unique ones."""
    c = _key_counts(samples, reference, key, {"valid": F.col(valid), "all": F.lit(True)})
    return c.select(
        "n_valid", F.col("unique_valid").alias("n_unique"), F.col("novel_valid").alias("n_novel"),
        _ratio(F.col("n_valid"), F.col("n_all")).alias("validity"),
        _ratio(F.col("unique_valid"), F.col("n_valid")).alias("uniqueness"),
        _ratio(F.col("novel_valid"), F.col("unique_valid")).alias("novelty"),
    )


def conditional_metrics(samples: DataFrame, reference: DataFrame, target: float, eps: float, key: str = "key", value: str = "value", valid: str = "valid", final: str = "final", total_samples: int | None = None) -> DataFrame:
    """Property targeting: one row with the total, valid and hits blocks. Null or NaN properties are left out of the errors."""
    usable = F.col(valid) & F.col(value).isNotNull() & ~F.isnan(value)
    error = F.abs(F.col(value) - target)
    hit = usable & (error <= eps)
    sums = samples.agg(
        F.count("*").alias("n_samples"), F.count_if(F.col(final)).alias("n_final"), F.count_if(F.col(valid)).alias("n_valid"),
        F.count_if(usable).alias("n_valid_non_nan"), F.avg(F.when(usable, error)).alias("mae_to_target"),
        F.sqrt(F.avg(F.when(usable, error * error))).alias("rmse_to_target"),
        F.count_if(hit).alias("n_hits"), F.count_if(hit & F.col(final)).alias("n_final_hits"),
    ).first()
    counts = _key_counts(samples, reference, key, {"valid": F.col(valid), "hit": hit})
    total = F.lit(sums["n_samples"] if total_samples is None else total_samples)
    lit = {k: F.lit(v) for k, v in sums.asDict().items()}
    den = lit["n_valid_non_nan"]
    return counts.select(
        total.alias("total_samples"), _ratio(lit["n_valid"], total, 100.0).alias("validity_pct"), _ratio(lit["n_final"], total, 100.0).alias("final_pct"),
        lit["n_valid"].alias("n_valid"), den.alias("n_valid_non_nan"), lit["mae_to_target"].cast("double").alias("mae_to_target"),
        lit["rmse_to_target"].cast("double").alias("rmse_to_target"), _ratio(lit["n_hits"], den, 100.0).alias("success_at_eps_pct"),
        _ratio(lit["n_final_hits"], den, 100.0).alias("final_success_at_eps_pct"),
        _ratio(F.col("unique_valid"), lit["n_valid"], 100.0).alias("uniqueness_pct"), _ratio(F.col("novel_valid"), lit["n_valid"], 100.0).alias("novelty_pct"),
        lit["n_hits"].alias("n_hits"), _ratio(F.col("unique_hit"), lit["n_hits"], 100.0).alias("uniqueness_hits_pct"),
        _ratio(F.col("novel_hit"), lit["n_hits"], 100.0).alias("novelty_hits_pct"),
    )


def property_stats(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population std, min and max of each property."""
    out = []
    for c in columns:
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*keys).agg(*out)


def kl_divergence(gen: DataFrame, ref: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """KL(gen ‖ ref) of smoothed shared histograms: one row (kl); null below ten values on either side."""
    both = gen.select(F.lit(True).alias("_g"), F.col(value).cast("double").alias("_v")).unionByName(
        ref.select(F.lit(False).alias("_g"), F.col(value).cast("double").alias("_v"))
    )
    s = both.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count_if("_g").alias("g"), F.count_if(~F.col("_g")).alias("r")).first()
    spark = gen.sparkSession
    if s["g"] < 10 or s["r"] < 10:
        return spark.range(1).select(F.lit(None).cast("double").alias("kl"))
    eps = (s["hi"] - s["lo"]) * 0.01
    if eps == 0:
        eps = 0.5  # a histogram of equal values spans half a unit to each side
    lo, width = s["lo"] - eps, (s["hi"] - s["lo"] + 2 * eps) / bins
    bin_no = F.least(F.floor((F.col("_v") - lo) / width), F.lit(bins - 1)).cast("long")
    counts = both.groupBy(bin_no.alias("_b")).agg(F.count_if("_g").alias("g"), F.count_if(~F.col("_g")).alias("r"))
    every = spark.range(bins).withColumnRenamed("id", "_b").join(counts, "_b", "left").fillna(0)
    dense = every.select((F.col("g") / (s["g"] * width) + 1e-10).alias("g"), (F.col("r") / (s["r"] * width) + 1e-10).alias("r"))
    # Σ (g/G) ln((g/G)/(r/R)) with G, R the sums, over `bins` rows.
    terms = dense.agg(F.sum("g").alias("_g"), F.sum("r").alias("_r"), F.sum(F.col("g") * F.log(F.col("g") / F.col("r"))).alias("_t"))
    return terms.select((F.col("_t") / F.col("_g") + F.log(F.col("_r") / F.col("_g"))).alias("kl"))


def frechet_distance(a: DataFrame, b: DataFrame, vector: str) -> float:
    """Fréchet distance of the two fitted normals; only D × D matrices reach the driver."""
    ma, mb = moments(a, vector), moments(b, vector)
    ca, cb = ma.covariance(), mb.covariance()
    values, vectors = np.linalg.eigh(ca)
    root = (vectors * np.sqrt(np.maximum(values, 0.0))) @ vectors.T
    inner = np.maximum(np.linalg.eigvalsh(root @ cb @ root), 0.0)
    gap = ma.mean - mb.mean
    return float(gap @ gap + np.trace(ca) + np.trace(cb) - 2 * np.sqrt(inner).sum())


def top_k_mean(df: DataFrame, value: str, k: int) -> DataFrame:
    """One row: mean of the k largest values, null if there are fewer."""
    top = df.filter(F.col(value).isNotNull()).select(value).orderBy(F.desc(value)).limit(k)
    return top.agg(F.when(F.count("*") == k, F.avg(value)).alias("top_mean"))


def composite_score(parts: Sequence[Column]) -> Column:
    """Geometric mean of the parts; 0 if any is not positive, null if any is null."""
    low, total, missing = F.lit(False), F.lit(0.0), F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
        low = low | (p <= 0)
        total = total + F.log(F.when(p > 0, p).otherwise(1.0))
    return F.when(missing, None).when(low, 0.0).otherwise(F.exp(total / len(parts)))


def target_error(df: DataFrame, value: str, target: float, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error and shares strictly within 0.5 and 1.0."""
    e = F.abs(F.col(value) - target)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(*keys).agg(F.avg(e).alias("mae"), share(e < 0.5).alias("within_0_5"), share(e < 1.0).alias("within_1_0"))


def _paired(a: DataFrame, b: DataFrame, keys: Sequence[str], parts: int = 0) -> DataFrame:
    """Sums of ``cnt`` of both tables per keys. The rows of both are brought together once, by the first key, and grouped there; a null
    key is a value like any other."""
    none = lambda df: F.lit(0).cast(df.schema["cnt"].dataType)
    rows = a.select(*keys, F.col("cnt").alias("ca"), none(b).alias("cb")).union(b.select(*keys, none(a).alias("ca"), F.col("cnt").alias("cb")))
    dealt = rows.repartition(parts, keys[0]) if parts else rows.repartition(keys[0])
    return dealt.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ca", "cb")])


def edge_iou(a: DataFrame, b: DataFrame, graph: str = "graph_id", items: Sequence[str] = ("a", "b")) -> DataFrame:
    """Multiset intersection over union of counted items per graph, 0 when both are empty."""
    both = _paired(a, b, [graph, *items])
    union = F.sum(F.greatest("ca", "cb"))
    return both.groupBy(graph).agg(_ratio(F.sum(F.least("ca", "cb")), union).alias("iou"))


def compare_counts(decoded: DataFrame, truth: DataFrame, item: str = "idx", graphs: DataFrame | None = None, parts: int = 0) -> DataFrame:
    """Exact match, missing, extra and totals of two count tables per graph. Rows of equal items are added; ``parts`` sets the number
    of tasks (``session.parts_for``), by default the session's number of partitions."""
    both = _paired(decoded, truth, ["graph_id", item], parts)
    gap = F.col("ca") - F.col("cb")
    out = both.groupBy("graph_id").agg(
        (F.sum(F.abs(gap)) == 0).alias("exact_match"), F.sum(F.greatest(-gap, F.lit(0))).alias("missing"),
        F.sum(F.greatest(gap, F.lit(0))).alias("extra"), F.sum("ca").alias("decoded_total"), F.sum("cb").alias("truth_total"),
    )
    if graphs is None:
        return out
    filled = graphs.select("graph_id").join(out, "graph_id", "left").fillna(0, ["missing", "extra", "decoded_total", "truth_total"])
    return filled.withColumn("exact_match", F.coalesce("exact_match", F.lit(True)))


def accuracy_by_size(df: DataFrame, size: str, flag: str) -> DataFrame:
    """Hit rate (share and percent) and count per size."""
    rate = F.avg(F.when(F.col(flag), 1.0).otherwise(0.0))
    return df.groupBy(size).agg(rate.alias("hit_rate"), F.count("*").alias("count"), (rate * 100).alias("hit_rate_pct"))


def retrieval_summary(df: DataFrame, measures: Sequence[str], level: str, levels: Sequence[str], sim: str, match: str) -> DataFrame:
    """One row: mean and population std of the measures, percent per level, and perfect similarities without a match."""
    out = []
    for m in measures:
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    for name in levels:
        out.append((F.avg(F.when(F.col(level) == name, 1.0).otherwise(0.0)) * 100).alias(f"{level}_{name}_pct"))
    out.append(F.count_if((F.col(sim) == 1.0) & ~F.col(match)).alias("max_sim_non_hits"))
    return df.agg(*out)


def category_frequencies(gen: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Frequencies of two collections over the union of their keys."""
    a = gen.groupBy(key).agg(F.count("*").alias("_a"))
    b = ref.groupBy(key).agg(F.count("*").alias("_b"))
    both = a.join(b, key, "full_outer").fillna(0, ["_a", "_b"])
    totals = both.agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb")).first()
    share = lambda c, t: F.col(c) / F.lit(float(t or 1))
    return both.select(key, share("_a", totals["_ta"]).alias("gen_freq"), share("_b", totals["_tb"]).alias("ref_freq"))


def shared_histogram(gen: DataFrame, ref: DataFrame, value: str, integer: bool = False) -> DataFrame:
    """Counts of both collections in shared bins: (bin, lo, hi, gen, ref). Unit bins around integers, otherwise
    min(30, max(10, int(range) + 1)) equal bins with the last one closed."""
    both = gen.select(F.lit(True).alias("_g"), F.col(value).cast("double").alias("_v")).unionByName(
        ref.select(F.lit(False).alias("_g"), F.col(value).cast("double").alias("_v"))
    )
    s = both.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    spark = gen.sparkSession
    if s["lo"] is None:
        return spark.createDataFrame([(0, 0.0, 1.0, 0, 0)], "bin long, lo double, hi double, gen long, ref long")
    if integer:
        lo, bins, width = s["lo"] - 0.5, int(s["hi"] - s["lo"]) + 1, 1.0
    else:
        lo, bins = s["lo"], min(30, max(10, int(s["hi"] - s["lo"]) + 1))
        width = (s["hi"] - s["lo"]) / bins
    raw = F.floor((F.col("_v") - lo) / width) if width > 0 else F.lit(0)
    counts = both.groupBy(F.least(raw, F.lit(bins - 1)).cast("long").alias("bin")).agg(
        F.count_if("_g").alias("gen"), F.count_if(~F.col("_g")).alias("ref")
    )
    every = spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").fillna(0)
    return every.select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), "gen", "ref")


def structure_profile(nodes: DataFrame, edges: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """Long-form counts (kind, value, cnt): atom, bond, degree and ring sizes, and per-graph numbers of atoms and bonds."""
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("value"))
    bonds = edges.filter("src < dst").groupBy("graph_id").agg(F.count("*").alias("value"))
    bonds = sizes.select("graph_id").join(bonds, "graph_id", "left").fillna(0, ["value"])
    degree = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count("*").alias("value"))
    degree = nodes.select("graph_id", "node_id").join(degree, ["graph_id", "node_id"], "left").fillna(0, ["value"])
    parts = {
        "atom": nodes.select(F.col("feat")[0].alias("value")), "bond": edges.filter("src < dst").select(F.col("bond").alias("value")),
        "degree": degree.select("value"), "num_atoms": sizes.select("value"), "num_bonds": bonds.select("value"),
    }
    if rings is not None:
        one = rings.select("graph_id", "ring_id", "size").distinct()
        parts["ring_size"] = one.select(F.col("size").alias("value"))
        per_graph = one.groupBy("graph_id").agg(F.count("*").alias("value"))
        parts["num_rings"] = sizes.select("graph_id").join(per_graph, "graph_id", "left").fillna(0, ["value"]).select("value")
    out = None
    for kind, rows in parts.items():
        counted = rows.groupBy(F.col("value").cast("long").alias("value")).agg(F.count("*").alias("cnt")).withColumn("kind", F.lit(kind))
        out = counted if out is None else out.unionByName(counted)
    return out.select("kind", "value", "cnt")


def count_summary(profile: DataFrame) -> DataFrame:
    """Min, max, mean and median per kind from counted values."""
    mean = F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")
    middle = F.percentile("value", F.lit(0.5), F.col("cnt"))
    return profile.groupBy("kind").agg(F.min("value").alias("min"), F.max("value").alias("max"), mean.alias("mean"), middle.alias("median"))


def sim_by_flag(df: DataFrame, sim: str, flag: str) -> DataFrame:
    """One row: mean and population std of the similarity for final and non-final samples, zeros when there are none."""
    out = []
    for name, cond in (("final", F.col(flag)), ("nonfinal", ~F.col(flag))):
        out.append(F.coalesce(F.avg(F.when(cond, F.col(sim))), F.lit(0.0)).alias(f"{name}_sim_mean"))
        out.append(F.coalesce(F.stddev_pop(F.when(cond, F.col(sim))), F.lit(0.0)).alias(f"{name}_sim_std"))
    return df.agg(*out)


def rejection_report(df: DataFrame, reason: str, ok: str = "valid") -> DataFrame:
    """Count per reason with the number of attempts and the share of valid ones on every row."""
    counts = df.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("cnt"))
    # One row per reason.
    every = Window.partitionBy()
    attempts = F.sum("cnt").over(every)
    good = F.sum(F.when(F.col("reason") == ok, F.col("cnt")).otherwise(0)).over(every)
    return counts.select("reason", "cnt", attempts.alias("attempts"), (good / attempts).alias("validity_rate"))


def similarity_quantiles(df: DataFrame, sim: str) -> DataFrame:
    """One row: mean, lower median, min, max, and percent above 0.90, 0.95 and 0.99."""
    above = lambda x: F.avg(F.when(F.col(sim) > x, 1.0).otherwise(0.0)) * 100
    _, middle = order_statistics(df, sim, [0.5], "lower")
    return df.agg(
        F.avg(sim).alias("mean"), F.lit(middle[0] if middle else None).cast("double").alias("median"), F.min(sim).alias("min"), F.max(sim).alias("max"),
        above(0.90).alias("pct_above_090"), above(0.95).alias("pct_above_095"), above(0.99).alias("pct_above_099"),
    )


def distribution_match(gen: DataFrame, ref: DataFrame, vector: str) -> DataFrame:
    """One row: mean absolute error and R² of the per-position means and stds, centroid cosine, mean length."""

    def per_position(df: DataFrame, tag: str) -> DataFrame:
        cells = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("d", "_v"))
        return cells.groupBy("d").agg(F.avg("_v").alias(f"m{tag}"), F.stddev_samp("_v").alias(f"s{tag}"))

    both = per_position(gen, "g").join(per_position(ref, "r"), "d")
    gap = lambda c: F.col(f"{c}g") - F.col(f"{c}r")
    r2 = lambda c: 1 - F.sum(gap(c) ** 2) / F.greatest(F.var_pop(f"{c}r") * F.count("*"), F.lit(1e-8))
    length = lambda c: F.greatest(F.sqrt(F.sum(F.col(c) ** 2)), F.lit(V.EPSILON))
    summary = both.agg(
        F.avg(F.abs(gap("m"))).alias("mean_mae"), F.avg(F.abs(gap("s"))).alias("std_mae"), r2("m").alias("mean_r2"), r2("s").alias("std_r2"),
        (F.sum(F.col("mg") * F.col("mr")) / (length("mg") * length("mr"))).alias("centroid_cosine"),
    )
    norm = gen.agg(F.avg(V.norm(F.col(vector).cast("array<double>")))).first()[0]
    return summary.withColumn("mean_norm", F.lit(norm))


def node_decode_accuracy(comparison: DataFrame, dim: str = "dim", split: str = "split") -> DataFrame:
    """Exact-match rate per dim and split, with the overall row of each dim (split 'overall') from a roll-up."""
    hits = F.count_if("exact_match")
    out = comparison.rollup(dim, split).agg(F.grouping(dim).alias("_gd"), F.grouping(split).alias("_gs"), hits.alias("matches"), F.count("*").alias("total"))
    kept = out.filter("_gd = 0").withColumn(split, F.when(F.col("_gs") == 1, "overall").otherwise(F.col(split)))
    return kept.select(dim, split, "matches", "total", _ratio(F.col("matches"), F.col("total")).alias("accuracy"))


def reconstruction_summary(df: DataFrame, valid: str, match: str, nodes_ok: str, tanimoto: str) -> DataFrame:
    """One row: counts and rates of valid, matching and node-count-correct samples; mean and median Tanimoto."""
    out = [F.count("*").alias("num_samples")]
    for name, c in (("valid", valid), ("match", match), ("node_decode", nodes_ok)):
        out += [F.count_if(F.col(c)).alias(f"{name}_count"), F.avg(F.when(F.col(c), 1.0).otherwise(0.0)).alias(f"{name}_rate")]
    _, middle = order_statistics(df, tanimoto, [0.5])
    out += [F.coalesce(F.avg(tanimoto), F.lit(0.0)).alias("mean_tanimoto"), F.lit(middle[0] if middle else 0.0).alias("median_tanimoto")]
    return df.agg(*out)


def edge_cross_entropy(predicted: DataFrame, true: DataFrame, per_graph: bool = False, classes: int = 5) -> DataFrame:
    """One row (loss): −Σ true·ln p over off-diagonal pairs; flat mean, or mean of the graph means; 0 without pairs.

    ``predicted`` has (graph_id, src, dst, probs); ``true`` has (graph_id, src, dst, bond), missing pairs being class 0."""
    real = true.filter("src <> dst").select("graph_id", "src", "dst", "bond")
    joined = predicted.filter("src <> dst").join(real, ["graph_id", "src", "dst"], "left")
    chosen = F.get("probs", F.coalesce("bond", F.lit(0)))
    loss = joined.select("graph_id", (-F.log(chosen)).alias("_l"))
    if per_graph:
        loss = loss.groupBy("graph_id").agg(F.avg("_l").alias("_l"))
    return loss.agg(F.coalesce(F.avg("_l"), F.lit(0.0)).alias("loss"))
