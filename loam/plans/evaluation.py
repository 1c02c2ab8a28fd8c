"""Queries of metrics, statistics, splits and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import expr as E
from loam.operators import metrics, ml, ranked, spatial
from loam.operators.lineage import cut
from loam.operators.relational import keep_first
from loam.plans import views as V
from loam.plans.registry import query
from loam.sources.tables import table

_CURVE_SQL = """c as (select {g} score, count(*) n, sum(y) pos from {t} group by {gn} score), w as (select *, sum(n) over ({p} order by score desc) upto, sum(pos) over ({p} order by score desc) tp from c)"""


def _curve(t: str = "pu", groups: str = "") -> str:
    return _CURVE_SQL.format(t=t, g=groups + "," if groups else "", gn=groups + "," if groups else "", p=f"partition by {groups}" if groups else "")


_AUC = "sum((n - pos) * (tp - pos / 2)) / (sum(pos) * (sum(n) - sum(pos))) auc, sum(pos * tp / upto) / sum(pos) ap"
#: All feature columns of grid_features_static; effort is n_plant_effort.
FEATURES = ["bio_01", "elevation_m", "effort", "bio_12", "slope_deg", "dist_river_m", "dist_road_m", "dist_settlement_m", "network_distance_to_infected_km"]
FOLDS, REPEATS = 5, 20
#: The subsets of the reference as far as the table has their columns: effort goes with roads, and of connectivity there is one column.
_EFFORT, _CONNECTIVITY = {"effort", "dist_road_m"}, {"network_distance_to_infected_km"}
SUBSETS = {
    "all": FEATURES, "no_effort": [f for f in FEATURES if f not in _EFFORT], "no_connectivity": [f for f in FEATURES if f not in _CONNECTIVITY],
    "no_effort_no_connectivity": [f for f in FEATURES if f not in _EFFORT | _CONNECTIVITY], "climate": ["bio_01", "bio_12"],
}


@query(f"with {V.PU_SQL}, {_curve()}, l as (select avg(-y * ln(greatest(least(score, 1 - 1e-7), 1e-7)) - (1 - y) * ln(1 - greatest(least(score, 1 - 1e-7), 1e-7))) loss from pu) select cast(sum(n) as bigint) n, cast(sum(pos) as bigint) n_pos, round(max(auc), 6) auc, round(max(ap), 6) ap, round(max(loss), 6) log_loss from (select sum(n) n, sum(pos) pos, {_AUC} from w), l")
def auc_ap_logloss(spark: SparkSession, d: str) -> DataFrame:
    """Area under the ROC curve, average precision and log loss, exact with ties."""
    p = V.pu(spark, d)
    m = metrics.ranking_metrics(p, "score", F.col("y")).first()
    loss = p.agg(metrics.log_loss(F.col("score"), F.col("y") == 1).alias("l")).first()["l"]
    return spark.createDataFrame([(m["n"], m["n_pos"], round(m["auc"], 6), round(m["ap"], 6), round(loss, 6))], "n bigint, n_pos bigint, auc double, ap double, log_loss double")


@query(f"with {V.PU_SQL}, {_curve()} select score, cast(tp as bigint) tp, cast(upto as bigint) upto, round(tp / upto, 8) \"precision\", round(tp / (select sum(y) from pu), 8) recall from w")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall at every distinct score."""
    p = V.pu(spark, d)
    total = p.agg(F.sum("y")).first()[0]
    c = metrics.score_curve(p, "score", F.col("y"))
    return c.select("score", "tp", "upto", F.round(F.col("tp") / F.col("upto"), 8).alias("precision"), F.round(F.col("tp") / total, 8).alias("recall"))


_GROUP_SQL = f"{V.PU_SQL}, {_curve('pu', 'grp')}, g as (select grp, cast(sum(n) as bigint) n, cast(sum(pos) as bigint) n_pos, case when sum(pos) >= 2 and sum(pos) < sum(n) then sum((n - pos) * (tp - pos / 2)) / (sum(pos) * (sum(n) - sum(pos))) end auc, case when sum(pos) >= 2 and sum(pos) < sum(n) then sum(pos * tp / upto) / sum(pos) end ap from w group by 1)"


@query(f"with {_GROUP_SQL} select grp, n, n_pos, round(auc, 6) auc, round(ap, 6) ap from g")
def auc_by_group(spark: SparkSession, d: str) -> DataFrame:
    g = metrics.grouped_metrics(V.pu(spark, d), ["grp"], "score", F.col("y"))
    return g.select("grp", "n", "n_pos", F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"))


@query(f"with {_GROUP_SQL} select count(auc) n_groups, round(avg(auc), 6) mean, round(stddev_samp(auc), 6) sd, round(stddev_pop(auc), 6) sd_pop, round(min(auc), 6) lo, round(max(auc), 6) hi from g")
def metric_spread(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviations and range of a metric over groups."""
    g = metrics.grouped_metrics(V.pu(spark, d), ["grp"], "score", F.col("y"))
    return g.agg(F.count("auc").alias("n_groups"), *[F.round(f("auc"), 6).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("sd_pop", F.stddev_pop), ("lo", F.min), ("hi", F.max))])


@query(f"with {V.PU_SQL}, folds as (select *, case when grp < 'VX-20' then 0 when grp < 'VX-30' then 1 else 2 end f from pu), m as (select cell_id, y, case f when 0 then score when 1 then round(score, 2) else score2 end score from folds), {_curve('m')} select cast(sum(n) as bigint) n, cast(sum(pos) as bigint) n_pos, round(max(auc), 6) auc, round(max(ap), 6) ap from (select sum(n) n, sum(pos) pos, {_AUC} from w)")
def pooled_metrics(spark: SparkSession, d: str) -> DataFrame:
    """One metric over the pooled scores of several folds."""
    p = V.pu(spark, d)
    a = p.where("grp < 'VX-20'").select("y", "score")
    b = p.where("grp >= 'VX-20' and grp < 'VX-30'").select("y", F.round("score", 2).alias("score"))
    c = p.where("grp >= 'VX-30'").select("y", F.col("score2").alias("score"))
    m = metrics.ranking_metrics(a.unionByName(b).unionByName(c), "score", F.col("y"))
    return m.select("n", "n_pos", F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"))


@query(f"with {V.PU_SQL}, r as (select *, row_number() over (order by score desc, cell_id) r from pu), k as (select unnest([50, 200, 500]) k), b as (select avg(y) prevalence, sum(y) pos from pu) select cast(k as integer) k, round(sum(y) / count(*), 8) \"precision\", round(sum(y) / max(pos), 8) recall, round(sum(y) / count(*) / max(prevalence), 6) enrichment from k join r on r <= k, b group by 1")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and enrichment of the k best cells: a top-k report."""
    m = metrics.at_k(V.pu(spark, d), "score", F.col("y"), "cell_id", [50, 200, 500])
    return m.select("k", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"), F.round("enrichment", 6).alias("enrichment"))


@query(f"with {V.PU_SQL}, t as (select score t from pu order by score desc limit 1 offset 499) select round(t, 8) threshold, count(*) filter (where score >= t) n, round(100.0 * count(*) filter (where score >= t) / count(*), 6) pct from pu, t group by t")
def nth_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The 500th highest score as a threshold, and the cells that reach it."""
    p = V.pu(spark, d)
    t = ranked.value_at_rank(p, "score", 500)
    return p.agg(F.round(F.lit(t), 8).alias("threshold"), F.count_if(F.col("score") >= t).alias("n"), F.round(100.0 * F.count_if(F.col("score") >= t) / F.count("*"), 6).alias("pct"))


@query(f"with {V.PU_SQL}, r as (select score2, rank() over (order by score2) + (count(*) over (partition by score2) - 1) / 2 r from (select round(score2, 2) score2, cell_id from pu)) select score2, count(*) n, round(max(r) / (select count(*) from pu) * 100, 6) pct from r group by 1")
def pct_rank_avg_ties(spark: SparkSession, d: str) -> DataFrame:
    """Percentile rank of each distinct (rounded) score, ties sharing the mean rank."""
    p = V.pu(spark, d).select(F.round("score2", 2).alias("score2"))
    return ranked.average_ranks(p, "score2", "r").select("score2", "n", F.round(F.col("r") / p.count() * 100, 6).alias("pct"))


@query(f"with {V.PTS_SQL}, b as (select floor(x / 20000) bx, floor(y / 20000) by_, count(*) n from pts group by 1, 2), o as (select *, sum(n) over (order by md5(concat_ws('|', cast(cast(bx as bigint) as varchar), cast(cast(by_ as bigint) as varchar), '42')), bx, by_) - n before from b) select key, coalesce(before < 0.2 * (select count(*) from pts), false) is_test from pts left join o on floor(x / 20000) = bx and floor(y / 20000) = by_")
def block_running_share(spark: SparkSession, d: str) -> DataFrame:
    """Whole 20 km blocks in random order as test rows until they hold a fifth of all."""
    return ml.block_split(V.pts(spark, d), "x", "y", 20000.0, 0.2, 42).select("key", "is_test")


@query(f"with {V.PU_SQL} select cast(bin as integer) bin, count(*) n, round(avg(score), 6) predicted, round(avg(y), 6) observed, round(avg(score) - avg(y), 6) gap from (select *, (select min(k) from (select edge, row_number() over (order by edge) - 1 k from (select distinct unnest(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) edge from pu)) where edge >= score and k > 0) - 1 bin from pu) group by 1")
def reliability_table(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.reliability(V.pu(spark, d), "score", F.col("y"))
    return r.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("predicted", "observed", "gap")])


# two-sided p by Simpson's rule over Student's density, at 4,000 places
_T_TAIL = "greatest(0, 1 - 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * (select sum(case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end * (1 + (t * i / 4000) ** 2 / (n - 2)) ** (-(n - 1) / 2.0)) * t / 12000 from range(4001) r(i)))"


@query(f"with {V.PU_SQL}, s as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 rb from (select round(score, 2) a, elevation_m b from pu where elevation_m is not null)), c as (select count(*) n, corr(ra, rb) rho from s), q as (select n, rho, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) t from c) select n, round(rho, 6) rho, round({_T_TAIL}, 6) p from q")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    p = V.pu(spark, d).select(F.round("score", 2).alias("a"), F.col("elevation_m").alias("b"))
    return metrics.spearman(p, "a", "b").select("n", F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p"))


@query("""with f as (select key, min("month") m from heracleum_ua_clean where label_role = 'target' and "month" is not null and "year" is not null group by 1),
o as (select key, "month", day, "year" from heracleum_ua_clean where label_role = 'target' and "month" between 3 and 11 and "year" is not null qualify row_number() over (partition by key order by "year", "month", day nulls first, ingest_id) = 1),
s as (select "year" v, case when "month" <= 5 then 'spring' when "month" <= 8 then 'summer' else 'autumn' end g from o), r as (select g, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2 r from s),
t as (select sum(n * n * n - n) t from (select cast(count(*) as double) n from s group by v)), q as (select count(*) n, count(distinct g) k from r), h as (select sum(sr * sr / n) q from (select sum(r) sr, count(*) n from r group by g))
select q.k, q.n, round((12.0 / (q.n * (q.n + 1.0)) * h.q - 3.0 * (q.n + 1)) / (1 - t.t / (cast(q.n as double) ** 3 - q.n)), 6) h, round(exp(-(12.0 / (q.n * (q.n + 1.0)) * h.q - 3.0 * (q.n + 1)) / (1 - t.t / (cast(q.n as double) ** 3 - q.n)) / 2), 8) p from q, h, t""")
def kruskal(spark: SparkSession, d: str) -> DataFrame:
    """Do years of first detection differ between its seasons? First record per key, season, rank sums with ties."""
    o = V.obs(spark, d).where("label_role = 'target' and month between 3 and 11 and year is not null").select("key", "year", "month", "day", "ingest_id")
    first = keep_first(o, ["key"], [F.asc("year"), F.asc("month"), F.asc_nulls_first("day"), F.asc("ingest_id")]).select("year", E.season(F.col("month")).alias("g"))
    k = metrics.kruskal(first, "year", "g")
    return k.select("k", "n", F.round("h", 6).alias("h"), F.round("p", 8).alias("p"))


@query(f"""with {V.PTS_SQL}, m as (select avg(x) mx, avg(y) my, covar_samp(x, x) + 1e-6 a, covar_samp(x, y) b, covar_samp(y, y) + 1e-6 c from pts)
select key, round(sqrt((c * (x - mx) ** 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * c - b * b)), 5) mahalanobis from pts, m""")
def cov_mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    """Distance from the mean in the covariance of the points."""
    return ml.mahalanobis(V.pts(spark, d), ["x", "y"]).select("key", F.round("mahalanobis", 5).alias("mahalanobis"))


@query(f"with {V.PU_SQL}, m as (select avg(bio_01) m, stddev_pop(bio_01) s from pu) select cell_id, round((bio_01 - m) / s, 5) z_bio_01 from pu, m")
def standardised(spark: SparkSession, d: str) -> DataFrame:
    return ml.standardise(V.pu(spark, d), ["bio_01"]).select("cell_id", F.round("z_bio_01", 5).alias("z_bio_01"))


@query(f"with {V.PU_SQL}, b as (select quantile_cont(score, 0.5) lo, quantile_cont(score, 0.75) hi, quantile_cont(abs(score - score2), 0.25) q from pu), s as (select * from pu, b where score >= lo and score < hi and y = 0 and abs(score - score2) >= q) select count(*) n, min(cell_id) first_cell, min_by(cell_id, score + cell_id * 1e-15) seed from s")
def argmin_seed_band(spark: SparkSession, d: str) -> DataFrame:
    """A band of uncertain, unlabelled cells by exact percentiles, and its least certain cell as a seed."""
    p = V.pu(spark, d).withColumn("gap", F.abs(F.col("score") - F.col("score2")))
    lo, hi = ranked.quantiles(p, "score", [0.5, 0.75])
    (q,) = ranked.quantiles(p, "gap", [0.25])
    s = p.where((F.col("score") >= lo) & (F.col("score") < hi) & (F.col("y") == 0) & (F.col("gap") >= q))
    return s.agg(F.count("*").alias("n"), F.min("cell_id").alias("first_cell"), F.min_by("cell_id", F.col("score") + F.col("cell_id") * 1e-15).alias("seed"))


@query(f"with {V.PU_SQL}, k as (select cell_id, case when y = 1 then 'pos_' else 'bg_' end || cell_id g from pu) select cell_id, cast(floor((cast('0x' || substr(md5(concat_ws('|', g, '42')), 1, 12) as bigint) + 0.5) / 281474976710656.0 * 5) as integer) fold from k")
def folds_group_hash(spark: SparkSession, d: str) -> DataFrame:
    """Five folds by the hash of a group; rows without a group are groups of their own."""
    p = V.pu(spark, d).withColumn("g", ml.singleton_group(F.lit(None), F.col("cell_id"), F.col("y") == 1))
    return ml.group_folds(p, F.col("g"), 5, 42).select("cell_id", "fold")


def _train(spark: SparkSession, d: str) -> DataFrame:
    p = V.pu(spark, d).select("cell_id", "y", "grp", *FEATURES[:3])
    more = table(spark, d, "grid_features_static").groupBy("cell_id").agg(*[F.max(c).cast("double").alias(c) for c in FEATURES[3:]])
    return cut(ml.stratified_folds(p.join(more, "cell_id"), "y", "cell_id", FOLDS, 42))


_HELD = "grp < 'VX-18'"
_MORE = ", ".join(f"max(cast({c} as double)) {c}" for c in FEATURES[3:])
_TRAIN_SQL = f"""{V.PU_SQL}, more as (select cell_id, {_MORE} from grid_features_static group by 1),
train as (select *, cast(floor((cast('0x' || substr(md5(concat_ws('|', cast(y as varchar), cast(cell_id as varchar), '42')), 1, 12) as bigint) + 0.5) / 281474976710656.0 * {FOLDS}) as integer) fold from pu join more using (cell_id))"""


@query(f"with {_TRAIN_SQL}, f as (select unnest(range({FOLDS})) k) select cast(k as integer) fold, count(*) n, cast(sum(y) as bigint) n_pos, round(cast(sum(1 - y) as double) / sum(y), 8) weight, " + ", ".join(f"round(coalesce(quantile_cont(cast({c} as double), 0.5), 0), 6) m_{c}" for c in FEATURES) + " from f join train on fold <> k group by 1")
def training_folds(spark: SparkSession, d: str) -> DataFrame:
    """What each out-of-fold model is fitted with: rows, positives, their weight, and the medians that fill each feature, all features of a fold in one pass."""
    t, rows = _train(spark, d), []
    for k in range(FOLDS):
        part = t.where(F.col("fold") != k)
        n = part.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
        m = ml.medians(part, FEATURES)
        rows.append((k, n["n"], n["p"], round(ml.class_weight(part, "y"), 8), *[round(m[c], 6) for c in FEATURES]))
    return spark.createDataFrame(rows, "fold int, n bigint, n_pos bigint, weight double, " + ", ".join(f"m_{c} double" for c in FEATURES))


def _rungs(spark: SparkSession, d: str, train: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """Scores of a held-out part that need no model: a constant, effort, and the nearness of a known positive."""
    at = V.grid(spark, d).select("cell_id", F.col("x").alias("px"), F.col("y").alias("py"))
    known = train.where("y = 1").join(at, "cell_id").withColumnRenamed("cell_id", "known")
    near = spatial.nearest(test.join(at, "cell_id"), "cell_id", known, "known", x="px", y="py").select("cell_id", (-F.round("distance", 6)).alias("score"))
    return {"constant": test.withColumn("score", F.lit(0.5)), "effort": test.withColumn("score", F.col("effort").cast("double")), "nearest_positive": test.join(near, "cell_id")}


@query(f"""with {_TRAIN_SQL}, {V.GRID_SQL}, known as (select g.x, g.y from train t join grid g using (cell_id) where not {_HELD} and t.y = 1),
near as (select cell_id, -round(min(sqrt((g.x - known.x) ** 2 + (g.y - known.y) ** 2)), 6) score from (select cell_id from train where {_HELD}) join grid g using (cell_id), known group by 1),
m as (select 'constant' model, 0.5 score, y from train where {_HELD} union all select 'effort', cast(effort as double), y from train where {_HELD} union all select 'nearest_positive', score, y from near join (select cell_id, y from train) using (cell_id)),
{_curve('(select * from m where score is not null)', 'model')} select model, cast(sum(n) as bigint) n, cast(sum(pos) as bigint) n_pos, round(sum((n - pos) * (tp - pos / 2)) / (sum(pos) * (sum(n) - sum(pos))), 6) auc, round(sum(pos * tp / upto) / sum(pos), 6) ap from w group by 1""")
def baseline_simple(spark: SparkSession, d: str) -> DataFrame:
    """The rungs of the ladder that need no model, on held-out regions: a constant, effort, the nearest known positive."""
    t = _train(spark, d)
    rungs = _rungs(spark, d, t.where(f"not {_HELD}"), t.where(_HELD))
    rows = [(name, *metrics.ranking_metrics(m, "score", F.col("y")).first()) for name, m in rungs.items()]
    return spark.createDataFrame([(n, k, p, round(a, 6), round(b, 6)) for n, k, p, a, b in rows], "model string, n bigint, n_pos bigint, auc double, ap double")


@query("select unnest([" + ", ".join(f"'{c}'" for c in ("(constant)", *FEATURES)) + "]) feature, cast(0 as double) slope")
def logistic_optimum(spark: SparkSession, d: str) -> DataFrame:
    """Slope of the weighted logistic loss at the fitted model, per standardised feature: 0 to three digits, as the loss is convex and this is its least place."""
    t = _train(spark, d)
    model = ml.fit(t, FEATURES, "y", "logistic")
    w = ml.class_weight(t, "y")
    s = cut(ml.impute(ml.score(model, t), model[1]))
    stats = s.agg(*[x for i, c in enumerate(FEATURES) for x in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))]).first()
    off = F.when(F.col("y") == 1, w).otherwise(1.0) * (F.col("score") - F.col("y"))
    terms = [F.avg(off)] + [F.avg(off * (F.col(c) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0)) for i, c in enumerate(FEATURES)]
    got = s.agg(*[x.alias(f"g{i}") for i, x in enumerate(terms)]).first()
    return spark.createDataFrame([(c, abs(round(got[i], 3))) for i, c in enumerate(("(constant)", *FEATURES))], "feature string, slope double")


@query()
def pu_train_score(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on labelled cells against background: out-of-fold scores, the share of positives labelled, rescaled scores of all cells."""
    t = _train(spark, d)
    oof = ml.out_of_fold(t, FEATURES, "y", "fold", FOLDS)
    c = ml.elkan_noto(oof, "y")
    return oof.select("cell_id", "y", "fold", "score", ml.rescale(F.col("score"), c).alias("calibrated"))


@query()
def baseline_ladder(spark: SparkSession, d: str) -> DataFrame:
    """A constant, effort, the nearest positive, and logistic models of climate, infrastructure and all features against boosted trees, on held-out regions."""
    t = _train(spark, d)
    train, test = t.where(f"not {_HELD}"), t.where(_HELD)
    rows = [(name, *metrics.ranking_metrics(m, "score", F.col("y")).first()) for name, m in _rungs(spark, d, train, test).items()]
    for name, f, how in (("climate", ["bio_01", "bio_12"], "logistic"), ("infrastructure", ["dist_river_m", "dist_road_m"], "logistic"), ("logistic", FEATURES, "logistic"), ("trees", FEATURES, "gbt")):
        m = ml.score(ml.fit(train, f, "y", how), test)
        rows.append((name, *metrics.ranking_metrics(m, "score", F.col("y")).first()))
    return spark.createDataFrame([tuple(r) for r in rows], "model string, n bigint, n_pos bigint, auc double, ap double")


@query()
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    t = _train(spark, d)
    return ml.permutation_importance(ml.fit(t, FEATURES, "y"), t, FEATURES, "cell_id", repeats=REPEATS)


@query()
def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    t = _train(spark, d)
    return ml.ablation(t.where("fold > 0"), t.where("fold = 0"), SUBSETS)


@query()
def shap_strata(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute Shapley value of each feature of boosted trees, per quintile of their score."""
    from loam.operators import shap

    t = _train(spark, d)
    m = ml.fit(t, FEATURES, "y")
    b, _ = ranked.quantile_bins(cut(ml.score(m, t).select("cell_id", "score")), "score", 5, "quintile")
    return shap.mean_absolute(shap.shap_values(m, t, "cell_id", FEATURES).join(b, "cell_id"), FEATURES, "quintile")


@query(f"""with {V.PTS_SQL}, f as (select cell_id, min("year") first_year from pts where "year" is not null group by 1), {V.GRID_SQL}, g as (select grid.cell_id, first_year from grid left join f using (cell_id)),
t as (select unnest([2012, 2016, 2020]) t)
select t, part, count(*) n, count(*) filter (where y = 1) n_pos from (
  select t, 'train' part, case when first_year <= t then 1 else 0 end y from t, g
  union all select t, 'test', case when first_year = t + 1 then 1 else 0 end from t, g where first_year is null or first_year > t) group by 1, 2""")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows and positives of point-in-time splits: known by the cutoff against first seen the year after; later finds are background, not yet known."""
    first = V.pts(spark, d).where("year is not null").groupBy("cell_id").agg(F.min("year").alias("first_year"))
    g = V.grid(spark, d).select("cell_id").join(first, "cell_id", "left")
    t = F.explode(F.array(*map(F.lit, (2012, 2016, 2020)))).alias("t")
    rows = g.select("first_year", t)
    train = rows.select("t", F.lit("train").alias("part"), F.coalesce(F.col("first_year") <= F.col("t"), F.lit(False)).alias("y"))
    test = rows.where("first_year is null or first_year > t").select("t", F.lit("test").alias("part"), F.coalesce(F.col("first_year") == F.col("t") + 1, F.lit(False)).alias("y"))
    return train.unionByName(test).groupBy("t", "part").agg(F.count("*").alias("n"), F.count_if("y").alias("n_pos"))
