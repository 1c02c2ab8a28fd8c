"""Queries of the relational core: filters, maps, joins, set operations, aggregates, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import expr as E
from loam.operators import ml, ranked, relational
from loam.plans import views as V
from loam.plans.registry import query
from loam.sources.tables import table


@query("select \"row\" * 100000 + col cell_id, n, n_keys from (select cast(floor(y3035 / 1000) as bigint) \"row\", cast(floor(x3035 / 1000) as bigint) col, count(*) n, count(distinct key) n_keys from target_points_clustered group by 1, 2)")
def cell_counts(spark: SparkSession, d: str) -> DataFrame:
    """Points and distinct keys per 1 km cell, the key made from the position."""
    from loam.functions.geo import cell_id

    p = table(spark, d, "target_points_clustered")
    return p.groupBy(cell_id(F.col("x3035"), F.col("y3035")).alias("cell_id")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))


_CLEAN_SQL = """clean as (select * from heracleum_ua_clean where upper(occurrenceStatus) <> 'ABSENT' and decimalLatitude between 44.2 and 52.5 and decimalLongitude between 22 and 40.3
  and coalesce(basisOfRecord not in ('FOSSIL_SPECIMEN', 'LIVING_SPECIMEN', 'MATERIAL_SAMPLE'), true) and (coordinateUncertaintyInMeters is null or coordinateUncertaintyInMeters <= 1000)),
one as (select * from clean qualify row_number() over (partition by speciesKey, round_even(decimalLatitude * 10000, 0), round_even(decimalLongitude * 10000, 0), coalesce(eventDate, 'NA') order by ingest_id) = 1)"""


def _clean(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d).where(F.upper("occurrenceStatus") != "ABSENT").where("decimalLatitude between 44.2 and 52.5 and decimalLongitude between 22 and 40.3")
    o = o.where(E.not_in_keep_null(F.col("basisOfRecord"), ["FOSSIL_SPECIMEN", "LIVING_SPECIMEN", "MATERIAL_SAMPLE"])).where(E.null_or_at_most(F.col("coordinateUncertaintyInMeters"), 1000))
    return relational.keep_first(o, ["speciesKey", E.round_even(F.col("decimalLatitude"), 4), E.round_even(F.col("decimalLongitude"), 4), F.coalesce("eventDate", F.lit("NA"))], [F.asc("ingest_id")])


@query(f"with {_CLEAN_SQL} select ingest_id, key, speciesKey, decimalLatitude, decimalLongitude, coordinateUncertaintyInMeters is null uncertainty_missing from one")
def obs_filter_clean(spark: SparkSession, d: str) -> DataFrame:
    """Status, box, basis and uncertainty filters, then the first record of each species, place and date; a NULL date is a date of its own."""
    return _clean(spark, d).select("ingest_id", "key", "speciesKey", "decimalLatitude", "decimalLongitude", F.col("coordinateUncertaintyInMeters").isNull().alias("uncertainty_missing"))


@query("select count(*) n, count(*) filter (where identificationVerificationStatus is null) n_null from heracleum_ua_clean where coalesce(identificationVerificationStatus not in ('verified', 'unverified'), true)")
def not_in_keeps_null(spark: SparkSession, d: str) -> DataFrame:
    o = V.obs(spark, d).where(E.not_in_keep_null(F.col("identificationVerificationStatus"), ["verified", "unverified"]))
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("identificationVerificationStatus").isNull()).alias("n_null"))


@query("""select key, ingest_id, label_role, roles from (select key, ingest_id, label_role, row_number() over (partition by key order by case label_role when 'target' then 0 when 'invasive_other' then 1 else 2 end, ingest_id) r from heracleum_ua_clean)
join (select key, string_agg(distinct label_role, '|' order by label_role) roles from heracleum_ua_clean group by 1) using (key) where r = 1""")
def dedup_priority(spark: SparkSession, d: str) -> DataFrame:
    """One record per key by priority of role, with all roles it was delivered under."""
    o = V.obs(spark, d).select("key", "ingest_id", "label_role")
    rank = F.when(F.col("label_role") == "target", 0).when(F.col("label_role") == "invasive_other", 1).otherwise(2)
    roles = o.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("label_role")), "|").alias("roles"))
    return relational.keep_first(o, ["key"], [rank.asc(), F.asc("ingest_id")]).join(roles, "key")


@query("""select o_orderkey, o_totalprice, src from (select *, row_number() over (partition by o_orderkey order by src desc) r from
(select o_orderkey, o_totalprice, 0 src from orders union all by name select o_orderkey, o_totalprice * 2 o_totalprice, 1 src from orders where o_orderstatus = 'F')) where r = 1""")
def union_dedup_last(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    a = o.select("o_orderkey", "o_totalprice", F.lit(0).alias("src"))
    b = o.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(1).alias("src"))
    return relational.union_keep_last([a, b], ["o_orderkey"], [F.asc("o_totalprice")])


@query("select c_custkey, case c_mktsegment when 'BUILDING' then 'b' when 'MACHINERY' then 'm' end strict, case c_mktsegment when 'BUILDING' then 'b' when 'MACHINERY' then 'm' else c_mktsegment end loose from customer")
def dict_map_default(spark: SparkSession, d: str) -> DataFrame:
    m = {"BUILDING": "b", "MACHINERY": "m"}
    c = F.col("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", E.dict_map(c, m).alias("strict"), E.dict_map(c, m, True).alias("loose"))


@query("""select ingest_id, mediaTypes is not null has_media, coalesce(regexp_matches(mediaTypes, 'StillImage|MovingImage'), false) has_picture, coalesce(regexp_matches(datasetName, '(?i)atlas|track|snap'), false) is_citizen,
basisOfRecord = 'PRESERVED_SPECIMEN' is_preserved, coalesce(nullif(trim(datasetName), ''), upper(institutionCode), 'unknown') dataset_resolved, cast(length(locality) as integer) locality_length, starts_with(scientificName, 'Heracleum') is_genus, replace(occurrenceID, 'urn:obs:', '') bare_id from heracleum_ua_clean""")
def provenance_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags from what a record says about where it comes from."""
    return V.obs(spark, d).select(
        "ingest_id", F.col("mediaTypes").isNotNull().alias("has_media"), F.coalesce(F.col("mediaTypes").rlike("StillImage|MovingImage"), F.lit(False)).alias("has_picture"),
        F.coalesce(F.col("datasetName").rlike("(?i)atlas|track|snap"), F.lit(False)).alias("is_citizen"), (F.col("basisOfRecord") == "PRESERVED_SPECIMEN").alias("is_preserved"),
        F.coalesce(F.nullif(F.trim("datasetName"), F.lit("")), F.upper("institutionCode"), F.lit("unknown")).alias("dataset_resolved"), F.length("locality").alias("locality_length"),
        F.startswith("scientificName", F.lit("Heracleum")).alias("is_genus"), F.replace("occurrenceID", F.lit("urn:obs:"), F.lit("")).alias("bare_id"),
    )


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k, cast(case when len(json_keys(props)) > 0 then len(json_keys(props)) end as integer) n_props from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A value out of JSON text, and the number of its keys, NULL if there is none."""
    keys = F.size(F.json_object_keys("props"))
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.when(keys > 0, keys).alias("n_props"))


@query("""select case when month(o_orderdate) in (12, 1, 2) then 'winter' when month(o_orderdate) <= 5 then 'spring' when month(o_orderdate) <= 8 then 'summer' else 'autumn' end season,
count(*) n, cast(min(dayofyear(o_orderdate)) as integer) first_day, cast(max(dayofyear(o_orderdate)) as integer) last_day from orders group by 1""")
def season_bucket(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(E.season(F.month("o_orderdate")).alias("season")).agg(F.count("*").alias("n"), F.min(F.dayofyear("o_orderdate")).alias("first_day"), F.max(F.dayofyear("o_orderdate")).alias("last_day"))


@query("""with q as (select quantile_cont(cast(o_totalprice as double), 0.25) lo, quantile_cont(cast(o_totalprice as double), 0.95) hi from orders)
select action, count(*) n from (select case when o_totalprice < lo then 'low' when o_totalprice < hi and o_orderstatus <> 'F' then 'review' else 'direct' end action from orders, q) group by 1""")
def three_way_policy(spark: SparkSession, d: str) -> DataFrame:
    """Rows sorted into three classes by exact percentiles and a flag."""
    o = table(spark, d, "orders")
    lo, hi = ranked.quantiles(o, "o_totalprice", [0.25, 0.95])
    action = F.when(F.col("o_totalprice") < lo, "low").when((F.col("o_totalprice") < hi) & (F.col("o_orderstatus") != "F"), "review").otherwise("direct")
    return o.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("""select o_orderkey, 'Order ' || lpad(cast(o_orderkey as varchar), 10, '0') || ': ' || printf('%.2f', o_totalprice) || case when o_totalprice > 100000 then ', large' else '' end || case when o_orderstatus = 'F' then ', final' else ', open' end txt from orders""")
def justification_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Order "), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit(": "), E.fixed(F.col("o_totalprice"), 2), F.when(F.col("o_totalprice") > 100000, ", large").otherwise(""), F.when(F.col("o_orderstatus") == "F", ", final").otherwise(", open"))
    return table(spark, d, "orders").select("o_orderkey", t.alias("txt"))


@query("""select k, coalesce(a, 0) n_orders, coalesce(b, 0) n_lines, coalesce(c, 0) n_events from (select o_orderkey k, count(*) a from orders group by 1)
full join (select l_orderkey k, count(*) b from lineitem group by 1) using (k) full join (select event_id k, count(*) c from events group by 1) using (k) where k is not null""")
def count_align_outer(spark: SparkSession, d: str) -> DataFrame:
    """Rows per key in three tables side by side: one union and one aggregate instead of full joins."""
    t = {"n_orders": ("orders", "o_orderkey"), "n_lines": ("lineitem", "l_orderkey"), "n_events": ("events", "event_id")}
    return relational.align_counts({k: table(spark, d, a).select(F.col(b).alias("k")) for k, (a, b) in t.items()}, "k")


@query("""select c_custkey, 'with' part from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000) union all
select c_custkey, 'without' from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)""")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return c.join(o.where("o_totalprice > 100000"), "c_custkey", "left_semi").withColumn("part", F.lit("with")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("part", F.lit("without")))


@query("""select c_custkey, n_name nation, r_name region, coalesce(n_orders, 0) n_orders from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
left join (select o_custkey, count(*) n_orders from orders group by 1) on o_custkey = c_custkey""")
def chained_left_assembly(spark: SparkSession, d: str) -> DataFrame:
    """A wide table by left joins; the large side is aggregated before it is joined."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("region"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return c.join(n, "c_nationkey", "left").join(r, "r_regionkey", "left").join(o, "c_custkey", "left").select("c_custkey", "nation", "region", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("""with a as (select l_orderkey, l_linenumber, sum(l_quantity) quantity from lineitem group by 1, 2), b as (select l_orderkey, l_linenumber, count(*) n from lineitem where l_returnflag = 'R' group by 1, 2)
select a.l_orderkey, a.l_linenumber, quantity, n n_returned, o_totalprice price_order from a left join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber left join orders on o_orderkey = a.l_orderkey""")
def composite_left(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a = li.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("quantity"))
    b = li.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_returned"))
    o = table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_totalprice").alias("price_order"))
    return a.join(b, ["l_orderkey", "l_linenumber"], "left").join(o, a["l_orderkey"] == o["o_orderkey"], "left").select(a["l_orderkey"], "l_linenumber", "quantity", "n_returned", "price_order")


@query(f"with {V.YEARLY_SQL} select p.point, a.v v_1997, b.v v_lag from (select distinct point from yearly) p left join (select * from yearly where \"year\" = 1997) a using (point) left join (select * from yearly where \"year\" = 1998) b using (point)")
def panel_asof_year(spark: SparkSession, d: str) -> DataFrame:
    """Values of a panel at two fixed years by key."""
    y = V.yearly(spark, d)
    lag = relational.at_year(y, "point", "year", 1998, ["v"], "_lag")
    return y.select("point").distinct().join(relational.at_year(y, "point", "year", 1997, ["v"], "_1997"), "point", "left").join(lag, "point", "left")


@query("select o_custkey, min(o_totalprice) lo, max(o_totalprice) hi, count(distinct o_orderpriority) n_priorities, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 6) share_f from orders group by 1")
def minmax_nunique(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count_distinct("o_orderpriority").alias("n_priorities"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("share_f"))


@query("select round(quantile_cont(cast(o_totalprice as double), 0.25), 6) p25, round(quantile_cont(cast(o_totalprice as double), 0.5), 6) p50, round(quantile_cont(cast(o_totalprice as double), 0.95), 6) p95, round(quantile_cont(cast(o_totalprice as double), 0.99), 6) p99 from orders")
def percentile_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exact interpolated percentiles without one task holding the column."""
    v = ranked.quantiles(table(spark, d, "orders"), "o_totalprice", [0.25, 0.5, 0.95, 0.99])
    return spark.createDataFrame([tuple(round(x, 6) for x in v)], "p25 double, p50 double, p95 double, p99 double")


@query("select o_custkey, array_to_string(list_sort(list(distinct o_orderpriority)), ',') priorities, cast(len(list(distinct o_orderpriority)) as integer) n from orders group by 1")
def collect_sorted_set(spark: SparkSession, d: str) -> DataFrame:
    s = F.array_sort(F.collect_set("o_orderpriority"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(s, ",").alias("priorities"), F.size(s).alias("n"))


@query("select l_suppkey, l_quantity mode_quantity from (select l_suppkey, l_quantity, row_number() over (partition by l_suppkey order by count(*) desc, l_quantity) r from lineitem group by 1, 2) where r = 1")
def mode_min_tie(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent value per group, the smaller one on ties."""
    c = table(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    return c.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("n")).alias("n"), "l_quantity"))["l_quantity"].alias("mode_quantity"))


@query("select o_orderpriority, count(*) n, count(*) filter (where o_orderstatus = 'F' and o_totalprice > 150000) both_, count(*) filter (where o_orderstatus = 'F' and not o_totalprice > 150000) only_f, count(*) filter (where o_orderstatus <> 'F' and o_totalprice > 150000) only_large from orders group by 1")
def flag_pairs(spark: SparkSession, d: str) -> DataFrame:
    f, g = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(f & g).alias("both_"), F.count_if(f & ~g).alias("only_f"), F.count_if(~f & g).alias("only_large"))


@query(f"""with {V.PU_SQL}, g as (select grp, avg(y) rate from pu group by 1 having count(*) >= 20)
select count(*) n_groups, round(stddev_samp(rate), 6) sd, round(avg(rate), 6) mean, round(max(rate) - min(rate), 6) span from g having count(*) >= 3""")
def rate_range_having(spark: SparkSession, d: str) -> DataFrame:
    """Spread of group rates, over groups with enough rows."""
    g = V.pu(spark, d).groupBy("grp").agg(F.avg("y").alias("rate"), F.count("*").alias("n")).where("n >= 20")
    return g.agg(F.count("*").alias("n_groups"), F.round(F.stddev_samp("rate"), 6).alias("sd"), F.round(F.avg("rate"), 6).alias("mean"), F.round(F.max("rate") - F.min("rate"), 6).alias("span")).where("n_groups >= 3")


@query("""with o as (select cast(o_totalprice as double) x from orders),
e as (select unnest(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) edge from o), c as (select edge, row_number() over (order by edge) - 1 k from (select distinct edge from e)),
b as (select x, (select min(k) from c where edge >= x and k > 0) - 1 bin from o)
select cast(bin as integer) bin, count(*) n, round(min(x), 6) lo, round(max(x), 6) hi, round(avg(x), 4) mean from b group by 1""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    """Right-closed deciles with equal edges merged, and what is in them."""
    b, _ = ranked.quantile_bins(table(spark, d, "orders").select("o_totalprice"), "o_totalprice", 10)
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 6).alias("lo"), F.round(F.max("o_totalprice"), 6).alias("hi"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(f"with {V.PTS_SQL}, m as (select min(x) a, max(x) b, min(y) c, max(y) e from pts) select key, round((x - a) / (b - a), 6) x01, round((y - c) / (e - c), 6) y01, round((x - a) / (b - a) * (1 - (y - c) / (e - c)), 6) risk from pts, m")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    n = ml.minmax(V.pts(spark, d), ["x", "y"])
    return n.select("key", F.round("x01", 6).alias("x01"), F.round("y01", 6).alias("y01"), F.round(F.col("x01") * (1 - F.col("y01")), 6).alias("risk"))


@query(f"with {V.PU_SQL} select cell_id, round((score + score2) / 2, 6) mean, round(abs(score - score2) / sqrt(2), 6) sd from pu")
def horizontal_mean_std(spark: SparkSession, d: str) -> DataFrame:
    m, s = E.pair_mean_std(F.col("score"), F.col("score2"))
    return V.pu(spark, d).select("cell_id", F.round(m, 6).alias("mean"), F.round(s, 6).alias("sd"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round_even(l_discount * 10, 0) / 10 even, ceil(l_quantity / 3) up, floor(-l_quantity / 3) down, round(ln(1 + l_tax), 8) l1p, round(sqrt(abs(l_quantity - 25)), 8) root,
case when nullif(l_discount, 0.0) is null then null else round(l_tax / nullif(l_discount, 0.0), 6) end ratio, try_cast(l_returnflag as double) bad, case when l_quantity > 25 then 'big' else 'small' end size from lineitem""")
def scalar_math(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", E.round_even(F.col("l_discount"), 1).alias("even"), F.ceil(q / 3).cast("double").alias("up"), F.floor(-q / 3).cast("double").alias("down"), F.round(F.log1p("l_tax"), 8).alias("l1p"), F.round(F.sqrt(F.abs(q - 25)), 8).alias("root"),
        F.round(F.try_divide("l_tax", F.nullif("l_discount", F.lit(0.0))), 6).alias("ratio"), E.number(F.col("l_returnflag")).alias("bad"), F.when(q > 25, "big").otherwise("small").alias("size"),
    )


@query("select o_orderkey, c_name customer, cast(o_totalprice as float) price, 'UA' country, o_orderstatus from orders join customer on o_custkey = c_custkey")
def projection_core(spark: SparkSession, d: str) -> DataFrame:
    """Inner join, constant column, rename, drop, type-driven downcast, reordering."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), F.col("c_name").alias("customer")).withColumn("country", F.lit("UA"))
    return relational.to_front(relational.narrow_floats(j), "o_orderkey", "customer", "price", "country")


@query(f"with {V.PU_SQL} select cell_id, y, grp in ('VX-11', 'VX-16', 'VX-29') held_out, bio_01, elevation_m from pu where y = 1 or (effort > 0 and y = 0)")
def region_holdout_pool(spark: SparkSession, d: str) -> DataFrame:
    """Positives and background with effort; whole regions held out; columns chosen by name."""
    p = V.pu(spark, d)
    chosen = relational.columns_like(p, prefixes=("bio_", "elev"), without=("score",))
    return p.where("y = 1 or (effort > 0 and y = 0)").select("cell_id", "y", F.col("grp").isin("VX-11", "VX-16", "VX-29").alias("held_out"), *chosen)


@query(f"with {V.GRID_SQL} select cell_id, true ctrl from grid where cell_id not in (select cell_id from target_points_clustered where cell_id is not null) order by md5(concat_ws('|', cast(cell_id as varchar), '42')), cell_id limit 100")
def random_control_sample(spark: SparkSession, d: str) -> DataFrame:
    """A reproducible random sample of cells without a target point: a sampling operator, hence the limit."""
    taken = table(spark, d, "target_points_clustered").select("cell_id").where("cell_id is not null")
    free = V.grid(spark, d).select("cell_id").join(taken, "cell_id", "left_anti")
    return free.orderBy(E.order_hash(42, F.col("cell_id")), "cell_id").limit(100).withColumn("ctrl", F.lit(True))


@query("""select 'between(l_discount)' "constraint", count(*) filter (where not l_discount between 0 and 0.05) violations from lineitem union all select 'not_null(l_orderkey)', count(*) filter (where l_orderkey is null) from lineitem
union all select 'unique(l_orderkey,l_linenumber)', count(*) - count(distinct (l_orderkey, l_linenumber)) from lineitem""")
def constraint_report(spark: SparkSession, d: str) -> DataFrame:
    return relational.constraint_report(table(spark, d, "lineitem"), unique=["l_orderkey", "l_linenumber"], not_null=["l_orderkey"], between={"l_discount": (0.0, 0.05)})


@query("select coalesce(nullif(trim(stateProvince), ''), 'none') state, count(*) n from heracleum_ua_clean group by 1")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).groupBy(F.coalesce(F.nullif(F.trim("stateProvince"), F.lit("")), F.lit("none")).alias("state")).agg(F.count("*").alias("n"))


@query("with m as (select quantile_cont(cast(bio_01 as double), 0.5) b from grid_features_static where bio_01 is not null) select cell_id, round(coalesce(cast(bio_01 as double), b), 6) bio_01, coalesce(oblast, oblast_code, 'none') oblast, coalesce(n_plant_effort, 0) effort from grid_features_static, m")
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    """NULLs filled by the median, by another column, by a constant."""
    f = table(spark, d, "grid_features_static").select("cell_id", F.col("bio_01").cast("double").alias("bio_01"), F.coalesce("oblast", "oblast_code", F.lit("none")).alias("oblast"), F.coalesce("n_plant_effort", F.lit(0)).alias("effort"))
    return relational.fill_median(f, ["bio_01"]).withColumn("bio_01", F.round("bio_01", 6))
