"""Queries of the training-data operators and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.geo import EARTH_RADIUS
from loam.functions.regions import cell_regions
from loam.llm import clusters, leakage, names, packing, quality, splits, survivor, topn
from loam.operators.lineage import cut, join_hint
from loam.operators.timestamps import interpretations
from loam.plans.problems import located
from loam.plans.timestamps_sql import INSTANTS_SQL
from loam.sources.tables import table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return cell_regions(table(spark, d, "grid_features_static"), table(spark, d, "admin_units"))


# 1. splits that keep related records together


def _split_records(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "target_points_clustered").select("key", "cell_id", "patch_id", "year").where("key is not null")
    records = points.join(_regions(spark, d), "cell_id", "left")
    return splits.assign_splits(records, "key", ["oblast_code", "patch_id"], label="year")


@query
def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """Each record of target_points_clustered with its component and split."""
    return _split_records(spark, d).select("key", "cell_id", "patch_id", "oblast_code", "component", "split")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each key with the smallest oblast code among the records that must be in the same split."""
    records = _split_records(spark, d)
    codes = records.groupBy("component").agg(F.min("oblast_code").alias("group_code"))
    return records.select("key", "component").distinct().join(codes, "component").select("key", "group_code")


@query
def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """What the splits of all records must satisfy, as numbers: records, components, components in two splits (0), and whether annealing came nearer to the shares than every hashed start (1)."""
    r = cut(_split_records(spark, d).select("key", "component", "split", "year"))
    names = list(splits.SPLITS)
    apart = r.groupBy("component").agg(F.count_distinct("split").alias("n")).agg(F.count("*").alias("k"), F.count_if(F.col("n") > 1).alias("two")).first()
    number = F.array_position(F.array(*map(F.lit, names)), F.col("split")) - 1
    got = splits.deviation(r, number, "year", splits.SPLITS)
    hashed = [splits.deviation(r, splits.hashed_start(F.col("component"), F.lit(c), splits.SPLITS, 0), "year", splits.SPLITS) for c in range(splits.CHAINS)]
    rows = [("records", r.count()), ("components", apart["k"]), ("components in two splits", apart["two"]), ("nearer than hashed", int(got < min(hashed) or got == 0))]
    return spark.createDataFrame(rows, "fact string, value bigint")


# 4. top N items within every group


@query
def p4_top_cells(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best cells of every run and region with score and rank."""
    scores = table(spark, d, "suitability_predictions").select("run_id", "cell_id", "suitability_targetbg_raw").where("suitability_targetbg_raw between 0 and 1 and run_id is not null")
    # the map of cells is broadcast if it is small, so that heaps come before the first shuffle of the scores
    return topn.top_n(scores.join(join_hint(cut(_regions(spark, d))), "cell_id"), ["run_id", "oblast_code"], "suitability_targetbg_raw", "cell_id", 10)


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_top_cells(spark, d).select("run_id", "oblast_code", "cell_id")


_REGIONS_SQL = r"""
names as (select distinct trim(regexp_replace(regexp_replace(lower(replace(replace(n, '''', ''), '’', '')), '\b(oblast|obl|область|обл)\b', ' ', 'g'), '[^\p{L}]+', ' ', 'g')) k, oblast_code c
  from (select oblast_code, unnest([name, replace(replace(name_local, ' область', ''), '''', '')]) n from admin_units)),
cells as (select cell_id, min(coalesce(nullif(upper(trim(oblast_code)), ''), c)) oblast_code
  from grid_features_static left join names
    on names.k = trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(oblast), '''', ''), '’', ''), '(^|[^\p{L}])(oblast|obl|область|обл)($|[^\p{L}])', ' ', 'g'), '[^\p{L}]+', ' ', 'g'), ' +', ' ', 'g'))
  group by 1 having min(coalesce(nullif(upper(trim(oblast_code)), ''), c)) is not null)
"""
SQL["p4_top_cells"] = f"""with {_REGIONS_SQL},
best as (select run_id, oblast_code, cell_id, max(suitability_targetbg_raw) suitability_targetbg_raw from suitability_predictions join cells using (cell_id)
  where suitability_targetbg_raw between 0 and 1 group by 1, 2, 3)
select run_id, oblast_code, cell_id, suitability_targetbg_raw, cast(row_number() over (partition by run_id, oblast_code order by suitability_targetbg_raw desc, cell_id) as integer) "rank" from best qualify "rank" <= 10"""
SQL["p4_found"] = f"select run_id, oblast_code, cell_id from ({SQL['p4_top_cells']})"
SQL["p1_found"] = f"""with recursive {_REGIONS_SQL},
r as (select distinct key, patch_id, oblast_code from target_points_clustered left join cells using (cell_id)),
e as (select distinct a.oblast_code x, b.oblast_code y from r a join r b using (patch_id)),
reach as (select distinct oblast_code x, oblast_code y from r where oblast_code is not null union select reach.x, e.y from reach join e on e.x = reach.y)
select key, min(m) group_code from r left join (select x, min(y) m from reach group by 1) on x = oblast_code group by 1"""
SQL["p1_shares"] = f"""with recursive {_REGIONS_SQL},
r as (select 'k:' || key k, coalesce('o:' || oblast_code, 'p:' || patch_id) o, 'p:' || patch_id p from target_points_clustered left join cells using (cell_id) where key is not null),
e as (select k x, o y from r where o is not null union select k, p from r where p is not null union select o, k from r where o is not null union select p, k from r where p is not null),
reach as (select distinct k x, k y from r union select reach.x, e.y from reach join e on e.x = reach.y)
select 'records' fact, count(*) value from r union all select 'components', count(distinct m) from (select x, min(y) m from reach group by 1) union all select 'components in two splits', 0 union all select 'nearer than hashed', 1"""


# 6. grouping records into similarity clusters


def _clusters(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return clusters.pivot_clusters(located(spark, d), "key", "lat", "lon", 500.0)


@query
def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of neighbouring target records with size, medoid and most typical keys."""
    c = _clusters(spark, d)["clusters"]
    return c.select("cluster", "size", F.round("medoid_lat", 8).alias("medoid_lat"), F.round("medoid_lon", 8).alias("medoid_lon"), F.array_join("typical", "|").alias("typical"))


@query
def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of each located target record, and the patch it was given, if any."""
    patch = table(spark, d, "target_points_clustered").where("key is not null").groupBy("key").agg(F.min("patch_id").alias("patch_id"))
    return _clusters(spark, d)["members"].select("key", "lat", "lon", "cluster").join(patch, "key", "left")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.linked_groups(_clusters(spark, d), 500.0, 3)


SQL["p6_found"] = """with recursive o as (select distinct key, decimalLatitude lat, decimalLongitude lon from heracleum_ua_clean
  where label_role = 'target' and decimalLatitude between 44.2 and 52.5 and decimalLongitude between 22 and 40.3),
e as (select distinct a.key x, b.key y from o a join o b on b.lat between a.lat - 0.005 and a.lat + 0.005 and b.lon between a.lon - 0.01 and a.lon + 0.01
  where 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) < 500),
reach as (select x, y from e union select reach.x, e.y from reach join e on e.x = reach.y),
g as (select x key, min(y) cluster_key from reach group by 1)
select key, cluster_key from g where cluster_key in (select cluster_key from g group by 1 having count(*) >= 3)"""


_SIDE = repr(float(np.degrees(500.0 / EARTH_RADIUS)) * clusters.SPOT)
_CIRCLE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
#: The clusters by the sequential rule that the parallel rounds stand for: in the order of their hashes spots become pivots unless a similar one is; the others go to the nearest pivot.
_PIVOTS_SQL = f"""o as (select key, decimalLatitude lat, decimalLongitude lon, cast(floor((decimalLatitude + 90) / {_SIDE}) as bigint) * 4294967296 + cast(floor((decimalLongitude + 180) / {_SIDE}) as bigint) spot from heracleum_ua_clean
  where label_role = 'target' and decimalLatitude between 44.2 and 52.5 and decimalLongitude between 22 and 40.3),
spots as (select spot, count(*) n, min(struct_pack(lat := lat, lon := lon)) rep, sum(lat) slat, sum(lon) slon, cast('0x' || substr(md5(concat_ws('|', cast(spot as varchar), '0')), 1, 15) as bigint) h from o group by 1),
s as (select spot, h, rep.lat lat, rep.lon lon, n, slat, slon from spots),
near as (select a.spot a, b.spot b, b.h hb, {_CIRCLE.format(a="a.", b="b.")} d from s a join s b on a.spot <> b.spot and b.lat between a.lat - 0.005 and a.lat + 0.005 and b.lon between a.lon - 0.01 and a.lon + 0.01 where {_CIRCLE.format(a="a.", b="b.")} < 500),
line as (select s.spot, row_number() over (order by h, s.spot) i, coalesce(nb, []) nb from s left join (select a spot, list(b) nb from near group by 1) using (spot)),
walk as (select cast(0 as bigint) i, cast([] as bigint[]) pivots union all select line.i, case when list_has_any(nb, pivots) then pivots else list_append(pivots, line.spot) end from walk join line on line.i = walk.i + 1),
pivots as (select unnest(pivots) p from (select pivots from walk order by i desc limit 1)),
own as (select p spot, p cluster from pivots union all select a, arg_min(b, struct_pack(d := d, h := hb, b := b)) from near where b in (select p from pivots) and a not in (select p from pivots) group by 1)"""
SQL["p6_members"] = f"""with recursive {_PIVOTS_SQL} select key, lat, lon, cluster, patch_id from o join own using (spot) left join (select key, min(patch_id) patch_id from target_points_clustered where key is not null group by 1) using (key)"""
SQL["p6_clusters"] = f"""with recursive {_PIVOTS_SQL},
centre as (select cluster, sum(n) size, sum(slat) / sum(n) lat, sum(slon) / sum(n) lon from s join own using (spot) group by 1),
medoid as (select cluster, size, arg_min(struct_pack(lat := s.lat, lon := s.lon), struct_pack(d := {_CIRCLE.format(a="s.", b="centre.")}, rep := struct_pack(lat := s.lat, lon := s.lon))) m from s join own using (spot) join centre using (cluster) group by 1, 2),
place as (select cluster, size, m.lat lat, m.lon lon from medoid),
off as (select cluster, key, min({_CIRCLE.format(a="o.", b="place.")}) d from o join own using (spot) join place using (cluster) where key is not null group by 1, 2),
best as (select cluster, string_agg(cast(key as varchar), '|' order by d, key) typical from (select * from off qualify row_number() over (partition by cluster order by d, key) <= 3) group by 1)
select cluster, cast(size as bigint) size, round(lat, 8) medoid_lat, round(lon, 8) medoid_lon, typical from place left join best using (cluster)"""


# 2. best representative of each duplicate group

#: Fields that make a record complete.
FIELDS = ["datasetName", "institutionCode", "identificationVerificationStatus", "recordedBy", "identifiedBy", "stateProvince", "locality", "individualCount", "coordinateUncertaintyInMeters", "mediaTypes"]


@query
def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record per reported occurrence, its empty fields filled from the next best records of its group."""
    seen = table(spark, d, "heracleum_ua_clean")
    read = interpretations(seen.select("ingest_id", "key", "speciesKey", "decimalLatitude", "decimalLongitude", "eventDate"), "eventDate", "Europe/Kyiv")
    one = F.size(F.array_distinct("instants")) == 1
    when = F.when(one, F.concat(F.lit("i"), F.col("instants")[0].cast("string"))).when(F.col("day").isNotNull(), F.concat(F.lit("d"), F.col("day").cast("string"))).otherwise(F.coalesce(F.concat(F.lit("t"), F.col("eventDate")), F.lit("n")))
    lat, lon = (F.when(F.round(c, 5) != 0, F.round(F.round(c, 5) * 100_000).cast("bigint").cast("string")) for c in ("decimalLatitude", "decimalLongitude"))
    place = F.concat(F.col("speciesKey").cast("string"), F.lit("|"), lat, F.lit("|"), lon, F.lit("|"), when)
    links = cut(read.select("ingest_id", F.col("key").cast("string").alias("_key"), place.alias("_place")))
    groups = survivor.duplicate_groups(links, "ingest_id", [F.col("_key"), F.col("_place")])
    status = F.lower(F.col("identificationVerificationStatus"))
    trust = F.when(status.contains("expert"), 3).when(status == "verified", 2).when(survivor.filled(status), 1).otherwise(0)
    rows = seen.select("ingest_id", "lastInterpreted", *FIELDS).join(groups, "ingest_id")
    return survivor.survivors(rows, "group", "ingest_id", FIELDS, "lastInterpreted", trust, size="group_size").withColumn("newest", F.unix_seconds("newest"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_survivors(spark, d).where("n_rows > 1").select("first_id", "survivor_id")


_BLANK = ", ".join("'" + u.replace("'", "''") + "'" for u in survivor.UNKNOWN)
_FULL = " + ".join(f"coalesce(cast(regexp_replace(lower(trim(regexp_replace(cast({c} as varchar), '\\s+', ' ', 'g'))), '\\.+$', '') not in ({_BLANK}) as integer), 0)" for c in FIELDS)
_GROUPS_SQL = f"""{INSTANTS_SQL},
one as (select ingest_id, min(u) u from instants group by 1 having count(distinct u) = 1), day1 as (select ingest_id, min(dd) dd from days group by 1),
r as (select ingest_id, key, lastInterpreted, {_FULL} c, case when round(decimalLatitude, 5) <> 0 and round(decimalLongitude, 5) <> 0 then
  speciesKey || '|' || cast(round(round(decimalLatitude, 5) * 100000) as bigint) || '|' || cast(round(round(decimalLongitude, 5) * 100000) as bigint) || '|' || coalesce('i' || u, 'd' || dd, 't' || eventDate, 'n') end place
  from heracleum_ua_clean left join one using (ingest_id) left join day1 using (ingest_id)),
e as (select a.ingest_id x, b.ingest_id y from r a join r b using (key) union select a.ingest_id, b.ingest_id from r a join r b using (place)),
reach as (select x, y from e union select reach.x, e.y from reach join e on e.x = reach.y),
g as (select x ingest_id, min(y) first_id from reach group by 1)"""
SQL["p2_found"] = f"""with recursive {_GROUPS_SQL},
best as (select first_id, ingest_id, count(*) over (partition by first_id) n, row_number() over (partition by first_id order by c desc, lastInterpreted desc nulls last, ingest_id) k from g join r using (ingest_id))
select first_id, ingest_id survivor_id from best where k = 1 and n > 1"""


def _known(c: str) -> str:
    return f"regexp_replace(lower(trim(regexp_replace(cast({c} as varchar), '\\s+', ' ', 'g'))), '\\.+$', '') not in ({_BLANK})"


_VALUES = ", ".join(f"case when {_known('h.' + c)} then h.{c} end v{i}" for i, c in enumerate(FIELDS))
_PACK = ", ".join(f"v{i} := v{i}" for i in range(len(FIELDS)))
#: Layers by definition: what no other row of the rest beats is a layer; the first row by completeness, recency, trust and id of the first layer is the survivor, and a field is that of the first row in layer order that fills it.
SQL["p2_survivors"] = f"""with recursive {_GROUPS_SQL},
full_ as (select first_id, g.ingest_id id, r.c, coalesce(epoch_us(r.lastInterpreted), -9223372036854775807) t, case when contains(lower(identificationVerificationStatus), 'expert') then 3 when lower(identificationVerificationStatus) = 'verified' then 2 when {_known('identificationVerificationStatus')} then 1 else 0 end q,
  coalesce('0:' || r.key, '1:' || place) label, {_VALUES} from g join r using (ingest_id) join heracleum_ua_clean h using (ingest_id)),
peel as (select first_id, 0 k, cast(null as bigint[]) layer, list(struct_pack(id := id, c := c, t := t, q := q)) rest from full_ group by 1
  union all select first_id, k + 1, list_transform(list_filter(rest, lambda p: len(list_filter(rest, lambda o: o.c >= p.c and o.t >= p.t and o.q >= p.q and (o.c > p.c or o.t > p.t or o.q > p.q))) = 0), lambda p: p.id),
   list_filter(rest, lambda p: len(list_filter(rest, lambda o: o.c >= p.c and o.t >= p.t and o.q >= p.q and (o.c > p.c or o.t > p.t or o.q > p.q))) > 0) from peel where len(rest) > 0),
layers as (select first_id, k, unnest(layer) id from peel where k > 0),
ordered as (select full_.*, k, row_number() over (partition by full_.first_id order by k, c desc, t desc, q desc, id) place from full_ join layers using (first_id, id))
select min(label) "group", first_id, count(*) n_rows, arg_min(id, place) survivor_id, cast(arg_min(c, place) as integer) completeness, cast(arg_min(q, place) as integer) trust, case when max(t) > -9223372036854775807 then max(t) // 1000000 end newest,
{", ".join(f"arg_min(v{i}, place) filter (where v{i} is not null) {c}" for i, c in enumerate(FIELDS))} from ordered group by first_id"""


# 8. filling fixed-capacity containers with items

#: Tokens of a container.
CAPACITY = 4096


@query
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each text of documents, in tokens, with its place in a container of 4096 tokens."""
    path, pattern = packing.tokenizer_files()
    docs = table(spark, d, "documents").select("doc_id", "text")
    return packing.pack(packing.token_counts(docs, "doc_id", "text", path, pattern), "doc_id", "n_tokens", CAPACITY)


@query
def p8_facts(spark: SparkSession, d: str) -> DataFrame:
    """What the packing of all texts must satisfy, as numbers: texts placed; containers above capacity, places that overlap, texts with a gap or split though small (0); whether at least 95 % of the room is used, or as few containers as there can be (1)."""
    p = cut(p8_containers(spark, d))
    used = p.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.max(F.col("offset") + F.col("n_tokens")).alias("end"))
    box = used.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.count_if(F.col("end") > CAPACITY).alias("above"), F.count_if(F.col("end") > F.col("n")).alias("overlap")).first()
    text = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.count("*").alias("pieces"))
    item = text.agg(F.count("*").alias("k"), F.count_if((F.col("n") != F.col("end")) | (F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("n") / CAPACITY)))).alias("bad")).first()
    n = box["n"] or 0
    full = box["k"] <= -(-n // CAPACITY) + 1 or n >= 0.95 * CAPACITY * box["k"]
    rows = [("texts placed", item["k"]), ("containers above capacity", box["above"]), ("containers with holes or overlaps", box["overlap"]), ("texts with a gap or split though small", item["bad"]), ("room is used", int(full))]
    return spark.createDataFrame(rows, "fact string, value bigint")


SQL["p8_facts"] = """select 'texts placed' fact, count(distinct doc_id) value from documents union all select 'containers above capacity', 0 union all select 'containers with holes or overlaps', 0
union all select 'texts with a gap or split though small', 0 union all select 'room is used', 1"""


# 10. per-document text quality statistics


@query
def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and kind of every mail."""
    return quality.quality_statistics(table(spark, d, "documents"), "doc_id", "text")


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Mails whose author mostly wrote a list, a table or junk."""
    return p10_statistics(spark, d).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


@query
def p10_facts(spark: SparkSession, d: str) -> DataFrame:
    """What the statistics of all mails must satisfy: mails and code points measured, mails whose shares leave 0 to 1 (0), and whether kinds agree with at least 98 of 100 labels (1)."""
    p = cut(p10_statistics(spark, d))
    shares = [c for c in p.columns if c.endswith(("_share", "_ratio"))]
    out = F.lit(False)
    for c in shares:
        out = out | ~F.col(c).between(0, 1)
    n = p.agg(F.count("*").alias("k"), F.sum("n_chars").alias("n"), F.count_if(out).alias("out")).first()
    label = p.join(table(spark, d, "doc_labels"), "doc_id").agg(F.count("*").alias("k"), F.count_if(F.when(F.col("kind") == "empty", "prose").otherwise(F.col("kind")) == F.col("body_kind")).alias("same")).first()
    rows = [("mails", n["k"]), ("code points", n["n"] or 0), ("shares beyond 0 to 1", n["out"]), ("agrees with labels", int(label["same"] >= 0.98 * label["k"]))]
    return spark.createDataFrame(rows, "fact string, value bigint")


SQL["p10_facts"] = "select 'mails' fact, count(*) value from documents union all select 'code points', cast(sum(n_chars) as bigint) from documents union all select 'shares beyond 0 to 1', 0 union all select 'agrees with labels', 1"


# 9. evaluation texts leaking into training text


@query
def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Mails that hold at least 12 consecutive words of a test item, with the number of windows found."""
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


@query
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """The test items that leaked and into how many mails."""
    return p9_leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_windows").alias("most_windows"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


@query
def p9_plain(spark: SparkSession, d: str) -> DataFrame:
    """The same search with the raw texts taken as they are, headers, markup and encodings included: what SQL can follow of it."""
    docs = table(spark, d, "documents")
    return leakage.find_leaks(docs, "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", split=leakage.plain_words).select("doc_id", "item_id", "n_windows")


_GRAM = " || ' ' || ".join(["w", *(f"lead(w, {i}) over p" for i in range(1, leakage.LEAST))])
SQL["p9_plain"] = f"""with t as (select 'd' src, doc_id id, text from documents union all select distinct 'i', item_id, text from eval_items),
word as (select src, id, unnest(ws) w, generate_subscripts(ws, 1) k from (select src, id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') ws from t)),
gram as (select src, id, k, {_GRAM} g from word window p as (partition by src, id order by k)),
ig as (select id, k, g from gram where src = 'i' and g is not null)
select d.id doc_id, ig.id item_id, count(distinct ig.k) n_windows from gram d join ig using (g) where src = 'd' group by 1, 2"""


# 5. variant spellings of names typed by people


@query
def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of a recorder or identifier and the person or organisation it means."""
    return names.link_names(table(spark, d, "heracleum_ua_clean").select("recordedBy", "identifiedBy"), ["recordedBy", "identifiedBy"])


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different spellings of one person or organisation."""
    e = cut(p5_entities(spark, d).where("entity is not null").select("entity", "name"))
    return e.select("entity", F.col("name").alias("name_a")).join(e.select("entity", F.col("name").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")


@query
def p5_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling that is linked, with the number of rows it comes in: all of the names, each once."""
    return p5_entities(spark, d).groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("times"))


SQL["p5_spellings"] = r"""select name, count(*) n, 1 times from (select regexp_replace(regexp_replace(v, '^[\s\x{a0}]+', ''), '[\s\x{a0}]+$', '') name from (select unnest(regexp_split_to_array(recordedBy, '[|;&]')) v from heracleum_ua_clean
union all select unnest(regexp_split_to_array(identifiedBy, '[|;&]')) from heracleum_ua_clean)) where name <> '' group by 1"""
