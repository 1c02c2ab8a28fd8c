"""Region names as people write them, brought to one code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for "region" that surround a name.
REGION_WORDS = ("oblast", "obl", "область", "обл")


def region_key(name: Column) -> Column:
    """Lower case letters of a region name without words for "region"; '' and NULL become NULL."""
    words = "|".join(REGION_WORDS)
    spaced = F.regexp_replace(F.lower(name), r"['’ʼ`]", "")
    bare = F.regexp_replace(spaced, rf"(?U)(?<![\p{{L}}])({words})(?![\p{{L}}])", " ")
    letters = F.regexp_replace(bare, r"[^\p{L}]+", " ")
    return F.nullif(F.trim(letters), F.lit(""))


def cell_regions(cells: DataFrame, units: DataFrame) -> DataFrame:
    """``(cell_id, oblast_code)``, one row per cell that has a region code or a known region name.

    Where the code is NULL or blank, the name decides: it is looked up among ``name`` and ``name_local`` of the units.
    Repeated rows of a cell give its smallest code. Rows with NULL ``cell_id`` or no known region do not come out.
    """
    names = (
        units.select(F.col("oblast_code").alias("_code"), F.explode(F.array("name", "name_local")).alias("_name"))
        .select(region_key(F.col("_name")).alias("_key"), "_code").where("_key is not null and _code is not null").groupBy("_key").agg(F.min("_code").alias("_code"))
    )
    code = F.nullif(F.upper(F.trim("oblast_code")), F.lit(""))
    known = cells.select("cell_id", code.alias("_own"), region_key(F.col("oblast")).alias("_key")).where("cell_id is not null")
    return known.join(names, "_key", "left").select("cell_id", F.coalesce("_own", "_code").alias("oblast_code")).where("oblast_code is not null").groupBy("cell_id").agg(F.min("oblast_code").alias("oblast_code"))
