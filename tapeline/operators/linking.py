"""Joins of eras with successors, catalogs, registries and older ids; ambiguity never matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import names

BOUNDARY, VOLUME, ISSUER, CIK = 0.35, 0.25, 0.25, 0.15


def successor_pairs(eras: DataFrame, most_days: int = 10) -> DataFrame:
    """Eras and those of other symbols that begin 1 to ``most_days`` days after their end, scored.

    Each era stands once for each day it may be followed on, so that the range becomes an equality
    and the join a hash join. Eras have issuer and cik columns, which may be null.
    """
    day = lambda c: F.to_date(c, "yyyyMMdd")
    a = eras.select(*[F.col(c).alias(f"a_{c}") for c in ("symbol", "symbol_era_id", "last_day", "trade_rows", "issuer", "cik")])
    b = eras.select(*[F.col(c).alias(f"b_{c}") for c in ("symbol", "symbol_era_id", "first_day", "trade_rows", "issuer", "cik")])
    a = a.withColumn("gap_days", F.explode(F.sequence(F.lit(1), F.lit(most_days)))).withColumn("_day", F.date_add(day("a_last_day"), F.col("gap_days")))
    pairs = a.join(b.withColumn("_day", day("b_first_day")), "_day").filter("a_symbol <> b_symbol").drop("_day")
    pairs = pairs.withColumns(
        {
            "boundary_score": F.round(1 - (F.col("gap_days") - 1) / most_days, 4),
            "volume_score": names.volume_score(F.col("a_trade_rows"), F.col("b_trade_rows")),
            "issuer_score": names.issuer_score(F.col("a_issuer"), F.col("b_issuer")),
            "cik_score": names.id_score(F.col("a_cik"), F.col("b_cik")),
        }
    )
    total = BOUNDARY * F.col("boundary_score") + VOLUME * F.col("volume_score") + ISSUER * F.col("issuer_score") + CIK * F.col("cik_score")
    return pairs.withColumn("score", F.round(total, 4))


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs in which each era is the other's heaviest neighbour; equals are settled by score, then id."""
    after = Window.partitionBy("a_symbol_era_id").orderBy(F.desc("b_trade_rows"), F.desc("score"), "b_symbol_era_id")
    before = Window.partitionBy("b_symbol_era_id").orderBy(F.desc("a_trade_rows"), F.desc("score"), "a_symbol_era_id")
    ranked = pairs.withColumns({"_s": F.row_number().over(after), "_p": F.row_number().over(before)})
    return ranked.filter("_s = 1 and _p = 1").drop("_s", "_p")


def catalog_matches(eras: DataFrame, catalog: DataFrame, days: int = 45) -> DataFrame:
    """Eras with catalog rows of their ticker whose event is near the era's end or inception near its start.

    Needs ticker, event_date and inception_date (dates) in the catalog; a pair near both gives two rows.
    """
    close = lambda a, b: F.abs(F.datediff(F.col(a), F.to_date(b, "yyyyMMdd"))) <= days
    joined = eras.join(catalog, names.symbol_key(eras["symbol"]) == catalog["ticker"])
    bases = F.array(F.when(close("event_date", "last_day"), F.lit("delist_window")), F.when(close("inception_date", "first_day"), F.lit("inception_window")))
    return joined.withColumn("match_basis", F.explode(F.filter(bases, lambda b: b.isNotNull())))


def name_index(registry: DataFrame) -> DataFrame:
    """normalized_name and cik of the names that belong to one registrant only."""
    rows = registry.select(names.normal_name(F.col("sec_name")).alias("normalized_name"), F.ltrim(F.col("sec_cik"), F.lit("0")).alias("cik")).filter("normalized_name <> ''").distinct()
    alone = rows.withColumn("_n", F.count("*").over(Window.partitionBy("normalized_name")))
    return alone.filter("_n = 1").drop("_n")


def match_names(rows: DataFrame, index: DataFrame) -> DataFrame:
    """symbol_era_id and name_matched_cik: by the plain name, the name without descriptors, or a prefix of it.

    Names are matched once each and joined back to the eras that bear them. A prefix must point to
    one registrant only; candidates share the first word, which makes the join an equality.
    """
    distinct = rows.select("identity_issuer").distinct().withColumns(
        {"_plain": names.normal_name(F.col("identity_issuer")), "_bare": names.normal_name(names.without_descriptors(F.col("identity_issuer")))}
    )
    plain = index.select(F.col("normalized_name").alias("_plain"), F.col("cik").alias("_cik_plain"))
    bare = index.select(F.col("normalized_name").alias("_bare"), F.col("cik").alias("_cik_bare"))
    found = distinct.join(plain, "_plain", "left").join(bare, "_bare", "left")
    words = lambda c: F.split(c, " ")
    left = found.filter("_cik_plain is null and _cik_bare is null and _bare <> ''").select("_bare").distinct().withColumn("_first", words("_bare")[0])
    right = index.select("normalized_name", F.col("cik").alias("_cik_prefix"), words("normalized_name")[0].alias("_first"))
    near = left.join(right, "_first").filter(names.prefix_related(words("_bare"), words("normalized_name")))
    near = near.groupBy("_bare").agg(F.min("_cik_prefix").alias("_cik_prefix"), F.max("_cik_prefix").alias("_other")).filter("_cik_prefix = _other").drop("_other")
    matched = found.join(near, "_bare", "left").select("identity_issuer", F.coalesce("_cik_plain", "_cik_bare", "_cik_prefix").alias("name_matched_cik"))
    same = rows["identity_issuer"].eqNullSafe(matched["identity_issuer"])
    return rows.join(matched, same, "left").select("symbol_era_id", "name_matched_cik")


def remap_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old era ids with the new id of the same symbol and dates, or of the same first or last day.

    Both have symbol, symbol_era_id, first_day and last_day. An old id that a tier finds several
    new ones for is ambiguous: nothing may be guessed, so that raises an error.
    """
    dashless = {c: F.replace(F.col(c).cast("string"), F.lit("-"), F.lit("")) for c in ("first_day", "last_day")}
    rest = old.withColumns(dashless).withColumnRenamed("symbol_era_id", "old_era_id")
    target = new.withColumns(dashless).withColumnRenamed("symbol_era_id", "new_era_id")
    out = None
    for keys, kind in ((["symbol", "first_day", "last_day"], None), (["symbol", "first_day"], "last_day_shift"), (["symbol", "last_day"], "first_day_shift")):
        label = F.lit(kind) if kind else F.when(F.col("old_era_id") == F.col("new_era_id"), "unchanged").otherwise("id_shift")
        one = target.groupBy(*keys).agg(F.min("new_era_id").alias("new_era_id"), F.count("*").alias("_n"))
        only = F.when(F.col("_n") == 1, F.col("new_era_id")).otherwise(F.raise_error(F.concat(F.lit("ambiguous era remap: "), F.col("old_era_id"))).cast("string"))
        met = rest.join(one, keys).select("old_era_id", only.alias("new_era_id")).withColumn("match_kind", label)
        rest = rest.join(one.select(*keys), keys, "left_anti")
        out = met if out is None else out.unionByName(met)
    return out


def apply_remap(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows under their new era id; rows of ids that the mapping doesn't cover are dropped."""
    return rows.join(mapping.select(F.col("old_era_id").alias("symbol_era_id"), "new_era_id"), "symbol_era_id").withColumn("symbol_era_id", F.col("new_era_id")).drop("new_era_id")


def reference_errors(rows: DataFrame, eras: DataFrame, most: int = 10) -> DataFrame:
    """Up to ``most`` rows whose era is missing or belongs to another symbol."""
    known = eras.select("symbol_era_id", F.col("symbol").alias("_symbol"))
    joined = rows.join(known, "symbol_era_id", "left")
    error = F.when(F.col("_symbol").isNull(), "missing_era").when(F.col("_symbol") != F.col("symbol"), "symbol_mismatch")
    return joined.select("symbol_era_id", "symbol", error.alias("error")).filter("error is not null").orderBy("symbol_era_id", "symbol").limit(most)


def first_ranked(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)
