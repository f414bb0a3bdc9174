"""Facts with deterministic ids, stores of them, and what the best of them say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Assurance of verification states, best first.
TIERS = ("verified", "corroborated", "openfigi_asserted")
_VOLATILE = ("fact_id", "created_at", "updated_at")


def canonical_json(columns: list[str]) -> Column:
    """Columns as JSON with sorted names and no spaces; nulls are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def fact_id(kind: str, columns: list[str]) -> Column:
    """Kind and 24 hex digits that depend on the content alone, not on when it was written."""
    stable = [c for c in columns if c not in _VOLATILE]
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(canonical_json(stable), 256), 1, 24))


def tier_rank(state: Column) -> Column:
    out = F.lit(9)
    for rank, tier in reversed(list(enumerate(TIERS))):
        out = F.when(state == tier, rank).otherwise(out)
    return out


def best_facts(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Each era's fact of best assurance, the first in ``order`` among equals."""
    w = Window.partitionBy("symbol_era_id").orderBy(tier_rank(F.col("verification_state")), *order)
    return rows.filter("symbol_era_id is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_facts(rows: DataFrame, key: str = "symbol_era_id", order: Sequence[Column] = ()) -> DataFrame:
    """Each key's fact of the latest time, the greatest id among equals; ``order`` settles what an id leaves open."""
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("fact_id"), *order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge(stored: DataFrame, fresh: DataFrame, order: list[Column]) -> DataFrame:
    """A store with new facts added; what is stored under an id stays, and of new ones the first counts."""
    w = Window.partitionBy("fact_id").orderBy(*order)
    first = fresh.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return stored.unionByName(first.join(stored.select("fact_id"), "fact_id", "left_anti"))


def replace(stored: DataFrame, fresh: DataFrame, order: list[Column]) -> DataFrame:
    """A store in which new facts take the place of those of their id; of new ones the last counts."""
    w = Window.partitionBy("fact_id").orderBy(*order)
    last = fresh.withColumn("_n", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy("fact_id"))).filter("_n = _m").drop("_n", "_m")
    return stored.join(last.select("fact_id"), "fact_id", "left_anti").unionByName(last)


def staged_additions(stored: DataFrame, stage: DataFrame) -> DataFrame:
    """Staged facts whose id is new and whose era has no verified fact yet."""
    verified = stored.filter("verification_state = 'verified'").select("symbol_era_id")
    return stage.join(stored.select("fact_id"), "fact_id", "left_anti").join(verified, "symbol_era_id", "left_anti")


def identities_and_events(identities: DataFrame, events: DataFrame) -> DataFrame:
    """Best identity and best event of each era that has either."""
    return identities.join(events, "symbol_era_id", "full")


def bridged_gaps(eras: DataFrame, known: DataFrame) -> DataFrame:
    """Unknown eras between two of the same entity and instrument, in strict order of time.

    ``eras`` has symbol, symbol_era_id, first_day, last_day; ``known`` symbol_era_id, entity_id and
    instrument of verified identities.
    """
    facts = known.select("symbol_era_id", F.nullif(F.ltrim("entity_id", F.lit("0")), F.lit("")).alias("entity_id"), F.nullif("instrument", F.lit("")).alias("instrument"), F.lit(True).alias("_known"))
    w = Window.partitionBy("symbol").orderBy("first_day", "symbol_era_id")
    rows = eras.select("symbol", "symbol_era_id", "first_day", "last_day").join(facts, "symbol_era_id", "left")
    around = {f"_{side}_{c}": f(c).over(w) for side, f in (("b", F.lag), ("a", F.lead)) for c in ("entity_id", "instrument", "symbol_era_id", "first_day", "last_day")}
    rows = rows.withColumns(around)
    same = (F.col("_b_entity_id") == F.col("_a_entity_id")) & (F.col("_b_instrument") == F.col("_a_instrument"))
    ordered = (F.col("_b_last_day") < F.col("first_day")) & (F.col("first_day") <= F.col("last_day")) & (F.col("last_day") < F.col("_a_first_day"))
    return rows.filter(F.col("_known").isNull() & same & ordered).select(
        "symbol", "symbol_era_id", F.col("_b_entity_id").alias("entity_id"), F.col("_b_instrument").alias("instrument"), F.col("_b_symbol_era_id").alias("before_era_id"), F.col("_a_symbol_era_id").alias("after_era_id")
    )


def cohort_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: size and a hash (32 hexadecimal digits) that does not depend on order or partitions."""
    h = F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]).cast("binary"))
    half = lambda at: F.lpad(F.lower(F.hex(F.bit_xor(F.conv(F.substring(h, at, 16), 16, -10).cast("long")))), 16, "0")
    return rows.agg(F.count("*").alias("rows"), F.concat(half(1), half(17)).alias("hash"))


def ledger_errors(rows: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Eras that a ledger holds twice or with an unknown status."""
    each = rows.groupBy("symbol_era_id").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("resolution_status").isin(*known), F.lit(False))).alias("invalid"))
    return each.filter("n > 1 or invalid > 0")


def corroborated(facts: DataFrame, names_by_era: DataFrame, normal) -> DataFrame:
    """Facts with a label of whether other sources' names agree, and the state that follows.

    ``names_by_era`` has symbol_era_id, catalog_name and registry_name; the catalog's name decides
    where there is one. ``normal`` brings a name into normal form.
    """
    rows = facts.join(names_by_era, "symbol_era_id", "left")
    own = normal(F.col("issuer"))
    catalog, registry = F.nullif("catalog_name", F.lit("")), F.nullif("registry_name", F.lit(""))
    label = F.when(catalog.isNotNull(), F.when(normal(catalog) == own, "form25_agree").otherwise("form25_conflict")).when(
        registry.isNotNull(), F.when(normal(registry) == own, "sec_name_agree").otherwise("sec_name_conflict")
    ).otherwise("uncorroborated")
    state = F.when(F.endswith(label, F.lit("_agree")), "corroborated").otherwise("openfigi_asserted")
    return rows.withColumns({"corroboration": label, "verification_state": state, "contested": F.endswith(label, F.lit("_conflict"))}).drop("catalog_name", "registry_name")


def migrated(rows: DataFrame, mapping: DataFrame, must_survive: bool) -> DataFrame:
    """Older rows as facts under their era's new id.

    Rows of eras that are gone are dropped, or, where they are verified by hand and
    ``must_survive``, an error. A status that ends in ``_lead`` makes a candidate only.
    """
    known = mapping.select(F.col("old_era_id").alias("symbol_era_id"), "new_era_id")
    joined = rows.join(known, "symbol_era_id", "left")
    if must_survive:
        gone = F.raise_error(F.concat(F.lit("verified override on vanished era: "), F.col("symbol_era_id"))).cast("string")
        joined = joined.withColumn("new_era_id", F.coalesce("new_era_id", gone))
    kept = joined.filter("new_era_id is not null").withColumn("symbol_era_id", F.col("new_era_id")).drop("new_era_id")
    return kept.withColumn("verification_state", F.when(F.col("status").endswith("_lead"), "event_candidate").otherwise("verified"))


def check_cohort(rows: DataFrame, columns: list[str], stored: tuple[int, str] | None) -> tuple[int, str]:
    """Size and hash of a cohort; raises if one was stored and differs."""
    now = tuple(cohort_hash(rows, columns).first())
    if stored is not None and tuple(stored) != now:
        raise ValueError(f"the cohort has changed: {stored} was stored, {now} is here")
    return now


def bound_identities(eras: DataFrame, identifiers: DataFrame, catalog: DataFrame, done: DataFrame, normal) -> DataFrame:
    """Eras with the security that an identifier registry has for their symbol, or why they are held back.

    ``eras`` has symbol, symbol_era_id and match_status (single, multi or none), ``identifiers`` symbol,
    figi, name and place (their order), ``catalog`` symbol_era_id and catalog_name, ``done`` the
    symbol_era_id of eras that need none. Of several securities one is bound if the names of all whose
    normal form is the catalog's are one; nothing is guessed. Adds figi, issuer and binding.
    """
    named = catalog.filter("coalesce(catalog_name, '') <> ''").groupBy("symbol_era_id").agg(F.min("catalog_name").alias("_catalog"))
    rows = eras.join(done.select("symbol_era_id"), "symbol_era_id", "left_anti").filter(F.col("match_status").isin("single", "multi"))
    rows = rows.join(identifiers, "symbol").join(named, "symbol_era_id", "left")
    same = normal(F.col("name")) == normal(F.col("_catalog"))
    entry = F.struct("place", "figi", "name")
    each = rows.groupBy("symbol", "symbol_era_id", "match_status").agg(F.min(entry).alias("_first"), F.min(F.when(same, entry)).alias("_same"), F.count_distinct(F.when(same, F.col("figi"))).alias("_n"))
    single, bound = F.col("match_status") == "single", F.col("_n") == 1
    chosen = F.when(single, F.col("_first")).when(bound, F.col("_same"))
    binding = F.when(single, "single_figi_staged").when(bound, "multi_figi_bound").otherwise("multi_figi_held")
    return each.select("symbol", "symbol_era_id", chosen["figi"].alias("figi"), chosen["name"].alias("issuer"), binding.alias("binding"))
