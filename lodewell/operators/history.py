"""The history of named things over versions, with parts that some versions could not read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Event kinds in their fixed order.
KINDS = ("created", "snapshot", "clone", "promoted", "renamed", "destroyed", "snapshot-destroyed", "property", "host", "pending", "unreadable", "abandoned")


def presence(states: DataFrame, versions: DataFrame, unread: DataFrame, version: str, key: str, name: str) -> DataFrame:
    """Each state with its key's previous and next state, and the first version that truly lacks it.

    ``versions`` holds the readable versions in one column; ``unread`` lists
    (version, prefix): names at or below a prefix were not read there, so
    their absence says nothing and they are carried over. ``_gone`` is the
    first later version, before the key's next state, that read the name's
    place and did not find the key; null if there is none.
    """
    w = Window.partitionBy(key).orderBy(version)
    rows = states.withColumn("_prev", F.lag(F.struct(*states.columns)).over(w)).withColumn("_next", F.lead(version).over(w))
    later = versions.select(F.col(version).alias("_at"))
    gaps = rows.select(F.col(version).alias("_v"), F.col(key).alias("_k"), F.col(name).alias("_name"), "_next")
    # Versions are at most the slots of all members' rings, some hundreds of rows each; a state meets those between it and its key's next state.
    cand = gaps.join(F.broadcast(later), (F.col("_at") > F.col("_v")) & (F.col("_next").isNull() | (F.col("_at") < F.col("_next"))))
    hidden = F.broadcast(unread.select(F.col(version).alias("_at"), "prefix"))
    inside = (F.col("_name") == F.col("prefix")) | F.col("_name").startswith(F.concat("prefix", F.lit("/"))) | F.col("_name").startswith(F.concat("prefix", F.lit("@")))
    real = cand.join(hidden.withColumnRenamed("_at", "_u"), (F.col("_at") == F.col("_u")) & inside, "left_anti")
    gone = real.groupBy("_v", "_k").agg(F.min("_at").alias("_gone"))
    return rows.join(gone, (rows[version] == gone["_v"]) & rows[key].eqNullSafe(gone["_k"]), "left").drop("_v", "_k")


def events(states: DataFrame, versions: DataFrame, unread: DataFrame, version: str = "txg", key: str = "guid", name: str = "name", facts: Sequence[str] = ("volsize", "volblocksize")) -> DataFrame:
    """(txg, kind, kind_ord, object, guid, details, last_seen, recover_with).

    ``states`` has one row per version and key with name, snapshot, clone,
    origin_obj, creation_txg, the facts, and ``unknown`` (facts not read).
    The first version's states are the base, not events. A creation is dated
    by the object's own record where that is older; a fact's change is an
    event only if it was read on both sides.
    """
    rows = presence(states, versions, unread, version, key, name)
    first = versions.agg(F.min(version).alias("_first"))
    rows = rows.join(F.broadcast(first))
    prev = F.col("_prev")
    back = prev.isNull() & (F.col(version) > F.col("_first"))
    again = prev.isNotNull() & F.col("_was_gone")
    rows = rows.withColumn("_was_gone", F.lag(F.col("_gone").isNotNull(), 1, False).over(Window.partitionBy(key).orderBy(version)))
    kind = F.when(F.col("snapshot"), "snapshot").when(F.col("clone"), "clone").otherwise("created")
    none = F.lit(None).cast("string")
    no_version = F.lit(None).cast("long")
    shape = [F.col(name).alias("object"), F.col(key).alias("guid")]

    made = rows.filter(back | again).select(F.least(version, F.coalesce("creation_txg", version)).alias("txg"), kind.alias("kind"), *shape, none.alias("details"), no_version.alias("last_seen"), none.alias("recover_with"))
    both = rows.filter(prev.isNotNull() & ~F.col("_was_gone"))
    renamed = both.filter(prev[name] != F.col(name)).select(F.col(version).alias("txg"), F.lit("renamed").alias("kind"), *shape, F.concat(F.lit("was "), prev[name]).alias("details"), no_version.alias("last_seen"), none.alias("recover_with"))
    promoted = both.filter((F.coalesce(prev["origin_obj"], F.lit(0)) != 0) & (F.coalesce("origin_obj", F.lit(0)) == 0) & ~F.col("snapshot")).select(F.col(version).alias("txg"), F.lit("promoted").alias("kind"), *shape, none.alias("details"), no_version.alias("last_seen"), none.alias("recover_with"))
    texts, changed = [], F.lit(False)
    for f in facts:
        known = ~F.array_contains("unknown", f) & ~F.array_contains(prev["unknown"], f)
        differs = known & ~prev[f].eqNullSafe(F.col(f))
        changed = changed | differs
        texts.append(F.when(differs, F.concat(F.lit(f"{f}: "), F.coalesce(prev[f].cast("string"), F.lit("none")), F.lit(" -> "), F.coalesce(F.col(f).cast("string"), F.lit("none")))))
    props = both.filter(changed).select(F.col(version).alias("txg"), F.lit("property").alias("kind"), *shape, F.concat_ws(", ", *texts).alias("details"), no_version.alias("last_seen"), none.alias("recover_with"))
    lost = rows.filter("_gone is not null").select(F.col("_gone").alias("txg"), F.when(F.col("snapshot"), "snapshot-destroyed").otherwise("destroyed").alias("kind"), *shape, none.alias("details"), F.col(version).cast("long").alias("last_seen"), F.concat(F.lit("dump "), F.col(name), F.lit(" --txg "), F.col(version)).alias("recover_with"))
    out = made.unionByName(renamed).unionByName(promoted).unionByName(props).unionByName(lost)
    return out.withColumn("kind_ord", F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1)
