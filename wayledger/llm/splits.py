"""Splits that keep related records together.

Records and the entities they name form a bipartite graph. The smallest record id spreads
over it, from records to entities and back, until nothing changes; then each connected group
has one label, its smallest id. Groups are assigned to splits so that sizes and label
distribution come close to the wanted ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.runtime import fits_broadcast, stage, unstage, weighted_join

STRATA = 200  # the most frequent label values are strata of their own; the others share one for each power of two of their frequency
BINS = 32  # bins of groups per stratum; strata * bins units are assigned on the driver
LARGE = 2000  # a group with more than 1/LARGE of all records is a unit of its own


def record_groups(records: DataFrame, record: str, entity: Column) -> DataFrame:
    """(group, record): every record that names an entity, with the smallest record of its group.

    Records are in one group if they share an entity, directly or through others. A null entity
    relates nothing, and records with only null entities do not come out, nor do null records.
    Repeated rows change nothing; an empty table gives no rows.

    The first round serves all records that name one entity. Only entities that a record
    joins to others take part in further rounds. Their labels jump to the label of their label, so
    the number of rounds follows the logarithm of a chain's length. No step gathers a group:
    minima combine map-side, and the rows of hot entities, hot records and hot labels meet what is joined to them without
    a shuffle, in every round.
    """
    edges = records.select(F.col(record).alias("record"), entity.alias("entity")).where(F.col("record").isNotNull() & F.col("entity").isNotNull()).distinct()
    edges = stage(edges, "edges")
    total = edges.count()
    labels = stage(edges.groupBy("entity").agg(F.min("record").alias("label"), F.count("*").alias("n")), "entities")
    bridges = edges.groupBy("record").agg(F.count("*").alias("n")).where("n > 1").select("record")
    links = stage(edges.join(bridges, "record", "left_semi"), "links")
    if links.isEmpty():
        return weighted_join(edges, labels, "entity", "n", total).select(F.col("label").alias("group"), "record")

    # with each entity goes the record that is its label, so that labels can jump
    labelled = labels.join(links.select("entity").distinct(), "entity", "left_semi").select("entity", F.col("label").alias("record"))
    links = stage(links.select("entity", "record").unionByName(labelled).distinct(), "links")
    # rows that meet each entity and record in a round, so that hot ones can be told
    ends = links.groupBy("entity").agg(F.count("*").alias("n_links"))
    degree = stage(links.groupBy("record").agg(F.count("*").alias("n_links")), "degree")
    n_links = links.count()
    current = stage(labels.drop("n").join(ends, "entity"), "labels")
    changed = True
    while changed:  # labels only get smaller, so this ends
        by_record = weighted_join(links, current, "entity", "n_links", n_links).groupBy("record").agg(F.min("label").alias("low"))
        by_record = stage(by_record.join(degree, "record"), "lowest")
        lowest = weighted_join(links, by_record, "record", "n_links", n_links).groupBy("entity").agg(F.min("low").alias("low"))
        step = stage(current.join(lowest, "entity").select("entity", "n_links", F.col("label").alias("was"), F.least("label", "low").alias("label")), "step")
        # a label is a record; where that record has a smaller label by now, jump to it
        over = by_record.select(F.col("record").alias("label"), F.col("low").alias("over"))
        used = step.groupBy("label").agg(F.count("*").alias("n_used"))
        over = over.join(used, "label")
        jumped = weighted_join(step, over.where(F.col("over") < F.col("label")), "label", "n_used", n_links).select("entity", "over")
        moved = stage(step.join(jumped, "entity", "left").select("entity", "n_links", "was", F.least("label", "over").alias("label")), "labels")
        changed = not moved.where(F.col("label") < F.col("was")).isEmpty()
        for done in (current, by_record, step):
            unstage(done)
        current = moved.drop("was")
    final = labels.join(current.select("entity", F.col("label").alias("settled")), "entity", "left").select("entity", "n", F.coalesce("settled", "label").alias("label"))
    return weighted_join(edges, final, "entity", "n", total).select(F.col("label").alias("group"), "record").distinct()


def split_assignment(groups: DataFrame, strata: DataFrame, wanted: dict[str, float], seed: int = 42) -> DataFrame:
    """(record, group, split): whole groups assigned near the wanted shares, label values spread alike over the splits.

    ``groups`` is (group, record), each record once; ``strata`` is (record, stratum) with the label values, any number of rows a
    record. A group belongs to the stratum of its rarest label value, so rare values are spread
    first; values beyond the STRATA most frequent share strata by frequency. Within a stratum, groups fall by hash into bins; a group with more than 1/LARGE of all
    records is a unit alone. The units (at most LARGE + strata * BINS, whatever the data's size) are
    assigned on the driver, rarest stratum and largest unit first, each to the split where the squared deviations from the wanted
    numbers, of records and of every label value a unit has, end least; then units move on while that lowers their sum.
    Shares are scaled to sum to 1; ties go to the split named first. Empty groups give no rows.
    """
    if not wanted or min(wanted.values()) < 0 or not sum(wanted.values()):
        raise ValueError("wanted shares must be positive")
    groups, strata = stage(groups, "groups"), stage(strata.where(F.col("stratum").isNotNull()), "strata")
    frequent = stage(strata.groupBy("stratum").agg(F.count("*").alias("n")), "frequent")
    ranked = frequent.orderBy(F.desc("n"), "stratum").limit(STRATA).collect()
    own = (F.col("n") > ranked[-1].n) | ((F.col("n") == ranked[-1].n) & (F.col("stratum") <= ranked[-1].stratum)) if ranked else F.lit(False)
    pool = F.concat(F.lit("n"), F.length(F.bin("n")).cast("string"))  # at most 64 pools
    named = frequent.withColumn("name", F.when(own, F.concat(F.lit("v"), "stratum")).otherwise(pool))
    known = weighted_join(strata.select("record", "stratum"), named, "stratum", "n", strata.count())
    # a record's names are at most the strata's, however many rows it has
    of_record = known.groupBy("record").agg(F.min(F.struct("n", F.col("name").alias("stratum"))).alias("best"), F.collect_set("name").alias("names"))
    labelled = stage(groups.join(of_record, "record", "left"), "labelled")
    sized = (
        labelled.groupBy("group")
        .agg(F.count("*").alias("size"), F.min("best").alias("best"))
        .select("group", "size", F.coalesce("best.n", F.lit(1 << 62)).alias("n"), F.coalesce("best.stratum", F.lit("")).alias("stratum"))
    )
    total = groups.count()
    binned = F.when(F.col("size") * LARGE > F.lit(total), F.concat(F.lit("g"), F.col("group").cast("string"))).otherwise(F.pmod(F.xxhash64("group", F.lit(seed)), F.lit(BINS)).cast("string"))
    sized = stage(sized.withColumn("bin", binned), "sized")
    placed = stage(weighted_join(labelled.select("group", "record", "names"), sized, "group", "size", total), "placed")
    units = placed.groupBy("stratum", "bin").agg(F.min("n").alias("n"), F.count("*").alias("size")).orderBy("n", F.desc("size"), "stratum", "bin").collect()
    values = placed.select("stratum", "bin", F.explode("names").alias("name")).groupBy("stratum", "bin", "name").count().collect()
    at = {(u.stratum, u.bin): i for i, u in enumerate(units)}
    column = {name: k + 1 for k, name in enumerate(sorted({v.name for v in values}))}
    has = np.zeros((len(units), len(column) + 1))
    has[:, 0] = [u["size"] for u in units]
    for v in values:
        has[at[v.stratum, v.bin], column[v.name]] = v["count"]
    whole = sum(wanted.values())
    share = {s: w / whole for s, w in wanted.items() if w}
    names = list(share)
    chosen = [(u.stratum, u.bin, names[k]) for u, k in zip(units, _assign(has, np.array(list(share.values()))))]
    plan = groups.sparkSession.createDataFrame(chosen, "stratum string, bin string, split string")  # as many rows as units
    return placed.join(F.broadcast(plan), ["stratum", "bin"]).select("record", "group", "split")


def _assign(has: np.ndarray, share: np.ndarray, passes: int = 8) -> list[int]:
    """The split of each unit; ``has`` holds its records and its records of each label value.

    The deviation of a split is the sum over the columns of the squared difference between what it has and
    its share of the column, over the column's total: so a value counts by its records. Records in all count
    as much as all values together.
    """
    if not len(has):
        return []
    total = np.maximum(has.sum(axis=0), 1)
    weight = 1 / total
    weight[0] *= max(1, len(total) - 1)
    now = np.zeros((len(share), has.shape[1]))
    seen = np.zeros(has.shape[1])
    out = np.zeros(len(has), int)
    for i, row in enumerate(has):
        seen += row
        lack = share[:, None] * seen - now  # of all assigned so far
        # adding the row to a split changes its deviation by row^2 - 2 row lack
        out[i] = np.argmin(((row * row - 2 * row * lack) * weight).sum(axis=1))
        now[out[i]] += row
    for _ in range(passes):
        moved = False
        for i, row in enumerate(has):
            k = out[i]
            over = now - share[:, None] * total
            gain = ((2 * row * over + row * row) * weight).sum(axis=1)  # of joining a split
            leave = ((row * row - 2 * row * over[k]) * weight).sum()
            gain[k] = -leave
            best = int(np.argmin(gain))
            if gain[best] + leave < -1e-9:
                now[k] -= row
                now[best] += row
                out[i], moved = best, True
        if not moved:
            break
    return out.tolist()


def split_targets(targets: DataFrame, limit: int = 1000) -> dict[str, float]:
    """The wanted share of each split, from a table checked to be small: what assigns units needs all splits at once."""
    if not fits_broadcast(targets, limit):
        raise ValueError(f"more than {limit} splits")
    return {r.split_name: r.wanted_share for r in targets.select("split_name", "wanted_share").distinct().orderBy(F.desc("wanted_share"), "split_name").collect() if r.split_name is not None and r.wanted_share is not None}
