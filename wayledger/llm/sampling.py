"""Samples that match target category proportions.

Each (category, record) pair gets a uniform hash. A category's acceptance probability is its
wanted over its observed number, slightly raised; pairs with a hash below it are accepted
independently, wherever they are. Then counts are corrected exactly: the accepted pairs with the
largest hashes are dropped. For that only a histogram of hashes per category is made; ranks
are computed in one bin of each category, never over a whole category. The report of shortfalls compares the drawn
sample with the wanted one.

Targets are a table like any other: nothing here depends on their number but the kind of join Spark picks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayledger.llm.text import term_column
from wayledger.runtime import stage

BINS = 1024  # bins of a category's histogram, at least; the square root of the wanted rows if that is more


def wanted_rows(targets: DataFrame, keys: list[str], share: str = "wanted_share", minimum: str = "min_rows", rows: str = "sample_rows") -> DataFrame:
    """``targets`` with want_rows = the share of the sample, at least the minimum; nulls count as 0."""
    want = F.greatest(F.round(F.coalesce(share, F.lit(0.0)) * F.coalesce(rows, F.lit(0))).cast("bigint"), F.coalesce(minimum, F.lit(0)))
    return targets.select(*keys, want.alias("want_rows"))


class ProportionalSample:
    """A sample of records per category and the report of its shortfalls.

    ``units`` is (k0, k1, ..., record) with normalised keys; the keys of the targets are
    normalised in the same way. Several targets of one normalised key take the largest want. Units with a null in a
    key or the record count nowhere, repeated units once. A want of null or below 1 wants nothing.
    """

    def __init__(self, units: DataFrame, targets: DataFrame, keys: list[str], want: str = "want_rows", seed: int = 42, slack: float = 4.0) -> None:
        self.keys, self.slack = keys, slack
        self._names = [f"k{i}" for i in range(len(keys))]
        spelled = targets.select(*[F.col(k).alias(f"t{i}") for i, k in enumerate(keys)], F.greatest(F.lit(0), F.coalesce(want, F.lit(0))).cast("bigint").alias("want"), *[term_column(F.col(k)).alias(n) for k, n in zip(keys, self._names)])
        self._targets = stage(spelled.distinct(), "targets")
        self.wanted = self._targets.dropna(subset=self._names).where("want > 0").groupBy(*self._names).agg(F.max("want").alias("want"))
        found = units.where(F.col("record").isNotNull()).join(self.wanted.select(*self._names), self._names, "left_semi").select(*self._names, "record").distinct()
        u = F.pmod(F.xxhash64(*self._names, "record", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        self.pairs = stage(found.withColumn("u", u), "pairs")

    def probabilities(self) -> DataFrame:
        """(keys, want, p, bins): acceptance probability of each category, its wanted rows and some standard deviations more, over the observed."""
        observed = self.pairs.groupBy(*self._names).agg(F.count("*").alias("have"))
        p = F.least(F.lit(1.0), (F.col("want") + F.lit(self.slack) * F.sqrt("want") + 1) / F.col("have"))
        return self.wanted.join(observed, self._names).select(*self._names, "want", p.alias("p"), F.greatest(F.lit(BINS), F.ceil(F.sqrt("want"))).alias("bins"))

    def draw(self) -> DataFrame:
        """(keys normalised, record): exactly min(want, observed) records of each category."""
        drawn = self._drawn()
        return drawn.select(*[F.col(n).alias(k) for n, k in zip(self._names, self.keys)], "record")

    def _drawn(self) -> DataFrame:
        offered = stage(self.probabilities(), "offered")
        while True:
            accepted = self.pairs.join(offered, self._names).where(F.col("u") < F.col("p")).withColumn("bin", F.floor(F.col("u") / F.col("p") * F.col("bins")))
            histogram = stage(accepted.groupBy(*self._names, "bin", "want").agg(F.count("*").alias("n")), "histogram")
            short = offered.join(histogram.groupBy(*self._names).agg(F.sum("n").alias("n")), self._names, "left")
            short = short.where((F.col("p") < 1) & (F.coalesce("n", F.lit(0)) < F.col("want"))).select(*self._names, F.lit(True).alias("short"))
            if short.isEmpty():
                break
            # chance left a category short: offer it more
            offered = stage(offered.join(stage(short, "short"), self._names, "left").withColumn("p", F.when(F.col("short"), F.least(F.lit(1.0), F.greatest(2 * F.col("p"), 1 / F.col("bins")))).otherwise(F.col("p"))).drop("short"), "offered")
        before = F.sum("n").over(W.partitionBy(*self._names).orderBy("bin")) - F.col("n")  # a category has no more rows than bins
        cuts = histogram.withColumn("rest", F.col("want") - before).where((F.col("rest") > 0) & (F.col("n") >= F.col("rest"))).select(*self._names, F.col("bin").alias("cut"), "rest")
        judged = accepted.join(cuts, self._names, "left")
        below = judged.where(F.col("cut").isNull() | (F.col("bin") < F.col("cut"))).select(*self._names, "record")
        last = judged.where(F.col("bin") == F.col("cut")).withColumn("rank", F.row_number().over(W.partitionBy(*self._names).orderBy("u", "record")))
        return below.unionByName(last.where(F.col("rank") <= F.col("rest")).select(*self._names, "record"))

    def deficits(self) -> DataFrame:
        """(keys, want_rows, have_rows) of the targets, as spelled in their table, of which the drawn sample has fewer records than wanted."""
        have = self._drawn().groupBy(*self._names).agg(F.count("*").alias("have"))
        report = self._targets.join(have, self._names, "left").withColumn("have_rows", F.coalesce("have", F.lit(0)).cast("bigint"))
        return report.where(F.col("have_rows") < F.col("want")).select(*[F.col(f"t{i}").alias(k) for i, k in enumerate(self.keys)], F.col("want").alias("want_rows"), "have_rows").distinct()
