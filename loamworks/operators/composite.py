"""Scorecards of site results: four axes, their composite, strata, and the comparison of two scorecards by stratum."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the axes, core fields, and needles that name a stratum.
WEIGHTS = {"discovery": 0.20, "quality_extraction": 0.30, "field_completeness": 0.25, "volume_accuracy": 0.25}
CORE_FIELDS = ["title", "source_url", "location_raw", "salary_raw", "employment_type", "description"]
NEEDLES = {
    "greenhouse": "greenhouse", "lever.co": "lever", "ashby": "ashby", "workday": "workday", "myworkdayjobs": "workday", "bamboohr": "bamboohr", "smartrecruiters": "smartrecruiters", "icims": "icims", "taleo": "taleo",
    "successfactors": "successfactors", "jobvite": "jobvite", "breezy": "breezyhr", "rippling": "rippling", "oracle": "oracle_cx", "salesforce": "salesforce", "martianlogic": "martianlogic", "pageup": "pageup",
    "recruitee": "recruitee", "teamtailor": "teamtailor",
}
SHELL_NEEDLES, CMS_NEEDLES = ["__next_data__", "_next/data", "nuxt", "react-root"], ["wordpress", "elementor", "drupal", "joomla"]
#: Rows of a stratum from which it takes part in comparisons, points it may lose, and the ratio from which volume is too large.
LEAST_SITES, TOLERANCE, OVER = 3, 2.0, 1.5


def volume(found: Column, expected: Column) -> Column:
    """0 to 100: in proportion up to what is expected, falling from OVER times on; 50 for anything where nothing is expected."""
    ratio = found / F.nullif(expected, F.lit(0))
    over = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.greatest(F.lit(0.0), (ratio - OVER) * 100)))
    return F.when(F.coalesce(expected, F.lit(0)) <= 0, F.when(found > 0, 50.0).otherwise(0.0)).when(ratio >= 1, over).otherwise(F.greatest(F.lit(0.0), 100.0 * ratio))


def scorecard(sites: DataFrame, keys: Sequence[str], capped: bool = True, fields: int = len(CORE_FIELDS)) -> DataFrame:
    """One row a key of site results (found, failed, warned, jobs, filled, base): the axes and their composite, to one digit, and the number of sites ``n``.

    ``found`` and ``failed`` say whether the site's page was found and whether
    finding it failed, ``warned`` whether its jobs are doubtful; ``jobs`` are its
    good jobs, ``filled`` their filled core fields, ``base`` the jobs expected.
    Nulls count as false and 0. ``capped`` keeps each axis between 0 and 100.
    """
    number = lambda c: F.coalesce(F.sum(c), F.lit(0))
    total = sites.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("found") & ~F.coalesce("failed", F.lit(False))).alias("__d"),
        (F.count_if(F.col("jobs") > 0) - F.count_if("warned")).alias("__q"),
        number("jobs").alias("__jobs"), number("filled").alias("__filled"), number("base").alias("__base"),
    )
    axes = {
        "discovery": F.col("__d") / F.col("n") * 100,
        "quality_extraction": F.greatest(F.lit(0.0), F.col("__q") / F.col("n") * 100),
        "field_completeness": F.col("__filled") / F.greatest(F.lit(1), F.col("__jobs") * fields) * 100,
        "volume_accuracy": volume(F.col("__jobs"), F.col("__base")),
    }
    if capped:
        axes = {k: F.least(F.lit(100.0), F.greatest(F.lit(0.0), a)) for k, a in axes.items()}
    composite = sum((w * axes[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    return total.select(*keys, "n", F.round(composite, 1).alias("composite"), *(F.round(a, 1).alias(k) for k, a in axes.items()))


def stratum(tag: Column, hay: Column) -> Column:
    """A site's stratum: its tag, else the first needle in ``hay``, else the kind of page; a null hay is bespoke."""
    own, text = F.lower(F.trim(F.coalesce(tag, F.lit("")))), F.lower(F.coalesce(hay, F.lit("")))
    any_of = lambda needles: sum((F.when(F.contains(text, F.lit(x)), 1).otherwise(0) for x in needles), F.lit(0)) > 0
    out = F.when(any_of(SHELL_NEEDLES), "spa_shell").when(any_of(CMS_NEEDLES), "generic_cms").otherwise("bespoke")
    for needle, label in reversed(NEEDLES.items()):
        out = F.when(F.contains(text, F.lit(needle)), label).otherwise(out)
    return F.when(~own.isin("", "none", "null", "unknown"), own).otherwise(out)


def compared(challenger: DataFrame, champion: DataFrame, tolerance: float = TOLERANCE, least: int = LEAST_SITES) -> DataFrame:
    """(stratum, champion, challenger, delta, regressed) of each stratum in which the champion has enough sites; a missing challenger counts as 0 and as a loss."""
    old = champion.where(F.col("n") >= least).select("stratum", F.col("composite").alias("champion"))
    new = challenger.select("stratum", F.col("composite").alias("__c"))
    delta = F.round(F.coalesce("__c", F.lit(0.0)) - F.col("champion"), 1)
    lost = F.col("__c").isNull() | (F.col("__c") - F.col("champion") < -tolerance)
    return old.join(new, "stratum", "left").select("stratum", "champion", F.coalesce("__c", F.lit(0.0)).alias("challenger"), delta.alias("delta"), lost.alias("regressed"))


def verdict(challenger: DataFrame, champion: DataFrame, tolerance: float = TOLERANCE, least: int = LEAST_SITES) -> DataFrame:
    """One row: (regressions, worst_kept, passed) of two scorecards by stratum; ``worst_kept``: the worst stratum with enough sites is no more than ``tolerance`` below the champion's."""
    losses = compared(challenger, champion, tolerance, least).agg(F.count_if("regressed").alias("regressions"))
    worst = lambda cards, name: cards.where(F.col("n") >= least).agg(F.min("composite").alias(name))
    # Each side is one row.
    joined = losses.crossJoin(worst(champion, "__old")).crossJoin(worst(challenger, "__new"))
    kept = F.col("__old").isNull() | F.coalesce(F.col("__new") >= F.col("__old") - tolerance, F.lit(False))
    return joined.select("regressions", kept.alias("worst_kept"), ((F.col("regressions") == 0) & kept).alias("passed"))


def page_axes(pages: DataFrame) -> DataFrame:
    """One row over tested pages (error, titles, expected, extracted, filled): the axes by page means and their composite to two digits.

    ``titles`` counts distinct addresses with a title of 4 to 140 signs; a page is
    good from two on. Pages with an error count for discovery only.
    """
    ok = F.col("error").isNull()
    ratio = F.col("extracted") / F.nullif(F.col("expected"), F.lit(0))
    own = F.when(F.col("expected").isNull(), F.when(F.col("extracted") >= 1, 100.0).otherwise(0.0)).when(ratio <= 1, 100.0 * ratio).otherwise(F.greatest(F.lit(0.0), 100 - 100 * F.greatest(F.lit(0.0), ratio - OVER)))
    share = F.when(F.col("extracted") > 0, F.col("filled") / (F.col("extracted") * len(CORE_FIELDS))).otherwise(0.0)
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(ok, c)), F.lit(0.0)), 1)
    axes = pages.agg(
        F.round(F.coalesce(100 * F.avg(ok.cast("int")), F.lit(0.0)), 1).alias("discovery"), mean(F.when(F.col("titles") >= 2, 100.0).otherwise(0.0)).alias("quality_extraction"), mean(100 * share).alias("field_completeness"), mean(own).alias("volume_accuracy")
    )
    return axes.withColumn("composite", F.round(sum((w * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0)), 2))
