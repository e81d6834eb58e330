"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from trackscan.config import TOLERANCE, Bounds

# The frozen forest over the eight component features. A tree is
# (feature, threshold, tree at or below, tree above) or the value of a leaf.
THRESHOLD = 0.80645161290322576
FOREST = [
    (4, 0.2405722239418025, 0, (4, 0.99075833152796644, (6, 55.019496972978843, 0, (6, 56.635885751466859, 0.99331423113658068, 0)), 0)),
    (1, 0.64376556873321533, 0, (4, 1.0390564421527346, (6, 56.659900879576597, (4, 0.91116745485137007, 1, 0.93023255813953476), 0), 0)),
    (3, 0.61948281526565552, 0, (3, 1.6678162664175034, (0, 108.5, 0.83333333333333337, (6, 55.817378043813974, 0.98765432098765438, 1)), 0)),
    (1, 0.62267351150512695, 0, (3, 1.9294230937957764, (0, 74, 0, (0, 112.5, 0.98765432098765438, 1)), 0)),
    (3, 0.4982905387878418, 0, (3, 1.468310983851552, (4, 0.20042878722145585, 0, 1), 0)),
    (1, 0.63983064889907837, 0, (4, 0.94571887957256573, (2, 0.31847763061523438, 0, 1), 0)),
    (1, 0.65225982666015625, (1, 0.63709843158721924, 0, (2, 0.50532341003417969, 0.83333333333333337, 0)),
     (0, 171.5, (0, 111, (0, 105.5, 0.83333333333333337, 0), (2, 0.46001434326171875, 0.99415204678362579, 0.87671232876712335)), 0)),
    (3, 0.43592306971549988, 0, (3, 1.824202761054039, (3, 0.67402970790863037, 0, (2, 0.31877899169921875, 0, 0.99712368168744014)), 0)),
    (3, 0.43389829993247986, 0, (3, 1.9438272640109062, (2, 0.95899772644042969, (0, 81, 0, 0.99903938520653224), 0), 0)),
    (3, 0.47281622886657715, 0, (3, 1.3727716524153948, (0, 81, 0, (3, 0.86080271005630493, 0.98765432098765438, 1)), 0)),
    (5, 394.06683227881535, (3, 1.9075610265135765, (6, 59.694974016304371, (6, 53.078439118596876, 0, 1), 0), 0), 0),
    (3, 0.5187225341796875, 0, (3, 1.8108683973550797, (4, 0.25856169460259659, 0, (3, 1.5080595016479492, 1, 0.93023255813953476)), 0)),
    (1, 0.63468855619430542, 0, (3, 1.5284046977758408, (0, 112.5, 0.967741935483871, 1), 0)),
    (1, 0.6429750919342041, 0, (3, 1.8862583041191101, (7, 63.124003759455363, 1, 0), 0)),
    (3, 0.44766530394554138, 0, (3, 1.9438272640109062, (3, 0.67192453145980835, 0, (6, 58.837184919165821, 0.99712368168744014, 0)), 0)),
    (1, 0.63312959671020508, 0, (4, 0.95572084571048121, (6, 56.659900879576597, 1, 0), 0)),
    (1, 0.62540161609649658, 0, (3, 1.8499920666217804, (0, 111.5, 0.83333333333333337, 1), 0)),
]


def number(x: float) -> str:
    """A literal that both dialects read as a double."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def forest_sql(features: list[str]) -> str:
    """The mean of the trees as one CASE expression for each tree."""

    def case(tree) -> str:
        if not isinstance(tree, tuple):
            return number(tree)
        feature, threshold, low, high = tree
        return f"CASE WHEN {features[feature]} <= {number(threshold)} THEN {case(low)} ELSE {case(high)} END"

    return "(" + " + ".join(case(t) for t in FOREST) + f") / {number(len(FOREST))}"


def forest_score(*features: str) -> Column:
    return F.expr(forest_sql(list(features)))


def lower_quantile(values: Column, q: float) -> Column:
    """sorted[floor((n - 1) * q)] of an array; null when it is empty. Not the discrete percentile of SQL."""
    at = F.greatest(F.floor((F.size(values) - 1) * F.lit(float(q))) + 1, F.lit(1)).cast("int")
    return F.try_element_at(F.sort_array(values), at)


def distance(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Distance from the sensor."""
    return F.expr(f"sqrt(cast({x} AS double) * {x} + cast({y} AS double) * {y} + cast({z} AS double) * {z})")


def in_bounds(bounds: Bounds, lateral: Column, height: Column) -> Column:
    """All four sides included, with the tolerance."""
    return (
        (lateral >= bounds.left - TOLERANCE) & (lateral <= bounds.right + TOLERANCE) & (height >= bounds.bottom - TOLERANCE) & (height <= bounds.top + TOLERANCE)
    )


def zone_name(zone: Column) -> Column:
    return F.when(zone == 1, "CORE").when(zone == 2, "MARGIN").when(zone == 3, "OUTSIDE_REFERENCE").otherwise("UNKNOWN")


def finite(*columns: str) -> Column:
    """None of the columns null, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    return out


def header_ns(sec: Column, nanosec: Column) -> Column:
    """Nanoseconds of a message header, as text so that no reader rounds them."""
    return (sec.cast("long") * 1_000_000_000 + nanosec.cast("long")).cast("string")


def mebibytes(usage: Column) -> Column:
    """The used part of 'used / limit' in MiB; null when it can't be read."""
    used = F.trim(F.element_at(F.split(usage, "/"), 1))
    amount, unit = (F.regexp_extract(used, r"^([0-9.]+)\s*([KMG]?i?)B$", i) for i in (1, 2))
    value = F.when(amount != "", amount.try_cast("double"))
    return F.when(unit.isin("Gi", "G"), value * 1024.0).when(unit.isin("Mi", "M"), value).when(unit.isin("Ki", "K"), value / 1024.0).otherwise(value / 1048576.0)


def percent(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "%", "").try_cast("double")


def register(spark: SparkSession) -> None:
    """SQL functions zone_of(lateral, height), forest_score(f0 .. f7) and lower_quantile(array, q)."""
    names = [f"f{i}" for i in range(8)]
    from trackscan.config import CORE, EXPANDED

    def box(b: Bounds) -> str:
        return f"lateral BETWEEN {number(b.left - TOLERANCE)} AND {number(b.right + TOLERANCE)} AND height BETWEEN {number(b.bottom - TOLERANCE)} AND {number(b.top + TOLERANCE)}"

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION zone_of(lateral DOUBLE, height DOUBLE) RETURNS INT RETURN CASE WHEN {box(CORE)} THEN 1 WHEN {box(EXPANDED)} THEN 2 ELSE 3 END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION forest_score({', '.join(n + ' DOUBLE' for n in names)}) RETURNS DOUBLE RETURN {forest_sql(names)}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lower_quantile(v ARRAY<DOUBLE>, q DOUBLE) RETURNS DOUBLE RETURN try_element_at(sort_array(v), greatest(cast(floor((size(v) - 1) * q) + 1 AS int), 1))")
