"""Quantities recorded in different units, brought to common ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BROADCAST_ROWS, broadcast_checked
from ..functions.unitgraph import CANONICAL, CASED, EDGES, SPELLINGS, conversion_rows

# Words by which remarks name a field.
FIELD_WORDS = {
    "dx": ["dx", "channel pitch", "channel spacing", "spatial step", "distance step", "kanalabstand", "pas spatial"],
    "dt": ["dt", "time step", "sampling step", "abtastschritt", "pas de temps"],
    "datarate": ["data ?rate", "sampling rate", "sample rate", "rate", "abtastrate", "cadence"],
    "spacing": ["spacing"],
}


def _words(dimension: str) -> str:
    """Alternatives for a unit in running text, longest first; letters may vary in case
    except where the case tells units apart."""
    plain = sorted({s for spellings in SPELLINGS[dimension].values() for s in spellings if s[0].isalpha() or s[0] in "µμ"}, key=lambda s: (-len(s), s))
    cased = [s for spellings in CASED.get(dimension, {}).values() for s in spellings]
    return "|".join([*cased, f"(?iu:{'|'.join(plain)})"])


def remark_unit(remarks: str, field: str, dimension: str):
    """The unit that remarks state for a field: the first unit after the field's
    name in the same clause. Other remarks with units in them don't count."""
    names = "|".join(FIELD_WORDS[field])
    between = r"[^.;,/\n]{0,40}?" if field != "spacing" else r"[^.\n]{0,40}?"
    pattern = rf"(?<![\p{{L}}])(?iu:{names})(?![\p{{L}}]){between}(?<![\p{{L}}\d])({_words(dimension)})(?![\p{{L}}\d])"
    found = F.regexp_extract(remarks, pattern, 1)
    return F.when(found != "", found)


def to_canonical(df: DataFrame, *, dimension: str = "dimension", value: str = "value", unit: str = "unit", canonical=CANONICAL, edges=EDGES) -> DataFrame:
    """Add ``common_unit``, ``common_value`` and ``is_common`` to rows of values.

    ``dimension``, ``value`` and ``unit`` name columns of ``df``; ``unit`` is a
    spelling, blanks around it and a full stop after it don't count.  Conversions
    are composed on the driver (some hundred rows) and joined by equality on
    dimension and spelling.  A null unit means the common one.  With a null value
    or an unknown unit or dimension the common value is null; an unknown unit is
    not common.  All rows are kept, repeated ones too.
    """
    known = conversion_rows(canonical, edges)
    rows = df.sparkSession.createDataFrame(
        known, "__u_dim string, __u_text string, __u_unit string, __u_cased boolean, __u_scale double, __u_offset double, __u_target string"
    )
    clean = F.regexp_replace(F.trim(F.col(unit)), r"(?<=.)\.$", "")
    cased = [s for table in CASED.values() for spellings in table.values() for s in spellings]
    text = F.when(clean.isin(cased), clean).otherwise(F.lower(clean))
    keyed = df.withColumn("__text", text)
    joined = keyed.join(F.broadcast(rows) if len(known) <= BROADCAST_ROWS else rows, (F.col(dimension) == F.col("__u_dim")) & (F.col("__text") == F.col("__u_text")), "left")
    home = F.create_map(*[F.lit(x) for pair in canonical.items() for x in pair])
    target = F.try_element_at(home, F.col(dimension))
    number = F.col(value).cast("double")
    missing = F.col("__text").isNull() | (F.col("__text") == "")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        target.alias("common_unit"),
        F.when(missing & target.isNotNull(), number).otherwise(number * F.col("__u_scale") + F.col("__u_offset")).alias("common_value"),
        (missing | F.coalesce(F.col("__u_unit") == target, F.lit(False))).alias("is_common"),
    )


def header_quantities(headers: DataFrame, instruments: DataFrame) -> DataFrame:
    """The steps and rates of acquisition headers in metres, seconds and hertz.

    One row for each number of a header row: acq_id, field (dx, dt, datarate or
    spacing), part (0, or the place in spacing), value, unit (what is said of it,
    null if nothing), is_common (the unit is the field's common one: m, s, Hz;
    [m, ms] for spacing), common_unit and common_value (m, s, Hz).  What the row
    says goes before the instrument's unit system.  A period in place of a rate
    is not common; its common value is the rate.  Fields that are null, or hold
    no number, give no row.
    """
    systems = broadcast_checked(instruments.select("instrument", "unit_system").dropDuplicates(["instrument"]))
    h = headers.select("acq_id", "instrument", "dx", "dxunit", "dt", "dtunit", "datarate", "spacing", "remarks").join(systems, "instrument", "left")
    imperial = F.when(F.col("unit_system") == "imperial", F.lit("ft"))
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    number = r"^\s*((?i:every|each|alle|toutes les)\s+)?([+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*(.*?)\s*$"
    part = lambda k: F.regexp_extract("datarate", number, k)
    rate_unit = F.coalesce(F.when(part(3) != "", part(3)), remark_unit("remarks", "datarate", "rate"))
    times = [s for spellings in SPELLINGS["time"].values() for s in spellings]
    is_period = (part(1) != "") | F.lower(rate_unit).isin(times)
    spacing_time = F.coalesce(remark_unit("remarks", "spacing", "time"), F.lit("ms"))

    def item(field, at, dimension, value, unit, common):
        return F.struct(F.lit(field).alias("field"), F.lit(at).alias("part"), F.lit(dimension).alias("dimension") if isinstance(dimension, str) else dimension.alias("dimension"),
                        value.cast("double").alias("value"), unit.alias("unit"), F.lit(common).alias("field_unit"))

    items = F.array(
        item("dx", 0, "length", F.col("dx"), F.coalesce(blank("dxunit"), remark_unit("remarks", "dx", "length"), imperial), "m"),
        item("dt", 0, "time", F.col("dt"), F.coalesce(blank("dtunit"), remark_unit("remarks", "dt", "time")), "s"),
        item("datarate", 0, F.when(is_period, "time").otherwise("rate"),
             F.regexp_replace(part(2), ",", ".").try_cast("double"), rate_unit, "Hz"),
        item("spacing", 0, "length", F.try_element_at("spacing", F.lit(1)), F.coalesce(remark_unit("remarks", "spacing", "length"), imperial), "m"),
        item("spacing", 1, "time", F.try_element_at("spacing", F.lit(2)), spacing_time, "ms"),
    )
    rows = h.select("acq_id", F.explode(items).alias("i")).select("acq_id", "i.*").filter("value IS NOT NULL AND NOT isnan(value)")
    found = to_canonical(rows)
    period = (F.col("field") == "datarate") & (F.col("dimension") == "time")
    in_ms = F.lower(F.trim("unit")).isin(SPELLINGS["time"]["ms"])
    return found.select(
        "acq_id", "field", "part", "value", "unit",
        F.when(period, False).when(F.col("field_unit") == "ms", F.coalesce(in_ms, F.lit(False))).otherwise(F.col("is_common")).alias("is_common"),
        F.when(period, "Hz").otherwise(F.col("common_unit")).alias("common_unit"),
        F.when(period, F.expr("try_divide(1D, common_value)")).otherwise(F.col("common_value")).alias("common_value"),
    )
