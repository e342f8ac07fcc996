"""Values as written in tables: a number or range, its comparator, its unit and whether a footnote qualifies it.

A cell is cut into tokens (numbers, bounds, dashes, the rest), and its form is read off the sequence of their kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import is_placeholder_value

#: spelling without blanks in lower case -> unit id and symbol (fixed values)
UNIT_ALIASES: dict[str, tuple[str, str]] = {
    "l/p/day": ("lpd", "l/p/day"), "ppm": ("ppm", "ppm"), "ppb": ("ppb", "ppb"), "%": ("pct", "%"), "m": ("m", "m"), "km": ("km", "km"), "m2": ("m2", "m2"), "m²": ("m2", "m2"),
    "kgco2e/kg": ("kgco2e_kg", "kgCO2e/kg"), "µg/m3": ("ug_m3", "µg/m³"), "mg/m3": ("mg_m3", "mg/m³"), "db": ("db", "dB"), "dba": ("db", "dBA"), "sec": ("s", "sec"), "years": ("yr", "years"),
    "kwh/m2.year": ("kwh_m2_yr", "kWh/m2.year"), "kgco2e/m2gia": ("kgco2e_m2_gia", "kgCO2e/m2GIA"),
}
#: units that a sentence beside a cell may give in brackets (fixed values)
CONTEXT_UNITS = ("%", "m", "km", "m2", "m²", "dB", "dBA")
CAVEAT = "asterisk: a footnote qualifies this value"
#: characters a unit may begin with; further on it may hold digits and slashes too, and a stop that leads on to one of these
_UNIT = "a-zA-Zµ°²·"
#: the tokens of a cell: codes and section numbers, numbers (a minus behind no number or word is their sign), per cent, units, other signs
_TOKENS = "|".join([
    r"[a-zA-Z_]\w*\.[0-9][\w.]*|[0-9]+(?:\.[0-9]+){2,}", r"(?:(?<![\w.)%²³]\s{0,3})-)?[0-9]+(?:\.[0-9]+)?", "%",
    rf"[{_UNIT}](?:[{_UNIT}%0-9/]|\.(?=[{_UNIT}]))*", r"[^\s]"])
#: the forms of a cell by the kinds of its tokens, in the order they are tried, and the tokens each takes before a unit
_FORMS = [("range", "ndn", 3), ("lte", "ln", 2), ("gte", "gn", 2), ("percent", "np", 1), ("whole", "^n[up]?$", 1)]


def unit_of(symbol: Column) -> Column:
    """struct(unit_id, unit_symbol): by the table of spellings, else a slug of the symbol itself; null for an empty one."""
    key = F.lower(F.regexp_replace(symbol, r"\s+", ""))
    known = F.create_map(*[F.lit(x) for k, v in UNIT_ALIASES.items() for x in (k, v[0])])
    shown = F.create_map(*[F.lit(x) for k, v in UNIT_ALIASES.items() for x in (k, v[1])])
    slug = F.regexp_replace(F.regexp_replace(key, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    empty = symbol.isNull() | (key == "")
    return F.struct(
        F.when(~empty, F.coalesce(F.try_element_at(known, key), F.nullif(slug, F.lit("")))).alias("unit_id"),
        F.when(~empty, F.coalesce(F.try_element_at(shown, key), F.trim(symbol))).alias("unit_symbol"))


def _kind(token: Column) -> Column:
    """n number, p per cent, u unit or word, d dash, l and g bounds from above and below, c code, o any other."""
    return (
        F.when(token.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "n").when(token == "%", "p").when(token == "-", "d").when(token.isin("<", "≤"), "l").when(token.isin(">", "≥"), "g")
        .when(token.rlike(r"\.[0-9]"), "c").when(token.rlike(f"^[{_UNIT}]"), "u").otherwise("o"))


def parse_values(df: DataFrame, text: str, context: str | None = None, out: str = "parsed") -> DataFrame:
    """Adds struct(numeric, minimum, maximum, comparator, unit_id, unit_symbol, caveat_text, parsed_ok) of a cell, all native.

    A cell is cut into tokens and its form read off their kinds: number dash number is a range, a number behind `<` or `≤`
    is bounded from above, behind `>` or `≥` from below, a number before a per cent sign is a percentage, and a cell that is
    a number, or a number and a unit, is that. The first form in this order that occurs counts. Numbers inside codes are
    none. `context`, the sentence beside the cell, gives a unit in brackets and minimum or maximum only where the cell has
    none. Placeholders, words and null parse to nothing. The steps are columns of their own, so that each is evaluated once
    and the plan stays small enough to be compiled.
    """
    cell = F.trim(F.col(text))
    body = F.when(is_placeholder_value(cell), F.lit("")).otherwise(F.regexp_replace(cell, r"[\s*]*\*$", ""))
    steps = df.withColumn("_body", body).withColumn("_tokens", F.regexp_extract_all("_body", F.lit(_TOKENS), F.lit(0))).withColumn(
        "_kinds", F.array_join(F.transform("_tokens", _kind), ""))
    form, at, size = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, kinds, n in reversed(_FORMS):
        found = F.col("_kinds").rlike(kinds)
        form, at, size = F.when(found, name).otherwise(form), F.when(found, F.regexp_instr("_kinds", F.lit(kinds)) - 1).otherwise(at), F.when(found, n).otherwise(size)
    steps = steps.withColumns({"_form": form, "_at": at, "_size": size})
    bounded = F.col("_form").isin("lte", "gte")
    ctx = F.col(context) if context else F.lit(None).cast("string")
    beside = F.array_compact(F.array(*[F.when(F.contains(ctx, F.lit(f"({u})")), F.struct(F.locate(f"({u})", ctx).alias("at"), F.lit(u).alias("u"))) for u in CONTEXT_UNITS]))
    after = F.get("_tokens", F.col("_at") + F.col("_size"))
    own = F.when(F.substring("_kinds", F.col("_at") + F.col("_size") + 1, F.lit(1)).isin("u", "p"), after)
    words = F.transform(F.split(ctx, r"\W+"), lambda w: F.lower(w))
    told = F.when(F.array_contains(words, "minimum"), "gte").when(F.array_contains(words, "maximum"), "lte")
    steps = steps.withColumns({
        "_low": F.get("_tokens", F.col("_at") + F.when(bounded, 1).otherwise(0)).try_cast("double"), "_high": F.get("_tokens", F.col("_at") + 2).try_cast("double"),
        "_unit": F.coalesce(own, F.get(F.array_sort(beside), F.lit(0))["u"])}).withColumn("_u", unit_of(F.col("_unit")))
    is_range, ok = F.col("_form") == "range", F.col("_form").isNotNull()
    comparator = F.coalesce(F.when(is_range | bounded, F.col("_form")), told, F.lit("none"))
    return steps.withColumn(out, F.struct(
        F.when(ok & ~is_range, F.col("_low")).alias("numeric"), F.when(is_range, F.col("_low")).alias("minimum"), F.when(is_range, F.col("_high")).alias("maximum"),
        comparator.alias("comparator"), F.col("_u.unit_id").alias("unit_id"), F.col("_u.unit_symbol").alias("unit_symbol"),
        F.when(cell.rlike(r"\*$"), F.lit(CAVEAT)).alias("caveat_text"), ok.alias("parsed_ok"))).drop("_body", "_tokens", "_kinds", "_form", "_at", "_size", "_low", "_high", "_unit", "_u")
