"""Column renaming and value normalisation of raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens import schemas
from fundlens.functions.dates import normalize_date
from fundlens.functions.money import normalize_currency
from fundlens.functions.names import blank_to_null
from fundlens.functions.numbers import to_number
from fundlens.operators.geography import match_references


def alias_lookup(column_map: dict[str, list[str]] | None = None) -> dict[str, str]:
    lookup = {}
    for canonical, aliases in (column_map or schemas.COLUMN_ALIASES).items():
        for name in (canonical, *aliases):
            lookup[name.lower().strip()] = canonical
    return lookup


def harmonise_columns(df: DataFrame, column_map: dict[str, list[str]] | None = None) -> DataFrame:
    """Rename known headings to canonical names; unknown columns pass through.

    When several source columns have the same target, the last one wins.
    """
    lookup = alias_lookup(column_map)
    source_of = {}
    for name in df.columns:
        source_of[lookup.get(name.lower().strip(), name)] = name
    return df.select([F.col(f"`{src}`").alias(dst) for dst, src in source_of.items()])


def normalise_values(df: DataFrame) -> DataFrame:
    """Currency, dates and percentages to plain text; what cannot be read stays as it was."""
    out = {}
    for c in df.columns:
        raw = F.col(f"`{c}`")
        if c in schemas.CURRENCY_COLUMNS:
            out[c] = F.coalesce(normalize_currency(raw).cast("string"), raw)
        elif c in schemas.DATE_COLUMNS:
            out[c] = F.coalesce(normalize_date(raw).cast("string"), raw)
        elif c in schemas.PERCENT_COLUMNS:
            number = to_number(F.regexp_replace(F.trim(raw), r"%+\s*$", ""))
            out[c] = F.coalesce(number.cast("string"), raw)
    return df.withColumns(out) if out else df


def reference_lists(mp_master: DataFrame) -> DataFrame:
    """Distinct trimmed place names as rows of (kind, name)."""
    kinds = {"state": "state", "district": "district", "constituency": "constituency"}
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), F.trim(F.col(c)).alias("name"))
                for kind, c in kinds.items()
            ]
        )
    )
    return (
        mp_master.select(pairs.alias("p"))
        .select("p.kind", "p.name")
        .where(blank_to_null(F.col("name")).isNotNull())
        .distinct()
    )


def normalise_rows(df: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """The whole normalisation stage; places are repaired when reference lists are given."""
    out = normalise_values(df)
    if references is None:
        return out
    places = {
        "state": "state",
        "nodal_district": "district",
        "implementing_district": "district",
        "constituency": "constituency",
    }
    return match_references(out, {c: k for c, k in places.items() if c in out.columns}, references)
