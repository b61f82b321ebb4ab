"""Canonical place names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.schemas import PLACE_ALIASES
from fundlens.operators.names import similar_names
from fundlens.session import materialise

# Thresholds of the two fuzzy steps.
FUZZY_THRESHOLD = 0.80
ALIAS_THRESHOLD = 0.75


def place_mapping(
    raw_names: DataFrame, references: DataFrame, threshold: float = FUZZY_THRESHOLD
) -> DataFrame:
    """(raw, canonical) for every distinct raw name; canonical is NULL when nothing fits.

    Order: same name ignoring case; known alias (its reference, else the first reference like it,
    else the alias text itself); closest reference by ratio, ties to the larger name.
    ``raw_names`` and ``references`` have one column ``name``.
    """
    raw = (
        raw_names.where(F.trim("name") != "")
        .select(F.col("name").alias("raw"), F.trim("name").alias("place"))
        .distinct()
        .withColumn("lower", F.lower("place"))
    )
    refs = references.select("name").distinct()
    exact = refs.groupBy(F.lower("name").alias("lower")).agg(F.min("name").alias("exact"))

    alias_of = F.element_at(
        F.create_map(*[F.lit(x) for pair in PLACE_ALIASES.items() for x in pair]), F.col("lower")
    )
    step = raw.join(exact, "lower", "left").withColumn(
        "alias_text", F.when(F.col("exact").isNull(), alias_of)
    )
    alias_exact = exact.select(
        F.col("lower").alias("alias_lower"), F.col("exact").alias("alias_exact")
    )
    aliases = step.where(F.col("alias_text").isNotNull()).select(
        F.lower("alias_text").alias("name")
    ).distinct()
    lower_refs = refs.select(F.lower("name").alias("name")).distinct()
    alias_like = (
        similar_names(aliases, lower_refs, ALIAS_THRESHOLD)
        .join(exact, F.col("name_b") == F.col("lower"))
        .groupBy(F.col("name_a").alias("alias_lower"))
        .agg(F.min("exact").alias("alias_like"))
    )
    unresolved = step.where(F.col("exact").isNull() & F.col("alias_text").isNull())
    closest = (
        similar_names(refs, unresolved.select(F.col("place").alias("name")), threshold)
        .groupBy(F.col("name_b").alias("place"))
        .agg(F.max(F.struct("ratio", "name_a")).alias("best"))
        .select("place", F.col("best.name_a").alias("fuzzy"))
    )
    return (
        step.withColumn("alias_lower", F.lower("alias_text"))
        .join(alias_exact, "alias_lower", "left")
        .join(alias_like, "alias_lower", "left")
        .join(closest, "place", "left")
        .select(
            "raw",
            F.coalesce("exact", "alias_exact", "alias_like", "alias_text", "fuzzy").alias(
                "canonical"
            ),
        )
    )


def match_reference(
    df: DataFrame, column: str, references: DataFrame, threshold: float = FUZZY_THRESHOLD
) -> DataFrame:
    """Replace ``column`` by its canonical name where one is found."""
    mapping = place_mapping(df.select(F.col(column).alias("name")), references, threshold)
    order = df.columns
    return (
        df.join(mapping, df[column] == mapping.raw, "left")
        .withColumn(column, F.coalesce(F.col("canonical"), df[column]))
        .select(order)
    )


def match_references(
    df: DataFrame, columns: dict[str, str], references: DataFrame, threshold: float = FUZZY_THRESHOLD
) -> DataFrame:
    """``match_reference`` for several columns, given with the kind of place each one names.

    ``references`` is (kind, name). The distinct names of all columns are taken in one pass over
    ``df``, and each kind is mapped once, whatever the number of its columns.
    """
    if not columns:
        return df
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for c, k in columns.items()]))
    names = materialise(df.select(found.alias("p")).select("p.kind", "p.name").distinct(), "place-names")
    mapping = None
    for kind in sorted(set(columns.values())):
        of_kind = F.col("kind") == kind
        part = place_mapping(names.where(of_kind).select("name"), references.where(of_kind).select("name"), threshold)
        part = part.select(F.lit(kind).alias("kind"), "raw", "canonical")
        mapping = part if mapping is None else mapping.unionByName(part)
    mapping = materialise(mapping, "place-mapping")
    order = df.columns
    for column, kind in columns.items():
        names_of = mapping.where(F.col("kind") == kind).select(F.col("raw").alias("_raw"), F.col("canonical").alias("_canonical"))
        df = (
            df.join(names_of, F.col(column) == F.col("_raw"), "left")
            .withColumn(column, F.coalesce("_canonical", column))
            .select(order)
        )
    return df
