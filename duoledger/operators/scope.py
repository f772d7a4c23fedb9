"""Who may read what: one entity, or all that a reader may see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """entity_ids: empty for all that the reader may see; consolidated needs two of them at least."""

    user_id: int
    entity_ids: tuple[int, ...] = ()
    consolidated: bool = False


def visible(entities: DataFrame, grants: DataFrame, scope: Scope) -> DataFrame:
    """(entity_id) of active entities granted to the reader, cut to the scope; none where a consolidated view would have fewer than two."""
    own = entities.where("active").join(grants.where(F.col("user_id") == scope.user_id).select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id")
    if scope.entity_ids:
        own = own.where(F.col("entity_id").isin(list(scope.entity_ids)))
    if scope.consolidated:
        enough = own.agg((F.count("*") >= 2).alias("enough")).where("enough")
        own = own.join(F.broadcast(enough), F.lit(True), "left_semi")
    return own


def scoped(rows: DataFrame, entities: DataFrame, grants: DataFrame, scope: Scope) -> DataFrame:
    """rows of the entities that the scope shows."""
    return rows.join(visible(entities, grants, scope), "entity_id", "left_semi")


def search(rows: DataFrame, column: str, term: str) -> DataFrame:
    """rows whose column holds the term, whatever its case; % and , in the term stand for a space."""
    return rows.where(F.col(column).ilike("%" + term.replace("%", " ").replace(",", " ") + "%"))
