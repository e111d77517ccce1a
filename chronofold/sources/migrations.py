"""Tables of older versions brought to the present one: columns that were added, metadata that was renamed.

A step turns a table of one version into the next by Columns alone, so a chain of steps is one projection over the old
files, and a migration is one commit that replaces the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metadata import ABOUT, FACETS, MOST_MOODS, PRIORITIES, allowed_strings, distinct_strings
from .adapters import legacy_role
from .store import LogStore

VERSION = 5
#: Facets of old category names.
CATEGORY_FACETS = {"preference": "preference", "personal_profile": "profile", "plan_goal": "plan", "relationship": "relationship", "emotion_state": "state", "life_event": "event"}
#: Roles of old subject scopes.
SCOPE_ROLES = {"user": ("user",), "assistant": ("assistant",), "other": ("third_party", "external")}
#: The least old importance of each priority, from the highest.
IMPORTANCE = ((0.85, "critical"), (0.65, "high"), (0.25, "normal"))

_STRINGS = "array<string>"
#: What old metadata may hold.
OLD_METADATA = "struct<turn_intent:string,memory_facets:array<string>,about_roles:array<string>,entity_anchors:array<string>,topic_terms:array<string>,retrieval_priority:string,mood_tags:array<string>,keywords:array<string>,categories:array<string>,subject_scopes:array<string>,importance:string>"


def _mapped(values: Column, pairs: dict[str, tuple[str, ...]]) -> Column:
    table = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.filter(F.transform(distinct_strings(values), lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull()))


def present_metadata(raw: Column) -> Column:
    """Old metadata (JSON) in present terms; anything unreadable is empty metadata."""
    m = F.coalesce(F.from_json(raw, OLD_METADATA), F.from_json(F.lit("{}"), OLD_METADATA))
    categories = distinct_strings(m["categories"])
    facets = F.concat(distinct_strings(m["memory_facets"]), _mapped(m["categories"], {k: (v,) for k, v in CATEGORY_FACETS.items()}))
    roles = F.concat(distinct_strings(m["about_roles"]), _mapped(m["subject_scopes"], SCOPE_ROLES))
    asked = F.array_contains(categories, "memory_query") | (F.trim(F.coalesce(m["turn_intent"], F.lit(""))) == "memory_query")
    given, importance = F.lower(F.trim(F.coalesce(m["retrieval_priority"], F.lit("")))), F.coalesce(m["importance"].try_cast("double"), F.lit(0.0))
    by_importance = F.lit("low")
    for least, name in reversed(IMPORTANCE):
        by_importance = F.when(importance >= least, name).otherwise(by_importance)
    return F.struct(
        F.when(asked, "memory_query").otherwise("").alias("turn_intent"), allowed_strings(facets, FACETS).alias("memory_facets"), allowed_strings(roles, ABOUT).alias("about_roles"),
        distinct_strings(m["entity_anchors"]).alias("entity_anchors"), distinct_strings(F.concat(distinct_strings(m["topic_terms"]), distinct_strings(m["keywords"]))).alias("topic_terms"),
        F.when(given.isin(*PRIORITIES), given).otherwise(by_importance).alias("retrieval_priority"), F.slice(distinct_strings(m["mood_tags"]), 1, MOST_MOODS).alias("mood_tags"),
    )


def with_defaults(df: DataFrame, **defaults: Column) -> DataFrame:
    """``df`` with the columns that it lacks; those that it has stay."""
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def _typed(df: DataFrame) -> DataFrame:
    """1 to 2: roles become kinds, origins and turn roles."""
    role = legacy_role(F.col("role"))
    return with_defaults(df, kind=role["kind"], origin=role["origin"], turn_role=role["turn_role"], correlation_id=role["correlation_id"], turn_id=F.lit(""))


def _described(df: DataFrame) -> DataFrame:
    """2 to 3: metadata in present terms; the JSON text goes."""
    raw = F.col("memory_metadata_json") if "memory_metadata_json" in df.columns else F.lit(None).cast("string")
    return df.withColumn("memory_metadata", present_metadata(raw)).drop("memory_metadata_json")


def _governed(df: DataFrame) -> DataFrame:
    """3 to 4: what is found by default and what only when asked for."""
    environment = F.col("origin") == "environment"
    return with_defaults(df, retrieval_visibility=F.when(environment, "explicit").otherwise("default"), retrieval_policy=F.when(environment, "explicit").otherwise("auto"), semanticize=~environment, prompt_visible=F.lit(True), trust=F.lit("untrusted_data"))


def _versioned(df: DataFrame) -> DataFrame:
    """4 to 5: rows have versions, and all are to be indexed again."""
    return with_defaults(df, row_version=F.lit(1).cast("long"), is_summarized=F.lit(False)).withColumn("index_status", F.lit("pending"))


STEPS: dict[int, Callable[[DataFrame], DataFrame]] = {1: _typed, 2: _described, 3: _governed, 4: _versioned}


def migrated(df: DataFrame, version: int, to: int = VERSION) -> DataFrame:
    """A timeline of ``version`` as one of version ``to``; a newer one than this engine knows is an error."""
    if version > to:
        raise ValueError("schema_version_is_newer_than_engine")
    for v in range(version, to):
        df = STEPS[v](df)
    return df


def migrate(store: LogStore, table: str, version: int) -> int:
    """Replace a stored table by its present form in one commit; the generation that it was read from must be the last."""
    base = store.generation(table)
    return store.commit(table, migrated(store.read(table, base), version), base, replace=True)
