"""What a retrieval may return: one hard plan, compiled for the scan and applied again to the rows behind the hits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import TimeRange
from ..plans import filters
from . import lineage

#: The version of an index entry that this engine writes and accepts, and the only trust it serves.
INDEX_VERSION, TRUST = 1, "untrusted_data"
LAYERS = ("raw", "summary", "semantic")


def kind_pattern(pattern: str) -> tuple[str, bool]:
    """A kind, or a root with one trailing ``.*``; anything else is an error."""
    import re

    low = (pattern or "").strip().lower()
    root = low.removesuffix(".*")
    parts = r"[a-z0-9_-]+(\.[a-z0-9_-]+)" + ("*" if root != low else "+")
    if len(root) > 160 or not re.fullmatch(parts, root):
        raise ValueError("invalid_kind_pattern")
    return root, root != low


@dataclass(frozen=True)
class HardPlan:
    """Everything that must hold of a hit, whatever its score."""

    tenant_id: str = ""
    user_id: str = ""
    domain_id: str = ""
    conversation_id: str | None = None
    layers: tuple[str, ...] = LAYERS
    kinds: tuple[str, ...] = ()
    explicit: bool = False
    time: TimeRange | None = None
    timezone: str = "UTC"
    limit: int = 6
    most: int = 50
    entities: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not set(self.layers) <= set(LAYERS) or not self.layers:
            raise ValueError("invalid_source_layers")
        if not 1 <= self.limit <= self.most:
            raise ValueError("limit_out_of_range")
        for pattern in self.kinds:
            kind_pattern(pattern)
        clean = tuple(dict.fromkeys(e.strip() for e in self.entities if e.strip()))
        object.__setattr__(self, "entities", clean)

    def predicate(self) -> Column:
        """Over columns of an index entry: scope, layer, kind, turn_role, visibility, policy, trust, state, lineage, timestamp."""
        trace = filters.is_trace(F.col("kind"), F.col("turn_role"))
        seen = (F.col("retrieval_visibility") == "default") & ~trace
        if self.explicit:
            seen = seen | (F.col("retrieval_visibility") == "explicit") | trace
        out = filters.scope(self.tenant_id, self.user_id, self.domain_id, self.conversation_id) & (F.col("index_status") == "indexed") & (F.col("index_version") == INDEX_VERSION)
        out = out & (F.coalesce("trust", F.lit(TRUST)) == TRUST) & (F.col("retrieval_visibility") != "never") & (F.col("retrieval_policy") != "never") & seen
        out = out & F.col("layer").isin(*self.layers) & ((F.col("layer") == "raw") | (F.col("lineage_status") == "valid"))
        if self.kinds:
            any_kind = F.lit(False)
            for pattern in self.kinds:
                any_kind = any_kind | filters.kind_matches(F.col("kind"), pattern)
            out = out & any_kind
        if self.time is not None:
            out = out & self.time.predicate(F.col("timestamp"), self.timezone)
        return F.coalesce(out, F.lit(False))

    def echo(self) -> dict:
        """The filters as they are applied, for the caller."""
        return {"scope": [self.tenant_id, self.user_id, self.domain_id], "conversation_id": self.conversation_id, "layers": list(self.layers), "kinds": list(self.kinds), "explicit": self.explicit, "time": self.time and [self.time.start, self.time.end, list(self.time.periods)], "entities": list(self.entities)}


def revalidated(hits: DataFrame, truth: DataFrame, plan: HardPlan, excluded: DataFrame | None = None, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits (source_id, score) whose record in the tables of truth still meets the plan, and those that do not.

    An index may lag behind: a hit whose record is gone, changed or excluded (id) or lies outside ``within`` (id) is
    told apart, so a caller can report the retrieval as unavailable instead of returning it.
    """
    good = truth.where(plan.predicate()).select("source_id")
    if excluded is not None:
        good = lineage.exclude(good, excluded)
    if within is not None:
        good = good.join(within.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return hits.join(good, "source_id", "left_semi"), hits.join(good, "source_id", "left_anti")


def relation_visible(explicit: bool) -> Column:
    """Whether an entry that a relation leads to may be shown (columns policy, visibility, trust, kind, turn_role)."""
    visibility = F.col("retrieval_visibility")
    shown = F.when(visibility == "explicit", F.lit(explicit)).when(visibility == "default", ~filters.is_trace(F.col("kind"), F.col("turn_role"))).otherwise(False)
    return F.coalesce((F.col("retrieval_policy") != "never") & (visibility != "never") & (F.coalesce("trust", F.lit(TRUST)) == TRUST) & shown, F.lit(False))


def excluded_ids(visible: DataFrame, edges: DataFrame, broken: DataFrame) -> DataFrame:
    """id: what is visible (start) and what is above it; of a visible id whose lineage is ``broken`` (id) only itself.

    A closure that is sound for all gives the same as one for each, so ids are resolved each on their own.
    """
    sound = visible.join(broken.select(F.col("id").alias("start")), "start", "left_anti")
    return lineage.visible_exclusion(sound, edges).unionByName(visible.select(F.col("start").alias("id"))).distinct()


def distinct_groups(matches: DataFrame, members: str = "source_ids") -> DataFrame:
    """Of matches (score, source_id, members) that stand for the same entries the best one."""
    from pyspark.sql import Window

    key = F.array_join(F.array_sort(members), "\x1f")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "source_id"))
    return matches.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
