"""A conversation's items for an agent that keeps its own list: stored in the engine, kept going if the store fails."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from .api import Engine
from .sources import writers


class Session:
    """get_items, add_items, pop_item and clear_session of one conversation.

    Items are dicts with a role. If the store fails the session goes on with its native list and says why in
    ``degraded``; nothing that was added is lost to the agent.
    """

    def __init__(self, engine: Engine, clock):
        if engine.namespace.conversation_id is None:
            raise ValueError("session_needs_a_conversation")
        self.engine, self.clock = engine, clock
        self.native: list[dict] = []
        self.hidden: set[str] = set()
        self.degraded = ""

    def _rows(self):
        if not self.engine.store.generation("timeline"):
            return []
        n = self.engine.namespace
        rows = self.engine.store.read("timeline", scope=(n.tenant_id, n.user_id, n.domain_id)).where(F.col("conversation_id") == n.conversation_id)
        return [(r.source_id, json.loads(r.payload)) for r in rows.orderBy("seq_no").select("source_id", "payload").collect() if r.payload and r.source_id not in self.hidden]

    def get_items(self, limit: int | None = None) -> list[dict]:
        if not self.degraded:
            try:
                items = [item for _, item in self._rows()]
                return items if limit is None else items[-limit:] if limit else []
            except Exception as error:  # noqa: BLE001  whatever the store fails with, the agent goes on
                self.degraded = type(error).__name__
        return list(self.native) if limit is None else self.native[-limit:] if limit else []

    def add_items(self, items: list[dict]) -> None:
        self.native += items
        if self.degraded or not items:
            return
        try:
            spark, n, now = self.engine.spark, self.engine.namespace, int(self.clock())
            made = [(n.tenant_id, n.user_id, n.domain_id, n.conversation_id, f"item-{uuid.uuid4().hex}", now, i, str(item.get("role") or "user"), item["content"] if isinstance(item.get("content"), str) else json.dumps(item.get("content")), json.dumps(item)) for i, item in enumerate(items)]
            rows = spark.createDataFrame(made, "tenant_id string, user_id string, domain_id string, conversation_id string, source_id string, timestamp long, place int, role string, text string, raw string")
            stored = writers.chat(rows, self.engine.timezone, F.col("role"), F.col("text")).drop("payload").join(rows.select("source_id", F.col("raw").alias("payload"), "role", "place"), "source_id")
            # Items of one call share a second, so their numbers follow their places.
            top = max([0, *(r.seq_no for r in self.engine.store.read("timeline").where(F.col("conversation_id") == n.conversation_id).agg(F.max("seq_no").alias("seq_no")).collect() if r.seq_no)]) if self.engine.store.generation("timeline") else 0
            self.engine.append(stored.withColumn("seq_no", (F.col("place") + top + 1).cast("long")).drop("place"))
        except Exception as error:  # noqa: BLE001
            self.degraded = type(error).__name__

    def pop_item(self) -> dict | None:
        """The last item, which the session no longer shows; the timeline keeps it."""
        last = self.native.pop() if self.native else None
        if self.degraded:
            return last
        rows = self._rows()
        if not rows:
            return None
        self.hidden.add(rows[-1][0])
        return rows[-1][1]

    def clear_session(self) -> None:
        self.native.clear()
        if not self.degraded:
            self.hidden |= {key for key, _ in self._rows()}
