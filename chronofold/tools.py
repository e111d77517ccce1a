"""The engine as tools of a model: specifications, checked arguments, permissions, dispatch and receipts."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from .functions.documents import stable_hash


@dataclass(frozen=True)
class Parameter:
    kind: str
    required: bool = False
    choices: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None

    def schema(self) -> dict:
        if self.kind == "strings":
            return {"type": "array", "items": {"type": "string"}}
        out: dict = {"type": {"string": "string", "integer": "integer", "boolean": "boolean", "object": "object"}[self.kind]}
        out |= {"enum": list(self.choices)} if self.choices else {}
        out |= {"minimum": self.least} if self.least is not None else {}
        return out | ({"maximum": self.most} if self.most is not None else {})

    def check(self, name: str, value):
        ok = {"string": isinstance(value, str), "integer": isinstance(value, int) and not isinstance(value, bool), "boolean": isinstance(value, bool), "object": isinstance(value, dict), "strings": isinstance(value, list) and all(isinstance(v, str) for v in value)}
        if not ok[self.kind] or self.choices and value not in self.choices:
            raise ValueError(f"invalid_argument:{name}")
        if self.kind == "integer" and (self.least is not None and value < self.least or self.most is not None and value > self.most):
            raise ValueError(f"argument_out_of_range:{name}")
        return value


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict[str, Parameter]
    permission: str = "read"

    def schema(self, strict: bool = False) -> dict:
        """JSON schema of the arguments; a strict one lists all as required and lets optional ones be null."""
        properties = {n: p.schema() for n, p in self.parameters.items()}
        required = [n for n, p in self.parameters.items() if p.required]
        if strict:
            properties = {n: s if n in required else s | {"type": [s["type"], "null"]} for n, s in properties.items()}
            required = list(properties)
        return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}

    def spec(self, form: str, strict: bool = False) -> dict:
        """The specification in a provider's form."""
        head = {"name": self.name, "description": self.description}
        if form == "openai_chat":
            return {"type": "function", "function": head | {"parameters": self.schema(strict)} | ({"strict": True} if strict else {})}
        if form == "openai_responses":
            return {"type": "function"} | head | {"parameters": self.schema(strict)} | ({"strict": True} if strict else {})
        if form == "anthropic_messages":
            return head | {"input_schema": self.schema(strict)}
        if form == "plain":
            return head | {"parameters": self.schema(strict)}
        raise ValueError("unknown_tool_form")

    def arguments(self, raw) -> dict:
        """Arguments as text or object: known names only, right kinds, all that must be there; nulls count as absent."""
        value = json.loads(raw) if isinstance(raw, str) else raw
        if not isinstance(value, dict):
            raise ValueError("arguments_must_be_object")
        value = {k: v for k, v in value.items() if v is not None}
        if unknown := sorted(set(value) - set(self.parameters)):
            raise ValueError(f"unknown_argument:{unknown[0]}")
        if missing := [n for n, p in self.parameters.items() if p.required and n not in value]:
            raise ValueError(f"missing_argument:{missing[0]}")
        return {n: self.parameters[n].check(n, v) for n, v in value.items()}


_TIME = Parameter("object")
TOOLS = {t.name: t for t in (
    Tool("retrieve", "Find entries and summaries by meaning and keywords.", {"query": Parameter("string", True), "entities": Parameter("strings"), "topics": Parameter("strings"), "selector": _TIME, "within": Parameter("string"), "limit": Parameter("integer", least=1, most=50), "budget": Parameter("integer", least=1)}),
    Tool("browse", "List summaries by time, keywords and participants.", {"selector": _TIME, "node_types": Parameter("strings"), "keywords": Parameter("strings"), "match": Parameter("string", choices=("any", "all")), "page_size": Parameter("integer", least=1, most=200), "cursor": Parameter("string")}),
    Tool("open", "Open an entry or a summary with the ids of its sources.", {"memory_id": Parameter("string", True)}),
    Tool("open_sources", "Read what summaries were made of, in pages.", {"memory_ids": Parameter("strings", True), "page_size": Parameter("integer", least=1, most=200), "tokens": Parameter("integer", least=0), "size": Parameter("integer", least=0), "speakers": Parameter("strings"), "after": Parameter("object")}),
    Tool("read_timeline", "Read whole turns of a time range or around an entry.", {"selector": _TIME, "anchor": Parameter("string"), "turns": Parameter("integer", least=0, most=50), "budget": Parameter("integer", least=1)}),
    Tool("read_entry", "Read one entry.", {"source_id": Parameter("string", True)}),
    Tool("load_material", "Load a file that an entry refers to.", {"handle": Parameter("string", True)}, "material"),
)}


@dataclass
class Dispatcher:
    """Runs tools by name for a caller with some permissions; every call leaves a receipt."""

    engine: object
    permissions: frozenset[str] = frozenset({"read"})
    material: Callable[[str], str] | None = None
    receipts: list[dict] = field(default_factory=list)

    def _run(self, tool: Tool, arguments: dict):
        if tool.name == "load_material":
            if self.material is None:
                raise ValueError("material_loader_missing")
            return self.material(arguments["handle"])
        out = getattr(self.engine, tool.name)(**arguments)
        if hasattr(out, "collect"):
            return [r.asDict(True) for r in out.collect()]
        if isinstance(out, tuple):
            return {"items": [r.asDict(True) for r in out[0].collect()], "cursor": out[1]}
        return vars(out) if hasattr(out, "matches") else out

    def call(self, name: str, raw, call_id: str = "") -> dict:
        """{status, result or error}: a refused or failed call is an answer, never an exception of the host."""
        tool = TOOLS.get(name)
        try:
            if tool is None:
                raise ValueError("unknown_tool")
            if tool.permission not in self.permissions:
                raise PermissionError("tool_not_permitted")
            answer = {"status": "ok", "result": self._run(tool, tool.arguments(raw))}
        except PermissionError as error:
            answer = {"status": "forbidden", "error": str(error)}
        except KeyError as error:
            answer = {"status": "not_found", "error": str(error.args[0]) if error.args else ""}
        except ValueError as error:
            answer = {"status": "invalid", "error": str(error)}
        self.receipts.append({"call_id": call_id, "tool": name, "status": answer["status"], "arguments_hash": stable_hash(raw if isinstance(raw, dict) else str(raw)), "result_hash": stable_hash(json.loads(json.dumps(answer, default=str)))})
        return answer
