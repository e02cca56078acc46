"""Adapters: what a project plugs into the flow of edits and sessions, by type."""

from __future__ import annotations

import tomllib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import fold_messages
from .ledger import verdict_fold


class Adapter:
    """Does nothing; each kind overrides what it has to say. Columns are expressions over a batch of events."""

    kind = ""

    def __init__(self, options: dict | None = None):
        self.options = options or {}

    def pre_edit(self, events: DataFrame) -> Column:
        """pass, ask or deny."""
        return F.lit("pass")

    def post_edit(self, events: DataFrame) -> Column:
        """A message, or null."""
        return F.lit(None).cast("string")

    def session_start(self, sessions: DataFrame) -> Column:
        return F.lit(None).cast("string")

    def session_stop(self, sessions: DataFrame) -> Column:
        return F.lit(None).cast("string")

    def tools(self) -> dict[str, Callable]:
        return {}


class Registry:
    """Factories of adapters by type."""

    def __init__(self) -> None:
        self.factories: dict[str, Callable[[dict], Adapter]] = {}

    def register(self, kind: str, factory: Callable[[dict], Adapter]) -> None:
        if not kind or kind in self.factories:
            raise ValueError(f"the type {kind!r} is empty or taken")
        self.factories[kind] = factory

    def create(self, kinds: list[str], options: dict[str, dict] | None = None) -> list[Adapter]:
        unknown = [k for k in kinds if k not in self.factories]
        if unknown:
            raise KeyError(f"no adapter of type {unknown[0]!r}")
        return [self.factories[k]((options or {}).get(k, {})) for k in kinds]


def read_config(text: str | None) -> dict:
    """A TOML configuration; a missing one is empty. Adapters are an array of tables with a type each."""
    config = tomllib.loads(text or "")
    adapters = config.get("adapters", [])
    if not isinstance(adapters, list) or not all(isinstance(a, dict) for a in adapters):
        raise ValueError("adapters must be an array of tables")
    return config


def enabled(config: dict, truth_folder: bool) -> list[str]:
    """The types that take part, in order: those listed, each once; without a list `code` first, and `ground-truth` if its folder is there."""
    listed = [a.get("type", "") for a in config.get("adapters", [])]
    if listed:
        return list(dict.fromkeys(k for k in listed if k)) or ["code"]
    return ["code"] + ["ground-truth"] * truth_folder


def pre_edit_verdicts(events: DataFrame, adapters: list[Adapter], key: str = "id") -> DataFrame:
    """(key, verdict): the first verdict, in the adapters' order, that is not a pass; ask counts as deny."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), a.pre_edit(events).alias("v")) for i, a in enumerate(adapters)])).alias("x")
    return verdict_fold(events.select(key, each).select(key, "x.o", "x.v"), key, "o", "v")


def messages(rows: DataFrame, adapters: list[Adapter], step: str, key: str = "id") -> DataFrame:
    """(key, message): what the adapters say at a step (post_edit, session_start, session_stop), joined in their order."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), getattr(a, step)(rows).alias("t")) for i, a in enumerate(adapters)])).alias("x")
    return fold_messages(rows.select(key, each).select(key, "x.o", "x.t"), key, "o", "t")
