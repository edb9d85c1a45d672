"""All queries of the core library; importing the modules adds theirs."""

from __future__ import annotations

import importlib

from tillage.plans.registry import Registry

REGISTRY = Registry()
for _name in ("retrieval", "texts", "normal", "chunks", "agronomic", "telemetry", "chat", "dashboard", "relations", "studies", "streams", "sources"):
    importlib.import_module(f"tillage.plans.{_name}")
