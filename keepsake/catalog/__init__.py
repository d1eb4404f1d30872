"""All registered queries. Importing this package fills the registry."""

from importlib import import_module

from keepsake.catalog.registry import ENTRIES

for _name in ("recall", "lifecycle", "messages", "graph_tools", "sessions", "plans", "streams"):
    import_module(f"keepsake.catalog.{_name}")

__all__ = ["ENTRIES"]
