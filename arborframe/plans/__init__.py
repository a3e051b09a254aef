"""Paths through nested schemas and the rewriting of columns at them."""

from arborframe.plans.paths import narrowed, resolve, rebuilt, rewritten

__all__ = ["narrowed", "rebuilt", "resolve", "rewritten"]
