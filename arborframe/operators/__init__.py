"""The fifteen operators: recastings, transformations and actions."""

from arborframe.operators.frame import NestedFrame

__all__ = ["NestedFrame"]
