"""User functions as Spark columns: translation of the source, then symbols, then an Arrow UDF."""

from arborframe.functions.translate import Untranslatable, behave, compiled, required

__all__ = ["Untranslatable", "behave", "compiled", "required"]
