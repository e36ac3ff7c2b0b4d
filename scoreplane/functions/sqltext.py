"""Spark SQL text for literals that are inlined into expressions.

Large constant arrays (rule dictionaries) are cheaper to hand to Spark as
one SQL expression than as thousands of ``lit`` calls.
"""

from __future__ import annotations


def sql_str(s: str) -> str:
    """A Spark SQL string literal with the exact value ``s``."""
    if "'" not in s:
        return "r'" + s + "'"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def str_array(items) -> str:
    items = list(items)
    return f"array({', '.join(sql_str(s) for s in items)})" if items else "CAST(array() AS array<string>)"
