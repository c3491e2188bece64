"""Open JSON (VARIANT) helpers.

They return SQL fragments rather than Columns because most of them run inside
higher-order functions, where the element is a lambda variable.
"""

from __future__ import annotations

# JSON renderings that count as false in a default chain.
_FALSY = "('\"\"', '0', '0.0', 'false', '{}', '[]', 'null')"


def node(v: str, path: str) -> str:
    """Sub-value at ``path`` (VARIANT), NULL when absent."""
    return f"try_variant_get({v}, '{path}', 'variant')"


def kind(v: str) -> str:
    return f"schema_of_variant({v})"


def as_text(v: str, path: str) -> str:
    """Scalar at ``path`` as text, whatever its type: enough to compare with a constant."""
    return f"try_variant_get({v}, '{path}', 'string')"


def text_at(v: str, path: str) -> str:
    """String at ``path``; NULL when absent or of another type."""
    return f"if({kind(node(v, path))} = 'STRING', try_variant_get({v}, '{path}', 'string'), NULL)"


def some_text_at(v: str, path: str) -> str:
    """Non-empty string at ``path``, else NULL."""
    return f"nullif({text_at(v, path)}, '')"


def list_at(v: str, path: str) -> str:
    """JSON array at ``path`` as array<variant>; NULL when it is anything else."""
    return f"try_variant_get({v}, '{path}', 'array<variant>')"


def items_at(v: str, path: str) -> str:
    """JSON array at ``path``, empty when absent or of another type."""
    return f"coalesce({list_at(v, path)}, CAST(array() AS array<variant>))"


def is_object(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL)"


def truthy(v: str) -> str:
    """Truth value of a VARIANT under default-chain rules."""
    return f"coalesce(to_json({v}) NOT IN {_FALSY}, false)"


def objects(arr: str) -> str:
    """Keep the object elements of an array<variant>; NULL gives an empty array."""
    return f"filter(coalesce({arr}, CAST(array() AS array<variant>)), o -> {is_object('o')})"


def stringify(v: str, limit: int = 5000) -> str:
    """Text form with a length cap: strings as they are, the rest as compact JSON, NULL as ``{{}}``."""
    return (f"coalesce(substring(CASE {kind(v)} WHEN 'STRING' THEN try_variant_get({v}, '$', 'string') "
            f"WHEN 'VOID' THEN '{{}}' WHEN 'BOOLEAN' THEN initcap(to_json({v})) "
            f"ELSE to_json({v}) END, 1, {limit}), '{{}}')")


def try_object(s: str) -> str:
    """Parse text as a JSON object; anything else gives an empty object."""
    parsed = f"try_parse_json({s})"
    return f"if({is_object(parsed)}, {parsed}, parse_json('{{}}'))"


def message_text(v: str) -> str:
    """Content of a chat message: text, or the text blocks of a list joined by blanks."""
    content = node(v, "$.content")
    blocks = (f"array_join(transform(filter({objects(list_at(v, '$.content'))}, "
              f"b -> {truthy(node('b', '$.text'))}), b -> {stringify(node('b', '$.text'), 2147483647)}), ' ')")
    return (f"CASE WHEN {kind(content)} LIKE 'ARRAY%' THEN {blocks} "
            f"WHEN {truthy(content)} THEN {stringify(content, 2147483647)} ELSE '' END")
