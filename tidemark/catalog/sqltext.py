"""SQL building blocks shared by the oracles."""

from tidemark.functions.texts import ADVICE, TEXTS, filled_sql, quoted

LEVELS = 17


def merkle_sql(leaves: str, name: str, keys: str = "source_id", levels: int = LEVELS) -> str:
    """CTEs name_1..name_n over leaves(keys, i, h hex): the last one holds the root at i = 0."""
    parts, below = [], leaves
    for n in range(1, levels + 1):
        parts.append(
            f"{name}_{n} AS (SELECT {keys}, i // 2 AS i, CASE WHEN count(*) = 2 THEN "
            f"sha256(unhex('01') || unhex(min_by(h, i)) || unhex(max_by(h, i))) ELSE min(h) END AS h "
            f"FROM {below} GROUP BY {keys}, i // 2)")
        below = f"{name}_{n}"
    return ",\n".join(parts)


def root_name(name: str, levels: int = LEVELS) -> str:
    return f"{name}_{levels}"


def finding_select(ident: str, ord_: int, source: str, **values: str) -> str:
    """A finding of every row of source; values are SQL expressions that fill its text."""
    text = TEXTS[ident]
    return (f"SELECT source_id, {ord_} AS ord, {quoted(ident)} AS id, {quoted(text.severity)} AS severity, {quoted(text.title)} AS title, "
            f"{filled_sql(text.detail, **values)} AS detail, {quoted(ADVICE[ident])} AS recommendation FROM {source}")
