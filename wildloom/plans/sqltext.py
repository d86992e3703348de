"""SQL text for joins on LIKE, in Spark's dialect."""

from __future__ import annotations

from wildloom.session import quoted


def literal(s: str) -> str:
    """A raw string literal, or a quoted one where the text holds both kinds of quotes."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def like_join_sql(texts: str, patterns: str, columns: list[str], text: str, pattern: str, ignore_case: bool = False, escape: str | None = None, order_by: list[str] | None = None, broadcast: bool = False) -> str:
    """``SELECT columns FROM texts JOIN patterns ON text [I]LIKE pattern [ESCAPE c] [ORDER BY ..]``.

    Without an escape sign backslashes are doubled, as Spark's default sign is
    the backslash. ``broadcast`` names the pattern side as the one to send to
    all tasks, for sides whose size was measured.
    """
    p = f"p.{quoted(pattern)}"
    side = p if escape else f"replace({p}, {literal(chr(92))}, {literal(chr(92) * 2)})"
    tail = f" ESCAPE {literal(escape)}" if escape else ""
    hint = "/*+ BROADCAST(p) */ " if broadcast else ""
    sql = f"SELECT {hint}{', '.join(columns)} FROM {quoted(texts)} t JOIN {quoted(patterns)} p ON t.{quoted(text)} {'ILIKE' if ignore_case else 'LIKE'} {side}{tail}"
    return sql + (f" ORDER BY {', '.join(order_by)}" if order_by else "")
