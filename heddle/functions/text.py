"""String expressions of the normalizer and of the checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a transcript's texts are trimmed by: more than the space that SQL's trim takes.
BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Our own bank of secret-shaped values, in syntax that Java and RE2 share.
SECRETS = (
    ("assigned_token", r"(?i)(token|secret|password|passwd|api[_-]?key)\s*[=:]\s*\x22?[A-Za-z0-9_\-]{16,}"),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("bearer", r"(?i)bearer\s+[A-Za-z0-9._\-]{20,}"),
)
#: Shapes that no quote may have.
QUOTE_EXCLUSIONS = (
    ("arn", r"\barn:[a-z0-9\-]+:"),
    ("url", r"https?://"),
    ("path", r"(^|\s)(/[A-Za-z0-9._\-]+){2,}"),
    ("uuid", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    ("config_key", r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b"),
    ("self_talk", r"(?i)^\s*(I.ll (start|begin) by|let me (help|start|check|look)|I notice (that )?I)"),
    ("apology", r"(?i)(you.re absolutely right|\bI apologi[sz]e\b)"),
    *SECRETS,
)
#: What doesn't belong in a relationship profile: numbers (tickets, dates, sprints), addresses and links.
NOT_PROFILE = r"[0-9#@]|https?://"


def trimmed(c: Column) -> Column:
    """Without any Unicode white space or byte order mark at either end."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def title_from_path(path: Column, empty: str = "Unknown") -> Column:
    """Last part of a path with either slash; without parts the path itself; empty or null: `empty`."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")
    return F.coalesce(F.nullif(F.coalesce(F.try_element_at(parts, F.lit(-1)), path), F.lit("")), F.lit(empty))


def title(title: Column, first_message: Column, path: Column, empty: str = "Unknown") -> Column:
    """The title, else the first 80 characters of the first message, else the path's last part; blanks count as absent."""
    return F.coalesce(F.nullif(trimmed(title), F.lit("")), F.nullif(F.substring(trimmed(first_message), 1, 80), F.lit("")), title_from_path(path, empty))


def decoded_directory(name: Column) -> Column:
    """A working directory from a folder name that has "-" for "/"; lossy."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(name, "^-+|-+$", ""), "-", "/"))


def qualified_id(tool: Column, machine: Column, session: Column, message: Column) -> Column:
    """tool:machine:session:message."""
    return F.concat_ws(":", tool, machine, session, message)


def timestamp_of_epoch(x: Column) -> Column:
    """A timestamp from epoch seconds or milliseconds, told apart by size; null unless positive."""
    return F.when(x > 0, F.when(x < 1e11, F.timestamp_seconds(x)).otherwise(F.timestamp_millis(x.cast("long"))))


def has_shape(c: Column, bank: tuple[tuple[str, str], ...]) -> Column:
    """Name of the first pattern of a bank that a text has, or null."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(n)) for n, p in bank])


def valid_identifiers(identifiers: Column, name: Column, known: tuple[str, ...]) -> Column:
    """Identifiers without dates, ages and the name itself; unknown types become "Nickname"."""
    kept = F.filter(identifiers, lambda i: ~i["value"].rlike(r"^\d{1,3}$|^\d{4}-\d{2}-\d{2}$") & (F.lower(i["value"]) != F.lower(name)))
    return F.transform(kept, lambda i: F.struct(F.when(i["type"].isin(*known), i["type"]).otherwise(F.lit("Nickname")).alias("type"), i["value"].alias("value"), i["is_primary"].alias("is_primary")))
