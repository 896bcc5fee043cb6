"""Text and tool-name columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterloom.functions.clock import as_col

# Tool names per activity kind, kinds in tie-break order.
KIND_ORDER = ["edit", "read", "search", "run", "web", "agent", "mcp", "other"]
TOOL_KIND = {
    "edit": ["Edit", "Write", "MultiEdit", "NotebookEdit"],
    "read": ["Read"],
    "search": ["Grep", "Glob", "LS", "ToolSearch"],
    "run": ["Bash", "PowerShell"],
    "web": ["WebFetch", "WebSearch"],
    "agent": ["Task"],
}
TOOL_PREFIX = {"agent": "Agent", "mcp": "mcp__"}


def tool_kind(name: Column | str) -> Column:
    """Activity kind of one tool name; case matters, unknown names are ``other``."""
    name = as_col(name)
    rules = [(name.isin(tools), kind) for kind, tools in TOOL_KIND.items()]
    rules += [(name.startswith(prefix), kind) for kind, prefix in TOOL_PREFIX.items()]
    head, *rest = rules
    chain = reduce(lambda acc, rule: acc.when(rule[0], rule[1]), rest, F.when(*head))
    return chain.otherwise("other")


def dominant_kind(tools: Column | str) -> Column:
    """Most frequent kind among a message's tools; ties go to the earlier kind, none to ``other``.

    Each kind becomes ``(count, -rank, kind)`` so that the greatest struct is the answer.  No
    count is taken for a message with at most one tool, which most are.
    """

    def vote(kinds: Column) -> Column:
        def ballot(rank: int, kind: str) -> Column:
            hits = F.size(F.filter(kinds, lambda k: k == kind))
            return F.struct(hits.alias("n"), F.lit(-rank).alias("tie"), F.lit(kind).alias("kind"))

        return F.array_max(F.array(*[ballot(r, k) for r, k in enumerate(KIND_ORDER)]))["kind"]

    # A one-element array binds a value to a name, so that it is computed once.
    def choose(names: Column) -> Column:
        several = F.transform(F.array(F.transform(names, tool_kind)), vote)[0]
        return (
            F.when(F.size(names) == 0, "other")
            .when(F.size(names) == 1, tool_kind(F.get(names, F.lit(0))))
            .otherwise(several)
        )

    return F.transform(F.array(as_col(tools)), choose)[0]


def basename(path: Column | str) -> Column:
    """Last non-empty component of a path written with ``/`` or ``\\``; '' when there is none."""
    return F.regexp_extract(as_col(path), r"([^/\\]+)[/\\]*$", 1)


def percent_decode(text: Column | str) -> Column:
    """Undo percent escapes and keep ``+``; a text with a malformed escape keeps that escape.

    Every ``%`` that does not start a well-formed escape is itself escaped first, so the
    built-in decoder only ever sees valid input.
    """
    guarded = F.regexp_replace(as_col(text), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.regexp_replace(guarded, r"\+", "%2B")), as_col(text))


def path_part(path: Column | str, from_end: int) -> Column:
    """Component of a ``/`` path counted from its end (1 = file name); '' when missing."""
    return F.coalesce(F.try_element_at(F.split(as_col(path), "/"), F.lit(-from_end)), F.lit(""))


def slug(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(as_col(text), "[^A-Za-z0-9]", ""))
