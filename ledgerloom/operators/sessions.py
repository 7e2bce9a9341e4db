"""Sessions of tool calls: which tools were used, and which to suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUGGESTED = 3
#: Tools in the order in which they are suggested, and what for. Tools of the code index aren't suggested.
SUGGESTIONS = (
    ("get_recent_changes", "see what others changed lately"),
    ("get_file_history", "learn why a file looks as it does before you change it"),
    ("search_changes", "find a decision by its words"),
    ("get_diff", "read the diff where a summary says too little"),
    ("get_changes_in_range", "see what happened in a span of time"),
    ("record_change", "say what you changed and why, right after you did"),
    ("record_batch", "say it for several files at once"),
)


def tools_used(calls: DataFrame, session: str = "session", tool: str = "tool") -> DataFrame:
    return calls.groupBy(session).agg(F.sort_array(F.collect_set(tool)).alias("tools"))


def suggestions(spark: SparkSession, used: DataFrame, session: str = "session", n: int = SUGGESTED, catalogue=SUGGESTIONS) -> DataFrame:
    """(session, rank, tool, why): the first tools of the catalogue that a session hasn't used."""
    listed = F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(w).alias("why")) for t, w in catalogue))
    open_ = F.slice(F.filter(listed, lambda x: ~F.array_contains("tools", x["tool"])), 1, n)
    return used.select(session, F.posexplode(open_).alias("rank", "s")).select(session, (F.col("rank") + 1).alias("rank"), F.col("s")["tool"].alias("tool"), F.col("s")["why"].alias("why"))


def elapsed(seconds: float) -> str:
    """A span of time in whole seconds: 5s, 2m5s, 1h0m5s."""
    h, rest = divmod(int(seconds + 0.5), 3600)
    m, s = divmod(rest, 60)
    return f"{h}h{m}m{s}s" if h else f"{m}m{s}s" if m else f"{s}s"


def context(used: DataFrame, n_changes: int, index: dict | None = None, session: str = "session", catalogue=SUGGESTIONS, seconds: float | None = None) -> DataFrame:
    """(session, report): the text that a session starts with."""
    names = F.when(F.size("tools") == 0, "none yet").otherwise(F.array_join("tools", ", "))
    head = F.concat(F.lit(f"session context\n\n- recorded changes in store: {n_changes}\n- tools used this session: "), names, F.lit("\n" if seconds is None else f"\n- time since the session began: {elapsed(seconds)}\n"))
    if not n_changes:
        return used.select(session, F.concat(head, F.lit("\nNothing is recorded yet. Record a change after each file that you edit.\n")).alias("report"))
    listed = F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(w).alias("why")) for t, w in catalogue))
    open_ = F.slice(F.filter(listed, lambda x: ~F.array_contains("tools", x["tool"])), 1, SUGGESTED)
    lines = F.array_join(F.transform(open_, lambda x: F.concat(F.lit("- "), x["tool"], F.lit(" — "), x["why"], F.lit("\n"))), "")
    body = F.when(F.size(open_) > 0, lines).otherwise("- you have used every tool; go on recording after each edit\n")
    state = "not loaded" if index is None else "loaded, not yet indexed" if not index.get("last_indexed_at") else f"{index['file_count']} files, {index['symbol_count']} symbols"
    return used.select(session, F.concat(head, F.lit("\nSuggested next steps:\n"), body, F.lit(f"\nStructural index:\n- index: {state}\n")).alias("report"))
