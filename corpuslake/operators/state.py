"""Session state as an append-only table of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: messages of failed runs
UNKNOWN_INTENT = "I couldn't understand that as an arXiv ID, URL, or topic. Please provide a paper to look up or a topic to search for."
GENERIC = "The agent could not complete this request."


def merge_updates(updates: DataFrame, fields: list[str]) -> DataFrame:
    """State after each update (thread_id, seq, set_fields, fields ...): a field not in ``set_fields`` keeps its value; an explicit null is kept as one."""
    order = Window.partitionBy("thread_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda f: F.last(F.when(F.array_contains("set_fields", f), F.struct(F.col(f).alias("v"))), ignorenulls=True).over(order)["v"]
    return updates.select("thread_id", "seq", *[last(f).alias(f) for f in fields])


def restore(states: DataFrame) -> DataFrame:
    """The latest state of each thread."""
    fields = [c for c in states.columns if c not in ("thread_id", "seq")]
    latest = states.groupBy("thread_id").agg(F.max_by(F.struct("seq", *fields), "seq").alias("s"))
    return latest.select("thread_id", "s.*")


def route(intent: Column, selected: Column, n_candidates: Column, next_action: Column) -> Column:
    """The step after each stage as struct(after_understand, after_search, after_select, after_embed)."""
    return F.struct(
        F.when(intent == "unknown", "handle_error").otherwise("search").alias("after_understand"),
        F.when(selected.isNotNull(), "fetch_parse").when(n_candidates > 0, "select_paper").otherwise("end").alias("after_search"),
        F.when(next_action.isin("confirm_with_user", "ask_user_to_rephrase"), "end").otherwise("fetch_parse").alias("after_select"),
        F.when(next_action == "error", "handle_error").otherwise("summarize").alias("after_embed"),
    )


def error_message(errors: Column, intent: Column) -> Column:
    """The message that a failed run shows: its last error, or what its intent suggests."""
    return F.coalesce(F.try_element_at(errors, F.lit(-1)), F.when(intent == "unknown", UNKNOWN_INTENT).otherwise(GENERIC))


def with_error(errors: Column, intent: Column) -> Column:
    """``errors`` ending in the message, without repeating it."""
    errors = F.coalesce(errors, F.array().cast("array<string>"))
    return F.when(F.size(errors) > 0, errors).otherwise(F.array(error_message(errors, intent)))
