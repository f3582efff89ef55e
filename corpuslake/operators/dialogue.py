"""Questions and answers over the passages of a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cited_numbers, pronoun_question

# fixed values: the messages of the answer ladder
NOT_IN_PAPER = "NOT_IN_PAPER"
REFUSAL = "I couldn't find that in this paper."
NO_MODEL = "No LLM configured — showing the most relevant passages from the paper."
NO_HISTORY = "(no prior questions)"


def turns(messages: DataFrame) -> DataFrame:
    """(session_id, turn_no, question, answer): each user message with the assistant's next one."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    paired = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("next_text", F.lead("text").over(order))
    asked = paired.where(F.col("role") == "user")
    return asked.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_no"), F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))


def resolve_questions(turns: DataFrame) -> DataFrame:
    """Adds ``resolved``: short questions with a pronoun refer to the session's question before."""
    before = F.lag("question").over(Window.partitionBy("session_id").orderBy("turn_no"))
    return turns.withColumn("resolved", pronoun_question(F.col("question"), before))


def with_history(turns: DataFrame, n: int = 3) -> DataFrame:
    """Adds ``history``: the last ``n`` turns before, as questions and answers."""
    span = Window.partitionBy("session_id").orderBy("turn_no").rowsBetween(-n, -1)
    one = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.coalesce("answer", F.lit("")))
    past = F.collect_list(one).over(span)
    return turns.withColumn("history", F.when(F.size(past) == 0, NO_HISTORY).otherwise(F.array_join(past, "\n\n")))


def last_turns(turns: DataFrame, n: int = 20) -> DataFrame:
    """Each session's last ``n`` turns."""
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_no")))
    return turns.withColumn("nth", newest).where(F.col("nth") <= n).drop("nth")


def format_passages(passages: DataFrame) -> DataFrame:
    """(query_id, n_passages, passages, sections, listed): numbered passages; their sections, each once, in order; passages as sources.

    ``listed`` has passage and section_title, and of chunk_index and score what ``passages`` has.
    """
    one = F.concat(F.lit("["), F.col("passage"), F.lit("] ("), F.col("section_title"), F.lit(") "), F.col("text"))
    source = ["passage", "section_title", *[c for c in ("chunk_index", "score") if c in passages.columns]]
    gathered = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("passage", one.alias("one"), F.struct(*source).alias("source")))).alias("all"))
    return gathered.select(
        "query_id", F.size("all").alias("n_passages"), F.array_join(F.transform("all", lambda s: s["one"]), "\n\n").alias("passages"),
        F.array_distinct(F.transform("all", lambda s: s["source"]["section_title"])).alias("sections"), F.transform("all", lambda s: s["source"]).alias("listed"))


def answer_sources(n_passages: Column, model: Column, response: Column, failure: Column, listed: Column) -> Column:
    """The sources of an answer: those that a grounded answer of a model cites; all that were found for any other outcome."""
    cited = cited_numbers(response, n_passages)
    own = F.filter(listed, lambda s: F.array_contains(cited, s["passage"]))
    answered = (model != "none") & failure.isNull() & ~F.contains(response, F.lit(NOT_IN_PAPER))
    return F.when(F.coalesce(n_passages, F.lit(0)) == 0, F.slice(listed, 1, 0)).when(F.coalesce(answered, F.lit(False)), own).otherwise(listed)


def cited_sources(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, passage, section_title, ...): the passages that each answer cites."""
    n = passages.groupBy("query_id").agg(F.count("*").alias("n"))
    cited = answers.join(n, "query_id").select("query_id", F.explode(cited_numbers(F.col("answer"), F.col("n"))).alias("passage"))
    return cited.join(passages, ["query_id", "passage"])


def answer_ladder(n_passages: Column, model: Column, response: Column, failure: Column, passages: Column, sections: Column) -> Column:
    """struct(answer, grounded): refusal without passages; passages without a model; the failure; a refusal by the model; its answer."""
    refused = F.concat(F.lit(REFUSAL + " Closest sections checked: "), F.array_join(sections, ", "), F.lit("."))
    answer = (
        F.when(F.coalesce(n_passages, F.lit(0)) == 0, REFUSAL)
        .when(model == "none", F.concat(F.lit(NO_MODEL + "\n\n"), passages))
        .when(failure.isNotNull(), F.concat(F.lit("Could not get an answer right now: "), failure))
        .when(F.contains(response, F.lit(NOT_IN_PAPER)), refused)
        .otherwise(response)
    )
    grounded = (F.coalesce(n_passages, F.lit(0)) > 0) & ((model == "none") | (failure.isNull() & ~F.contains(response, F.lit(NOT_IN_PAPER))))
    return F.struct(answer.alias("answer"), F.coalesce(grounded, F.lit(False)).alias("grounded"))
