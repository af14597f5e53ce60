"""Questions, answers and conversations as chat turns and prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn(sender: str, value: Column) -> Column:
    return F.struct(F.lit(sender).alias("from"), value.alias("value"))


def two_turns(question: Column, answer: Column) -> Column:
    """A question and its answer, with 'Question:' and 'Answer:' in front removed."""
    return F.array(turn("human", F.trim(F.regexp_replace(question, r"^\s*Question:\s*", ""))), turn("gpt", F.trim(F.regexp_replace(answer, r"^\s*Answer:\s*", ""))))


#: Parts of a question prompt by the letters of its layout: context, question, options, answer, lecture, solution.
LAYOUTS = ("QCM-A", "QCM-LA", "QCM-ALE", "QCM-LEA", "CQM-A", "QCML-A", "QCME-A", "QCMLE-A")
_TITLES = {"Q": ("Question", "question"), "C": ("Context", "context"), "M": ("Options", "options"), "A": ("Answer", "answer"), "L": ("Lecture", "lecture"), "E": ("Solution", "solution")}


def layout(which: str) -> tuple[Column, Column]:
    """(prompt, response) of a row with the columns of the parts; parts that are blank are left out."""
    def side(letters: str) -> Column:
        parts = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{t}: "), F.col(c))) for t, c in (_TITLES[x] for x in letters)]
        return F.concat_ws("\n", *parts)

    ask, reply = which.split("-")
    return side(ask), side(reply)


def rows_to_chat(df: DataFrame, id_: str, pairs: Sequence[tuple[str, str]], image: str | None = None) -> DataFrame:
    """id, image and alternating turns; the image tag opens the first one."""
    turns = []
    for i, (q, a) in enumerate(pairs):
        text = F.concat(F.lit("<image>\n"), F.col(q)) if image and i == 0 else F.col(q)
        turns += [turn("human", text), turn("gpt", F.col(a))]
    return df.select(F.col(id_).alias("id"), *([F.col(image).alias("image")] if image else []), F.array(*turns).alias("conversations"))


def dialogue_prompt(turns: DataFrame, id_: str, order: str, role: str, text: str) -> DataFrame:
    """One prompt per conversation: 'In: ...' for users, 'Out: ...' with an end mark for the assistant; and the trained characters."""
    said = F.when(F.col(role) == "assistant", F.concat(F.lit("Out: "), F.col(text), F.lit("</s>\n"))).otherwise(F.concat(F.lit("In: "), F.col(text), F.lit("\n")))
    trained = F.when(F.col(role) == "assistant", F.length(text)).otherwise(0)
    rows = turns.groupBy(id_).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), said.alias("s")))).alias("t"), F.sum(trained).alias("trained_chars"))
    return rows.select(id_, F.array_join(F.transform("t", lambda x: x["s"]), "").alias("prompt"), "trained_chars")


def few_shot(examples: DataFrame, order: str, question: str, answer: str, n: int) -> DataFrame:
    """One row: the first n examples as a prompt head. n is a property of the prompt, a handful."""
    block = F.concat(F.lit("Question: "), F.col(question), F.lit("\nAnswer: "), F.col(answer), F.lit("\n\n"))
    rows = examples.orderBy(order).limit(n).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("e"))
    return rows.select(F.array_join(F.transform("e", lambda x: x["b"]), "").alias("head"))


def two_turn_requests(turns: DataFrame, id_: str, order: str, text: str, least: int = 4, most_prompt: int = 1024, most_total: int = 2048) -> DataFrame:
    """First two turns of conversations that have them, within length bounds in words."""
    at = lambda i: F.max(F.when(F.col(order) == i, F.col(text)))
    rows = turns.groupBy(id_).agg(at(0).alias("prompt"), at(1).alias("completion")).where("prompt IS NOT NULL AND completion IS NOT NULL")
    sized = rows.withColumns({"prompt_len": F.size(F.split("prompt", " ")), "output_len": F.size(F.split("completion", " "))})
    return sized.where((F.col("prompt_len") >= least) & (F.col("output_len") >= least) & (F.col("prompt_len") <= most_prompt) & (F.col("prompt_len") + F.col("output_len") <= most_total))
