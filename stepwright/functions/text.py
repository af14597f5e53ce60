"""Instruction text: keys that count as the same instruction, prompts, and small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"\s+"


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def key_a(c: Column) -> Column:
    """Lower case, no final full stops, question or exclamation marks; null if blank."""
    return blank_to_null(strip(F.regexp_replace(strip(F.lower(c)), r"[.?!]+$", "")))


def key_b(c: Column) -> Column:
    """Lower case, only letters, digits, underscores and single spaces; Unicode letters count."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def key_c(c: Column) -> Column:
    """Key a without a final ' demo'."""
    return blank_to_null(strip(F.regexp_replace(key_a(c), r" demo$", "")))


def key_d(c: Column) -> Column:
    return blank_to_null(strip(c))


def first_filled(*columns: Column) -> Column:
    """The first column that is not blank, stripped."""
    return F.coalesce(*[key_d(c) for c in columns])


def action_prompt(instruction: Column, answer: Column) -> Column:
    """One question and answer turn that asks for an action."""
    return F.concat(F.lit("In: What action should the robot take to "), F.lower(instruction), F.lit("?\nOut: "), answer, F.lit("</s>"))


def clean_prompt(c: Column) -> Column:
    return F.translate(strip(c), "_\n", "  ")


def image_tag_first(c: Column, tag: str = "<image>") -> Column:
    """The image tag on a line of its own in front, wherever it stood."""
    rest = strip(F.replace(c, F.lit(tag), F.lit("")))
    return F.when(c.contains(tag), F.concat(F.lit(f"{tag}\n"), rest)).otherwise(c)


def task_name(path: Column) -> Column:
    """Task of a file name: its last part without ending, underscores as spaces."""
    return F.replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", ""), F.lit("_"), F.lit(" "))


def safe_name(c: Column) -> Column:
    """Letters, digits, '-' and '_' kept, all else an underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_-]", "_")


def numbered_items(c: Column) -> Column:
    """Texts of 'N. text' lines."""
    found = F.transform(F.split(c, "\n"), lambda x: F.regexp_extract(x, r"^\s*\d+[.)]\s*(.*\S)\s*$", 1))
    return F.filter(found, lambda x: x != "")


def score_pair(c: Column) -> Column:
    """Two numbers of the first line, parted by blanks or a comma; (-1, -1) if there are not just two."""
    parts = F.filter(F.split(F.replace(F.element_at(F.split(c, "\n"), 1), F.lit(","), F.lit(" ")), " "), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    good = (F.size(parts) == 2) & F.forall(numbers, lambda x: x.isNotNull())
    return F.when(good, numbers).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def last_integer(c: Column) -> Column:
    """The last whole number of a text, thousands commas ignored; null if there is none."""
    found = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"(\d+)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("long")
