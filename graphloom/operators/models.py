"""Prompts, length budgets and batch inference around a model that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def rendered(turns: Column, user: str, assistant: str, system: str = "", separator: str = "") -> Column:
    """Turns (structs query, answer) by templates with {query} and {answer}; a null answer leaves its turn open."""
    ask = lambda t: F.replace(F.lit(user), F.lit("{query}"), F.coalesce(t["query"], F.lit("")))
    reply = lambda t: F.coalesce(F.replace(F.lit(assistant), F.lit("{answer}"), t["answer"]), F.lit(""))
    return F.concat(F.lit(system), F.array_join(F.transform(turns, lambda t: F.concat(ask(t), reply(t))), separator))


def budgets(source: Column, target: Column, cutoff: int, least_target: int = 1) -> tuple[Column, Column]:
    """Most source and target tokens of ``cutoff``, in proportion to their lengths; the target has ``least_target`` at least."""
    share = F.coalesce(F.floor(F.lit(cutoff) * target / F.nullif(source + target, F.lit(0))), F.lit(0))
    t = F.least(F.greatest(share, F.lit(least_target)), F.lit(cutoff)).cast("int")
    return F.lit(cutoff) - t, t


def supervised(prompt: Column, answer: Column, cutoff: int, least_target: int = 1, ignored: int = -100) -> Column:
    """A struct (input_ids, labels) of two arrays of ids: cut to the budgets, the prompt's labels are ``ignored``."""
    s, t = budgets(F.size(prompt), F.size(answer), cutoff, least_target)
    p, a = F.slice(prompt, F.lit(1), s), F.slice(answer, F.lit(1), t)
    return F.struct(F.concat(p, a).alias("input_ids"), F.concat(F.array_repeat(F.lit(ignored), F.size(p)), a).alias("labels"))


def infer(records: DataFrame, prompt: str, load: Callable[[], Callable[[list[str]], list[str]]], output: str = "output") -> DataFrame:
    """All columns of ``records`` and the model's output, a row each. ``load`` runs once a task and gives the function of a batch of prompts."""
    keep = [c for c in records.columns if c != output]
    schema = StructType([*records.select(*keep).schema.fields, StructField(output, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield b.assign(**{output: model(b[prompt].fillna("").tolist())})

    return records.select(*keep).mapInPandas(run, schema)
