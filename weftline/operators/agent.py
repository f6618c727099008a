"""Search, select, read, recommend: the steps around a text generator, which is a parameter."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import json_list, numbered_names


class Generator(Protocol):
    """Anything that answers a prompt; models are outside this package."""

    def __call__(self, prompt: str) -> str: ...


class Echo:
    """A stand-in that selects every numbered name of its prompt."""

    def __call__(self, prompt: str) -> str:
        import json
        import re

        names = re.findall(r"\d+\.\s+\*\*([^*]+)\*\*", prompt) or re.findall(r"\d+\.\s+`?([^`\s(]+)", prompt)
        return json.dumps({"selected_files": names})


def answer(prompts: DataFrame, generate: Generator, prompt: str = "prompt") -> DataFrame:
    """Q16, Q18, Q19: adds answer, one call for each prompt, in the executors' Python."""

    def run(batches):
        for b in batches:
            yield b.assign(answer=[generate(p) if p is not None else None for p in b[prompt]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", answer string"
    return prompts.mapInPandas(run, schema)


def select_files(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Adds files: the selected files of a JSON answer, or else the names of its numbered lines."""
    j = json_list(F.col(column))
    return answers.withColumn("files", F.coalesce(j, numbered_names(F.col(column))))


def read_files(selected: DataFrame, contents: DataFrame, query: str = "query_id", limit: int = 5000) -> DataFrame:
    """Q07, Q16: (query, path, text) of selected files with their contents cut to limit characters; unknown files have null."""
    s = selected.select(query, F.explode("files").alias("path"))
    return s.join(contents.select("path", F.substring("text", 1, limit).alias("text")), "path", "left").select(query, "path", "text")


def simple_agent(context: DataFrame, generate: Generator) -> DataFrame:
    """Q18: context (query_id, prompt) of five modules, ten files and three tasks, answered once: (query_id, prompt, answer)."""
    return answer(context, generate)


def multi_agent(context: DataFrame, analyse: Generator, respond: Generator) -> DataFrame:
    """Q19: (query_id, analysis, answer): one generator analyses the modules of a prompt, another answers prompt and analysis together."""
    a = answer(context, analyse).withColumnRenamed("answer", "analysis")
    both = a.select("query_id", "analysis", F.concat_ws("\n\n# Analysis\n", "prompt", "analysis").alias("prompt"))
    return answer(both, respond).select("query_id", "analysis", "answer")
