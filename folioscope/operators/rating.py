"""Relevance of citations: prompts, replies and what they say; the provider is a callable of the caller's."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLY = "struct<score:int,wrong_paper:boolean,reason:string>"
ABSTRACT_CHARS, CONTEXTS, SIBLINGS = 1800, 3, 8


def prompts(entries: DataFrame, contexts: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(key, prompt): title, abstract and the first places where an entry is cited, with what it is cited beside."""
    places = contexts.select(F.explode("keys").alias("key"), "path", "line", "context", "keys")
    near = places.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("path", "line", "context", "keys"))), 1, CONTEXTS).alias("p"))
    cited = F.array_join(F.transform("p", lambda x: F.concat(F.lit("- "), x["context"], F.lit(" ["), F.array_join(F.slice(x["keys"], 1, SIBLINGS), ", "), F.lit("]"))), "\n")
    text = F.concat_ws("\n", F.lit("Rate from 0 to 10 how well the work fits where it is cited. Answer in JSON with score, wrong_paper and reason."), F.concat(F.lit("Title: "), F.coalesce(F.element_at("fields", "title"), F.lit(""))), F.concat(F.lit("Abstract: "), F.substring("abstract", 1, ABSTRACT_CHARS)), cited)
    return entries.select("key", "fields").join(near, "key").join(abstracts.select("key", "abstract"), "key").filter("abstract is not null").select("key", text.alias("prompt"))


def asked(rows: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """(key, reply): the provider's text; a provider that fails gives null."""

    def run(parts):
        for part in parts:
            out = []
            for prompt in part["prompt"]:
                try:
                    out.append(provider(prompt))
                except (OSError, ValueError):
                    out.append(None)
            yield pd.DataFrame({"key": part["key"], "reply": out})

    return rows.mapInPandas(run, "key string, reply string")


def findings(replies: DataFrame) -> DataFrame:
    """(key, category, severity, message): wrong paper, poor fit (at most 3), fit, or no usable answer."""
    body = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    r = F.from_json(body, REPLY)
    rated = replies.select("key", r.alias("r"))
    category = F.when(F.col("r.score").isNull(), "llm_unavailable").when(F.col("r.wrong_paper"), "wrong_paper").when(F.col("r.score") <= 3, "llm_relevance").otherwise("llm_ok")
    severity = F.when(category.isin("wrong_paper", "llm_relevance"), "warning").otherwise("note")
    return rated.select("key", category.alias("category"), severity.alias("severity"), F.coalesce("r.reason", F.lit("no usable answer")).alias("message"))
