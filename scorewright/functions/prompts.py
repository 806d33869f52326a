"""Prompts from templates and examples, as columns."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(template: str | Column, fields: dict[str, Column]) -> Column:
    """A template with {name} replaced by a field's text; names without a field stay, a null field is empty."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def template_hash(template: dict, inferencer: dict | None = None) -> str:
    """A hash of a prompt's definition, the same for any order of keys."""
    return hashlib.sha256(json.dumps([template, inferencer or {}], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def in_context(queries: DataFrame, chosen: DataFrame, examples: DataFrame, query: str, item: str, template: str, fields: list[str], separator: str = "\n", end: str = "\n") -> DataFrame:
    """(query, context): the examples chosen for a query (query, rank, item), rendered in the order of their ranks; a query
    without any has an empty context. The examples of a query are as many as the caller chose."""
    lines = chosen.join(examples, item).withColumn("__line", rendered(template, {f: F.col(f) for f in fields}))
    per = lines.groupBy(query).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item, "__line"))), lambda s: s["__line"]), separator), F.lit(end)).alias("context"))
    return queries.select(query).join(per, query, "left").select(query, F.coalesce("context", F.lit("")).alias("context"))


def label_prompts(rows: DataFrame, context: str, template: str, fields: list[str], labels: dict[str, str]) -> DataFrame:
    """rows once for each label with label and prompt: the context and the template with {label} and the fields filled in."""
    each = rows.withColumn("label", F.explode(F.array(*map(F.lit, labels)))) if labels else rows.withColumn("label", F.lit(None).cast("string"))
    text = F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("label")) if labels else F.lit("")
    return each.withColumn("prompt", F.concat(F.coalesce(F.col(context), F.lit("")), rendered(template, {**{f: F.col(f) for f in fields}, "label": text})))
