"""Hooks: extractors and processors by MIME pattern, text filters, an external analyser."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.json_columns import entities_from_json, salvage_json
from docloom.operators.extraction import explode_once, extract
from docloom.operators.routing import resolve
from docloom.operators.rules import PROSE_RULES, Rule
from docloom.session import cut_lineage, scratch

Hook = Callable[[DataFrame], DataFrame]
RowHook = Callable[[], Column]


@dataclass
class Registry:
    """Functions chosen per row by MIME pattern; a later registration of a pattern replaces the earlier one.

    A row hook makes an array of structs from the columns of its row.  All row hooks are branches of one expression, so any
    number of them costs one scan, and a row is only put through its own.  A hook from a DataFrame to a DataFrame sees only its own
    rows; where there are several, the rows are written once by pattern, and each hook reads its own folder.  All hooks must
    return the same columns.
    """

    hooks: dict[str, Hook] = field(default_factory=dict)
    row_hooks: dict[str, RowHook] = field(default_factory=dict)

    def register(self, pattern: str, hook: Hook) -> Registry:
        self.row_hooks.pop(pattern, None)
        self.hooks[pattern] = hook
        return self

    def register_rows(self, pattern: str, hook: RowHook) -> Registry:
        self.hooks.pop(pattern, None)
        self.row_hooks[pattern] = hook
        return self

    def chosen(self, mime: Column) -> Column:
        """Pattern of the hook that serves a MIME type, null if there is none."""
        return resolve(mime, {pattern: pattern for pattern in (*self.hooks, *self.row_hooks)})

    def _by_row(self, routed: DataFrame) -> DataFrame:
        branches = reduce(lambda case, p: case.when(F.col("_pattern") == p, self.row_hooks[p]()), self.row_hooks, F)
        return routed.select(F.explode_outer(branches).alias("_row")).filter(F.col("_row").isNotNull()).select("_row.*")

    def _by_frame(self, routed: DataFrame) -> list[DataFrame]:
        if len(self.hooks) > 1:
            path = scratch(routed.sparkSession, "routed")
            numbers = {pattern: number for number, pattern in enumerate(self.hooks)}
            own = reduce(lambda case, p: case.when(F.col("_pattern") == p, numbers[p]), numbers, F)
            routed.withColumn("_hook", own).filter("_hook IS NOT NULL").drop("_pattern").write.partitionBy("_hook").parquet(path)
            rows = routed.sparkSession.read.schema(routed.drop("_pattern").schema.add("_hook", T.IntegerType())).parquet(path)
            return [hook(rows.filter(F.col("_hook") == numbers[p]).drop("_hook")) for p, hook in self.hooks.items()]
        return [hook(routed.filter(F.col("_pattern") == p).drop("_pattern")) for p, hook in self.hooks.items()]

    def apply(self, df: DataFrame, mime: str = "content_type") -> DataFrame:
        """Union of what the hooks return; the input is scanned once for all row hooks and once for all others."""
        routed = df.withColumn("_pattern", self.chosen(F.col(mime)))
        parts = ([self._by_row(routed)] if self.row_hooks else []) + self._by_frame(routed)
        return reduce(lambda a, b: a.unionByName(b), parts)

    def unserved(self, df: DataFrame, mime: str = "content_type") -> DataFrame:
        return df.filter(self.chosen(F.col(mime)).isNull())


def apply_filters(df: DataFrame, filters: list[Callable[[Column], Column]], text: str = "text") -> DataFrame:
    """Content filters in sequence, folded into one expression."""
    return df.withColumn(text, reduce(lambda c, f: f(c), filters, F.col(text)))


def analyse(df: DataFrame, keys: list[str], analyser: Callable[[pd.Series], pd.Series],
            text: str = "text") -> DataFrame:
    """Texts with the raw answers of an external analyser, called with whole Arrow batches."""
    rows = df.select(*keys, text)
    schema = df.select(*keys, text).schema.add("answer", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=analyser(batch[text]))

    return rows.mapInPandas(run, schema)


def extract_with_analyser(df: DataFrame, keys: list[str], analyser: Callable[[pd.Series], pd.Series],
                          text: str = "text", rules: tuple[Rule, ...] = PROSE_RULES,
                          fallback: bool = True) -> DataFrame:
    """Mentions the analyser finds; the rules serve the items it finds nothing for.

    The answers are checkpointed, so each item is sent to the analyser once, and a text travels on
    only where the rules need it: no join brings texts and answers together.
    """
    answers = analyse(df, keys, analyser, text).select(
        *keys, text, entities_from_json(salvage_json(F.col("answer"))).alias("_entities")
    )
    unserved = F.when(F.size("_entities") == 0, F.col(text)).alias(text)
    answers = cut_lineage(answers.select(*keys, unserved, "_entities"))
    rows = explode_once(answers, keys, F.col("_entities"), "_e")
    mentions = rows.select(*keys, "ordinal", "_e.*").select(
        *keys, "ordinal", "name", F.col("type").alias("entity_type"), "description",
        F.explode_outer("mentions").alias("_m"),
    )
    found = mentions.select(
        *keys, "ordinal", "name", "entity_type", "description",
        "_m.context", "_m.position", "_m.relevance",
    )
    if not fallback:
        return found
    rest = answers.filter(F.size("_entities") == 0).select(*keys, text)
    by_rule = extract(rest, keys, text, rules)
    return found.unionByName(by_rule.select(*found.columns))
