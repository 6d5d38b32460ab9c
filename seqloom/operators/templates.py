"""Message templates: taken as they are, or mined by a fixed-depth tree.

Messages are masked and cut into tokens. Messages of different lengths or with different first tokens never share a template
(a first token with a digit counts as the wildcard), so (length, first token) is a leaf of the tree. In a leaf:

1. Different masked messages are taken in the order of their first lines. A message that shares less than `similarity` of its
   tokens with every seed before it is a seed itself.
2. Each message belongs to the seed that it shares most tokens with, the first of equal ones.
3. A template has the tokens that all messages of a seed have in common, and the wildcard elsewhere. Equal ones are one.

A message's part in this depends on those before it alone, never on how rows are dealt or how many there are, and no leaf is one
task: seeds are found in rounds, each of which takes the first `SEEDS` messages of every leaf that have no seed yet, finds the seeds
among these few, and compares all others with them by a join. Templates are aggregations.

Inference looks a message up by literal tokens: for each pattern of wildcards that its leaf has (few), an equi-join on the rest.

Defined results: a null message has no template; nor has a message that no template matches (`strict` makes that an error).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.text import masked
from seqloom.storage import kept

WILDCARD = "<:*:>"
#: Messages of a leaf that are looked at in one place for new seeds.
SEEDS = 256


def template_tokens(text: Column) -> Column:
    """Tokens of a masked message; underscores cut too."""
    return F.filter(F.split(F.replace(masked(text), F.lit("_"), F.lit(" ")), r"(?U)\s+"), lambda t: t != "")


def leading(tokens: Column) -> Column:
    first = F.get(tokens, F.lit(0))
    return F.when(first.rlike(r"\d"), WILDCARD).otherwise(F.coalesce(first, F.lit("")))


class FittedTemplates(Protocol):
    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with template and params."""


class TemplateParser(Protocol):
    """What a dataset takes to make templates of messages."""

    def fit(self, rows: DataFrame) -> FittedTemplates: ...


@dataclass(frozen=True)
class IdentityParser:
    """Each message is its own template, without parameters."""

    def fit(self, rows: DataFrame) -> IdentityParser:
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("template", F.col("untemplated_message_text")).withColumn("params", F.array().cast("array<string>"))


def literals(tokens: Column, wild: Column) -> Column:
    """Tokens with the wildcard at the places that wild (an array of booleans) has."""
    return F.zip_with(tokens, wild, lambda t, w: F.when(w, WILDCARD).otherwise(t))


@dataclass(frozen=True)
class TemplateModel:
    """templates: n, lead, tokens (array) and template."""

    templates: DataFrame

    def transform(self, rows: DataFrame, strict: bool = False) -> DataFrame:
        """rows with template and params; null where no template matches, or an error with `strict`. Different messages are matched once each; of several templates that match, the one of most literal tokens has it, the last by name of equal ones."""
        known = rows.select("untemplated_message_text").distinct().withColumn("_tokens", template_tokens(F.col("untemplated_message_text")))
        known = known.withColumn("n", F.size("_tokens")).withColumn("lead", leading(F.col("_tokens")))
        wild = F.transform("tokens", lambda t: t == WILDCARD)
        kinds = self.templates.withColumn("wild", wild)
        patterns = kinds.select("n", "lead", "wild").distinct()
        # a leaf's patterns are far fewer than its templates
        asked = known.join(patterns, ["n", "lead"]).withColumn("key", literals(F.col("_tokens"), F.col("wild")))
        met = asked.join(kinds.select("n", "lead", F.col("tokens").alias("key"), "template"), ["n", "lead", "key"])
        literal = F.size(F.filter("wild", lambda w: ~w))
        params = F.transform(F.filter(F.arrays_zip("_tokens", "wild"), lambda x: x["wild"]), lambda x: x["_tokens"])
        best = met.groupBy("untemplated_message_text").agg(F.max_by(F.struct("template", params.alias("params")), F.struct(literal, "template")).alias("m"))
        out = rows.join(best.select("untemplated_message_text", "m.template", "m.params"), "untemplated_message_text", "left")
        if strict:
            missing = F.raise_error(F.concat(F.lit("no template for the message: "), F.coalesce("untemplated_message_text", F.lit("null"))))
            out = out.withColumn("template", F.coalesce("template", missing.cast("string")))
        return out

    def save(self, path: str) -> None:
        self.templates.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TemplateModel:
        return cls(spark.read.parquet(path))


def shared(seed: Column, tokens: Column) -> Column:
    """How many places of two messages of one length have the same token."""
    return F.size(F.filter(F.zip_with(seed, tokens, lambda a, b: a == b), lambda x: x))


@dataclass(frozen=True)
class DrainParser:
    """similarity: share of equal tokens from which a message belongs to a seed."""

    similarity: float = 0.4

    def enough(self, seed: Column, tokens: Column) -> Column:
        return shared(seed, tokens) >= F.lit(float(self.similarity)) * F.size(tokens)

    def seeds(self, messages: DataFrame) -> DataFrame:
        """n, lead, first and tokens of the seeds of messages (n, lead, first, tokens)."""
        found, rest = [], messages
        while not rest.isEmpty():
            order = Window.partitionBy("n", "lead").orderBy("first", "tokens")
            front = rest.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= SEEDS)
            # at most SEEDS messages of a leaf
            front = front.groupBy("n", "lead").agg(F.array_sort(F.collect_list(F.struct("first", "tokens"))).alias("front"))
            none = F.slice("front", 1, 0)
            new = F.aggregate("front", none, lambda seeds, m: F.when(F.exists(seeds, lambda s: self.enough(s["tokens"], m["tokens"])), seeds).otherwise(F.concat(seeds, F.array(m))))
            new = kept(front.select("n", "lead", new.alias("seeds")))
            found.append(new.select("n", "lead", F.inline("seeds")))
            rest = kept(rest.join(new, ["n", "lead"]).where(~F.exists("seeds", lambda s: self.enough(s["tokens"], F.col("tokens")))).drop("seeds"))
        out = found[0] if found else messages
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def fit(self, rows: DataFrame) -> TemplateModel:
        text = rows.where("untemplated_message_text IS NOT NULL").select(template_tokens(F.col("untemplated_message_text")).alias("tokens"), "line_order")
        different = text.groupBy("tokens").agg(F.min("line_order").alias("first"))
        messages = kept(different.withColumn("n", F.size("tokens")).withColumn("lead", leading(F.col("tokens"))))
        seeds = self.seeds(messages).select("n", "lead", F.col("first").alias("seed"), F.col("tokens").alias("own"))
        by_leaf = kept(seeds.groupBy("n", "lead").agg(F.array_sort(F.collect_list(F.struct("seed", "own"))).alias("seeds")))
        # the most shared tokens, then the first seed
        likeness = F.transform("seeds", lambda s: F.struct((-shared(s["own"], F.col("tokens"))).alias("less"), s["seed"].alias("seed"), s["own"].alias("own")))
        owned = messages.join(by_leaf, ["n", "lead"]).select("n", "lead", "tokens", F.array_min(likeness).alias("s"))
        places = owned.select("n", "lead", "s.seed", "s.own", F.posexplode("tokens").alias("place", "token"))
        same = places.groupBy("n", "lead", "seed", "own", "place").agg(F.when(F.min("token") == F.max("token"), F.min("token")).otherwise(WILDCARD).alias("token"))
        made = same.groupBy("n", "lead", "seed", "own").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("t"))
        made = made.select("n", "lead", F.transform("t", lambda x: x["token"]).alias("tokens"))
        # a message without tokens has no places
        bare = messages.where("n = 0").select("n", "lead", "tokens")
        return TemplateModel(kept(made.unionByName(bare).distinct().withColumn("template", F.array_join("tokens", " "))))


TEMPLATE_PARSERS = {"drain": DrainParser, "identity": IdentityParser}


def template_parser(name: str, **options):
    if name not in TEMPLATE_PARSERS:
        raise KeyError(f"unknown template parser {name!r}; known: {', '.join(sorted(TEMPLATE_PARSERS))}")
    return TEMPLATE_PARSERS[name](**options)
