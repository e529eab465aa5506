"""Nested JSON documents as VARIANT columns: read whole, checked against the keys they must have, and kept with the reason where they fail."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """What a document must have: keys at the top, keys of objects inside it, keys that aren't blank, words that a key is one of, and numbers likewise. A key whose value is null is there."""

    top: tuple[str, ...] = ()
    nested: dict[str, tuple[str, ...]] = field(default_factory=dict)
    filled: tuple[str, ...] = ()
    words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    numbers: dict[str, tuple[int, ...]] = field(default_factory=dict)


#: The keys of a card.
CARD = Shape(
    top=("card_id", "thesis_id", "generation", "thesis", "pre_registered", "formula", "ast_canonical", "complexity", "tier1_metrics", "fresh_fold_metrics", "tier2_metrics", "audit", "redteam", "verdict", "lineage", "provenance"),
    nested={
        "thesis": ("mechanism", "counterparty", "why_not_arbitraged", "horizon_days", "regime", "falsifiable_claim"),
        "pre_registered": ("sign", "horizon_days", "committed_at", "hash"),
        "complexity": ("nodes", "depth", "free_params"),
        "lineage": ("parent_card_id", "edit_motif"),
        "provenance": ("fields_used",),
    },
    filled=("card_id",),
    words={"verdict": ("accept", "reject", "revise", "provisional")},
    numbers={"pre_registered.sign": (-1, 1)},
)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, value: whole files as text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def part(doc: Column | str, path: str, kind: str = "variant") -> Column:
    """What is at a path of keys; null where there is nothing or it is of another kind. A JSON null is a value of kind variant and null otherwise."""
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, "$" + "".join(f".{k}" for k in path.split(".")), kind)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def checked(texts: DataFrame, shape: Shape) -> DataFrame:
    """All columns of ``texts`` (among them value: JSON text), doc (a VARIANT, null where the text isn't JSON) and reason: what the document lacks first, null where it has everything."""
    d = F.col("doc")
    reasons = [F.when(d.isNull(), "not json"), F.when(~is_object(d), "not an object")]
    reasons += [F.when(part(d, k).isNull(), f"no {k}") for k in shape.top]
    reasons += [F.when(F.trim(F.coalesce(part(d, k, "string"), F.lit(""))) == "", f"blank {k}") for k in shape.filled]
    for sub, keys in shape.nested.items():
        reasons += [F.when(~is_object(part(d, sub)), f"{sub} is no object"), *(F.when(part(d, f"{sub}.{k}").isNull(), f"no {sub}.{k}") for k in keys)]
    reasons += [F.when(~F.coalesce(part(d, k, "string").isin(*some), F.lit(False)), f"other {k}") for k, some in shape.words.items()]
    reasons += [F.when(~F.coalesce(part(d, k, "int").isin(*some), F.lit(False)), f"other {k}") for k, some in shape.numbers.items()]
    return texts.withColumn("doc", F.try_parse_json("value")).withColumn("reason", F.coalesce(*reasons))


def split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that have everything, and the others with their text and reason; none is lost."""
    return docs.where("reason IS NULL").drop("value", "reason"), docs.where("reason IS NOT NULL").drop("doc")


def common_schema(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, schema and n: the schema that all documents of a key fit, merged over them."""
    return docs.groupBy(*keys).agg(F.schema_of_variant_agg("doc").alias("schema"), F.count("*").alias("n"))
