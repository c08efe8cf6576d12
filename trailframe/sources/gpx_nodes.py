"""Extension nodes for GPX metadata, as JSON columns of info: a label, the device, a summary of the device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMESPACE = "urn:trailframe:extensions"
#: Elements of a device and the columns of info that fill them.
DEVICE = (
    ("manufacturer", "manufacturer"), ("model", "model"), ("product", "product"), ("serialNumber", "serial_number"), ("softwareVersion", "software_version"),
    ("fitManufacturerId", "fit_manufacturer_id"), ("fitProductId", "fit_product_id"))


def _tag(name: str, namespace: str) -> Column:
    return F.lit(f"{{{namespace}}}{name}").alias("tag")


def label_node(label: Column, namespace: str = NAMESPACE) -> Column:
    """SNK-19: an activity element with a label; null for blank labels."""
    return F.when(F.trim(label) != "", F.struct(_tag("activity", namespace), label.alias("text"), F.array().cast("array<struct<tag:string,text:string>>").alias("children")))


def device_node(name: str = "device", extras: dict[str, Column] | None = None, namespace: str = NAMESPACE) -> Column:
    """SNK-19: an element with a child for each device column that is not blank, and for the extras."""
    fields = [(n, F.col(c).cast("string")) for n, c in DEVICE] + [(n, c.cast("string")) for n, c in (extras or {}).items()]
    children = F.array_compact(F.array(*[F.when(F.trim(c) != "", F.struct(_tag(n, namespace), c.alias("text"))) for n, c in fields]))
    return F.when(F.size(children) > 0, F.struct(_tag(name, namespace), F.lit(None).cast("string").alias("text"), children.alias("children")))


def summary_node(extras: dict[str, Column] | None = None, namespace: str = NAMESPACE) -> Column:
    return device_node("deviceSummary", extras, namespace)


def with_nodes(info: DataFrame, *nodes: Column) -> DataFrame:
    """info whose GPX metadata carries the nodes, after those that it has."""
    made = F.array_compact(F.array(*nodes))
    old = F.coalesce("metadata", F.lit("{}"))
    rest = F.to_json(F.map_filter(F.from_json(old, "map<string,string>"), lambda k, v: k != "extensions"))
    head = F.when(rest == "{}", F.lit("{")).otherwise(F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(",")))
    had, new = F.get_json_object(old, "$.extensions"), F.to_json(made)
    both = F.when(had.isNull() | (had == "[]"), new).otherwise(F.concat(F.substring(had, F.lit(1), F.length(had) - 1), F.lit(","), F.substring(new, F.lit(2), F.length(new))))
    return info.withColumn("metadata", F.when(F.size(made) == 0, F.col("metadata")).otherwise(F.concat(head, F.lit('"extensions":'), both, F.lit("}"))))
