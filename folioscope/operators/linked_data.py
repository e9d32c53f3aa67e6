"""JSON-LD as a relation: a row for each object, its own fields as a variant, with any field in reach."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom, jsonld


class _Objects:
    def eval(self, block: str) -> Iterator[tuple]:
        yield from jsonld.shallow(jsonld.block(block or ""))


def objects(pages: DataFrame) -> DataFrame:
    """pages(url or not, html, ...) without html to (..., block, place, parent, key, depth, object): every object of the JSON-LD blocks in order.

    `object` is a variant of the object's own fields; an object within it is a row of its own, with the outer one's place as parent and the key that it
    stands under, so that a block of any depth takes its own length. Blocks that aren't JSON have no rows. Columns of these names are replaced."""
    added = ["block", "place", "parent", "key", "depth", "object"]
    kept = [c for c in pages.columns if c not in [*added, "html", "dom"]]
    page = dom.with_dom(pages)
    scripts = F.filter(dom.by_tag(F.col("dom"), "script"), lambda n: n["attrs"]["type"] == "application/ld+json")
    blocks = page.select(*[F.col(f"`{c}`") for c in kept], F.posexplode(F.transform(scripts, lambda n: n["own"])).alias("block", "_raw"))
    read = F.udtf(_Objects, returnType="place int, parent int, key string, depth int, _own string")
    return blocks.lateralJoin(read(F.col("_raw").outer())).withColumn("object", F.try_parse_json("_own")).drop("_raw", "_own")


def field(name: str, kind: str = "string") -> Column:
    """A field of the object, or null where it is missing or of another kind; of texts what isn't blank. Its name may have quotes of one sort."""
    quote = '"' if "'" in name else "'"
    path = f"$[{quote}{name}{quote}]"
    value = F.try_variant_get("object", path, kind)
    return F.nullif(F.trim(value), F.lit("")) if kind == "string" else value


def typed(kind: str) -> Column:
    """Whether one of an object's types contains a word."""
    types = F.coalesce(F.try_variant_get("object", "$['@type']", "array<string>"), F.array(F.try_variant_get("object", "$['@type']", "string")))
    return F.coalesce(F.exists(types, lambda t: F.contains(t, F.lit(kind))), F.lit(False))


def people(pages: DataFrame, key: str) -> DataFrame:
    """(key, block, place, name, job, town) of the persons that pages declare, their town from the object under `address`. key names a page."""
    rows = objects(pages.select(key, "html"))
    towns = rows.where("key = 'address'").select(key, "block", F.col("parent").alias("place"), F.coalesce(field("addressLocality"), field("addressRegion"), field("name")).alias("town"), F.col("place").alias("_at"))
    towns = towns.groupBy(key, "block", "place").agg(F.min_by("town", "_at").alias("town"))
    found = rows.where(typed("Person")).select(key, "block", "place", field("name").alias("name"), field("jobTitle").alias("job"))
    return found.join(towns, [key, "block", "place"], "left")
