"""Posts out of posts: quoted and repeated ones, to any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.session import stored

# How a post says which post it holds within it.
EMBEDDED = ("quoted_status", "retweeted_status")


def unroll_posts(posts: DataFrame, column: str = "post", keep: tuple[str, ...] = (), embedded: tuple[str, ...] = EMBEDDED) -> DataFrame:
    """One row for every post and every post within it: `root`, `depth`, `relation`, `post`.

    `column` holds posts as VARIANT, whose form no schema bounds. `root` is the
    id of the outermost post, `relation` the field that the post was found in
    (null for outermost ones). Each level is taken out of the one before where
    it lies, without a shuffle, until there is none: a text nests finitely, so
    that ends whatever ids the posts name. `keep` names further columns of the
    outermost posts that their inner ones inherit.
    """
    level = posts.select(
        *keep,
        F.try_variant_get(column, "$.id", "bigint").alias("root"),
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("relation"),
        F.col(column).alias("post"),
    )
    levels = []
    while True:
        level = stored(level, "posts")
        if level.isEmpty():
            break
        levels.append(level)
        inner = F.array(*[F.struct(F.lit(f).alias("relation"), _object(F.col("post"), f).alias("post")) for f in embedded])
        level = (
            level.withColumn("_inner", F.explode(inner))
            .where(F.col("_inner.post").isNotNull())
            .select(*keep, "root", (F.col("depth") + 1).alias("depth"), "_inner.relation", "_inner.post")
        )
    return reduce(DataFrame.unionByName, levels) if levels else level


def _object(post: Column, field: str) -> Column:
    """The post in a field; null if there is none, also if the field is a JSON null."""
    inner = F.try_variant_get(post, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner)


def post_fields(unrolled: DataFrame, **fields: str) -> DataFrame:
    """`unrolled` with columns read from the posts: name, and the path and type as in `id_str="$.id_str string"`."""
    read = []
    for name, place in fields.items():
        path, kind = place.split()
        read.append(F.try_variant_get("post", path, kind).alias(name))
    return unrolled.select(*[c for c in unrolled.columns if c != "post"], *read)
