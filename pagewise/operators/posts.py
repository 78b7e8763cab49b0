"""Blog posts: replay of an edit log and the public and draft lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions import text as T


def publish_state(edits: DataFrame) -> DataFrame:
    """Current post per id from its edits (post_id, edit_ord, ts, title, excerpt, body_md, cover_url, slug,
    published, author_email).

    The last given value of each field wins. The publish time is that of the first publish after the last
    unpublish. The first edit creates the post, so its missing flag means unpublished.
    """
    created = F.col("edit_ord") == 0
    flagged = edits.withColumn("published", F.when(created, F.coalesce("published", F.lit(False))).otherwise(F.col("published")))

    def latest(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("edit_ord")))

    slug_source = F.when(created, F.coalesce(F.nullif("slug", F.lit("")), F.col("title"))).otherwise(F.col("slug"))
    slug = F.when(slug_source.isNotNull(), T.blog_slug(slug_source, F.col("ts")))
    current = flagged.groupBy("post_id").agg(
        latest(slug).alias("slug"),
        latest(T.strip_text(F.col("title"))).alias("title"),
        F.coalesce(latest(T.strip_text(F.col("excerpt"))), F.lit("")).alias("excerpt"),
        latest(T.strip_text(F.col("body_md"))).alias("body_md"),
        latest(F.col("cover_url")).alias("cover_url"),
        F.coalesce(latest(F.col("published")), F.lit(False)).alias("published"),
        latest(F.nullif("author_email", F.lit(""))).alias("author_email"),
        F.min_by("ts", "edit_ord").alias("created_at"),
        F.max_by("ts", "edit_ord").alias("updated_at"),
        F.max(F.when(~F.col("published"), F.col("edit_ord"))).alias("last_unpublish"),
    )
    live = current.filter("published").select("post_id", F.coalesce("last_unpublish", F.lit(-1)).alias("after"))
    stamps = (
        flagged.filter("published")
        .join(live, "post_id")
        .filter(F.col("edit_ord") > F.col("after"))
        .groupBy("post_id")
        .agg(F.min_by("ts", "edit_ord").alias("published_at"))
    )
    return current.drop("last_unpublish").join(stamps, "post_id", "left")


def blog_list(posts: DataFrame, include_drafts: bool = False) -> DataFrame:
    """Newest 50 published posts, or the 100 last edited ones with drafts."""
    if include_drafts:
        return posts.orderBy(F.desc("updated_at"), "post_id").limit(100)
    return posts.filter("published").orderBy(F.desc("published_at"), "post_id").limit(50)
