"""Catalog queries: lookup, search, access, union, pagination; and changes of tables as post-images.

Tables are immutable, so an insert, update, delete or upsert returns what the table is afterwards; a caller writes it.
Checks that a store makes one by one before a write are set operations here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(conditions: dict) -> Column:
    """A filter from a dict: a value is equal, a list is any of, None is missing, ("~", pattern) is found in."""

    def one(name, want) -> Column:
        if want is None:
            return F.col(name).isNull()
        if isinstance(want, (list, set)):
            return F.col(name).isin(list(want))
        if isinstance(want, tuple) and want[:1] == ("~",):
            return F.coalesce(F.col(name).rlike(f"(?iu){want[1]}"), F.lit(False))
        return F.col(name) == want

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in conditions.items()], F.lit(True))


def found_by(term: str, *columns: str) -> Column:
    """A term, as a pattern whatever its letters' case, in any of the columns. A missing value has no match."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(f"(?iu){term}"), F.lit(False)) for c in columns])


def readable_by(user: int | str) -> Column:
    return F.col("is_public") | (F.col("uploaded_by") == user)


def public_then_own(books: DataFrame, user: int, public_limit: int, limit: int | None = None) -> DataFrame:
    """The first public books and all own ones, each once, in that order."""
    public = books.where("is_public").orderBy("book_id").limit(public_limit).withColumn("_part", F.lit(0))
    both = public.unionByName(books.where(F.col("uploaded_by") == user).withColumn("_part", F.lit(1)))
    once = both.withColumn("_n", F.row_number().over(Window.partitionBy("book_id").orderBy("_part"))).where("_n = 1").drop("_n")
    return once.orderBy("_part", "book_id").limit(limit).drop("_part") if limit else once.drop("_part")


def page(df: DataFrame, order: list, skip: int = 0, limit: int = 0) -> DataFrame:
    """Rows after ``skip`` in order, at most ``limit``; 0 is no limit."""
    df = df.orderBy(*order)
    df = df.offset(skip) if skip else df
    return df.limit(limit) if limit else df


def inserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with those rows whose key it doesn't have; of equal new keys one."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"), allowMissingColumns=True)


def refused(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows that ``inserted`` leaves out because their key is taken."""
    return rows.join(table.select(*key), key, "left_semi")


def updated(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table after the changes, a row for each key: the values of their columns, nulls too, take the place of what was there."""
    names = [c for c in changes.columns if c not in key]
    renamed = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in names], F.lit(True).alias("_changed"))
    joined = table.join(renamed, key, "left")
    return joined.select(*[F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def pushed(table: DataFrame, entries: DataFrame, key: str, into: str) -> DataFrame:
    """The table with the entries (key, entry) behind those of its array, in their order."""
    more = entries.groupBy(key).agg(F.array_sort(F.collect_list("entry")).alias("_more"))
    none = F.array().cast(dict(table.dtypes)[into])
    return table.join(more, key, "left").withColumn(into, F.concat(F.coalesce(into, none), F.coalesce("_more", none))).drop("_more")


def reset(table: DataFrame, defaults: dict) -> DataFrame:
    """The table with these columns at their defaults."""
    return table.withColumns({name: F.lit(value).cast(dict(table.dtypes)[name]) for name, value in defaults.items()})


def stamped(rows: DataFrame, now: Column) -> DataFrame:
    """Rows with generated ids, and the time as that of their making and last change."""
    return rows.withColumns({"id": F.uuid(), "created_at": now, "updated_at": now})


def deleted(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti")


def cascaded(tables: dict[str, DataFrame], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the deleted keys."""
    return {name: deleted(df, keys, [key]) for name, df in tables.items()}


def toggled(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys of either side alone: what was there goes, what was not comes."""
    a = table.select(*key, F.lit(1).alias("_a")).distinct()
    b = rows.select(*key, F.lit(1).alias("_b")).distinct()
    return a.join(b, key, "full").where(F.col("_a").isNull() | F.col("_b").isNull()).select(*key)


def upserted_positions(progress: DataFrame, saves: DataFrame) -> DataFrame:
    """Positions after saves (user_id, book_id, current_chapter, current_chunk, words, minutes): placed anew, counters added."""
    key = ["user_id", "book_id"]
    new = saves.select(*key, F.col("current_chapter").alias("_c"), F.col("current_chunk").alias("_k"), F.col("words").alias("_w"), F.col("minutes").alias("_m"))
    joined = progress.join(new, key, "full")
    return joined.select(
        *key, F.coalesce("_c", "current_chapter").alias("current_chapter"), F.coalesce("_k", "current_chunk").alias("current_chunk"),
        (F.coalesce("words", F.lit(0)) + F.coalesce("_w", F.lit(0))).alias("words"), (F.coalesce("minutes", F.lit(0)) + F.coalesce("_m", F.lit(0))).alias("minutes"),
    )


def with_defaults(users: DataFrame, settings: DataFrame, key: str, defaults: dict) -> DataFrame:
    """A row of settings for each user; missing or empty values are the defaults."""

    def value(name: str, default) -> Column:
        c = F.col(name)
        return F.coalesce(F.nullif(c, F.lit("")) if isinstance(default, str) else c, F.lit(default)).alias(name)

    return users.select(key).join(settings, key, "left").select(key, *[value(n, d) for n, d in defaults.items()])


def replaced_by_natural_key(books: DataFrame, imported: DataFrame, natural: str) -> DataFrame:
    """Imported books take the place of those of the same name and keep their ids; others get ids behind the highest."""
    known = books.groupBy(natural).agg(F.min("book_id").alias("_id"))
    top = books.agg(F.coalesce(F.max("book_id"), F.lit(-1)).alias("_top"))
    rows = imported.join(known, natural, "left")
    fresh = rows.where("_id is null").select(natural).distinct()
    # new names are ranked inside blocks by hash, so no window takes them all
    blocks = fresh.withColumn("_block", F.pmod(F.xxhash64(natural), F.lit(64)))
    sizes = blocks.groupBy("_block").agg(F.count("*").alias("_n"))
    starts = sizes.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ranked = blocks.withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy(natural))).join(starts, "_block")
    ranked = ranked.crossJoin(F.broadcast(top)).select(natural, (F.col("_top") + F.col("_start") + F.col("_rank")).alias("_fresh"))
    with_ids = rows.join(ranked, natural, "left").withColumn("book_id", F.coalesce("_id", "_fresh")).drop("_id", "_fresh")
    kept = books.join(imported.select(natural).distinct(), natural, "left_anti")
    return kept.unionByName(with_ids, allowMissingColumns=True)


def reconciled(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Books with their chapters' totals, and whether these differ from what they said."""
    real = chapters.groupBy("book_id").agg(F.count("*").alias("real_chapters"), F.sum("chapter_words").alias("real_words"))
    out = books.join(real, "book_id", "left").withColumn("real_chapters", F.coalesce("real_chapters", F.lit(0)))
    return out.withColumn("differs", ~F.col("real_chapters").eqNullSafe(F.col("total_chapters"))).withColumn("total_chapters", F.col("real_chapters").cast("int")).drop("real_chapters")


def backfilled_start(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Where a book has no first chapter number: its lowest chapter's, or 1."""
    low = chapters.groupBy("book_id").agg(F.min("chapter_number").alias("_low"))
    return books.join(low, "book_id", "left").withColumn("chapter_start_number", F.coalesce("chapter_start_number", "_low", F.lit(1))).drop("_low")


def with_uploaded_names(chapters: DataFrame, key: list[str], files: DataFrame) -> DataFrame:
    """Chapters (key, chunks of type, url, name) whose image chunks that are among the files (file_name) carry the name and no address.

    Chunks meet the files by the last part of their address, and go back to their chapters in order.
    """
    rows = chapters.select(*key, F.posexplode_outer("chunks").alias("_pos", "_c")).withColumn("_base", F.element_at(F.split("_c.url", "/"), -1))
    there = files.select(F.col("file_name").alias("_base")).distinct().withColumn("_there", F.col("_base"))
    joined = rows.join(there, "_base", "left")
    named = (F.col("_c.type") == "image") & F.col("_there").isNotNull()
    chunk = F.when(named, F.col("_c").withField("name", F.col("_base")).withField("url", F.lit(None).cast("string"))).otherwise(F.col("_c"))
    back = joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", chunk.alias("_c"))))).alias("_rows"))
    return back.select(*key, F.transform("_rows", lambda r: r["_c"]).alias("chunks"))
