"""Chapters by a book's configured titles: where these stand in its lines, which place of each is meant, what is between.

Titles are a table (doc_id, nth, title), and lines meet those of their own document that share a word with them, in an equi-join. All steps after
it are windows over a document's lines, dealt once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.documents import PUBLISHING, marked_lines, preferred, sections_of

#: Letters of a title that is short, and of a word's beginning.
SHORT_TITLE, BEGINS = 10, 4
#: So many titles of a document are held against each of its lines; of more those that share a key with it.
FEW_TITLES = 32
#: Lines behind a title in which its content is counted, and letters of a line that counts.
BODY, LEAST_BODY = 99, 20
#: Lines in which the contents' heading is looked for, and from where to where behind it the first title.
CONTENTS_WITHIN, TITLE_FROM, TITLE_TO = 200, 5, 100


def book_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text): the trimmed lines that are not empty, counted from 0."""
    trimmed = F.transform(F.split("text", "\n"), T.trimmed)
    return docs.select("doc_id", F.posexplode(F.filter(trimmed, lambda x: x != "")).alias("line", "text"))


def content_line(text: Column) -> Column:
    """Whether a line is a chapter's content: long enough, no page number, no publishing data."""
    return (F.char_length(text) > 10) & ~text.rlike(r"^\d+\z") & ~text.rlike(rf"(?iu)^(?:{PUBLISHING})")


def content_chapter(number: Column, label: Column, title: Column, page: Column, names: list[str]) -> Column:
    """Whether an entry of a table of contents is a chapter to read: it has a page, and a number, or is an epilogue, or has or is in a configured name."""
    named = F.exists(F.array(*[F.lit(n) for n in names]), lambda n: title.contains(n) | n.contains(title)) if names else F.lit(False)
    wanted = F.coalesce(number >= 0, F.lit(False)) | F.coalesce(F.lower(label).contains("epilogue"), F.lit(False)) | F.coalesce(named, F.lit(False))
    return F.coalesce(page != 0, F.lit(False)) & wanted


def usable_link(subtype: Column, dest: Column, url: Column) -> Column:
    """Whether an annotation is a link inside its document."""
    return F.coalesce((subtype == "Link") & (dest != "") & (F.coalesce(url, F.lit("")) == ""), F.lit(False))


def title_key(f: Column) -> Column:
    """What a line that matches a folded title must have: the title as its beginning where that is short; else its longest inner word, or how its
    second and last word begins. Null for the titles, single long words above all, that need not leave a whole word in a line.

    A line may lack up to three letters at the title's beginning, and go on behind its end, so the first and the last word may be parts there.
    """
    words = F.split(f, " ")
    n, second = F.size(words), F.char_length(F.get(words, F.lit(0))) >= 2
    inner = F.slice(words, F.when(second, 2).otherwise(3), F.greatest(n - F.when(second, 2).otherwise(3), F.lit(0)))
    longest = F.get(F.array_sort(F.transform(inner, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
    last = F.get(words, n - 1)
    begins = F.when((n == 2) & second & (F.char_length(last) >= BEGINS), F.concat(F.lit("q"), F.substring(last, 1, BEGINS)))
    return F.when(F.char_length(f) <= SHORT_TITLE, F.concat(F.lit("p"), f)).otherwise(F.coalesce(F.concat(F.lit("w"), longest), begins))


def kinds_of_titles(titles: DataFrame) -> DataFrame:
    """(doc_id, _lengths, _pairs, _wanted, _given): the lengths that a document's short titles have, whether one of its titles goes by how words begin,
    the hashes of its titles' keys, and the titles that its lines are held against one by one: those without a key, or all where they are few."""
    n, key = F.char_length("_folded"), title_key(F.col("_folded"))
    many = F.count("*").over(Window.partitionBy("doc_id")) > FEW_TITLES
    kinds = titles.withColumn("_by_key", many & key.isNotNull()).groupBy("doc_id")
    wanted = F.collect_set(F.when(F.col("_by_key"), F.xxhash64(key))).alias("_wanted")
    given = F.collect_list(F.when(~F.col("_by_key"), F.struct("nth", "title", "_folded"))).alias("_given")
    return kinds.agg(F.collect_set(F.when(n <= SHORT_TITLE, n)).alias("_lengths"), F.coalesce(F.bool_or(key.startswith("q")), F.lit(False)).alias("_pairs"), wanted, given)


def line_keys(x: Column, lengths: Column, pairs: Column) -> Column:
    """The hashes of all keys of a folded line that a title of its document could have."""
    words = F.split(x, " ")
    key = lambda kind, c: F.xxhash64(F.concat(F.lit(kind), c))
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.char_length(x)), lambda k: key("p", F.substring(x, F.lit(1), k)))
    begins = F.when(pairs, F.transform(F.filter(words, lambda w: F.char_length(w) >= BEGINS), lambda w: key("q", F.substring(w, 1, BEGINS)))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(prefixes, F.transform(words, lambda w: key("w", w)), begins))


def with_candidates(lines: DataFrame, titles: DataFrame, *texts: str) -> DataFrame:
    """Lines (doc_id, _text, _wanted, ..) with nth, title and _folded of titles (.., _folded) of their document that have a key in common with them, by
    its hash: a row for each, and one without a title where there is none. ``texts`` stay only where there is one.

    A line's keys are held against those of its document's titles before they are dealt, so texts and keys of other lines never are.
    """
    keyed = titles.select(F.col("doc_id").alias("_doc"), title_key(F.col("_folded")).alias("_k"), "nth", F.col("title").alias("_title"), "_folded")
    met = F.when(F.size("_wanted") > 0, F.array_intersect(line_keys(F.col("_text"), F.col("_lengths"), F.col("_pairs")), "_wanted"))
    kept = [c for c in lines.columns if c not in ("_text", "_lengths", "_pairs", "_wanted")]
    asked = lines.withColumn("_met", met)
    asked = asked.select(*[F.when(F.size("_met") > 0, F.col(c)).alias(c) if c in texts else F.col(c) for c in kept], F.explode_outer("_met").alias("_key"))
    found = keyed.where("_k is not null").withColumn("_k", F.xxhash64("_k"))
    return asked.join(found, (F.col("doc_id") == F.col("_doc")) & (F.col("_key") == F.col("_k")), "left").select(*kept, "nth", "_title", "_folded")


def candidates(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, line, nth, title, _folded) of lines (.., _text) and titles (.., _folded) of one document of many titles that have a key in common."""
    asked = lines.select("doc_id", "line", "_text").join(kinds_of_titles(titles).drop("_given"), "doc_id")
    return with_candidates(asked, titles).where("_folded is not null").withColumnRenamed("_title", "title")


def with_titles(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Lines with ``title``, the first of their document's titles that they match, ``joined``, the same for a line and the next one together, and
    whether they count as content (``counts``) and have the contents' heading (``heads``).

    A document's few titles are held against its lines where these are; lines of a document with many meet only those that share a key with them
    (``title_key``), and these are then compared in full. Texts are dealt once, by document; behind that only of lines that meet a title by a key,
    and the given ``text`` only where it is asked for.
    """
    titles = titles.where(F.col("title").isNotNull()).select("doc_id", "nth", "title", T.folded(F.col("title")).alias("_folded"))
    counts = (F.char_length("text") > LEAST_BODY) & ~F.col("text").rlike(r"^\d+\z")
    own = lines.select("doc_id", "line", "text", counts.alias("counts"), F.lower("text").contains("contents").alias("heads"), T.spaced(F.col("text")).alias("_own"))
    # each line is a row of its own, also where an id is null or comes again
    both = own.withColumn("_after", F.lead("_own").over(Window.partitionBy("doc_id").orderBy("line"))).withColumn("_row", F.monotonically_increasing_id())
    one, two = T.ended(F.col("_own")), T.ended(F.concat(F.rtrim("_own"), F.lit(" "), F.ltrim("_after")))
    rows = both.join(kinds_of_titles(titles), "doc_id", "left").withColumn("_one", one).withColumn("_two", two).withColumn("_text", F.coalesce("_two", "_one"))
    # a line's own folded text is a beginning of that of both, so what is not in the longer one matches neither
    near = F.filter("_given", lambda t: F.col("_text").contains(F.substring(t["_folded"], 4, 10_000)))
    of = lambda c: F.array_min(F.transform(F.filter("_near", lambda t: T.folded_match(F.col(c), t["_folded"])), lambda t: F.struct(t["nth"].alias("nth"), t["title"].alias("title"))))
    rows = rows.withColumn("_near", near).withColumn("_first", of("_one")).withColumn("_joined", of("_two")).drop("_given", "_near", "_one", "_two")
    met = with_candidates(rows, titles, "_own", "_after").withColumn("_one", one).withColumn("_two", two)
    first = lambda c: F.min(F.when(T.folded_match(F.col(c), F.col("_folded")), F.struct("nth", F.col("_title").alias("title"))))
    found = met.groupBy("doc_id", "line", "_row").agg(
        *[F.first(c).alias(c) for c in ("text", "counts", "heads")], F.least(F.first("_first"), first("_one"))["title"].alias("title"), F.least(F.first("_joined"), first("_two"))["title"].alias("joined")
    )
    return found.drop("_row")


def occurrences(matched: DataFrame) -> DataFrame:
    """(doc_id, line, title, joined, content_lines): all places of titles, with the lines of content up to the next title."""
    w = Window.partitionBy("doc_id").orderBy("line")
    part = F.sum(F.col("title").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # a title begins a part, so the lines of the same part behind a line are those before the next title
    behind = Window.partitionBy("doc_id", "_part").orderBy("line").rowsBetween(1, BODY)
    rows = matched.withColumn("_part", part).withColumn("content_lines", F.coalesce(F.sum(F.col("counts").cast("long")).over(behind), F.lit(0)))
    place = lambda c, joined: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("title"), F.lit(joined).alias("joined")))
    placed = rows.select("doc_id", "line", "content_lines", F.explode(F.array_compact(F.array(place("title", False), place("joined", True)))).alias("_p"))
    return placed.select("doc_id", "line", "_p.title", "_p.joined", "content_lines")


def best_occurrences(found: DataFrame) -> DataFrame:
    """The place of each title with the most content behind it, the first of equal ones; none without content."""
    w = Window.partitionBy("doc_id", "title")
    ranked = found.withColumn("_nth", F.row_number().over(w.orderBy(F.desc("content_lines"), "line", "joined"))).withColumn("first_seen", F.min(F.struct("line", "joined")).over(w))
    return ranked.where("_nth = 1 and content_lines >= 1").drop("_nth")


def between_titles(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """The lines of content (doc_id, line, start, title, ..) from each title's best place to the next one's; their texts are dealt once."""
    best = best_occurrences(occurrences(with_titles(lines, titles)))
    # of two titles at one line the one that was seen later has what follows
    starts = best.groupBy("doc_id", "line").agg(F.max_by("title", "first_seen").alias("title")).withColumn("_kind", F.lit(0))
    body = lines.where(content_line(F.col("text")) & F.col("doc_id").isNotNull()).withColumn("_kind", F.lit(1))
    # a place is a row before its line's own
    w = Window.partitionBy("doc_id").orderBy("line", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = body.unionByName(starts, allowMissingColumns=True)
    placed = placed.withColumn("start", F.last(F.when(F.col("_kind") == 0, F.col("line")), ignorenulls=True).over(w)).withColumn("title", F.last("title", ignorenulls=True).over(w))
    return placed.where((F.col("_kind") == 1) & (F.col("line") != F.col("start"))).drop("_kind")


def chapters_by_title(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, chapter, title, line, content_lines, content): from each title's best place to the next one's."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), "\n")
    parts = between_titles(lines, titles).groupBy("doc_id", "start", "title").agg(F.count("*").alias("content_lines"), text.alias("content"))
    return parts.select("doc_id", chapter_number().alias("chapter"), "title", F.col("start").alias("line"), "content_lines", "content")


def chapter_number() -> Column:
    return F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))


def content_start(matched: DataFrame) -> DataFrame:
    """(doc_id, start): two lines before the first title behind the contents' heading, or so many behind it, or 0 without one."""
    heading = F.when((F.col("line") < CONTENTS_WITHIN) & F.col("heads"), F.col("line"))
    placed = matched.withColumn("_contents", F.min(heading).over(Window.partitionBy("doc_id")))
    title = F.when(F.col("title").isNotNull() & F.col("line").between(F.col("_contents") + TITLE_FROM, F.col("_contents") + TITLE_TO - 1), F.col("line"))
    found = placed.groupBy("doc_id").agg(F.first("_contents").alias("_contents"), F.min(title).alias("_title"))
    return found.select("doc_id", F.when(F.col("_contents").isNull(), 0).otherwise(F.coalesce(F.col("_title") - 2, F.col("_contents") + 15)).alias("start"))


def detected(by_contents: DataFrame, lines: DataFrame, titles: DataFrame, heading: Column) -> DataFrame:
    """(doc_id, chapter, chars): chapters of the table of contents where there are any, else by titles where the document has some, else by patterns.

    Lengths alone are asked for, so lines go by theirs and not by their texts, but where titles are looked for.
    """
    sized = lines.withColumn("_chars", F.char_length("text").cast("long"))
    parts = between_titles(sized, titles).groupBy("doc_id", "start", "title").agg((F.sum("_chars") + F.count("*") - 1).alias("chars"))
    by_title = parts.select("doc_id", chapter_number().cast("long").alias("chapter"), "chars")
    without = marked_lines(lines, heading).join(titles.select("doc_id").distinct(), "doc_id", "left_anti")
    by_pattern = sections_of(without).select("doc_id", "chapter", "chars")
    return preferred(by_contents.select("doc_id", "chapter", "chars"), by_title.unionByName(by_pattern))
