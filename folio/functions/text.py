"""Column functions over texts: words, previews, slugs, marked-up speech, headings, titles, page numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.fixed import ABBREVIATIONS, NUMBER_WORDS, ROMAN

#: The marks around a heading in a page's text.
HEADING_OPENS, HEADING_CLOSES = "⟨⟨HEADING⟩⟩", "⟨⟨/HEADING⟩⟩"
#: White space inside a class of characters, the no-break and the zero-width one of U+FEFF too, the next-line sign not.
SPACES = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = rf"[{SPACES}]+"
#: The same characters one by one.
SPACE_CHARACTERS = "\t\n\v\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def trimmed(c: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def split_size(c: Column) -> Column:
    """Parts between white space, empty ones too: 1 for an empty text."""
    return F.size(F.split(c, r"\s+"))


def preview(c: Column, most: int = 100) -> Column:
    return F.concat(F.substring(c, 1, most), F.when(F.char_length(c) > most, "...").otherwise(""))


def slug(c: Column, collapse: bool = True) -> Column:
    out = F.regexp_replace(F.lower(c), "[^a-z0-9]", "-")
    return F.regexp_replace(out, "-+", "-") if collapse else out


def image_name(page: Column, nth: Column, padded: bool = True) -> Column:
    return F.format_string("page-%03d-image-%d.jpg" if padded else "page-%d-image-%d.jpg", page, nth)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def mime_type(path: Column) -> Column:
    kinds = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}
    ending = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), ending), F.lit("application/octet-stream"))


def initials(c: Column) -> Column:
    return F.array_join(F.transform(F.slice(words(c), 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")


def regex_escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def spaced(c: Column) -> Column:
    """A text with plain quotes and single spaces, without backslashes."""
    odd = SPACE_CHARACTERS.replace(" ", "", 1)
    out = F.translate(c, odd + "“”″‶‘’", " " * len(odd) + "\"\"\"\"''")
    return F.replace(F.regexp_replace(out, " {2,}", " "), F.lit("\\"), F.lit(""))


def ended(c: Column) -> Column:
    """A spaced text without the page number at its end."""
    return F.trim(F.regexp_replace(c, r"(?i) +(?:ix|xi{1,3}|[0-9]+) *\z", ""))


def folded(c: Column) -> Column:
    """A title or line with plain quotes, single spaces and no page number at its end."""
    return ended(spaced(c))


def folded_match(a: Column, b: Column) -> Column:
    """Whether a line is, begins with, or has a title, or begins with all of it but its first letters; both folded."""
    long_ = F.char_length(b) > 10
    cut = F.lit(False)
    for k in (1, 2, 3):
        cut = cut | ((F.char_length(b) - k > 8) & a.startswith(F.substring(b, k + 1, 10_000)))
    return a.startswith(b) | (long_ & (a.contains(b) | cut))


def title_match(line: Column, title: Column) -> Column:
    return folded_match(folded(line), folded(title))


def without_tags(c: Column, marks_only: bool = False) -> Column:
    return F.regexp_replace(c, "<mark[^>]*/>" if marks_only else "<[^>]*>", "")


def marked_speech(c: Column) -> Column:
    """Speech markup with a mark, named after word and place, before each word; words are parted by spaces."""
    parts = F.filter(F.split(c, " "), lambda w: w != "")
    marked = F.transform(parts, lambda w, i: F.concat(F.lit(' <mark name="'), w, F.lit("-"), i.cast("string"), F.lit('"/> '), w))
    return F.concat(F.lit("<speak>"), F.array_join(marked, ""), F.lit("</speak>"))


def number_of(word: Column) -> Column:
    """The number that an English number word or small Roman numeral names."""
    known = {w: i + 1 for i, w in enumerate(NUMBER_WORDS)} | {r: i + 1 for i, r in enumerate(ROMAN[:10])}
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(word))


def ends_abbreviated(c: Column) -> Column:
    """Whether a text's end is an abbreviation, by its last letters alone."""
    end = F.lower(F.right(trimmed(c), F.lit(max(map(len, ABBREVIATIONS)))))
    return end.rlike("(?:" + "|".join(re.escape(a.lower()) for a in ABBREVIATIONS) + r")\z")


def is_heading(line: Column, following: Column, previous: Column) -> Column:
    """Whether a line of a page is a heading, by itself and the lines around it."""
    t = trimmed(line)
    w = words(t)
    n, first, second = F.size(w), F.get(w, F.lit(0)), F.get(w, F.lit(1))
    shape = (F.char_length(t) >= 3) & ~t.contains("@") & (n <= 10) & ~t.rlike(r"[.!?;)@]\z") & t.rlike("^[A-Z]")
    before = trimmed(previous)
    after_end = previous.isNull() | (F.char_length(before) == 0) | before.rlike(r"[.!?;0-9]\z")
    symbol = (n >= 2) & first.rlike(r"^[A-Z][a-z]?\z") & second.rlike(r"^[a-z]|^\d+\z")
    index = t.rlike(r"\b\d+[-–]\d+|\b\d+n\d+|\b\d+,\s*\d+|\s\d+\z") | t.rlike(r"^[A-Z]\)\s")
    strong = (t == F.upper(t)) | t.endswith(":")
    weak = (n <= 6) & F.coalesce(trimmed(following).rlike("^[A-Z0-9]"), F.lit(False))
    return shape & F.coalesce(after_end, F.lit(True)) & ~F.coalesce(symbol, F.lit(False)) & ~index & (strong | weak)


def marked_heading(line: Column, following: Column, previous: Column) -> Column:
    """A trimmed line, in a heading's marks where it is one."""
    t = trimmed(line)
    return F.when(is_heading(line, following, previous), F.concat(F.lit(HEADING_OPENS), t, F.lit(HEADING_CLOSES))).otherwise(t)


def without_page_number(c: Column, page: Column) -> Column:
    """A page's text without the printed number (one less than the page's) or a small Roman numeral at its beginning."""
    own = F.when(page > 1, F.regexp_replace(c, F.concat(F.lit(r"^\s*"), (page - 1).cast("string"), F.lit(r"\s+")), F.lit(""))).otherwise(c)
    numeral = rf"(?i)^\s*(?:{'|'.join(ROMAN)})\s+(?=(?-i:[A-Z])|the|and|or|but|in|on|at|to|for|of|with|by)"
    return F.when(page <= 20, F.regexp_replace(own, numeral, "")).otherwise(own)


def index_pages(c: Column) -> Column:
    """All pages that an index entry names; "150-51" is 150 to 151."""
    spans = F.regexp_extract_all(c, F.lit(r"\d+[-–]\d+|\d+"), F.lit(0))

    def pages(s: Column) -> Column:
        a = F.regexp_extract(s, r"^(\d+)", 1)
        b = F.regexp_extract(s, r"[-–](\d+)", 1)
        full = F.when(F.char_length(b) < F.char_length(a), F.concat(F.substring(a, F.lit(1), F.char_length(a) - F.char_length(b)), b)).otherwise(b)
        low, high = a.cast("int"), F.when(b == "", a).otherwise(full).cast("int")
        return F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array(low))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, pages))))


def toc_entry(line: Column) -> Column:
    """(number, label, title, page) of a table of contents' line; null where it is none, or only names a column or the contents.

    Four forms are tried in turn: a number, a title and a page; an introduction (number 0) with a page, that may be Roman;
    an appendix with its letter; letters and a page.
    """
    t = trimmed(line)
    forms = [
        (rf"^([0-9]+)\.?{SPACE}(.+?){SPACE}([0-9]+)\z", 2, 3), (rf"(?iu)^(introduction[:{SPACES}]*.*?){SPACE}([ivx]+|[0-9]+)\z", 1, 2),
        (rf"(?iu)^(appendix{SPACE}[a-z][:{SPACES}]*.*?){SPACE}([0-9]+)\z", 1, 2), (rf"^([A-Za-z{SPACES}]+){SPACE}([0-9]+)\z", 1, 2),
    ]
    out = F.when(t.rlike(r"(?iu)^(?:contents?|table of contents|page|chapter)\z"), None)
    for form, at_title, at_page in forms:
        title = trimmed(F.regexp_extract(t, form, at_title))
        number = F.regexp_extract(t, form, 1).try_cast("int") if at_title == 2 else F.when(F.lower(title).contains("introduction"), 0)
        letter = F.regexp_extract(title, rf"(?iu)appendix{SPACE}([a-z])", 1)
        label = F.when((F.lit(at_title == 1)) & number.isNull() & (letter != ""), F.concat(F.lit("Appendix "), letter))
        entry = F.struct(number.alias("number"), label.alias("label"), title.alias("title"), F.regexp_extract(t, form, at_page).alias("page"))
        out = out.when(t.rlike(form), entry)
    return out


WORDED = "|".join(NUMBER_WORDS)


def chapter_of_title(title: Column) -> Column:
    """(number, label, title) of a bookmark's title: "1. Title" has a number and the rest; "Chapter Two: Title" a number, an introduction 0,
    an appendix and an epilogue a label, all with the whole title; any other title is just that."""
    t = trimmed(title)
    numbered, worded = rf"^([0-9]+)\.?{SPACE}(.+)\z", rf"(?iu)^chapter{SPACE}({WORDED}):[{SPACES}]*(.+)\z"
    appendix = F.regexp_extract(t, rf"(?iu)^appendix{SPACE}([a-z0-9]+)", 1)
    has = lambda word: F.lower(t).contains(word)
    whole = lambda number, label: F.struct(number.cast("int").alias("number"), label.cast("string").alias("label"), t.alias("title"))
    none = F.lit(None)
    by_number = F.struct(F.regexp_extract(t, numbered, 1).try_cast("int").alias("number"), none.cast("string").alias("label"), trimmed(F.regexp_extract(t, numbered, 2)).alias("title"))
    return (
        F.when(t.rlike(numbered), by_number).when(t.rlike(worded), whole(number_of(F.regexp_extract(t, worded, 1)), none)).when(has("introduction"), whole(F.lit(0), none))
        .when(appendix != "", whole(none, F.concat(F.lit("Appendix "), appendix))).when(has("epilogue"), whole(none, F.lit("Epilogue"))).otherwise(whole(none, none))
    )


#: fixed values: titles that are chapters by themselves, in the second set of rules
SPECIAL_TITLES = ["introduction", "conclusion", "epilogue", "prologue", "preface", "foreword", "afterword"]


def chapter_of_outline(title: Column) -> Column:
    """(number, label, title) by the second set of rules: "Chapter 3: Title", with words to twelve; "3. Title"; "III. Title", with a label where the
    numeral is above ten; "Chapter Sixteen" is none, as no word is taken for its beginning; titles that are chapters by themselves, with these as labels. Null for any other title."""
    t = trimmed(title)
    chapter = rf"(?iu)^chapter{SPACE}([0-9]+|(?:{'|'.join(NUMBER_WORDS[:12])})\b):?[{SPACES}]*(.+)"
    numbered, roman = rf"^([0-9]+)\.?{SPACE}(.+)", rf"(?iu)^([ivxlcdm]+)\.{SPACE}(.+)"
    which, numeral = F.regexp_extract(t, chapter, 1), F.lower(F.regexp_extract(t, roman, 1))
    entry = lambda number, label, rest: F.struct(number.cast("int").alias("number"), label.cast("string").alias("label"), rest.alias("title"))
    none, rest = F.lit(None), lambda form: trimmed(F.regexp_extract(t, form, 2))
    return (
        F.when(t.rlike(chapter), entry(F.coalesce(which.try_cast("int"), number_of(which)), none, rest(chapter)))
        .when(t.rlike(numbered), entry(F.regexp_extract(t, numbered, 1).try_cast("int"), none, rest(numbered)))
        .when(t.rlike(roman), entry(number_of(numeral), F.when(number_of(numeral).isNull(), numeral), rest(roman)))
        .when(F.lower(t).isin(SPECIAL_TITLES), entry(none, F.lower(t), t))
    )


def navigation_kind(text: Column, has_point: Column) -> Column:
    """How a link's target is looked for."""
    return F.when(has_point, "coordinate").when(F.char_length(F.trim(text)) <= 3, "pattern").otherwise("text-search")


def footnote_pattern(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.char_length(t) <= 3, F.concat(F.lit("(^|\\s)"), regex_escaped(t), F.lit("(\\.|\\s|$)"))).otherwise(regex_escaped(t))


def rolling_hash(c: Column) -> Column:
    """32-bit h * 31 + code over a text, without sign, in hexadecimal."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    wrap = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.lower(F.hex(F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + x)))))


def image_address(base: Column, folder: Column, name: Column) -> Column:
    return F.when(name.isNull(), F.lit(None)).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), folder, F.lit("/"), name))


def prompt(title: Column, context: Column, history: Column, question: Column) -> Column:
    """A question about a book with what is known; parts that are empty are left out."""
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c, F.lit("\n"))).otherwise("")
    return F.concat(part("Book: ", title), part("Context: ", context), part("Conversation: ", history), F.lit("Question: "), question)


def sentences(c: Column) -> Column:
    """The words of a text, given as an array, as an array of (start, words, text): a sentence ends with a word that ends in a closing sign,
    unless that is an abbreviation before a small letter. Words behind the last such end are a sentence too."""
    n = F.size(c)
    small = lambda after: F.coalesce(after.rlike("^[a-z]"), F.lit(False))
    short = lambda word: F.rlike(F.lower(word), F.lit("(?:" + "|".join(re.escape(a.lower()) for a in ABBREVIATIONS) + r")\z"))
    closes = F.zip_with(c, F.slice(c, F.lit(2), n), lambda word, after: word.rlike(r"[.!?]\z") & ~(small(after) & short(word)))
    cuts = F.filter(F.transform(closes, lambda yes, i: F.when(yes, i + 1)), lambda at: at.isNotNull())
    stops = F.array_distinct(F.concat(cuts, F.filter(F.array(n), lambda x: x > 0)))
    starts = F.slice(F.concat(F.array(F.lit(0)), stops), F.lit(1), F.size(stops))
    return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b - a).alias("words"), F.array_join(F.slice(c, a + 1, b - a), " ").alias("text")))
