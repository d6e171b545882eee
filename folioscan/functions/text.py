"""Scalar text functions as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan import schemas

#: Unicode white space as Python's str.split and str.strip see it.
WS = r"(?U)[\s\x1c-\x1f]+"
#: Roman numerals and number words that stand for chapter and class numbers (fixed values).
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
#: Patterns of figure references, cut replies, equations and headings (fixed values).
FIGURE = r"(?i)(?:Fig\.?|Figure)\s*(\d+[\.\d]*(?:\([a-z]\))?)"
SALVAGE = r'(?s)\{\s*"chapter_number"\s*:.*?"topics"\s*:\s*\[.*?\]\s*\}'
BLOCK_EQUATION = r"(?s)\$\$(.+?)\$\$"
INLINE_EQUATION = r"(?d)(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)"
NUMBERED = r"^(\d+)\s*\.\s*(\d+)"
TOPIC_HEADING = r"^(\d+)\.(\d+)\s+(\S.*)"
EXERCISE_HEADING = r"(?i)^\s*(EXERCISES?|ADDITIONAL\s+EXERCISES?)(\s+\d+\.\d+)?\s*$"
INTEXT_HEADING = r"(?i)^\s*Intext\s+Questions?\s*$"
ANSWERS_HEADING = r"(?i)^\s*Answers\s+to\s+(?!.*\d{2,}\s*$).+"
EXAMPLE_HEADING = r"(?i)^Example\s+(\d+)\.(\d+)\s+(\S.*)"
CHAPTER_NUMBER = r"(?i)^chapter\s+(\d+)\b"
UNIT_HEADER = r"(?i)^unit\s+"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def words(c: Column) -> Column:
    """str.split(): no empty strings."""
    return F.filter(F.split(c, WS), lambda w: w != "")


def lines(c: Column) -> Column:
    """str.splitlines() without the trailing empty line."""
    cut = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    return F.split(F.regexp_replace(c, f"(?:{cut})\\z", ""), cut)


def solid_lines(c: Column) -> Column:
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def normalise(c: Column) -> Column:
    """Upper case, anything but A-Z, 0-9, dot and space as a space, single spaced."""
    return strip(F.regexp_replace(F.regexp_replace(F.upper(c), r"(?U)[^A-Z0-9.\s]", " "), WS, " "))


def falsy(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def safe_int(c: Column) -> Column:
    return strip(c).try_cast("int")


def figure_refs(c: Column) -> Column:
    """Distinct figure numbers of a text in order, part suffix like (a) dropped."""
    found = F.regexp_extract_all(c, F.lit(FIGURE), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"(?i)\([a-z]\)$", "")))


def figure_number(caption: Column) -> Column:
    return falsy(F.regexp_extract(caption, FIGURE, 1))


def roman_to_arabic(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, r in enumerate(ROMAN, 1) for x in (r, str(i))])
    return F.coalesce(F.try_element_at(table, F.upper(strip(c))), strip(c))


def word_to_digit(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBER_WORDS, 1) for x in (w, str(i))])
    return F.coalesce(F.try_element_at(table, F.lower(strip(c))), strip(c))


def strip_fences(c: Column) -> Column:
    """A reply that opens with a code fence, without its first line and a last line that is the fence; stripped."""
    all_ = lines(strip(c))
    end = F.when(strip(F.try_element_at(all_, F.lit(-1))) == "```", F.size(all_) - 1).otherwise(F.size(all_))
    inner = F.array_join(F.slice(all_, F.lit(2), F.greatest(end - 1, F.lit(0))), "\n")
    return F.when(strip(c).startswith("```"), strip(inner)).otherwise(strip(c))


def valid_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing after it, which the parsers let pass."""
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    at = lambda i: F.try_variant_get(v, f"$[{i}]", "variant")
    return F.coalesce(at(0).isNotNull() & at(1).isNull(), F.lit(False))


def salvage_chapters(c: Column) -> Column:
    """struct(chapters, _truncated) of the chapter objects that are complete, topics and all,
    in a truncated JSON reply; null where there is none.  A chapter's number comes first
    in it and its list of topics last; what is not valid JSON is passed over."""
    one = lambda x: F.from_json(x, schemas.CHAPTER_CHECKED, {"columnNameOfCorruptRecord": "corrupt"})
    sound = F.filter(F.transform(F.regexp_extract_all(c, F.lit(SALVAGE), F.lit(0)), one), lambda x: x["corrupt"].isNull())
    chapters = F.transform(sound, lambda x: F.struct(*[x[f].alias(f) for f in schemas.CHAPTER.names]))
    return F.when(F.size(chapters) > 0, F.struct(chapters.alias("chapters"), F.lit(True).alias("_truncated")))


def json_reply(c: Column, schema: str) -> Column:
    """struct(whole, salvaged) of a model's reply without its fence: parsed by ``schema`` (DDL), or,
    where it is not valid JSON, what salvage_chapters finds.  Both are null where neither helps."""
    text = strip_fences(c)
    whole = F.from_json(text, f"{schema}, corrupt string", {"columnNameOfCorruptRecord": "corrupt"})
    valid = F.coalesce(whole["corrupt"].isNull() & whole.isNotNull(), F.lit(False)) & valid_json(text)
    return F.struct(F.when(valid, whole.dropFields("corrupt")).alias("whole"), F.when(~valid, salvage_chapters(text)).alias("salvaged"))


def identity(c: Column) -> Column:
    """struct(subject, part, class_number) of a reply without its fence: its JSON or, where it isn't valid,
    the first object in it that holds no other; Unknown for what is missing, null-like parts as
    null, Roman numbers as digits."""
    parsed = lambda t: F.from_json(t, f"{schemas.IDENTITY.simpleString()[7:-1].replace(':', ' ')}, corrupt string", {"columnNameOfCorruptRecord": "corrupt"})
    text = strip_fences(c)
    whole, inner = parsed(text), parsed(F.regexp_extract(text, r"\{[^{}]+\}", 0))
    valid = F.coalesce(whole["corrupt"].isNull() & whole.isNotNull(), F.lit(False)) & valid_json(text)
    got = lambda f: F.when(valid, whole[f]).otherwise(inner[f])
    part = F.when(~F.lower(strip(got("part"))).isin("null", "none", ""), roman_to_arabic(got("part")))
    return F.struct(
        F.coalesce(falsy(strip(got("subject"))), F.lit("Unknown")).alias("subject"),
        part.alias("part"),
        roman_to_arabic(F.coalesce(falsy(strip(got("class_number"))), F.lit("Unknown"))).alias("class_number"),
    )


def point_id(stem: Column, page: Column) -> Column:
    """First 15 hexadecimal digits of the SHA-256 of ``stem:page``, as a number."""
    key = F.concat(stem, F.lit(":"), page.cast("string"))
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")


def cache_key(model: str, text: Column) -> Column:
    return F.concat(F.lit("emb:"), F.sha2(F.concat(F.lit(model + ":"), text), 256))


def first_int(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def page_of_name(c: Column) -> Column:
    return F.regexp_extract(c, r"page_(\d+)", 1).try_cast("int")


def page_name(page: Column, suffix: str = "txt") -> Column:
    return F.format_string(f"page_%04d.{suffix}", page)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once: in the functions given to transform or filter a column is computed anew for each element."""
    return F.transform(F.array(c), f)[0]


def window_step(target: int, overlap: float) -> int:
    return target - max(1, int(target * overlap))


def word_windows(c: Column, target: int = 400, least: int = 80, overlap: float = 0.15) -> Column:
    """Overlapping word windows; a last one of fewer than ``least`` words joins the
    one before it, overlap included, unless it is the only one."""
    step = window_step(target, overlap)

    def cut(w: Column) -> Column:
        n = F.size(w)
        cuts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(cuts, lambda i: F.slice(w, i + 1, target))

    def whole(parts: Column) -> Column:
        k = F.size(parts)
        short = (k > 1) & (F.size(F.try_element_at(parts, F.lit(-1))) < least)
        joined = F.concat(F.slice(parts, 1, F.greatest(k - 2, F.lit(0))), F.array(F.concat(F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))))
        return F.transform(F.when(short, joined).otherwise(parts), lambda p: F.array_join(p, " "))

    return once(once(words(c), cut), whole)


def equations(c: Column) -> Column:
    """struct(equations, text): display equations first, then inline ones, with their
    dollar signs; what is left has no runs of over two newlines."""
    rest = F.regexp_replace(c, BLOCK_EQUATION, "")
    found = F.concat(F.regexp_extract_all(c, F.lit(BLOCK_EQUATION), F.lit(0)), F.regexp_extract_all(rest, F.lit(INLINE_EQUATION), F.lit(0)))
    rest = F.regexp_replace(rest, INLINE_EQUATION, "")
    return F.struct(F.transform(found, strip).alias("equations"), strip(F.regexp_replace(rest, r"\n{3,}", "\n\n")).alias("text"))


def file_name(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"), r"\s+", "_"))


def chapter_file(number: Column, name: Column) -> Column:
    """Folder of a chapter's chunks; chapters without a digit number share one."""
    key = F.coalesce(falsy(number), F.lit("00"))
    named = F.concat(F.lit("chapter_"), F.lpad(key, 2, "0"), F.lit("_"), F.substring(file_name(F.coalesce(falsy(name), F.lit("Unknown"))), 1, 40))
    return F.when(key.rlike("^[0-9]+$"), named).otherwise("chapter_00_front_matter")
