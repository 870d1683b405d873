"""Text functions as Column expressions; they stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as str.split() sees it: Unicode's and the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"

# The patterns that blocks and model answers are recognised by
NUMERALS = "一二三四五六七八九十百零〇"
PAGE_NUMBER = r"(?U)^(?:[-—\s]*(第\s*)?\d+\s*页?\s*([/／共]\s*\d+\s*页?)?[-—\s]*)$"
LEVEL_1 = rf"(?U)^(第[{NUMERALS}\d]+[章部篇]|[{NUMERALS}]+[、．.]\s*\S)"
LEVEL_2 = rf"(?U)^(第[{NUMERALS}\d]+节|[（(][{NUMERALS}]+[)）]|\d+[.．]\d+(?![.．]?\d)\s*\S)"
LEVEL_3 = r"(?U)^\d+[.．]\d+[.．]\d+"
STRONG = rf"(?U)^第[{NUMERALS}\d]+[章节部篇]"
CONTENTS_LINE = r"(?U)(\.{3,}|…{2,}|·{3,}|-{4,})\s*\d+\s*$"
SENTENCE_ENDS = "。！？；!?;\n"
PARAGRAPH_ENDS = "。！？；：!?;:…”」』"
NOT_HEADING_ENDS = "。；;，,"


def ascii_lower(c) -> Column:
    """Lowers A-Z only, as the library's exact search does on stored text."""
    return F.translate(c, UPPER, LOWER)


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


def terms_column(c) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), SPACE), lambda t: t != ""))


def occurrences(text: Column, term: str | Column) -> Column:
    """How often term occurs, without overlaps; text and term are of one case already."""
    term = F.lit(term) if isinstance(term, str) else term
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")


def occurrences_of_all(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [occurrences(text, t) for t in terms], F.lit(0).cast("bigint"))


def contains_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.instr(text, t) > 0 for t in terms], F.lit(False))


def text_hash(c) -> Column:
    return F.md5(F.regexp_replace(c, SPACE, ""))


def margin_key(c) -> Column:
    """A margin text without white space, numbers made alike."""
    return F.regexp_replace(F.regexp_replace(c, SPACE, ""), r"(?U)\d+", "#")


def heading_level(c: Column) -> Column:
    return F.when(c.rlike(LEVEL_3), 3).when(c.rlike(LEVEL_2), 2).when(c.rlike(LEVEL_1), 1).otherwise(0)


def ends_with_any(c: Column, ends: str) -> Column:
    return (F.length(c) > 0) & (F.instr(F.lit(ends), F.right(c, F.lit(1))) > 0)


def sentences(c) -> Column:
    """Pieces that end behind a sentence's end or a line's; joined they are the text."""
    return F.split(c, f"(?<=[{SENTENCE_ENDS}])", -1)


def is_ascii_alnum(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9]$")


def join_lines(lines: Column) -> Column:
    """Lines of one paragraph: a space only between ASCII letters or digits."""
    step = lambda out, s: F.concat(out, F.when(is_ascii_alnum(F.right(out, F.lit(1))) & is_ascii_alnum(F.left(s, F.lit(1))), " ").otherwise(""), s)
    return F.trim(F.aggregate(lines, F.lit(""), step))


def rows_text(rows: Column) -> Column:
    """array<array<string>> of cells as lines; empty rows vanish."""
    clean = lambda cell: F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), SPACE, " "))
    lines = F.transform(rows, lambda r: F.transform(r, clean))
    return F.array_join(F.transform(F.filter(lines, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, " | ")), "\n")


def flattened(c) -> Column:
    """One line: blanks around cell marks and runs of white space made single."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s*\|\s*", " | "), r"(?U)\s+", " "))


def snippet(c, terms: list[str], before: int = 20, length: int = 80) -> Column:
    flat = flattened(c)
    places = [F.nullif(F.instr(F.lower(flat), t), F.lit(0)) for t in terms]
    first = (F.least(*places) if len(places) > 1 else places[0]) if places else F.lit(None)
    start = F.coalesce(F.greatest(F.lit(0), first - 1 - before), F.lit(0))
    tail = F.when(start + length < F.length(flat), "…").otherwise("")
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substr(flat, start + 1, F.lit(length)), tail)


def html_escaped(c) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def marked(c, terms: list[str]) -> Column:
    """Escaped HTML with every term marked, longest terms first, in either case. Private-use characters hold the places of the marks until the text is escaped."""
    if not terms:
        return html_escaped(c)
    special = ".*+?^${}()|[]\\"
    alternatives = "|".join("".join("\\" + x if x in special else x for x in t) for t in sorted(terms, key=len, reverse=True))
    held = F.regexp_replace(c, f"(?iu)({alternatives})", "\ue000$1\ue001")
    return F.replace(F.replace(html_escaped(held), F.lit("\ue000"), F.lit("<mark>")), F.lit("\ue001"), F.lit("</mark>"))


def cleaned_answer(c) -> Column:
    """A model's answer without its thoughts and without a code fence around it."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", "")
    out = F.when(F.instr(out, "</think>") > 0, F.substring_index(out, "</think>", -1)).otherwise(out)
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return strip(F.regexp_replace(F.regexp_replace(strip(out), r"^```(?:markdown|md)?\s*\n", ""), r"\n```\s*$", ""))


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    minutes, hours = F.floor(s / 60).cast("string"), F.floor(s / 3600).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" 秒"))).when(s < 3600, F.concat(minutes, F.lit(" 分钟"))).otherwise(F.concat(hours, F.lit(" 小时 "), F.floor(s % 3600 / 60).cast("string"), F.lit(" 分钟")))


def elapsed_text(seconds: Column) -> Column:
    """How long a job has taken, to the second below an hour; never negative."""
    s = F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("bigint")
    part = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    hours = F.concat_ws(" ", part(s / 3600, " 小时"), part(s % 3600 / 60, " 分"))
    return F.when(s < 60, part(s, " 秒")).when(s < 3600, F.concat_ws(" ", part(s / 60, " 分"), part(s % 60, " 秒"))).otherwise(hours)


def stamp(at: Column) -> Column:
    """A time as stored, in the session's zone."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def shown_stamp(text: Column) -> Column:
    """A stored time without its seconds, a dash if there is none."""
    return F.coalesce(F.nullif(F.left(text, F.lit(16)), F.lit("")), F.lit("–"))


# The lines that a small Markdown knows
MD_HEAD, MD_ITEM = r"(?U)^#{1,6}\s+(.*)$", r"(?U)^(?:[-*•·]|[0-9]+[.、)])\s*(.*)$"


def markdown(c) -> Column:
    """Headings, lists, bold type and paragraphs as HTML; everything else is escaped. A list goes on while its kind doesn't change; a blank line ends it."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    kind = lambda x: F.when(x.rlike(MD_HEAD), "h3").when(x.rlike(MD_ITEM), F.when(x.rlike("^[0-9]"), "ol").otherwise("ul")).when(x == "", "").otherwise("p")
    body = lambda x: F.regexp_replace(html_escaped(F.when(x.rlike(MD_HEAD), F.regexp_replace(x, MD_HEAD, "$1")).otherwise(F.regexp_replace(x, MD_ITEM, "$1"))), r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    rows = F.transform(lines, lambda x: F.struct(kind(x).alias("k"), body(x).alias("t")))
    listed = lambda k: k.isin("ol", "ul")
    beside = lambda i: F.coalesce(F.get(rows, i)["k"], F.lit(""))

    def shown(row: Column, i: Column) -> Column:
        k, t = row["k"], row["t"]
        opened = F.when(beside(i - 1) != k, F.concat(F.lit("<"), k, F.lit(">"))).otherwise("")
        closed = F.when(beside(i + 1) != k, F.concat(F.lit("</"), k, F.lit(">"))).otherwise("")
        plain = F.concat(F.lit("<"), k, F.lit(">"), t, F.lit("</"), k, F.lit(">"))
        return F.when(k == "", "").when(listed(k), F.concat(opened, F.lit("<li>"), t, F.lit("</li>"), closed)).otherwise(plain)

    return F.array_join(F.transform(rows, shown), "")


def size_text(n: Column) -> Column:
    kb, mb = F.format_string("%.0f KB", F.round(n / 1024, 0).cast("double")), F.format_string("%.1f MB", F.round(n / 1048576, 1).cast("double"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, kb).otherwise(mb)


def api_base(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path.isin("", "/"), F.concat(url, F.lit("/v1"))).otherwise(url)


def normal_chars(c) -> Column:
    """Each character lowered, unless it gets longer by that."""
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.length(F.lower(x)) == 1, F.lower(x)).otherwise(x)), "")


def output_tokens(context: Column, most: int = 2048) -> Column:
    """Tokens that a model may write: a quarter of its context at most; context null if unknown."""
    return F.when(F.coalesce(context, F.lit(0)) > 0, F.least(F.lit(most), F.floor(context / 4).cast("int"))).otherwise(F.lit(most))


def part_chars(context: Column, most: int = 2048) -> Column:
    """Characters of a text that fit a model's context besides prompt and answer."""
    fit = F.floor((context - output_tokens(context, most) - 1000) * F.lit(0.9).cast("double")).cast("int")
    return F.when(F.coalesce(context, F.lit(0)) > 0, F.greatest(F.lit(1500), F.least(F.lit(30000), fit))).otherwise(F.lit(12000))
