"""Text functions as columns: normal forms, token estimates, blocks, URLs and link density.

Unicode classes are switched on where a pattern has \\s or \\w, and white space
is stripped by pattern, since trim() only strips spaces. Null gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of the scripts that take about 1.5 characters a token.
CJK = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}]"


def once(x: Column, said: Callable[[Column], Column]) -> Column:
    """said(x), with x computed once a row; a column that is named in a lambda's body is computed anew for every item."""
    return F.transform(F.array(x), lambda y: said(y))[0]


def strip(s: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def normal(s: Column) -> Column:
    """Lower case, white space collapsed and stripped."""
    return F.trim(F.regexp_replace(F.lower(s), r"(?U)\s+", " "))


def normal_dashes(s: Column) -> Column:
    """normal(), with typographic dashes and the minus sign as hyphens."""
    return normal(F.translate(s, "–—―−", "----"))


def without_marks(s: Column) -> Column:
    """Without hyphens and trade mark signs."""
    return F.regexp_replace(s, "[-®™©]", "")


def without_punctuation(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)[^\w\s]", "")


def tidy_quote(s: Column) -> Column:
    """A quote without trailing dots and ellipses, dashes made equal."""
    return F.translate(strip(F.regexp_replace(strip(s), r"(?:\.{2,}|…)+$", "")), "–—―−", "----")


def without_markdown(s: Column) -> Column:
    """The text that images, links, emphasis, code spans and tables show; bars become spaces."""
    bracketed = r"!?\[([^\]]*)\]\([^)]*\)"
    rule = r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-*:?[ \t]*)*$"
    for pattern, shown in ((bracketed, "$1"), (rule, " "), (r"(\*{1,3}|(?<![\p{L}\d])_{1,3})(?=\S)(.+?)(?<=\S)\1", "$2"), ("`([^`\n]+)`", "$1"), (r"\|", " ")):
        s = F.regexp_replace(s, pattern, shown)
    return s


def token_estimate(s: Column) -> Column:
    """A fourth of the characters, two thirds of the CJK ones, each rounded down."""
    cjk = F.length(F.regexp_replace(s, CJK.replace("[", "[^", 1), ""))
    return (F.floor((F.length(s) - cjk) / 4) + F.floor(cjk / F.lit(1.5))).cast("long")


def blocks(s: Column, separator: str = r"\n\s*\n", least: int = 50) -> Column:
    """Parts of a text of at least ``least`` characters without the white space around them."""
    return F.filter(F.transform(F.split(s, separator), strip), lambda b: F.length(b) >= least)


def block_hash(b: Column) -> Column:
    """16 hex digits of the SHA-256 of the normal form."""
    return F.left(F.sha2(normal(b).cast("binary"), 256), F.lit(16))


def link_density(line: Column) -> Column:
    """Share of a line's characters in Markdown links and in URLs that no bracket opens; 0 for an empty one."""
    links = F.concat(F.regexp_extract_all(line, F.lit(r"\[[^\]]*\]\([^)]*\)"), 0), F.regexp_extract_all(line, F.lit(r"(?<!\()https?://\S+"), 0))
    inside = F.aggregate(F.transform(links, F.length), F.lit(0), lambda a, n: a + n)
    return F.when(F.length(line) == 0, 0.0).otherwise(inside / F.length(line))


# What of a page in Markdown is structure only. Images without a text; links that skip to the content;
# list items that are a link of 1 to 80 characters and nothing else; images alone on a line.
JUNK = [
    r"(?i)!\[\]\(https?://[^)]+\)\s*",
    r"(?im)^\[skip to [^\]]*\]\([^)]*\)\s*\n?",
    r"(?m)^[*-]\s+\[[^\]]{1,80}\]\([^)]*(?:\([^)]*\)[^)]*)*\)\s*$",
    r"(?m)^!\[[^\]]*\]\([^)]+\)\s*$",
]


def without_junk(s: Column) -> Column:
    """Without JUNK and runs of blank lines."""
    for pattern in JUNK:
        s = F.regexp_replace(s, pattern, "")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def content_start(s: Column, run: int = 3, density: float = 0.4, least: int = 20, lines: int | None = None) -> Column:
    """Where the first ``run`` long lines in a row with few links begin, counted from 0; shorter lines don't break the row. 0 if there is no such place. Looked for in the whole text, or in its first ``lines`` lines."""

    def place(parts: Column) -> Column:
        stripped = F.transform(parts if lines is None else F.slice(parts, 1, lines), lambda x, i: F.struct(i.alias("i"), strip(x).alias("t")))
        long = F.transform(F.filter(stripped, lambda x: F.length(x["t"]) >= least), lambda x: F.struct(x["i"].alias("i"), (link_density(x["t"]) < density).alias("low")))
        at = lambda long: F.transform(long, lambda x, j: F.when(F.size(F.filter(F.slice(long, j + 1, run), lambda y: y["low"])) == run, x["i"]))
        starts = F.filter(once(long, at), lambda i: i.isNotNull())
        before = F.slice(parts, 1, F.coalesce(F.get(starts, F.lit(0)), F.lit(0)))
        return F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x) + 1)

    return once(F.split(s, "\n"), place)


def cleaned(s: Column, lines: int | None = None) -> Column:
    """Without junk, from the content's start on; for embeddings."""
    return once(without_junk(s), lambda bare: strip(F.substring(bare, content_start(bare, lines=lines) + 1, F.length(bare))))


def cut_at_word(s: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last blank if that lies in the last fifth."""
    head = F.left(s, F.lit(most))
    blank = F.length(head) - F.locate(" ", F.reverse(head))
    return F.when(F.length(s) <= most, s).when((F.locate(" ", F.reverse(head)) > 0) & (blank > 0.8 * most), F.regexp_replace(F.left(head, blank), r"(?U)\s+$", "")).otherwise(head)


def page_summary(url: Column, title: Column, content: Column, most: int = 2000, lines: int | None = None) -> Column:
    """Title, URL and the start of the cleaned content, as lines."""
    return F.concat_ws("\n", F.when(F.length(title) > 0, F.concat(F.lit("Title: "), title)), F.concat(F.lit("URL: "), url), F.lit(""), once(cleaned(content, lines), lambda x: cut_at_word(x, most)))


def url_words(url: Column, title: Column, description: Column) -> Column:
    """What a URL says, as labelled lines: its last three path parts with blanks for separators, title and description; null without title and description."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    path = F.translate(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), " "), "-_", "  ")
    line = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{name}: "), c))
    return F.when((F.length(title) > 0) | (F.length(description) > 0), F.concat_ws("\n", line("Path", path), line("Title", title), line("Description", description)))


def decision(answer: Column) -> Column:
    """skip or extract, as a model's answer says: after its thoughts and without a code fence, the JSON object's decision, else a quoted "skip"; extract if unclear."""
    said = strip(F.regexp_replace(answer, r"(?s)^.*</think>", ""))
    said = F.regexp_replace(F.regexp_replace(said, r"^```[^\n]*\n?", ""), r"(?s)\s*```.*$", "")
    known = F.try_parse_json(said).isNotNull()
    skips = F.when(known, F.lower(F.get_json_object(said, "$.decision")) == "skip").otherwise(F.lower(said).rlike("[\"']skip[\"']"))
    return F.when(F.coalesce(skips, F.lit(False)), "skip").otherwise("extract")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_prefix(url: Column, depth: int = 1) -> Column:
    """The first ``depth`` parts of the path with slashes; / for the root."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, depth)
    return F.when(F.size(parts) == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


# How a quote that only says that nothing was found begins, and a word that follows within 50 characters.
NEGATION = r"(?i)^(?:no|not|n/?a|none)\b.{0,50}(?:mention|explicit|specified|found|available|provided|information|data|details|certif)"


def is_negation(quote: Column) -> Column:
    """Whether a quote only says that there is nothing."""
    return F.coalesce(strip(quote).rlike(NEGATION), F.lit(False))


def joined_quote(quote: Column) -> Column:
    """A quote given as JSON text: the items of an array other than null joined by spaces, else the text; null if empty."""
    listed = F.when(F.startswith(F.trim(quote), F.lit("[")), F.from_json(quote, "array<string>"))
    return F.nullif(F.coalesce(F.array_join(listed, " "), quote), F.lit(""))


def singular(word: Column) -> Column:
    """An English plural's singular by its ending; words in -ss, -us, -is and of fewer than three letters stay."""
    low = F.lower(word)
    less = lambda n: F.left(word, F.length(word) - n)
    return (
        F.when((F.length(word) < 3) | low.rlike("(?:ss|us|is)$"), word)
        .when(low.endswith("ies"), F.concat(less(3), F.lit("y")))
        .when(low.rlike("[sxz]es$"), less(2))
        .when(low.endswith("s"), less(1))
        .otherwise(word)
    )


def sample(s: Column, most: int = 2000) -> Column:
    """A long text's start, middle and end in shares of 40, 30 and 30 percent."""
    a, b = most * 2 // 5, most * 3 // 10
    middle = F.floor(F.length(s) / 2 - b / 2).cast("int")
    return F.when(F.length(s) <= most, s).otherwise(F.concat_ws("\n[...]\n", F.substring(s, 1, a), F.substring(s, middle + 1, F.lit(b)), F.substring(s, F.length(s) - b + 1, F.lit(b))))


def humanized(name: Column) -> Column:
    """snake_case as a title."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
