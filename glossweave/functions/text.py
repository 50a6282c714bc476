"""Text rules as Column functions. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"
#: The three escapes, `&` first on the way in and last on the way out.
_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
#: Story sources by the spellings that mean them.
OFFICIAL, LEGACY = "official_cn", "official_cn_legacy"
STORY_SOURCES = {"official_cn": OFFICIAL, "cn": OFFICIAL, "official_cn_legacy": OFFICIAL, "llm": "llm", "human": "human", "pinned": "pinned"}
#: Parts of messages of failures that may pass.
TRANSIENT = ["http 500", "http 502", "http 503", "http 504", *(f"http {n}" for n in range(520, 528)), "connection reset", "timeout", "EOF", "connection refused"]


def blank(c: Column) -> Column:
    """Absence is the empty string."""
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(blank(c), _EDGE, "")


def safe_text(c: Column) -> Column:
    """Trimmed; a lone dash means nothing."""
    t = trim(c)
    return F.when(t == "-", "").otherwise(t)


def blank_if_equal(source: Column, target: Column) -> Column:
    """The trimmed target text, or '' where it only repeats the source."""
    s, t = trim(source), trim(target)
    return F.when(s == t, "").otherwise(t)


def or_default(c: Column, default: Column | str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def strict_int(c: Column) -> Column:
    """A base-10 whole number without blanks or anything else, or 0."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), F.coalesce(c.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def prefix_int(c: Column) -> Column:
    """The whole number that the text starts with, or 0."""
    return strict_int(F.regexp_extract(blank(c), r"^\s*([+-]?\d+)", 1))


def story_source(c: Column) -> Column:
    """One spelling for each story source; what isn't known is pending."""
    t = F.lower(trim(c))
    return reduce(lambda rest, kv: F.when(t == kv[0], kv[1]).otherwise(rest), STORY_SOURCES.items(), F.lit("jp_pending"))


def provider(c: Column, fallback: str) -> Column:
    return or_default(F.lower(trim(c)), fallback)


def xml_escape(c: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ESCAPES, c)


def xml_unescape(c: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(_ESCAPES), c)


def xml_items(texts: Column) -> Column:
    """A numbered item a line, ids from 1, of an array of texts."""
    item = lambda x, i: F.concat(F.lit('<item id="'), (i + 1).cast("string"), F.lit('">'), xml_escape(x), F.lit("</item>\n"))
    return F.array_join(F.transform(texts, item), "")


def parse_xml_items(reply: Column, expected: Column) -> Column:
    """Texts by id 1..expected of a reply. Think blocks are dropped, a later item of an id wins, gaps are ''."""
    body = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    pattern = F.lit(r"""(?s)<t\s+id="(\d+)">(.*?)</t>""")
    ids = F.transform(F.regexp_extract_all(body, pattern, F.lit(1)), strict_int)
    pairs = F.arrays_zip(ids.alias("i"), F.regexp_extract_all(body, pattern, F.lit(2)).alias("t"))
    found = F.transform(F.sequence(F.lit(1).cast("bigint"), expected.cast("bigint")), lambda n: xml_unescape(trim(F.try_element_at(F.transform(F.filter(pairs, lambda p: p["i"] == n), lambda p: p["t"]), F.lit(-1)))))
    return F.when(expected > 0, found).otherwise(F.array().cast("array<string>"))


def truncate(c: Column, limit: int) -> Column:
    """At most `limit` characters, then an ellipsis if any were cut."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def etag(body: Column) -> Column:
    """The first 16 bytes of the SHA-256 as quoted hex."""
    return F.concat(F.lit('"'), F.substr(F.sha2(body, 256), F.lit(1), F.lit(32)), F.lit('"'))


def etag_matches(if_none_match: Column, tag: Column) -> Column:
    return F.array_contains(F.transform(F.split(if_none_match, ","), trim), tag)


def split_list(c: Column) -> Column:
    """Parts between commas, semicolons and line ends, without blank ones."""
    return F.filter(F.transform(F.split(blank(c), r"[,;\r\n]"), trim), lambda x: x != "")


def id_of_file(name: Column) -> Column:
    """N of event_N.json, else -1."""
    n = F.regexp_extract(name, r"(?:^|/)event_([0-9]+)\.json$", 1)
    return F.when(n != "", n.try_cast("bigint")).otherwise(F.lit(-1)).cast("bigint")


def is_transient(message: Column) -> Column:
    said = blank(message)
    return reduce(lambda a, b: a | b, [said.contains(p) for p in TRANSIENT])


def mask(key: Column, value: Column, secrets: list[str]) -> Column:
    return F.when(key.isin(secrets) & (value != ""), F.lit("********")).otherwise(value)


def as_bool(c: Column, fallback: bool) -> Column:
    t = F.lower(trim(c))
    return F.when(t.isin("1", "true", "yes", "on"), F.lit(True)).when(t.isin("0", "false", "no", "off"), F.lit(False)).otherwise(F.lit(fallback))


def as_int(c: Column, fallback: int) -> Column:
    t = trim(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), F.coalesce(t.try_cast("bigint"), F.lit(fallback))).otherwise(F.lit(fallback)).cast("bigint")


def ids_to_json(ids: Column) -> Column:
    return F.when(F.size(ids) > 0, F.to_json(ids)).otherwise(F.lit(""))


def ids_from_json(text: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.from_json(F.nullif(blank(text), F.lit("")), "array<string>"), empty)


def natural_key(c: Column) -> Column:
    """A key that orders runs of digits by value, and all else as the Unicode collation does: accents beside their letters, kana before kanji.

    Each run of digits is preceded by how long it is; equal texts but for leading zeros or blanks around them have equal keys.
    """
    plain = F.regexp_replace(blank(c), r"(?<![0-9])0+(?=[0-9])", "")
    runs = F.regexp_extract_all(plain, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(x).cast("string"), 6, "0"), x)).otherwise(x))
    return F.collate(F.array_join(padded, ""), "UNICODE")


def matches(query: str, *columns: Column) -> Column:
    """Case-insensitive search in texts joined by line ends."""
    return F.contains(F.lower(F.concat_ws("\n", *columns)), F.lit(query.lower()))


#: Fixed value: what marks a title among a story's rows.
TITLE_MARK = "__title__"


def row_key(episode: Column, kind: Column, text: Column) -> Column:
    """One key for a story row: episode and text of a line, with a mark between them for a title."""
    return F.when(kind == "title", F.concat_ws("|", episode, F.lit(TITLE_MARK), text)).otherwise(F.concat_ws("|", episode, text))


def parse_row_key(key: Column) -> Column:
    """Struct (episode_no, kind, text) of a row key; the text may hold the separator itself."""
    parts = F.split(key, r"\|", 2)
    rest = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    title = (rest == TITLE_MARK) | rest.startswith(TITLE_MARK + "|")
    return F.struct(F.get(parts, F.lit(0)).alias("episode_no"), F.when(title, "title").otherwise("talk").alias("kind"), F.when(title, F.substr(rest, F.lit(len(TITLE_MARK) + 2))).otherwise(rest).alias("text"))


#: Categories that have pages, with the part of the address that names them.
PAGES = {"cards": "cards", "events": "events", "gacha": "gacha", "virtualLive": "live", "music": "music", "mysekai": "mysekai", "costumes": "costumes", "characters": "character"}
STORY_PAGES = "eventstory"


def link(category: Column, field: Column, ids: Column, base: str) -> Column:
    """Address of the page of an entry's first id, or of a story, whose number is its field; null for categories without pages, and without ids."""
    top = base.rstrip("/")
    at = lambda kind, id_: F.concat(F.lit(f"{top}/{kind}/"), id_, F.lit("/"))
    first = F.when(F.size(ids) > 0, F.get(ids, F.lit(0)))
    story = F.when(category == "eventStory", at(STORY_PAGES, field))
    return reduce(lambda rest, kv: rest.when(category == kv[0], at(kv[1], first)), PAGES.items(), story)
