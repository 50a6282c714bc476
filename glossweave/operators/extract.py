"""Text pairs and reference ids from two editions of master documents.

Each category is a declarative spec: which document, by which key the editions meet, and which fields to take. One plan serves all.
Documents are tables (ord bigint, doc variant), ord being the place in the source array.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first_seen, last_value
from ..functions.documents import get_int, get_string, members, objects
from ..functions.text import blank_if_equal, safe_text, trim

PLAIN, SAFE, NO_DASH = "plain", "safe", "no_dash"


@dataclass(frozen=True)
class Source:
    """One document of a category. fields: (field, member, rule); rule is how a text is read."""

    file: str
    fields: tuple[tuple[str, str, str], ...]
    key: str = "id"
    text_key: bool = False
    two_sided: bool = True
    needs: str = ""  # a member that may not be blank
    spare_key: str = ""  # the id where the key is 0
    raw_pairs: bool = False  # pair keys stay untrimmed


@dataclass(frozen=True)
class Spec:
    sources: tuple[Source, ...]
    parts: bool = False
    fields: tuple[str, ...] = field(default=())


def _one(file: str, *fields: str, rule: str = PLAIN, **more) -> Spec:
    return Spec((Source(file, tuple((f, f, rule) for f in fields), **more),))


#: Documents, keys and fields of each category.
SPECS: dict[str, Spec] = {
    "cards": Spec((Source("cards", (("prefix", "prefix", PLAIN), ("skillName", "cardSkillName", PLAIN), ("gachaPhrase", "gachaPhrase", NO_DASH))),)),
    "skills": _one("skills", "description"),
    "information": _one("informations", "title", rule=SAFE, two_sided=False),
    "events": _one("events", "name"),
    "gacha": _one("gachas", "name"),
    "virtualLive": _one("virtualLives", "name"),
    "sticker": _one("stamps", "name"),
    "comic": _one("tips", "title", needs="assetbundleName"),
    "music": Spec((
        Source("musics", (("title", "title", PLAIN), ("artist", "lyricist", NO_DASH), ("artist", "composer", NO_DASH), ("artist", "arranger", NO_DASH)), two_sided=False, raw_pairs=True),
        Source("musicVocals", (("vocalCaption", "caption", PLAIN),), two_sided=False, spare_key="musicId", raw_pairs=True),
    )),
    "mysekai": Spec((
        Source("mysekaiFixtures", (("fixtureName", "name", PLAIN), ("flavorText", "flavorText", PLAIN))),
        Source("mysekaiFixtureMainGenres", (("genre", "name", PLAIN),)),
        Source("mysekaiFixtureTags", (("tag", "name", PLAIN),)),
    )),
    "costumes": Spec((Source("costumes", (("name", "name", SAFE), ("designer", "designer", SAFE))),), parts=True),
    "characters": _one("characterProfiles", "hobby", "specialSkill", "favoriteFood", "hatedFood", "weak", "introduction", rule=SAFE, key="characterId"),
    "units": _one("unitProfiles", "unitName", "profileSentence", key="unit", text_key=True),
}


def _text(doc: Column, member: str, rule: str) -> Column:
    text = get_string(doc, member)
    return safe_text(text) if rule == SAFE else F.when(text == "-", "").otherwise(text) if rule == NO_DASH else text


def _key(doc: Column, s: Source) -> Column:
    if s.text_key:
        return get_string(doc, s.key)
    return F.coalesce(F.nullif(get_int(doc, s.key), F.lit(0)), get_int(doc, s.spare_key)) if s.spare_key else get_int(doc, s.key)


def lookup(target: DataFrame, s: Source) -> DataFrame:
    """The target edition by key: of equal keys the last; a number 0 is no key."""
    rows = target.select("ord", _key(F.col("doc"), s).alias("key"), "doc")
    rows = rows if s.text_key else rows.where("key <> 0")
    return rows.groupBy("key").agg(F.max_by(F.struct("doc"), "ord").alias("t")).select("key", F.col("t.doc").alias("other"))


def _pairs(source: DataFrame, target: DataFrame | None, s: Source, step: int) -> DataFrame:
    """(field, jp, cn, ref, ord) of one document, still with repeats."""
    rows = source.select("ord", "doc", _key(F.col("doc"), s).alias("key"))
    if s.needs:
        rows = rows.where(get_string(F.col("doc"), s.needs) != "")
    if s.two_sided and target is not None:
        rows = rows.join(lookup(target, s), "key", "left")
    other = (lambda member, rule: _text(F.col("other"), member, rule)) if s.two_sided and target is not None else (lambda *_: F.lit(""))
    cells = [F.struct(F.lit(name).alias("field"), _text(F.col("doc"), member, rule).alias("jp"), F.coalesce(other(member, SAFE if rule == SAFE else PLAIN), F.lit("")).alias("cn"), F.lit(i).alias("sub")) for i, (name, member, rule) in enumerate(s.fields)]
    out = rows.select("ord", F.col("key").cast("string").alias("ref"), F.explode(F.array(*cells)).alias("c"))
    return out.select("c.field", "c.jp", "c.cn", "ref", (F.col("ord") * 64 + F.col("c.sub") + step * (1 << 40)).alias("ord"), F.lit(s.raw_pairs).alias("raw"))


def _parts(source: DataFrame, target: DataFrame, s: Source, step: int) -> DataFrame:
    """Color names of nested parts, which meet by costume, part type and asset; part types in order of their names."""

    def parts(rows: DataFrame, side: str) -> DataFrame:
        kinds = rows.select("key", "ord", F.explode(members(F.col("doc"), "$.parts")).alias("kind", "list"))
        p = kinds.select("key", "ord", "kind", F.posexplode("list").alias("at", "p"))
        return p.select("key", "ord", "kind", "at", get_string(F.col("p"), "assetbundleName").alias("asset"), safe_text(get_string(F.col("p"), "colorName")).alias(side))

    ours = parts(source.select("ord", "doc", _key(F.col("doc"), s).alias("key")), "jp").where("jp <> ''")
    theirs = parts(lookup(target, s).select("key", F.lit(0).cast("bigint").alias("ord"), F.col("other").alias("doc")), "cn")
    theirs = theirs.groupBy("key", "kind", "asset").agg(F.max_by("cn", "at").alias("cn"))
    place = F.struct("ord", "kind", "at")
    rows = ours.join(theirs, ["key", "kind", "asset"], "left")
    return rows.select(F.lit("colorName").alias("field"), "jp", F.coalesce("cn", F.lit("")).alias("cn"), F.col("key").cast("string").alias("ref"), place.alias("place"), F.lit(False).alias("raw"))


def _reduce(rows: DataFrame, category: str, order: str) -> tuple[DataFrame, DataFrame]:
    rows = rows.withColumn("key", F.when(F.col("raw"), F.col("jp")).otherwise(trim(F.col("jp"))))
    cn = F.when(F.col("raw"), F.lit("")).otherwise(blank_if_equal(F.col("jp"), F.col("cn")))
    pairs = last_value(rows.where("key <> ''").withColumn("cn_text", cn), ["field", "key"], "cn_text", order)
    traced = rows.select("field", trim(F.col("jp")).alias("key"), trim(F.col("ref")).alias("ref"), order).where("key <> '' and ref <> '' and ref <> '0'")
    traces = first_seen(traced, ["field", "key"], "ref", order, "ids")
    name = F.lit(category).alias("category")
    return pairs.select(name, "field", F.col("key").alias("jp_key"), "cn_text"), traces.select(name, "field", F.col("key").alias("jp_key"), "ids")


def extract(category: str, source: dict[str, DataFrame], target: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(pairs, traces) of a category from its documents by file name in both editions.

    Of equal keys the last text holds, also a blank one; ids are in order of first sight. LookupError if a document is missing, on
    the target side only where the two editions meet: half of the documents would make known texts look unknown.
    """
    spec = SPECS[category]
    missing = [f"source {s.file}" for s in spec.sources if s.file not in source] + [f"target {s.file}" for s in spec.sources if s.two_sided and s.file not in target]
    if missing:
        raise LookupError(f"no document for {category}: {', '.join(missing)}")
    found = [_pairs(source[s.file], target.get(s.file), s, i) for i, s in enumerate(spec.sources)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    pairs, traces = _reduce(rows, category, "ord")
    main = spec.sources[0]
    if spec.parts:
        p, t = _reduce(_parts(source[main.file], target[main.file], main, 0), category, "place")
        pairs, traces = pairs.union(p), traces.union(t)
    return pairs, traces


def array_documents(text: DataFrame, path: str = "$") -> DataFrame:
    """(ord, doc) of a table with one JSON document in `value`: the objects of its array at path."""
    items = objects(F.try_parse_json("value"), path)
    return text.select(F.posexplode(items).alias("ord", "doc")).select(F.col("ord").cast("bigint").alias("ord"), "doc")
