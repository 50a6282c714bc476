"""Near-duplicate documents by an inverted join over MinHash coordinates.

A document posts under each (coordinate, value) pair of its signature. Two documents of the wanted similarity agree in most
coordinates, so they meet in some of the rarest pairs of either (prefix); documents with too few shared pairs post nothing,
and pairs beyond the prefix are compared in the signatures, not merged (skip). What agrees often enough is confirmed on the
full shingle sets.

Equal sets form one class, whose smallest document stands for it. Within a posting every document first meets only the
smallest one; what that joins needs no more comparing. The documents of a posting that are still apart are sent to the family
of its leading component. Families are compared in tiles of bounded size, inside a task, so no posting makes rows of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, components, cut, distinct_sets, join_counted, mix, shingle_hashes, small_batches, utf8

#: Words of a shingle; a link is 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 3, 85
#: Coordinates of a signature, and agreeing ones that a pair needs. Of sets with a similarity of 0.85, one pair in about two
#: million agrees in fewer than 27 of 48 coordinates.
COORDINATES, AGREE = 48, 27
#: For any other percentage: standard deviations below the mean at which a pair may still be found.
DEVIATIONS = 5.6
#: Documents and shingles of a tile. A larger family is cut into tiles, each of which meets each other one in a task of its own.
TILE, TILE_SHINGLES = 1024, 1_500_000



def needed(percent: int) -> int:
    if percent == PERCENT:
        return AGREE
    s = percent / 100
    return max(1, int(COORDINATES * s - DEVIATIONS * (COORDINATES * s * (1 - s)) ** 0.5))


def _coordinates(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash signature of each set; zeros for an empty one."""
    sizes = np.array([len(s) for s in sets], int)
    full = np.flatnonzero(sizes)
    sig = np.zeros((len(sets), COORDINATES), np.int32)
    if len(full):
        u = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for k, f in enumerate(mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)):
            v = u * f
            v ^= v >> np.uint64(32)
            sig[full, k] = (np.minimum.reduceat((v * f) >> np.uint64(32), starts)).astype(np.uint32).view(np.int32)
    return sig


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, d1, d2, sig): the set's size, 128 bits that stand for the whole set, and its MinHash signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = utf8(b.text)
            for lo, hi in chunks(raw):
                sets = distinct_sets(*shingle_hashes(raw[lo:hi], shingle))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                d1, d2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                if len(full):
                    u = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    d1[full] = np.add.reduceat(mix(u + np.uint64(7)), starts).view(np.int64)
                    d2[full] = np.add.reduceat(mix(u ^ np.uint64(0x5BF03635DCF7A1F9)), starts).view(np.int64)
                yield pd.DataFrame({"doc_id": b.doc_id.iloc[lo:hi], "n": sizes, "d1": d1, "d2": d2, "sig": list(_coordinates(sets))})

    return small_batches(docs).select("doc_id", "text").mapInPandas(run, "doc_id long, n long, d1 long, d2 long, sig array<int>")


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                raw = utf8(part.left), utf8(part.right)
                good = np.zeros(len(part), bool)
                for lo, hi in chunks([x + y for x, y in zip(*raw, strict=True)]):
                    both = zip(*(distinct_sets(*shingle_hashes(side[lo:hi], shingle)) for side in raw), strict=True)
                    for i, (x, y) in enumerate(both, lo):
                        common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                        good[i] = 100 * common >= percent * (len(x) + len(y) - common)
                yield part.loc[good, ["a", "b"]]

    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(t)) for k, t in (("a", "left"), ("b", "right")))
    return pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right").mapInPandas(run, "a long, b long")


def _agreeing(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """(a, b, agree) of distinct pairs whose signatures agree in at least `least` coordinates."""
    left, right = (reps.select(F.col("doc_id").alias(k), F.col("sig").alias(s)) for k, s in (("a", "x"), ("b", "y")))
    agree = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda e: e))
    return pairs.select("a", "b").distinct().join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", agree.alias("agree")).where(F.col("agree") >= least)


def _marked(posts: DataFrame, label: DataFrame) -> DataFrame:
    """posts with the `component` of each document, its own id where it has none; both meet in a document's window."""
    others = [F.lit(None).cast(posts.schema[c].dataType).alias(c) for c in posts.columns if c != "doc_id"]
    both = posts.withColumn("component", F.lit(None).cast("long")).unionByName(label.select(F.col("id").alias("doc_id"), *others, "component"))
    found = F.max("component").over(Window.partitionBy("doc_id"))
    return both.withColumn("component", F.coalesce(found, "doc_id")).where("token is not null")


def _linked(reps: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between class representatives: enough of them to give every component."""
    least = needed(percent)
    token = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col").cast("long")
    posts = reps.select("doc_id", F.col("n").alias("size"), F.posexplode("sig")).select("doc_id", "size", token.alias("token"))
    often = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = posts.join(often.hint("merge"), "token")
    of_doc = Window.partitionBy("doc_id")
    # Of a document's pairs in the order of rarity the first COORDINATES - least + 1 are posted; those of one document only come
    # first and meet nobody.
    shared = shared.withColumn("n", F.count("*").over(of_doc)).withColumn("r", F.row_number().over(of_doc.orderBy("df", "token"))).where(F.col("r") <= F.col("n") - least + 1)
    posts = cut(shared.select("token", "doc_id", F.col("size").alias("high")))
    texts = cut(docs.select("doc_id", "text").join(posts.select("doc_id").distinct().hint("merge"), "doc_id"))

    # Everyone meets the smallest document of each posting, and is joined by the likeliest of these.
    hubs = posts.groupBy("token").agg(F.min("doc_id").alias("a"))
    pairs = posts.join(hubs.hint("merge"), "token").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    best = _agreeing(pairs, reps, least).groupBy("b").agg(F.max_by("a", F.struct("agree", F.negative("a"))).alias("a"))
    links = cut(_confirm(best, texts, shingle, percent))
    marked = cut(_marked(posts, components(links)))
    groups = marked.groupBy("token", "component").agg(F.count("*").alias("k"))
    main = groups.groupBy("token").agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("c")).where("c > 1")
    main = main.select("token", F.col("most.component").alias("family"))
    members = marked.join(main.hint("merge"), "token").groupBy("doc_id", "family").agg(F.max("component").alias("component"), F.max("high").alias("high"))
    return cut(links.union(_within_families(cut(members), texts, shingle, percent)))


def _placed(members: DataFrame) -> DataFrame:
    """(doc_id, family, component, key, part): the groups in which a document meets others of its family.

    Members outside the leading component meet each other and the leading ones; these don't meet among themselves. part is -1 in
    a group whose rows all meet, else rows of part 0 meet those of part 1. Families of one tile share groups.
    """
    leads = F.col("component") == F.col("family")
    tiles = lambda own: F.ceil(F.greatest(F.count_if(own) / TILE, F.sum(F.when(own, F.col("high")).otherwise(0)) / TILE_SHINGLES)).cast("int")
    sizes = cut(members.groupBy("family").agg(F.count("*").alias("k"), F.sum("high").alias("s"), tiles(leads).alias("tm"), tiles(~leads).alias("tf")))
    k, s = sizes.agg(F.sum("k"), F.sum("s")).first()
    shared = 1 + int(max((k or 0) / TILE, (s or 0) / TILE_SHINGLES))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = lambda key, part: F.struct(key.alias("key"), part.cast("int").alias("part"))
    among = F.transform(upto("tf"), lambda j: group(F.xxhash64("family", F.lit(0), F.least(own("tf"), j), F.greatest(own("tf"), j)), F.when(j == own("tf"), -1).when(j > own("tf"), 0).otherwise(1)))
    to_lead = F.transform(upto("tm"), lambda m: group(F.xxhash64("family", F.lit(1), own("tf"), m), F.lit(0)))
    from_lead = F.transform(upto("tf"), lambda i: group(F.xxhash64("family", F.lit(1), i, own("tm")), F.lit(1)))
    alone = F.array(group(F.pmod(F.xxhash64("family"), F.lit(shared)), F.lit(-1)))
    small = (F.col("k") <= TILE) & (F.col("s") <= TILE_SHINGLES)
    at = F.explode(F.when(small, alone).when(leads, from_lead).otherwise(F.concat(among, to_lead))).alias("at")
    return join_counted(members, sizes, ["family"], "k").select("doc_id", "family", "component", at).select("doc_id", "family", "component", "at.key", "at.part")


def _within_families(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that join different components. members: (doc_id, family, component, high), high being the largest set's size."""
    least = needed(percent)

    def family_links(ids: np.ndarray, comp: np.ndarray, part: np.ndarray, n_few: int, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        sig, sizes = _coordinates(sets), np.array([len(x) for x in sets])
        local = starts = mark = None
        for a in range(min(n_few, len(ids) - 1)):
            rest = slice(a + 1, None)
            may = (comp[rest] != comp[a]) & ((part[rest] != part[a]) | (part[a] < 0)) & (100 * sizes[rest] >= percent * sizes[a]) & (100 * sizes[a] >= percent * sizes[rest])
            at = a + 1 + np.flatnonzero(may)
            at = at[(sig[at] == sig[a]).sum(1) >= least]
            at = at[sizes[at] > 0]
            if not len(at) or not sizes[a]:
                continue
            if local is None:
                local = np.unique(np.concatenate(sets), return_inverse=True)[1]
                starts = np.concatenate(([0], np.cumsum(sizes)))
                mark = np.zeros(int(local.max()) + 1, np.int64)
            mark[local[starts[a] : starts[a + 1]]] = 1
            if len(at) * 4 > len(ids) - a:  # most of what follows: count all of it at once
                total = np.concatenate(([0], np.cumsum(mark[local[starts[a + 1] :]])))
                common = total[starts[at + 1] - starts[a + 1]] - total[starts[at] - starts[a + 1]]
            else:
                common = np.array([mark[local[starts[b] : starts[b + 1]]].sum() for b in at])
            mark[local[starts[a] : starts[a + 1]]] = 0
            for b in at[100 * common >= percent * (sizes[at] + sizes[a] - common)]:
                if comp[a] != comp[b]:  # what is joined here needs no more comparing here
                    yield ids[a], ids[b]
                    comp[comp == comp[b]] = comp[a]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(leads=rows.component == rows.family).sort_values(["family", "part", "leads"], kind="stable", ignore_index=True)
        raw, sets = utf8(rows.text), []
        for lo, hi in chunks(raw):
            sets += distinct_sets(*shingle_hashes(raw[lo:hi], shingle))
        ids, comp, part, leads = (rows[c].to_numpy() for c in ("doc_id", "component", "part", "leads"))
        edges = np.flatnonzero(np.diff(rows.family.to_numpy())) + 1
        found = []
        for lo, hi in zip([0, *edges], [*edges, len(rows)], strict=True):
            found += family_links(ids[lo:hi], comp[lo:hi].copy(), part[lo:hi], int((~leads[lo:hi]).sum()), sets[lo:hi])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return _placed(members).join(texts.hint("merge"), "doc_id").groupBy("key").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    A null, empty or blank text has no shingles and stands alone. Rows of one doc_id are one document with one component, found
    from each of its texts. A row without doc_id stands alone: no component, kept.
    """
    sigs = cut(_signatures(docs, shingle))
    whole = sigs.where("n > 0 and doc_id is not null")
    classes = cut(whole.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    owned = whole.join(classes.hint("merge"), ["n", "d1", "d2"])
    reps = cut(owned.where("doc_id = rep").dropDuplicates(["n", "d1", "d2", "doc_id"]).select("doc_id", "n", "sig"))
    repeated = whole.groupBy("doc_id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1)).first()[0]
    links = _linked(reps, docs, shingle, percent)
    if repeated:  # a doc_id of several rows may be in several classes; its smallest representative links them
        several = owned.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
        several = owned.join(several.select("doc_id", "a").hint("merge"), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
        links = cut(links.union(several))
    label = components(links)
    rows = sigs.select("doc_id", "n", "d1", "d2").join(classes.hint("merge"), ["n", "d1", "d2"], "left")
    rows = rows.join(label.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stand for their component, all columns as they are; repeated rows of a kept doc_id all stay."""
    gone = near_duplicates(docs, shingle, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("doc"))
    return rows.join(gone, F.col("doc.doc_id") == F.col("gone"), "left_anti").select("doc.*")
