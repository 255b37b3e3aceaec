"""Which tags of items moved between two dumps.

A dump is (key, name, tag, o, u): of each tag of an item the digest of its value
as it stands, and with lists in order.  Items of one base key and name are
paired across dumps by how many tags agree.  Equal items are paired first, by
their place among equals.  Of the rest the best pair is taken again and again (by
agreement, then by fewer tags that only one has, then by the keys).

Pairs are taken rank by rank: once none of a higher rank is left, items agree in
k tags where they have k digests in common, so each old item, in order, takes the
first new one that is listed under any k of its own digests, and no pair is made
to be compared.  What equal items leave over of one group meets in one task for
that, as numbers.  In groups with items of more than ``WIDE`` tags, which have too
many such choices, pairs that share a tag are joined, and in rounds each pair that
is the best of both its items is taken: as no two pairs rank alike, that gives the
same; there, pairs grow with the square of the group.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .graph import places
from .store import clustered, forget, settled

#: Fixed value of the original: pairs of a group, after equal items, beyond which
#: it is only counted there.  A bound of its kind is only kept where it is given.
MAX_GROUP_PAIRS = 10_000
#: Tags of an item up to which its digests are looked up by all choices of some.
WIDE = 8
CEILING = 100_000


def suspects(dump: DataFrame) -> DataFrame:
    """(tag, flagged, cleared, mods): items whose digests differ when lists are
    put in order, those whose do not, and the mods of the first."""
    differ = ~F.col("o").eqNullSafe(F.col("u"))
    return dump.groupBy("tag").agg(F.count_if(differ).alias("flagged"), F.count_if(~differ).alias("cleared"), F.count_distinct(F.when(differ, K.mod_of("key"))).alias("mods"))


def _by_key(dump: DataFrame) -> DataFrame:
    """In buckets by key.  An item's rows are put together before they travel,
    so that its key and name do so once."""
    of = [c for c in dump.columns if c not in ("key", "name")]
    items = dump.groupBy("key").agg(F.collect_list(F.struct("name", *of)).alias("rows"))  # of one key
    return clustered(dump.sparkSession, items.select("key", F.inline("rows")), "key", False)


def _entries(dump: DataFrame) -> DataFrame:
    """(grp, key, n, sig): a row per item; sig: a digest of all its tags and
    digests, in bytes."""
    tags = F.array_sort(F.collect_list(F.concat_ws("\x1e", "tag", F.coalesce("o", F.lit("\x1d")))))  # of one item
    rows = dump.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"), F.unhex(F.substring(F.sha2(F.array_join(tags, "\x1f"), 256), 1, 32)).alias("sig"))
    return rows.select(F.concat_ws("\x1f", K.base_key("key"), F.coalesce("name", F.lit(""))).alias("grp"), "key", "n", "sig")


def _seen(old: DataFrame, new: DataFrame) -> DataFrame:
    """(grp, sig, key, n, old, new): items, and how often each dump has them."""
    at = lambda dump, side: _entries(dump).select("*", *[F.lit(int(s == side)).alias(s) for s in ("old", "new")])
    both = at(old, "old").unionByName(at(new, "new"))
    return both.groupBy("grp", "sig", "key").agg(F.max("n").alias("n"), F.sum("old").alias("old"), F.sum("new").alias("new"))


def _sieved(seen: DataFrame) -> DataFrame:
    """(grp, old, new): equal items, the same key first, then the first with the
    first of each signature."""
    pairs = seen.where("old > 0 AND new > 0").select("grp", F.col("key").alias("old"), F.col("key").alias("new"))
    alone = seen.where("old = 0 OR new = 0")
    # only what the other dump has as well is numbered
    shared = settled(seen.sparkSession, alone.groupBy("grp", "sig").agg(F.max("old").alias("o"), F.max("new").alias("n")).where("o > 0 AND n > 0").select("grp", "sig"))
    rest = []
    for name in ("old", "new"):
        left = settled(seen.sparkSession, alone.where(F.col(name) > 0).join(shared, ["grp", "sig"], "left_semi").select("grp", "sig", F.col("key").alias(name)))
        placed = places(left, ["grp", "sig", name])
        first = placed.groupBy("grp", "sig").agg(F.min("place").alias("first"))
        rest.append(placed.join(first, ["grp", "sig"]).select("grp", "sig", name, (F.col("place") - F.col("first")).alias("nth")))
    return pairs.unionByName(rest[0].join(rest[1], ["grp", "sig", "nth"]).select("grp", "old", "new"))


def _matched(candidates: DataFrame) -> DataFrame:
    """Of candidates (grp, old, new, agree, apart) the pairs that taking the best
    again and again gives."""
    spark, found = candidates.sparkSession, None
    left = settled(spark, candidates)
    rank = lambda own, other: F.min(F.struct(-F.col("agree"), F.col("apart"), F.col("old"), F.col("new")))
    for _ in range(CEILING):
        by_old = left.groupBy("grp", "old").agg(rank("old", "new").alias("b")).select("grp", "b.old", "b.new")
        by_new = left.groupBy("grp", "new").agg(rank("new", "old").alias("b")).select("grp", "b.old", "b.new")
        taken = settled(spark, by_old.join(by_new, ["grp", "old", "new"]))
        if not taken.limit(1).count():
            return found if found is not None else taken
        found = taken if found is None else found.unionByName(taken)
        after = settled(spark, left.join(taken.select("grp", "old"), ["grp", "old"], "left_anti").join(taken.select("grp", "new"), ["grp", "new"], "left_anti"))
        forget(spark, left)
        left = after
    raise RuntimeError("pairs did not come to an end")


def _joined(old: DataFrame, new: DataFrame, rest_a: DataFrame, rest_b: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, old, new): the pairs of groups whose pairs that share a tag are joined."""
    spark = old.sparkSession
    of = lambda rows, dump, name: rows.join(groups, "grp", "left_semi").join(dump.select("key", "tag", "o"), "key").select("grp", F.col("key").alias(name), F.col("n").alias(f"n_{name}"), "tag", F.col("o").alias(f"o_{name}"))
    mine, theirs = settled(spark, of(rest_a, old, "old")), settled(spark, of(rest_b, new, "new"))
    shared = mine.join(theirs, ["grp", "tag"]).groupBy("grp", "old", "new", "n_old", "n_new").agg(F.count_if(F.col("o_old").eqNullSafe(F.col("o_new"))).alias("agree"), F.count(F.lit(1)).alias("both"))
    candidates = settled(spark, shared.select("grp", "old", "new", "agree", (F.col("n_old") + F.col("n_new") - 2 * F.col("both")).alias("apart")))
    first = settled(spark, _matched(candidates.where("agree > 0")))
    # what agrees in nothing: the other pairs of the groups' items that are still alone
    left = lambda rows, name: rows.join(groups, "grp", "left_semi").select("grp", F.col("key").alias(name), F.col("n").alias(f"n_{name}")).join(first.select("grp", name), ["grp", name], "left_anti")
    lone = left(rest_a, "old").join(left(rest_b, "new"), "grp").join(candidates.where("agree = 0").select("grp", "old", "new", "apart"), ["grp", "old", "new"], "left")
    last = _matched(lone.select("grp", "old", "new", F.lit(0).cast("long").alias("agree"), F.coalesce("apart", F.col("n_old") + F.col("n_new")).alias("apart")))
    return first.unionByName(last).select("grp", "old", "new")


def _taken(group: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one group, rank by rank.  ``tags``: an item's tags with their
    digests, behind a separator."""
    code, shape, sides = {}, {}, []
    for old in (True, False):
        rows = group[group["is_old"] == old].sort_values("key")
        tags = [sorted(code.setdefault(t, len(code)) for t in of) for of in rows["tags"]]
        shapes = [shape.setdefault((n, frozenset(t.split("\x1e", 1)[0] for t in of)), len(shape)) for n, of in zip(rows["n"], rows["tags"])]
        sides.append((rows["key"].tolist(), tags, shapes))
    (keys, mine, like), (others, theirs, alike) = sides
    apart = {(s, t): n + m - 2 * len(a & b) for (n, a), s in shape.items() for (m, b), t in shape.items()}
    steps = sorted({apart[s, t] for s in set(like) for t in set(alike)})
    near = {(s, a): [t for t in set(alike) if apart[s, t] == a] for s in set(like) for a in steps}
    left, gone, out = range(len(keys)), bytearray(len(others)), []
    for k in range(min(max(map(len, mine)), max(map(len, theirs))), -1, -1):
        lists = {c: {} for i in left for c in combinations(mine[i], k)}
        for j in range(len(others) - 1, -1, -1):  # so that the first is at the end
            if not gone[j]:
                for c in combinations(theirs[j], k):
                    if c in lists:
                        lists[c].setdefault(alike[j], []).append(j)
        lists = {c: by for c, by in lists.items() if by}
        for a in steps:
            rest = []
            for i in left:
                best = None
                for c in combinations(mine[i], k):
                    by = lists.get(c)
                    for t in near[like[i], a] if by else ():
                        line = by.get(t)
                        while line and gone[line[-1]]:
                            line.pop()
                        if line and (best is None or line[-1] < best):
                            best = line[-1]
                if best is None:
                    rest.append(i)
                else:
                    gone[best] = 1
                    out.append((keys[i], others[best]))
            left = rest
        if not left or len(out) == len(others):
            break
    return pd.DataFrame(out, columns=["old", "new"]).assign(grp=group["grp"].iloc[0])[["grp", "old", "new"]]


def pairs(old: DataFrame, new: DataFrame, max_pairs: int | None = None, kept: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(grp, old, new, how) of the items of both dumps that are one, and (grp,
    n_old, n_new, left_old, left_new, skipped) of the groups that both have:
    how many items there are, how many no equal one was found for, and whether
    these make more than ``max_pairs`` pairs, if that is given, and were left alone.

    how: equal; forced, if there was one of each left, so that nothing else
    could be paired; searched otherwise.  Names may be null; an item has a tag
    once.  ``kept``: both dumps in buckets by key, where there are such.
    """
    spark = old.sparkSession
    old, new = kept if kept is not None else (_by_key(d.select("key", "name", "tag", "o")) for d in (old, new))
    seen = settled(spark, _seen(old, new))
    equal = settled(spark, _sieved(seen))
    # the same key on both sides is equal; of the others what was paired by signature is taken off
    other = equal.where("old <> new")
    rest_a, rest_b = (settled(spark, seen.where(f"{n} > 0 AND {m} = 0").select("grp", "key", "n").join(other.select("grp", F.col(n).alias("key")), ["grp", "key"], "left_anti")) for n, m in (("old", "new"), ("new", "old")))
    count = lambda rows, name: rows.groupBy("grp").agg(F.count(F.lit(1)).alias(f"left_{name}"), F.max("n").alias(f"most_{name}"))
    sizes = seen.groupBy("grp").agg(F.sum("old").alias("n_old"), F.sum("new").alias("n_new")).where("n_old > 0 AND n_new > 0")
    groups = sizes.join(count(rest_a, "old"), "grp", "left").join(count(rest_b, "new"), "grp", "left").na.fill(0)
    over = F.col("left_old") * F.col("left_new") > max_pairs if max_pairs is not None else F.lit(False)
    wide = F.greatest("most_old", "most_new") > WIDE
    groups = settled(spark, groups.select("grp", "n_old", "n_new", "left_old", "left_new", over.alias("skipped"), wide.alias("wide")))
    searched = groups.where("NOT skipped AND left_old > 0 AND left_new > 0").select("grp", (F.greatest("left_old", "left_new") == 1).alias("forced"), "wide")
    # one and one are a pair whatever they agree in
    of = lambda rows, name: rows.join(searched.where("forced"), "grp", "left_semi").select("grp", F.col("key").alias(name))
    alone = of(rest_a, "old").join(of(rest_b, "new"), "grp").select("grp", "old", "new")
    tag = F.concat("tag", F.lit("\x1e"), F.coalesce(F.concat(F.lit("="), "o"), F.lit("")))  # null is no text
    tags = lambda dump: dump.where("tag IS NOT NULL").groupBy("key").agg(F.collect_list(tag).alias("tags"))  # one item's
    items = lambda rows, dump, is_old: rows.join(searched.where("NOT forced AND NOT wide"), "grp", "left_semi").join(tags(dump), "key", "left").select("grp", F.lit(is_old).alias("is_old"), "key", "n", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    ranked = items(rest_a, old, True).unionByName(items(rest_b, new, False)).groupBy("grp").applyInPandas(_taken, "grp string, old string, new string")
    more = alone.withColumn("how", F.lit("forced")).unionByName(ranked.withColumn("how", F.lit("searched")))
    many = settled(spark, searched.where("NOT forced AND wide").select("grp"))
    if many.limit(1).count():
        more = more.unionByName(_joined(old, new, rest_a, rest_b, many).withColumn("how", F.lit("searched")))
    return settled(spark, equal.withColumn("how", F.lit("equal")).unionByName(more)), groups.drop("wide")


def churn(old: DataFrame, new: DataFrame, max_pairs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What moved: (tag, added, removed, changed, order_only, forced,
    forced_order_only, same) over paired items whose key changed, and one row
    (changed_items, forced_changed_items, unchanged_items, unexplained,
    unpaired, oversized, new_only_groups).

    A change is one of order alone if the digest with lists in order stayed.
    An item whose key changed and no tag is unexplained, and counts for no tag.
    """
    spark = old.sparkSession
    # items meet their tags where these are, by key
    old, new = (_by_key(d.select("key", "name", "tag", "o", "u")) for d in (old, new))
    found, groups = pairs(old, new, max_pairs, (old, new))
    moved = found.where("old <> new")
    side = lambda dump, name: dump.select(F.col("key").alias(name), "tag", F.col("o").alias(f"o_{name}"), F.col("u").alias(f"u_{name}"), F.lit(True).alias(f"in_{name}"))
    a = moved.join(side(old, "old"), "old").select("grp", "old", "new", "how", "tag", "o_old", "u_old", "in_old")
    b = moved.join(side(new, "new"), "new").select("grp", "old", "new", "how", "tag", "o_new", "u_new", "in_new")
    tags = a.join(b, ["grp", "old", "new", "how", "tag"], "full")
    what = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("o_old").eqNullSafe(F.col("o_new")), "same").otherwise("changed")
    tags = settled(spark, tags.select("grp", "old", "new", "tag", what.alias("what"), (F.col("how") == "forced").alias("sure"), F.col("u_old").eqNullSafe(F.col("u_new")).alias("u_same")))
    dull = tags.groupBy("grp", "old", "new").agg(F.expr("bool_and(what = 'same')").alias("dull")).where("dull").select("grp", "old", "new")
    told = tags.join(dull, ["grp", "old", "new"], "left_anti")
    n = lambda *c: F.count_if(F.expr(" AND ".join(c)))
    changed = "what = 'changed'"
    by_tag = told.groupBy("tag").agg(n("what = 'added'").alias("added"), n("what = 'removed'").alias("removed"), n(changed).alias("changed"), n(changed, "u_same").alias("order_only"), n(changed, "sure").alias("forced"), n(changed, "u_same", "sure").alias("forced_order_only"), n("what = 'same'").alias("same"))
    items = found.join(dull.withColumn("dull", F.lit(True)), ["grp", "old", "new"], "left")
    items = items.agg(n("old <> new").alias("changed_items"), n("old <> new", "how = 'forced'", "dull IS NULL").alias("forced_changed_items"), n("old = new").alias("unchanged_items"), n("dull").alias("unexplained"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    rest = groups.agg(zero(F.abs(F.col("n_old") - F.col("n_new"))).alias("unpaired"), zero(F.when(F.col("skipped"), F.least("left_old", "left_new"))).alias("oversized"))
    ident = lambda dump: dump.select(F.concat_ws("\x1f", K.base_key("key"), F.coalesce("name", F.lit(""))).alias("grp")).distinct()
    only = ident(new).join(ident(old), "grp", "left_anti").agg(F.count(F.lit(1)).alias("new_only_groups"))
    return by_tag, items.join(F.broadcast(rest)).join(F.broadcast(only))  # one row each
