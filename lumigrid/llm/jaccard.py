"""N-gram Jaccard join with vertical partitioning.

A document is the set of its distinct 5-word shingles (64-bit hashes; equal sets, by a 128-bit hash, are one class).
The global order of shingles goes by how many sets hold them, rare ones first, and is cut into fragments. Shingles that
one set alone holds head every set; they only count. A set that shares too little with all others together is left
out. Two similar sets share one of their first n - ceil(n * threshold) + 1 shingles, so these prefixes meet by shingle;
for the pairs so found each fragment counts its partial overlap on its own, and the partial overlaps are summed per pair.

A group of near copies would have all its pairs as candidates. Links make components, and a pair inside one can't change
it; so, in a few rounds, each class first meets one hub, the class that stands for the buckets in which it occurs.
What then is left of a group, in other components, meets by differences: for sets x and y of one hub h, with the
differences X = x ^ h and Y = y ^ h, |x ^ y| = |X| + |Y| - 2 |X & Y|, so that x and y link exactly if
2 |X & Y| >= |X| + |Y| - (|x| + |y|) / 7. For any x that doesn't link with h the right side is positive: prefixes of the
differences (what x adds before what it lacks) meet instead of those of the sets, and what all near copies share never
does. Sets of different hubs, or of none, meet by their own prefixes. Hubs save work only; any choice gives the same
links.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and is its own component;
a row with a null id has its size and a null component; repeated rows and ids are in one class if their sets agree;
ties in the order are broken by hash; very long texts are hashed in slices, one text at a time; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import common, graph
from lumigrid.llm.shingling import LEAST, PER, shared_sets

#: Fragments of the global order: by powers of two of how many sets hold a shingle.
FRAGMENTS = 8
#: How often each class meets a hub, and then a class that shares some of its difference from the hub.
ROUNDS, NEAR_ROUNDS = 2, 1


def needed(na: Column, nb: Column) -> Column:
    """The least intersection with which sets of these sizes link."""
    return F.ceil((na + nb) * LEAST / (LEAST + PER))


def links(both: Column) -> Column:
    """Whether sets of sizes na and nb link, by the size of their intersection."""
    return (LEAST + PER) * both >= LEAST * (F.col("na") + F.col("nb"))


def apart_by_parity() -> Column:
    """A lower bound of |x ^ y| from the parity maps of x and y: a bit that differs takes a shingle that differs, and what
    a set alone holds always does."""
    differ = F.aggregate(F.zip_with("x.parity", "y.parity", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, x: acc + x)
    return differ + F.col("x.n") - F.col("x.held") + F.col("y.n") - F.col("y.held")


def fragments(sets: DataFrame) -> DataFrame:
    """(set_id, fragment, part array<long>): the sets cut along the global order."""
    cut = F.least(F.floor(F.log2("p.freqs")), F.lit(FRAGMENTS)).cast("int")
    items = sets.select("set_id", F.explode(F.arrays_zip("items", "freqs")).alias("p"))
    return items.groupBy("set_id", cut.alias("fragment")).agg(F.collect_list("p.items").alias("part"))  # at most one set


def verified(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that link: partial overlaps by fragment, summed per pair."""
    left = parts.select(F.col("set_id").alias("a"), "fragment", F.col("part").alias("pa"))
    right = parts.select(F.col("set_id").alias("b"), "fragment", F.col("part").alias("pb"))
    partial = pairs.join(right, "b").join(left, ["a", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("both"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both")).where(links(F.col("both"))).select("a", "b")


def posted(sets: DataFrame) -> DataFrame:
    """(shingle, set_id, n, held, place) of each prefix: the shingles that other sets hold too, with their places in the order."""
    alone = F.col("n") - F.size("items")
    prefix = F.col("n") - F.ceil(F.col("n") * LEAST / PER) + 1 - alone
    rows = sets.select("set_id", "n", F.size("items").alias("held"), F.posexplode(F.slice("items", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))))
    return rows.select(F.col("col").alias("shingle"), "set_id", "n", "held", (F.col("n") - F.col("held") + F.col("pos")).alias("place"))


def rooted(rows: DataFrame, roots: DataFrame | None, keys: list[str]) -> DataFrame:
    """rows with their root, of the buckets (equal keys) that hold more than one root."""
    if roots is None:
        placed = rows.withColumn("root", F.col("set_id"))
    else:
        placed = rows.join(roots, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id")).drop("node")
    mixed = placed.groupBy(*keys).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(*keys)
    return placed.join(mixed, keys, "left_semi")


def hubs(rows: DataFrame, seed: int) -> DataFrame:
    """(a, b, na, nb): at most one hub a for each class b of rows (shingle, set_id, n, root).

    A bucket's hub is its first class in a seeded random order; a class takes the hub of another component in whose
    buckets it occurs most."""
    one = F.struct("set_id", "n", "root")
    first = rows.groupBy("shingle").agg(F.min_by(one, F.struct(F.xxhash64(F.lit(seed), "set_id"), "set_id")).alias("hub"))
    met = rows.join(first, "shingle").where((F.col("hub.root") != F.col("root")) & (PER * F.least("n", "hub.n") >= LEAST * F.greatest("n", "hub.n"))).groupBy(F.col("set_id").alias("b"), F.col("n").alias("nb"), "hub").count()
    return met.groupBy("b", "nb").agg(F.max_by("hub", F.struct("count", "hub.set_id")).alias("h")).select(F.col("h.set_id").alias("a"), "b", F.col("h.n").alias("na"), "nb")


def chosen_hubs(rows: DataFrame, linked: DataFrame, roots: DataFrame) -> DataFrame:
    """(set_id, hub, hub_root): for the classes of rows the hub of one component each, if they meet any.

    A component's hub is its class with most links. A bucket speaks for its largest component, and a class takes the
    component for which most of its buckets speak."""
    degree = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node"))).groupBy("node").count()
    whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    heads = whole.join(degree, "node").groupBy("root").agg(F.max_by("node", F.struct("count", -F.col("node"))).alias("hub"), F.count(F.lit(1)).alias("size"))
    heads = heads.select(F.col("root").alias("hub_root"), "hub", "size")
    told = rows.select("shingle", "root").distinct().join(heads, F.col("root") == F.col("hub_root"))
    spoken = told.groupBy("shingle").agg(F.max(F.struct("size", "hub_root", "hub")).alias("h"))
    met = rows.select("shingle", "set_id").join(spoken, "shingle").groupBy("set_id", "h").count()
    return met.groupBy("set_id").agg(F.max_by("h", F.struct("count", "h")).alias("h")).select("set_id", "h.hub", "h.hub_root")


def differences(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(set_id, n, hub, hub_root, hub_n, d, held, lacks, parity, more, less): d is the size of the difference from the hub, more what the
    hub lacks and less what the set lacks, both without the shingles that one set alone holds; held counts what the set
    shares with any other, lacks all that it lacks of the hub."""
    of = chosen.select("hub").distinct().join(sets, F.col("hub") == F.col("set_id")).select("hub", F.col("n").alias("hub_n"), F.col("items").alias("theirs"))
    own = chosen.join(sets.select("set_id", "n", "items", "parity"), "set_id").where("set_id <> hub").join(of, "hub")
    both = F.size("items") - F.size("more")
    got = own.withColumn("more", F.array_except("items", "theirs")).withColumn("less", F.array_except("theirs", "items"))
    return got.select("set_id", "n", "hub", "hub_root", "hub_n", (F.col("n") + F.col("hub_n") - 2 * both).alias("d"), F.size("items").alias("held"), (F.col("hub_n") - both).alias("lacks"), "parity", "more", "less")


def difference_buckets(apart: DataFrame, roots: DataFrame) -> DataFrame:
    """(hub, shingle, set_id, n, d, held, parity, place, root): the prefixes of differences()."""
    now = apart.join(roots, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id")).drop("node", "hub_root")
    now = now.join(roots.select(F.col("node").alias("hub_node"), F.col("root").alias("hub_root")), F.col("hub") == F.col("hub_node"), "left").withColumn("hub_root", F.coalesce("hub_root", "hub")).drop("hub_node")
    # of two sets in different components one doesn't link with the hub: its 7 d - n is above hub_n, the other's at least `least`
    least = now.groupBy("hub").agg(F.min(7 * F.col("d") - F.col("n")).alias("least"))
    now = now.join(least, "hub")
    other = F.when(F.col("root") == F.col("hub_root"), F.col("hub_n") + 1).otherwise(F.col("least"))
    need = F.greatest(F.ceil((7 * F.col("d") - F.col("n") + other) / 14), F.lit(1))
    now = now.withColumn("alone", F.col("n") - F.col("held")).withColumn("prefix", F.col("d") - need + 1).where((F.col("prefix") > F.col("alone")) & (F.size("more") + F.col("lacks") >= need))
    # what the hub alone holds comes last: all sets lack it, so its first shingle stands for all
    order = F.concat("more", "less", F.array(F.col("hub")))
    rows = now.select("hub", "set_id", "n", "d", "held", "parity", "alone", F.posexplode(F.slice(order, F.lit(1), (F.col("prefix") - F.col("alone")).cast("int"))))
    rows = rows.select("hub", F.col("col").alias("shingle"), "set_id", "n", "d", "held", "parity", (F.col("alone") + F.col("pos")).alias("place"))
    return common.written(rooted(rows, roots, ["hub", "shingle"]), "difference-buckets")


def nearest(rows: DataFrame, seed: int) -> DataFrame:
    """(a, b, na, nb): at most one class a for each class b of difference_buckets(): of the classes that stand for b's buckets,
    the one that is nearest to b by what they share there. In round 0 the class nearest to the hub stands for a bucket, then
    a random one."""
    by = F.struct("d", "set_id") if seed == 0 else F.struct(F.xxhash64(F.lit(seed), "set_id"), "set_id")
    first = rows.groupBy("hub", "shingle").agg(F.min_by(F.struct("set_id", "n", "d", "root"), by).alias("near"))
    met = rows.join(first, ["hub", "shingle"]).where((F.col("near.root") != F.col("root")) & (PER * F.least("n", "near.n") >= LEAST * F.greatest("n", "near.n"))).groupBy(F.col("set_id").alias("b"), F.col("n").alias("nb"), "near").count()
    best = met.groupBy("b", "nb").agg(F.max_by("near", F.struct(2 * F.col("count") - F.col("near.d"), F.col("near.set_id"))).alias("h"))
    return best.select(F.col("h.set_id").alias("a"), "b", F.col("h.n").alias("na"), "nb")


def across_differences(rows: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) of difference_buckets() in different components whose differences may share enough."""
    x, y = rows.alias("x"), rows.alias("y")
    least_both = F.greatest(F.ceil((7 * (F.col("x.d") + F.col("y.d")) - F.col("x.n") - F.col("y.n")) / 14), F.lit(1))
    near = (PER * F.least("x.n", "y.n") >= LEAST * F.greatest("x.n", "y.n")) & (F.col("x.place") <= F.col("x.d") - least_both) & (F.col("y.place") <= F.col("y.d") - least_both)
    near = near & (7 * apart_by_parity() <= F.col("x.n") + F.col("y.n"))
    met = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") < F.col("y.root")) & near)
    return met.select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()


def across_prefixes(rows: DataFrame, chosen: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) of rows (shingle, set_id, n, held, place, root) in different components and of different hubs
    whose prefixes meet early enough."""
    hub = chosen.select(F.col("set_id").alias("hubbed"), "hub")
    # without a hub, a set has its own number, below 0
    rows = rows.join(hub, F.col("set_id") == F.col("hubbed"), "left").withColumn("hub", F.coalesce("hub", -F.col("set_id") - 1)).drop("hubbed")
    mixed = rows.groupBy("shingle").agg(F.min("hub").alias("low"), F.max("hub").alias("high")).where("low < high").select("shingle")
    rows = rows.join(mixed, "shingle", "left_semi").join(sets.select("set_id", "parity"), "set_id")
    rows = common.written(rows, "mixed-buckets")
    x, y = rows.alias("x"), rows.alias("y")
    most = lambda s: F.col(f"{s}.n") - F.col(f"{s}.place")
    near = (PER * F.least("x.n", "y.n") >= LEAST * F.greatest("x.n", "y.n")) & (F.least(most("x"), most("y")) >= needed(F.col("x.n"), F.col("y.n")))
    near = near & (7 * apart_by_parity() <= F.col("x.n") + F.col("y.n"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") < F.col("y.root")) & (F.col("x.hub") != F.col("y.hub")) & near)
    return met.select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()


def linked_sets(sets: DataFrame) -> DataFrame:
    """(node, root) of the sets (set_id, n, items, freqs, parity) that link with one of a less number: root is their component's least."""
    parts = common.written(fragments(sets), "fragments")
    rows = posted(sets)
    buckets = common.written(rooted(rows, None, ["shingle"]), "prefix-buckets")
    found, roots, mixed = None, None, buckets
    for seed in range(ROUNDS):
        got = verified(hubs(mixed, seed), parts)
        found = common.written(got if found is None else found.unionByName(got), "links")
        roots = graph.components(found)
        mixed = common.written(rooted(buckets.drop("root"), roots, ["shingle"]), "mixed-buckets")
    chosen = common.written(chosen_hubs(mixed, found, roots), "hubs")
    apart = common.written(differences(sets, chosen), "differences")
    near_hub = apart.where(7 * F.col("d") <= F.col("n") + F.col("hub_n")).select(F.col("hub").alias("a"), F.col("set_id").alias("b"))
    found = common.written(found.unionByName(near_hub), "links")
    roots = graph.components(found)
    rows = difference_buckets(apart, roots)
    for seed in range(NEAR_ROUNDS):
        found = common.written(found.unionByName(verified(nearest(rows, seed), parts)), "links")
        roots = graph.components(found)
        rows = common.written(rooted(rows.drop("root"), roots, ["hub", "shingle"]), "difference-buckets")
    pairs = across_differences(rows).unionByName(across_prefixes(rooted(buckets.drop("root"), roots, ["shingle"]), chosen, sets)).distinct()
    return graph.components(found.unionByName(verified(common.written(pairs, "pairs"), parts)))


def joined(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, text_key, n_shingles, component_id, class_id (null for an empty set)."""
    with common.Scratch(docs.sparkSession) as scratch:
        seen = shared_sets(docs)
        sets = seen.where("items is not null").select("high", "low", "n", "items", "freqs", "parity").dropDuplicates(["high", "low"])
        sets = common.written(sets.withColumn("set_id", F.monotonically_increasing_id()), "shared-sets")
        roots = linked_sets(sets)
        named = sets.select("set_id", "high", "low").join(roots, F.col("set_id") == F.col("node"), "left").select("high", "low", F.coalesce("root", "set_id").alias("root"))
        rows = seen.where("items is null").select("doc_id", "text_key", "n", "high", "low")
        firsts = rows.where("high is not null").groupBy("high", "low").agg(F.min("doc_id").alias("first"))
        whole = firsts.join(named, ["high", "low"], "left")
        heads = whole.where("root is not null").groupBy("root").agg(F.min("first").alias("head"))
        ends = whole.join(heads, "root", "left").select(F.col("high").alias("__high"), F.col("low").alias("__low"), F.coalesce("head", "first").alias("head"))
        out = rows.join(ends, (F.col("high") == F.col("__high")) & (F.col("low") == F.col("__low")), "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id"))
        name = F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("low"), 16, "0"))
        return scratch.keep(common.written(out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), name.alias("class_id")), "components"))


def linked(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, class_id (null for an empty set)."""
    return joined(docs).drop("text_key")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, one for each component: the one of its least id (of rows that share that id, the text
    that hashes least; of rows that share both, any). Rows with a null id or an empty set stay, all of them."""
    rows = common.written(joined(docs).where("doc_id is not null and class_id is not null").groupBy("component_id", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times")), "components")
    first = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("f"))
    named = rows.join(first, "component_id")
    stays = (F.col("doc_id") == F.col("f.doc_id")) & (F.col("text_key") == F.col("f.text_key"))
    marks = named.where(~stays | (F.col("times") > 1)).select(F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key"), stays.alias("stays"))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("key"))
    marked = own.join(marks, (F.col("id") == F.col("its_id")) & (F.col("key") == F.col("its_key")), "left")
    repeated = marked.where("stays").dropDuplicates(["id", "key"])
    return marked.where("stays is null").unionByName(repeated).select(*[F.col("row")[c].alias(c) for c in docs.columns])
