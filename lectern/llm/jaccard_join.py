r"""N-gram Jaccard join: exact connected components of texts whose shingle sets have Jaccard similarity of 3/4 or more.

Set relations save the work that a plain prefix-filter join repeats for sets that are nearly alike.

* Equal sets share one answer: each distinct set is joined once, whatever number of rows has it.
* Similar sets form clusters: MinHash bands pair each set with the first set of each band, the overlap of the pair is computed, and a
  set goes to the cluster of the first set that it is linked with. Linked clusters form groups; inside a group no
  pair is looked at again, so thousands of near copies cost a pair for each and not for each two.
* What is left is links between groups, found by an exact prefix-filter join in which a shingle's index list counts only if it
  holds two groups. The lists are cut into blocks by set size (powers of 4/3) and by the shingle's position in the set's
  order; a set probes the blocks that can hold a partner and skips the others. Shingles are ordered by rising frequency,
  so that the prefix avoids those that many texts share. In a list a cluster is one entry, not one for each member.
* A member's answers are derived from those of its cluster's centre. If A' has add(A') shingles that its centre A lacks, |A' & B'| is at
  most |A & B| + add(A') + add(B'). So the overlap of two centres, computed once, mostly settles all pairs of their members. Where it
  doesn't, the members of the smaller cluster are compared with the centre of the larger one, and beyond that a pair of members can only have
  shingles in common that its centre lacks: pairs are made by these, and only those that can be linked with them are compared.

Two sets with n1 >= n2 shingles and 7 * overlap >= 3 * (n1 + n2) share one of the first n1 - ceil(3 * n1 / 4) + 1 shingles of the
larger set that lies at a position of at most (4 * n2 - 3 * n1) / 7 in the smaller one, so the join loses no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import words as W
from lectern.llm.components import components
from lectern.llm.store import BROADCAST_ROWS, broadcast_if_small, table, written, written_and_seen, written_small

WIDTH, BANDS, PER_BAND = 5, 6, 2
#: Counters of shingle frequency: a power of two for so many shingles each, between these bounds; shingles that share one share its count.
SHINGLES_A_COUNTER, LEAST_BITS, MOST_BITS = 4096, 17, 21
_odd = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, BANDS * PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for i, j, joined, at in W.slices(batch.column("__text")):
        yield batch.column("__id").slice(i, j - i), W.shingles(*W.word_hashes(joined, at), width)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), _signed(flat))


def _sketches(width: int):
    """Size, two 64-bit sums that stand for the set, and the MinHash band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _sets(batch, width):
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                keys = np.zeros((len(n), BANDS), np.uint64)
                if len(full):
                    flat, cut = np.concatenate([sets[k] for k in full]), np.concatenate([[0], np.cumsum(n[full])])[:-1]
                    s1[full] = np.add.reduceat(flat, cut)
                    s2[full] = np.add.reduceat(W.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), cut)
                    for band in range(BANDS):
                        key = np.full(len(full), band, np.uint64)
                        for k in range(band * PER_BAND, (band + 1) * PER_BAND):
                            key = W.mix(key * W.PLACE[1] + np.minimum.reduceat(flat * _odd[k], cut))
                        keys[full, band] = key
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), _signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), _signed(s1), _signed(s2), bands], names=["__id", "n", "s1", "s2", "bands"])

    return run


def _frequencies(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, sets in _sets(batch, width):
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])

    return run


def _key(s: np.ndarray) -> int:
    """The first of the two sums of a set's sketch."""
    return int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0


def _listed(width: int, chosen: Callable[[np.ndarray], np.ndarray], name: str):
    """Rows of id, the set's key and size, and a list of shingles chosen from the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _sets(batch, width):
                keys, sizes = pa.array([_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, keys, sizes, _lists([chosen(s) for s in sets])], names=["__id", "s1", "n", name])

    return run


def _prefix(level: np.ndarray, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """A set's shingles in order of (frequency level, hash), as far as a partner must share one."""

    def first(s: np.ndarray) -> np.ndarray:
        n = len(s)
        order = np.argsort(level[s >> np.uint64(64 - bits)], kind="stable")
        return s[order[: n - (3 * n + 3) // 4 + 1 if n else 0]]

    return first


class _Sets:
    """The distinct sets (sid, rep, s1, s2, n), rep being the least id that has the set, and the texts they come from."""

    def __init__(self, kinds: DataFrame, texts: DataFrame, width: int):
        self.kinds, self.texts, self.width = kinds, texts, width

    def lists(self, wanted: DataFrame, rows: int, chosen: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
        """wanted (sid, rep, s1, n and more; so many rows) with a list of shingles of each set, once for each row of its rep.

        Only the texts wanted are hashed where their ids can be broadcast; beyond that all are, so that lists are shuffled and not texts.
        """
        keys = F.broadcast(wanted) if rows <= 500_000 else wanted
        texts = self.texts
        if rows <= BROADCAST_ROWS:
            texts = texts.join(F.broadcast(wanted.select(F.col("rep").alias("__id"))), "__id", "left_semi")
        found = texts.mapInArrow(_listed(self.width, chosen, name), f"__id long, s1 long, n long, {name} array<long>")
        return found.withColumnRenamed("__id", "rep").join(keys, ["rep", "s1", "n"])

    def both(self, pairs: DataFrame) -> DataFrame:
        """(a, b, na, nb, of_a, of_b) for distinct pairs of sids: their sizes and sets; only sets of some pair are shuffled."""
        pairs, seen = written_and_seen(pairs.distinct(), "pairs")
        ids = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select("b")).distinct()
        wanted, of_wanted = written_and_seen(self.kinds.join(ids, "sid").select("sid", "rep", "s1", "n"), "wanted")
        return _with_sets(pairs, seen["n"], self.lists(wanted, of_wanted["n"], lambda s: s, "shingles").dropDuplicates(["sid"]).select("sid", "n", "shingles"))

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """(a, b, na, nb, shared) for distinct pairs of sids, by exact intersection."""
        return self.both(pairs).select("a", "b", "na", "nb", _common("of_a", "of_b").alias("shared"))


def _with_sets(pairs: DataFrame, rows: int, sets: DataFrame, most: int = 200) -> DataFrame:
    """Written pairs (a, b), so many rows, with both sets (of_a, of_b) and their sizes (na, nb).

    Pairs of a set that has very many are joined with copies of it, so that no task has more than so many of its pairs.
    """

    def joined(some: DataFrame, of: dict[str, DataFrame], salted: bool) -> DataFrame:
        for side in ("b", "a"):
            own = of[side].select(F.col("sid").alias(side), *([f"salt_{side}"] if salted else []), F.col("n").alias(f"n{side}"), F.col("shingles").alias(f"of_{side}"))
            some = some.join(own, [side, f"salt_{side}"] if salted else side)
        return some.select("a", "b", "na", "nb", "of_a", "of_b")

    per = [pairs.groupBy(F.col(side).alias("sid")).agg(F.ceil(F.count("*") / most).cast("int").alias("copies")).withColumn("side", F.lit(side)) for side in ("a", "b")]
    hot, seen = written_and_seen(per[0].unionAll(per[1]).where("copies > 1"), "hot")
    if not seen["n"]:
        return joined(F.broadcast(pairs) if rows <= BROADCAST_ROWS else pairs, {"a": sets, "b": sets}, False)  # so that one side's sets aren't shuffled
    of = {side: hot.where(F.col("side") == side).select(F.col("sid").alias("__hot"), F.col("copies").alias(f"copies_{side}")) for side in ("a", "b")}
    tagged = pairs
    for side in ("a", "b"):
        tagged = tagged.join(broadcast_if_small(of[side]), F.col(side) == F.col("__hot"), "left").drop("__hot")
    calm = F.col("copies_a").isNull() & F.col("copies_b").isNull()
    salt = lambda other, copies: F.pmod(F.xxhash64(other), F.coalesce(copies, F.lit(1))).cast("int")
    many = written(tagged.where(~calm).select("a", "b", salt("b", "copies_a").alias("salt_a"), salt("a", "copies_b").alias("salt_b")), "hot-pairs")
    ids = written_small(many.select(F.col("a").alias("sid")).unionAll(many.select("b")).distinct(), "hot-ids")
    copied = {side: sets.join(ids, "sid", "left_semi").join(broadcast_if_small(of[side]), F.col("sid") == F.col("__hot"), "left").withColumn(f"salt_{side}", F.explode(F.sequence(F.lit(0), F.coalesce(f"copies_{side}", F.lit(1)) - 1))) for side in ("a", "b")}
    return joined(tagged.where(calm).select("a", "b"), {"a": sets, "b": sets}, False).unionAll(joined(many, copied, True))


def _common(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def _similar(shared: Column, na: Column, nb: Column) -> Column:
    return 7 * shared >= 3 * (na + nb)


def _hopeful(pairs: DataFrame, rows: int, prefixes: DataFrame) -> DataFrame:
    """The pairs, so many rows, that their prefixes leave room for; what is dropped can't be similar.

    Common shingles up to the last common one of the prefixes are all in both prefixes. Those after it follow it in both
    sets, and are behind the prefix of at least one of them.
    """
    wanted = written_small(pairs.select(F.col("a").alias("sid")).unionAll(pairs.select("b")).distinct(), "wanted")
    own = prefixes.join(wanted, "sid", "left_semi").select("sid", "n", F.col("prefix").alias("shingles"))
    both = _with_sets(pairs, rows, own).withColumn("common", F.array_intersect("of_a", "of_b")).where(F.size("common") > 0)
    last = F.element_at("common", -1)
    behind = lambda side: F.col(f"n{side}") - F.array_position(f"of_{side}", last)
    suffix = F.greatest(F.col("na") - F.size("of_a"), F.col("nb") - F.size("of_b"))
    return both.where(_similar(F.size("common") + F.least(suffix, behind("a"), behind("b")), F.col("na"), F.col("nb"))).select("a", "b")


def _clusters(kinds: DataFrame, stars: DataFrame) -> DataFrame:
    """(sid, cluster, add, rem, size): the centre of each set's cluster, how it differs from it, and the members of the cluster.

    A set goes to the first set that it is linked with; one that others go to is the centre of its own cluster.
    """
    to = stars.groupBy(F.col("b").alias("sid")).agg(F.min(F.struct("a", "na", "nb", "shared")).alias("to"))
    to = to.select("sid", F.col("to.a").alias("centre"), (F.col("to.nb") - F.col("to.shared")).alias("add"), (F.col("to.na") - F.col("to.shared")).alias("rem"))
    centres = stars.groupBy(F.col("a").alias("sid")).agg(F.lit(True).alias("is_centre"))
    found = kinds.select("sid").join(to, "sid", "left").join(centres, "sid", "left")
    goes = F.col("is_centre").isNull() & F.col("centre").isNotNull()
    found = written(found.select("sid", F.when(goes, F.col("centre")).otherwise(F.col("sid")).alias("cluster"), *[F.when(goes, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("add", "rem")]), "members")
    sizes = found.where("sid <> cluster").groupBy("cluster").agg((F.count("*") + 1).alias("size"))
    return found.join(written_small(sizes, "sizes"), "cluster", "left").withColumn("size", F.coalesce("size", F.lit(1)))


def _across(sets: _Sets, entries: DataFrame, prefixes: DataFrame, members: DataFrame) -> DataFrame:
    """Linked pairs (a, b) of sids between groups: one at least of each two groups that have one."""
    probes = entries.select("*", F.explode(_probes(F.col("n"))).alias("to")).select("shingle", "to.c", "to.h", "cluster", "group", "size", "n", "pos")
    index = entries.where("7 * pos <= n").select("shingle", _size_class(F.col("n")).alias("c"), F.when(F.col("pos") * 14 <= F.col("n"), 0).otherwise(1).alias("h"), "cluster", "group", "size", "n", "pos")

    def by_cluster(rows: DataFrame, side: str) -> DataFrame:
        """A list's entries: sets that are alone, and one for each cluster with the range of its members' sizes and of what can follow."""
        keys = ["shingle", "c", "h", "cluster", "group"]
        alone = rows.where("size = 1").select(*keys, F.col("n").alias("lo"), F.col("n").alias("hi"), (F.col("n") - F.col("pos")).cast("long").alias("room"))
        many = rows.where("size > 1").groupBy(*keys).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("room"))
        return alone.unionAll(many).select("shingle", "c", "h", F.col("cluster").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in ("group", "lo", "hi", "room")])

    met = by_cluster(probes, "a").join(by_cluster(index, "b"), ["shingle", "c", "h"])
    met = met.where("group_a <> group_b AND (hi_a > lo_b OR hi_a = lo_b AND a > b) AND 4 * hi_b >= 3 * lo_a AND 7 * least(room_a, room_b) >= 3 * (lo_a + lo_b)")
    met = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    many = members.where("size > 1").groupBy("cluster").agg(F.min("n").alias("lo"), F.max("add").alias("add"))
    many = written_small(many, "clusters")
    of = lambda side: many.select(F.col("cluster").alias(f"many_{side}"), F.col("lo").alias(f"lo_{side}"), F.col("add").alias(f"add_{side}"))
    alone = F.col("many_a").isNull() & F.col("many_b").isNull()
    met, seen = written_and_seen(met.join(of("a"), F.col("a") == F.col("many_a"), "left").join(of("b"), F.col("b") == F.col("many_b"), "left"), "candidates", F.count_if(alone).alias("alone"))

    ranges = met.where(~alone)
    checked = written(sets.overlaps(_hopeful(met.where(alone).select("a", "b"), seen["alone"], prefixes).unionAll(ranges.select("a", "b"))), "overlaps")
    linked = checked.where(_similar(F.col("shared"), F.col("na"), F.col("nb"))).select("a", "b")

    # Pairs of clusters whose centres aren't linked, but some members might be.
    lowest = lambda side: F.coalesce(f"lo_{side}", f"n{side}")
    most = F.col("shared") + F.coalesce("add_a", F.lit(0)) + F.coalesce("add_b", F.lit(0))
    undecided = ranges.join(checked, ["a", "b"]).where(~_similar(F.col("shared"), F.col("na"), F.col("nb")) & _similar(most, lowest("a"), lowest("b")))
    undecided, seen = written_and_seen(undecided.select("a", "b", "na", "nb", "shared"), "undecided")
    return linked.unionAll(_between_members(sets, undecided, members, prefixes)) if seen["n"] else linked


def _between_members(sets: _Sets, undecided: DataFrame, members: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Linked pairs between members of pairs of clusters (a, b) whose centres aren't linked: one at least of each pair of clusters that has one.

    Of two clusters the larger one is its centre A and what each member has and A lacks; of the other one every member b is compared with A.
    A member A' has at most |A & b| shingles in common with b, and those of b - A that A' has and A lacks. So members are paired by these
    shingles, and what each member has and A lacks is listed once, for all clusters that it meets; without such a shingle only
    a member so much smaller than A that |A & b| is enough can be linked.
    """
    sizes = members.where("sid = cluster").select(F.col("sid").alias("of"), "size")
    met = undecided.join(sizes.select(F.col("of").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("of").alias("b"), F.col("size").alias("size_b")), "b")
    larger = F.col("size_a") >= F.col("size_b")
    met = written(met.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("centre"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("other")), "met")
    inside = members.select("cluster", "sid", "n")
    ones = met.join(inside, F.col("other") == F.col("cluster")).select(F.col("sid").alias("a"), F.col("centre").alias("b"))
    with_centre = sets.both(ones).select(F.col("b").alias("centre"), F.col("a").alias("one"), F.col("na").alias("n_one"), F.col("nb").alias("n_centre"), _common("of_a", "of_b").alias("shared"), F.array_except("of_a", "of_b").alias("rest"))
    with_centre = written(with_centre, "with-centre")
    linked = with_centre.where(_similar(F.col("shared"), F.col("n_one"), F.col("n_centre"))).select(F.col("one").alias("a"), F.col("centre").alias("b"))

    centres = written_small(met.select("centre").distinct(), "centres")
    own = inside.where("sid <> cluster").join(centres, F.col("cluster") == F.col("centre"), "left_semi")
    more = sets.both(own.select(F.col("sid").alias("a"), F.col("cluster").alias("b"))).select(F.col("b").alias("centre"), F.col("a").alias("sid"), F.col("na").alias("n"), F.array_except("of_a", "of_b").alias("more"))
    listed = more.select("centre", "sid", "n", F.explode("more").alias("shingle"))
    probes = with_centre.select("centre", "one", "n_one", "shared", F.explode("rest").alias("shingle"))
    hits = listed.join(probes, ["centre", "shingle"]).groupBy("sid", "one", "n", "n_one", "shared").agg(F.count("*").alias("hits"))
    alike = F.expr("4 * least(n, n_one) >= 3 * greatest(n, n_one)")
    hits = hits.where(alike & _similar(F.col("shared") + F.col("hits"), F.col("n"), F.col("n_one"))).select(F.col("sid").alias("a"), F.col("one").alias("b"))
    smaller = with_centre.join(own.select(F.col("cluster").alias("centre"), "sid", "n"), "centre").where(alike & (F.col("n") < F.col("n_centre")) & _similar(F.col("shared"), F.col("n"), F.col("n_one")))
    pairs, seen = written_and_seen(hits.unionAll(smaller.select(F.col("sid").alias("a"), F.col("one").alias("b"))), "member-pairs")
    found = sets.overlaps(_hopeful(pairs, seen["n"], prefixes)).where(_similar(F.col("shared"), F.col("na"), F.col("nb")))
    return linked.unionAll(found.select("a", "b"))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")


def _probes(n: Column) -> Column:
    """The blocks (size class, position half) that can hold a partner of at most n shingles."""
    own = _size_class(n)

    def block(size_class: Column, half: int) -> Column:
        upper = F.least(n, F.pow(F.lit(4 / 3), size_class + 1) + 1)
        lower = F.pow(F.lit(4 / 3), size_class) - 1
        return F.when((4 * upper - 3 * n) / 7 + 1 >= (lower / 14 if half else F.lit(0.0)), F.struct(size_class.alias("c"), F.lit(half).alias("h")))

    return F.filter(F.array(block(own, 0), block(own, 1), block(own - 1, 0), block(own - 1, 1)), lambda x: x.isNotNull())


def similar_components(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for each row: the set's size, and the least id that links reach.

    Words are ASCII-lower-cased runs without white space; a set holds the distinct width-word shingles, or the whole sequence
    where there are fewer words. Two ids link when intersection / union >= 3/4. Null and wordless texts have empty sets and link with
    nothing. A row with a null id has a null component and is no partner. Rows of one id are one node; where their
    texts differ, that node has the links of all of them. Sets are compared by 64-bit shingle hashes.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    sketches = written(texts.mapInArrow(_sketches(width), "__id long, n long, s1 long, s2 long, bands array<long>"), "sketches")

    # Equal sets: one stands for all. Sets have numbers of their own in order of their least ids (copies tend to be closer to an earlier
    # text than to each other, so earlier ones make better heads), given once and kept in the written table.
    kinds = sketches.where("n > 0 AND __id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("__id").alias("rep"), F.any_value("bands").alias("bands"), F.count("*").alias("copies"))
    kinds, seen = written_and_seen(kinds.orderBy("rep", "s1").select(F.monotonically_increasing_id().alias("sid"), "s1", "s2", "n", "rep", "bands", "copies"), "kinds", F.sum("n").alias("shingles"))
    sets = _Sets(kinds.drop("bands", "copies"), texts.where(F.col("__id").isNotNull()), width)
    numbered = sketches.select("__id", "n", "s1", "s2").join(kinds.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.col("n").alias("kn"), F.col("sid")), (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")) & (F.col("n") == F.col("kn")) & F.col("__id").isNotNull(), "left")
    rows = written(numbered.select("__id", "n", "sid"), "rows")

    # Similar sets: each with the first set of its bands.
    banded = kinds.select("sid", "n", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min(F.struct("sid", "n")).alias("head"), F.count("*").alias("size")).where("size > 1").select(F.col("band").alias("key"), F.col("head.sid").alias("a"), F.col("head.n").alias("na"))
    near = banded.join(written(heads, "heads"), F.col("band") == F.col("key")).where("sid <> a AND 4 * least(n, na) >= 3 * greatest(n, na)")
    near = near.groupBy("a", F.col("sid").alias("b")).agg(F.count("*").alias("bands")).where(F.col("bands") > 1)  # one band alone is mostly chance; what it would have found is found below
    stars = sets.overlaps(near.select("a", "b")).where(_similar(F.col("shared"), F.col("na"), F.col("nb")))
    stars = written(stars, "stars")
    groups = written(components(stars.select("a", "b")), "groups")
    members = _clusters(kinds, stars).join(groups, F.col("sid") == F.col("node"), "left").select("sid", "cluster", "add", "rem", "size", F.coalesce("component", "sid").alias("group"))
    members, of_members = written_and_seen(members.join(kinds.select("sid", "rep", "s1", "n", "copies"), "sid"), "members")

    # Links between groups.
    total = seen["shingles"] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (total // SHINGLES_A_COUNTER).bit_length()))
    counted = sets.texts.mapInArrow(_frequencies(width, bits), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << bits)
    counts[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    level = np.minimum(65535, np.log2(counts + 1) * 32).astype(np.uint16)
    listed = sets.lists(members.select("sid", "rep", "s1", "n", "group", "cluster", "size", "copies"), of_members["n"], _prefix(level, bits), "prefix")
    listed = written(listed.select("sid", "n", "group", "cluster", "size", "prefix", "copies"), "prefixes")
    prefixes = listed.where("copies = 1").unionAll(listed.where("copies > 1").dropDuplicates(["sid"])).drop("copies")  # a set of one row is there once
    bridges = prefixes.select("group", F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("shingle")
    entries = prefixes.select("sid", "n", "group", "cluster", "size", F.posexplode("prefix").alias("pos", "shingle")).join(written_small(bridges, "bridges"), "shingle")
    linked = written(_across(sets, written(entries, "entries"), prefixes, members), "links")

    # Rows of one id with several sets join these.
    several = rows.where("__id IS NOT NULL").groupBy(F.col("__id").alias("several")).agg(F.min("sid").alias("first"), F.max("sid").alias("last"), F.count("*").alias("all"), F.count("sid").alias("full"))
    several = written_small(several.where("first < last OR full > 0 AND full < all").select("several", "first"), "several")
    same = rows.where("sid IS NOT NULL").join(several, F.col("__id") == F.col("several")).select(F.col("first").alias("a"), F.col("sid").alias("b"))
    of = members.select(F.col("sid").alias("__sid"), F.col("group").alias("__group"))
    joined = linked.unionAll(same).join(of, F.col("a") == F.col("__sid")).select("b", F.col("__group").alias("ga")).join(of, F.col("b") == F.col("__sid")).select(F.col("ga").alias("a"), F.col("__group").alias("b"))
    merged = components(joined)

    classes = written(members.join(merged, F.col("group") == F.col("node"), "left").select("sid", "rep", F.coalesce("component", "group").alias("class")), "classes")
    least = classes.groupBy("class").agg(F.min("rep").alias("least"))
    answers = written(classes.join(least, "class").select(F.col("sid").alias("__sid"), "least"), "answers")
    empty_rows = several.join(answers, F.col("first") == F.col("__sid")).select(F.col("several").alias("__several"), F.col("least").alias("of_others"))
    out = rows.join(answers, F.col("sid") == F.col("__sid"), "left").join(written_small(empty_rows, "several"), F.col("__id") == F.col("__several"), "left")
    return out.select(F.col("__id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "of_others", "__id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
