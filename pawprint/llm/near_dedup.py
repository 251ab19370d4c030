"""Near-duplicate groups by b-bit MinHash.

1. Signatures: each text's set of word shingles is hashed to 64 bits; PERMUTATIONS minima give the keys of bands, and
   their low bits, packed into longs, the signature. Texts with equal sets become one node.
2. Candidates: documents that share a band's bucket. All pairs of a bucket are never made: each member is paired with
   the bucket's hub (the node of most copies). The similarity estimated from bit counts, corrected for chance
   collisions of the low bits, drops pairs that are surely apart; the others are confirmed on full sets.
3. The rest of a hub's group, exactly: a pair of members that are not yet connected is compared by its signatures if
   the group is small. In a large group, central members take the hub's place: each connects what is like it, and the
   members that are left get the next centre. Then each member is reduced to its difference from a centre. Two linked
   sets differ in few elements, so their differences must agree in all but these, and share an element among the
   first few of them in one order, rare elements first. Only such pairs of different components are compared.
4. Components by alternating large and small stars, on tables.

A pair of similarity s shares no bucket with probability (1 - s ** ROWS) ** BANDS: 7e-9 at 0.85.

Defined cases: a text without words (empty or null) has no shingles and links with nothing; rows that repeat an
identifier get the component of their own text; null identifiers never are a component's name unless it has no
other, and are never kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, bounded_broadcast, release, temporary, without, worker_cache, written

BANDS, ROWS = 32, 5
PERMUTATIONS = BANDS * ROWS
#: Low bits kept of each minimum; 16 of them in a long.
BITS = 4
#: Pairs whose estimate is this much under the threshold are dropped unseen: over 6 standard deviations.
MARGIN = 0.18
#: Members of a hub's group that are compared in pairs of signatures.
SMALL = 24
SLICE_SHINGLES = 1 << 16
#: Members of a large group that are looked at for its centre and for the order of elements.
LOOK = 24
#: Centres that a large group gets at most, and the part of its members (one in so many) that a centre has to settle for the next.
ROUNDS, PROGRESS = 6, 16
P = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240101).integers(1, 1 << 32, (2, PERMUTATIONS), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles; of the whole text if it has fewer words."""
    import xxhash

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    s = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        s = s * P + h[i : len(h) - k + 1 + i]
    s ^= s >> np.uint64(29)
    return np.unique(s * P + np.uint64(k))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """PERMUTATIONS minima (32 bits) of each non-empty set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    for k in range(PERMUTATIONS):
        v = (x ^ _SEEDS[0, k]) * _SEEDS[1, k]
        v ^= v >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(v, at)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """Low BITS of minima, 16 to a long."""
    nibbles = (low & np.uint32(15)).astype(np.uint64).reshape(len(low), -1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).astype(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.astype(np.uint64).reshape(len(low), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * P, (len(low), 1))
    for i in range(ROWS):
        key = (key ^ rows[:, :, i]) * P
        key ^= key >> np.uint64(31)
    return key.astype(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """doc_id, n_shingles, fp (16 bytes of the set's hash), sig, bands, text_hash; fp, sig and bands null for texts without words."""

    def run(batches):
        worker_cache("near")
        for b in batches:
            texts, lo = b.column(1).cast(pa.binary()).to_pylist(), 0
            while lo < len(texts):
                sets, held, hi = [], 0, lo
                while hi < len(texts) and (hi == lo or held < SLICE_SHINGLES):
                    sets.append(shingles(texts[hi], n))
                    held += len(sets[-1])
                    hi += 1
                some = [i for i, s in enumerate(sets) if len(s)]
                fp, sig, bands = ([None] * len(sets) for _ in range(3))
                if some:
                    low = minima([sets[i] for i in some])
                    for i, s, k in zip(some, packed(low), band_keys(low), strict=True):
                        fp[i], sig[i], bands[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), s, k
                arrays = [b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())), b.column(2).slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "fp", "sig", "bands", "text_hash"])
                lo = hi

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, fp binary, sig array<bigint>, bands array<bigint>, text_hash bigint")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the bit counts of two signatures, corrected for collisions of the low bits."""
    apart = F.lit(0)
    ones = F.lit(0x1111111111111111)
    for i in range(PERMUTATIONS // 16):
        x = a[i].bitwiseXOR(b[i])
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        apart = apart + F.bit_count(any_bit.bitwiseAND(ones))
    chance = 2.0**-BITS
    return (1 - apart / PERMUTATIONS - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of edges a - b. Alternates large and small stars until nothing changes."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:  # each turn reads only what the last one wrote
        near = both(edges)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = written(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
        release(edges.sparkSession)


class NearDuplicates:
    """Groups of documents linked by a Jaccard similarity of at least percent / 100."""

    def __init__(self, docs: DataFrame, percent: int = 85, n: int = 5, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.percent, self.n = percent, n
        with arrow_batches(docs.sparkSession):
            self.rows = written(signatures(self.docs, "doc_id", "text", n), "signatures")
        nodes = self.rows.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        self.nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        self.enough = F.lit(percent / 100 - MARGIN)

    def stars(self) -> DataFrame:
        """node, hub: each member of a bucket with the bucket's hub."""
        entries = self.nodes.select("node", "copies", F.explode("bands").alias("key"))
        hubs = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("copies", "node")).alias("hub")).filter("m > 1").select("key", F.col("hub.node").alias("hub"))
        return entries.join(hubs, "key").filter("node <> hub").select("node", "hub").distinct()

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """pairs a, b with est from their signatures."""
        sig = self.nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
        other = self.nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
        return pairs.join(sig, "a").join(other, "b").withColumn("est", estimate(F.col("sig_a"), F.col("sig_b"))).drop("sig_a", "sig_b")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, set (sorted hashes) for the given nodes, from their texts."""
        n = self.n
        wanted = written(nodes.distinct().join(self.nodes.select("node", "min_id", "fp"), "node"), "wanted")
        found = self.docs.join(bounded_broadcast(wanted, wanted.count(), 64), self.docs["doc_id"].eqNullSafe(F.col("min_id")))

        def run(batches):
            worker_cache("near")
            for b in batches:
                sets = [shingles(t, n) for t in b.column(1).cast(pa.binary()).to_pylist()]
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == fp for s, fp in zip(sets, b.column(2).to_pylist(), strict=True)]
                batch = pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "set"])
                yield batch.filter(pa.array(same))

        return found.select("node", "text", "fp").mapInArrow(run, "node bigint, set array<bigint>").dropDuplicates(["node"])

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs a, b that are linked, by their full sets."""
        one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        two = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        return two.filter(100 * common >= self.percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")

    def apart(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """pairs without those that are connected already."""
        ra = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        rb = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        with_roots = pairs.join(ra, "a", "left").join(rb, "b", "left")
        return with_roots.filter(~F.coalesce("root_a", "a").eqNullSafe(F.coalesce("root_b", "b"))).drop("root_a", "root_b")

    def centred(self, star: DataFrame) -> DataFrame:
        """Large groups around central members: grp, node, round, centre, sig, est, settled.

        Each round takes for a group's centre, of the members that are left, the one whose estimates reach the
        threshold for most of LOOK members; members whose own estimate reaches it are settled, the others
        are left to the next round while rounds still settle some. The first centre names the group: groups of hubs
        that agree on it become one. A row for each member in each round that it is in.
        """
        sig = self.nodes.select("node", "sig")
        enough = F.lit(self.percent / 100)
        members = star.select(F.col("hub").alias("grp"), "node").unionByName(star.select(F.col("hub").alias("grp"), F.col("hub").alias("node")).distinct())
        left, rounds = written(members.join(sig, "node").select("grp", "node", "sig"), "members"), []
        for i in range(1, ROUNDS + 1):
            look = Window.partitionBy("grp").orderBy(F.xxhash64("node"), "node")
            seen = left.withColumn("i", F.row_number().over(look)).filter(F.col("i") <= LOOK).groupBy("grp").agg(F.collect_list("sig").alias("seen"))
            seen = written(seen, "seen")
            n = seen.count()
            if n == 0:
                break
            ests = F.transform("seen", lambda s: estimate(F.col("sig"), s))
            total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v)
            scored = left.join(bounded_broadcast(seen, n, 16 * LOOK * (PERMUTATIONS // 16)), "grp").withColumn("ests", ests)
            score = F.struct(F.size(F.filter("ests", lambda e: e >= enough)), total(F.col("ests")), "node")
            centres = written(scored.groupBy("grp").agg(F.max(F.struct(score.alias("score"), "node", "sig")).alias("c")).select("grp", F.col("c.node").alias("centre"), F.col("c.sig").alias("centre_sig")), "centres")
            if i == 1:
                alike = left.join(bounded_broadcast(centres, n, 200), "grp")
                left = alike.select(F.col("centre").alias("grp"), "node", "sig", "centre", "centre_sig").dropDuplicates(["grp", "node"])
            else:
                left = left.join(bounded_broadcast(centres, n, 200), "grp")
            left = left.withColumn("est", estimate(F.col("sig"), F.col("centre_sig"))).drop("centre_sig")
            rounds.append(written(left.withColumn("round", F.lit(i)).withColumn("settled", F.col("est") >= enough), "round"))
            went = rounds[-1].groupBy("grp").agg(F.count_if("settled").alias("settled"), F.count(F.lit(1)).alias("n"))
            on = written(went.filter((F.col("settled") * PROGRESS >= F.col("n")) & (F.col("n") - F.col("settled") > SMALL)).select("grp"), "on")
            left = rounds[-1].filter("not settled").join(bounded_broadcast(on, on.count(), 16), "grp", "left_semi").select("grp", "node", "sig")
            release(left.sparkSession)
        out = rounds[0]
        for r in rounds[1:]:
            out = out.unionByName(r)
        return out

    def differing(self, centred: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs a, b of one group in different components that may be linked, by their differences from a centre.

        A member settled by a connected centre is looked for only in that centre's round, by those that are left
        after it; the others (unsettled) are looked for by each other in the first round. A member probes if it isn't
        connected with the round's centre, or is unsettled.
        """
        q = 100 - self.percent
        most = lambda size: F.floor(size * q / (100 + self.percent))  # noqa: E731  two linked sets of that size together differ in no more elements
        root = roots.select("node", "root")
        rows = centred.select("grp", "round", "node", "centre", "settled").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = rows.join(root.select(F.col("node").alias("centre"), F.col("root").alias("root_c")), "centre", "left").withColumn("root_c", F.coalesce("root_c", "centre"))
        rows = rows.withColumn("home", F.col("settled") & (F.col("root") == F.col("root_c")))
        loose = rows.groupBy("grp", "node").agg(F.bool_or("home").alias("any_home")).filter("not any_home").select("grp", "node", F.lit(True).alias("loose"))
        rows = rows.join(loose, ["grp", "node"], "left").withColumn("loose", F.coalesce("loose", F.lit(False)))
        both = F.col("loose") & (F.col("round") == 1)
        rows = rows.withColumn("index", F.col("home") | both).withColumn("probe", both | (~F.col("home") & (F.col("root") != F.col("root_c"))))
        rows = written(rows.filter("index or probe"), "frames")
        asked = written(rows.groupBy("grp", "round").agg(F.bool_or("probe").alias("any"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("any and lo <> hi").select("grp", "round"), "asked")
        rows = rows.join(bounded_broadcast(asked, asked.count(), 24), ["grp", "round"], "left_semi")
        heads = written(rows.select("centre").distinct().join(sets, F.col("centre") == F.col("node")).select("centre", F.col("set").alias("h")), "centre-sets")
        bound = heads.agg(F.coalesce(F.sum(F.size("h") * 8 + 64), F.lit(0))).first()[0]
        own = rows.join(sets.select("node", F.col("set").alias("s")), "node").join(bounded_broadcast(heads, bound, 1), "centre")
        delta = own.select("grp", "round", "node", "root", "home", "index", "probe", F.size("s").alias("n"), F.size("h").alias("nh"), F.array_except("s", "h").alias("more"), F.array_except("h", "s").alias("less"))
        delta = delta.withColumn("d", F.size("more") + F.size("less")).withColumn("k", most(F.col("n") + F.floor(F.col("n") * 100 / self.percent)))
        delta = written(delta, "differences")
        release(delta.sparkSession)
        # any order of elements is right, as long as it is one; elements that several of a few members have are put last
        frame = ["grp", "round"]
        look = Window.partitionBy(*frame).orderBy(F.xxhash64("node"), "node")
        few = delta.select(*frame, "node", F.concat("more", "less").alias("delta")).withColumn("i", F.row_number().over(look)).filter(F.col("i") <= LOOK)
        seen = few.select(*frame, F.explode("delta").alias("e")).groupBy(*frame, "e").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
        common = written(seen.groupBy(*frame).agg(F.collect_list("e").alias("common")), "common")  # at most LOOK differences in a row
        bound = common.agg(F.coalesce(F.sum(F.size("common") * 8 + 64), F.lit(0))).first()[0]
        # of the others, those that the centre hasn't come first: what members lack of the centre is shared more often
        rare = F.concat(F.array_sort(F.array_except("more", "common")), F.array_sort(F.array_except("less", "common")))
        ordered = F.concat(rare, F.array_sort(F.array_intersect(F.concat("more", "less"), "common")))
        least = most(F.ceil(F.col("n") * self.percent / 100) + F.col("nh")) + 1  # a member that isn't linked to the centre differs from it in at least so many
        first = F.when(F.col("home"), F.floor((F.col("d") - least + F.col("k")) / 2) + 1).when(F.col("index"), F.floor(F.col("k") / 2) + 1).otherwise(0)
        ranked = delta.join(bounded_broadcast(common, bound, 1), frame, "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>"))).withColumn("first", first)
        take = F.greatest(F.col("first"), F.when(F.col("probe"), F.col("k") + 1).otherwise(0)).cast("int")
        ranked = ranked.filter(take > 0).select(*frame, "node", "root", "n", "d", "k", "probe", "first", F.posexplode(F.slice(ordered, F.lit(1), take)).alias("pos", "e"))
        ranked = written(ranked, "prefixes")
        release(ranked.sparkSession)
        index = ranked.filter(F.col("pos") < F.col("first")).select(*frame, "e", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("d").alias("da"), F.col("pos").alias("pa"))
        probe = ranked.filter(F.col("probe") & (F.col("pos") <= F.col("k"))).select(*frame, "e", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("pos").alias("pb"))
        overlap = F.ceil((F.col("da") + F.col("db") - most(F.col("na") + F.col("nb"))) / 2)
        fits = (F.col("ra") != F.col("rb")) & (F.col("pa") <= F.col("da") - overlap) & (F.col("pb") <= F.col("db") - overlap)
        return index.join(probe, [*frame, "e"]).filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def links(self) -> DataFrame:
        """Confirmed links a, b of nodes that connect what is linked."""
        star = written(self.stars(), "stars")
        sizes = star.groupBy("hub").agg(F.count(F.lit(1)).alias("g"))
        star = written(star.join(sizes, "hub"), "sized-stars")
        large, small = star.filter(F.col("g") > SMALL), star.filter(F.col("g") <= SMALL)
        near = self.estimated(small.select(F.col("node").alias("a"), F.col("hub").alias("b"))).filter(F.col("est") >= self.enough).select("a", "b")
        centred = None if large.isEmpty() else written(self.centred(large.select("hub", "node")), "centred")
        if centred is not None:
            near = near.unionByName(centred.filter((F.col("est") >= self.enough) & (F.col("node") != F.col("centre"))).select(F.col("node").alias("a"), F.col("centre").alias("b")))
        release(self.docs.sparkSession)
        near = written(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
        few = small.filter("g > 1")
        sig = self.nodes.select("node", "sig")
        few = written(few.join(sig, "node").select("hub", "node", "sig"), "few")
        one, two = few.select("hub", F.col("node").alias("a"), F.col("sig").alias("sig_a")), few.select("hub", F.col("node").alias("b"), F.col("sig").alias("sig_b"))
        beside = one.join(two, (one["hub"] == two["hub"]) & (F.col("a") < F.col("b")) & (estimate(F.col("sig_a"), F.col("sig_b")) >= self.enough)).select("a", "b").distinct()
        beside = written(beside, "beside")
        ends = lambda p: p.select(F.col("a").alias("node")).unionByName(p.select(F.col("b").alias("node")))
        nodes = ends(near).unionByName(ends(beside))
        if centred is not None:
            nodes = nodes.unionByName(centred.select("node"))
        with arrow_batches(self.docs.sparkSession):
            sets = written(self.sets(nodes), "sets")
        release(self.docs.sparkSession)
        links = written(self.confirmed(near, sets), "links")
        roots = written(components(links), "roots")
        more = self.apart(beside, roots)
        if centred is not None:
            wide = written(self.differing(centred, roots, sets), "wide")
            release(self.docs.sparkSession)
            more = more.unionByName(self.estimated(wide).filter(F.col("est") >= self.enough).select("a", "b")).distinct()
        return written(links.unionByName(self.confirmed(more, sets)), "links")

    def groups(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, kept, text_hash."""
        roots = written(components(self.links()), "roots")
        named = self.nodes.select("node", "fp", "min_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        names = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
        of_fp = named.join(names, "root").select(F.col("fp").alias("node_fp"), "component_id")
        found = self.rows.select("doc_id", "n_shingles", "fp", "text_hash").join(of_fp, F.col("fp") == F.col("node_fp"), "left")
        component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "text_hash")


def near_groups(docs: DataFrame, percent: int = 85, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of the group), kept."""
    with temporary(docs.sparkSession):
        found = NearDuplicates(docs, percent, n, id_col, text_col).groups().drop("text_hash")
        return written(found, "near-groups", keep=True)


def drop_near_copies(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the document of smallest identifier of each group, all columns kept. Null identifiers stay.

    Rows go by identifier and text, since an identifier may be repeated with texts of several groups.
    """
    with temporary(docs.sparkSession):
        groups = NearDuplicates(docs, percent, n, id_col, text_col).groups()
        gone = written(groups.filter("not kept and doc_id is not null").select("doc_id", "text_hash").distinct(), "near-copies", keep=True)
    return without(docs, gone, [docs[id_col], F.xxhash64(F.coalesce(docs[text_col], F.lit("")))], 24)
