"""Near-duplicate classes by BagMinHash signatures, bands and exact multiset overlap.

1. Exact copies collapse first, by the digest of the text; all later work is on
   distinct texts (nodes).
2. A node's five-word shingles with their multiplicities are a weighted set.
   Every shingle owns a Poisson process over its weight levels: block 0 is level
   1, block b the levels 2**(b-1)+1 .. 2**b, with a rate equal to its width.  A
   point of a block carries a uniform level and counts only if the shingle's
   weight reaches it, so equal shingles give equal points whatever their weights
   and the signature is unbiased for the weighted Jaccard similarity.  Points
   come in time order and are generated up to a horizon by which every signature
   component has met one; a text for which the horizon was too short is done
   again with twice the horizon, so the result doesn't depend on it.
3. Bands of the signature give buckets.  Each bucket has a leader, the member with
   the most bucket neighbours (it is near the middle of its group), and all
   members are compared with it, never with each other; the exact weighted Jaccard
   similarity of a candidate pair decides.  A leader's group is cut into chunks of
   ``CHUNK`` members, so a huge group spreads over many tasks.
4. Links give classes by label propagation.  Buckets that still hold several
   classes are not resolved: for their members an exact prefix filter finds all
   pairs of different classes that can be similar enough (texts share one of their
   rarest shingles), and these are compared too.  So no link between two classes
   that share a bucket is lost.  Where that would be many pairs, turns of leaders
   (one comparison a row) join classes before it, and the largest class of a
   shingle never meets itself; a hot shingle's rows are split over tasks.

Nothing but counts reaches the driver.  Intermediate tables are written to the
shared folder of ``spark.checkpoint.dir``; the ones with texts, buckets and pairs
are removed when the classes are known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesutil as B
from .common import fresh, removed, stored, text_digest, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
CHUNK = 64
TURNS, EASY = 8, 4
SPLIT = 4096
SALTS = 8
SLICE_BYTES = 2 << 20

_Q = np.uint64(0x9FB21C651E98DF25)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ONE = 1.0 / (1 << 53)


def shingles(column, size: int = SHINGLE):
    """Hashes of all word shingles of each text: (hash, text index) in text order.

    Words are runs of letters and digits without regard to A-Z case.  A text of
    fewer than ``size`` words, but not none, is one shingle; one without words
    has no shingle.
    """
    data, offs = B.buffers(column)
    s, e = B.spans(data, offs, B.LOWER_ALNUM)
    h = B.span_hashes(data, s, e)
    rows = B.row_of(s, offs)
    n = np.diff(rows)
    doc = np.repeat(np.arange(len(n)), n)
    out = h.copy()
    for k in range(1, size):
        ahead = np.zeros_like(h)
        ahead[:len(h) - k] = h[k:] if k < len(h) else 0
        stays = np.arange(len(h)) + k < rows[1:][doc] if len(h) else np.zeros(0, bool)
        out = np.where(stays, out * _Q + ahead, out)
    at = np.arange(len(h)) - rows[:-1][doc] if len(h) else np.zeros(0, np.int64)
    whole = at + size <= n[doc] if len(h) else np.zeros(0, bool)
    whole |= (at == 0) & (n[doc] < size) if len(h) else False
    return B.mix(out[whole]), doc[whole], n


def multiset(h: np.ndarray, doc: np.ndarray):
    """Distinct (text, shingle) with their multiplicities."""
    if not len(h):
        return h, doc, np.zeros(0, np.int64)
    key = B.mix(h + (doc.astype(np.uint64) + np.uint64(1)) * _GOLD)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    return h[order[first]], doc[order[first]], count


def signatures(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures, one row a text (zeros for a text without shingles)."""
    # elements: the level blocks that a multiplicity reaches
    n_blocks = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    which = np.repeat(np.arange(len(h)), n_blocks)
    block = np.arange(len(which)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    width = np.where(block == 0, 1, low)
    seed = B.mix(h[which] + block.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    owner, weight = doc[which], count[which]
    total = np.bincount(doc, count, n_docs)
    sig = np.zeros((n_docs, m), np.uint64)
    todo = np.flatnonzero(total > 0)
    stretch = np.log(m) + 3.5
    while len(todo):
        horizon = np.zeros(n_docs)
        horizon[todo] = m * stretch / total[todo]
        best_x = np.full(n_docs * m, np.inf)
        best_z = np.zeros(n_docs * m, np.uint64)
        live = np.flatnonzero(horizon[owner] > 0)
        x = np.zeros(len(live))
        j = 0
        while len(live):
            j += 1
            z = B.mix(seed[live] + np.uint64(j * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            u = ((z >> np.uint64(11)).astype(np.float64) + 0.5) * _ONE
            x = x - np.log(u) / width[live]
            inside = x <= horizon[owner[live]]
            live, x, z = live[inside], x[inside], z[inside]
            v = B.mix(z ^ _Q)
            level = low[live] + 1 + ((v & np.uint64(0xFFFFFFFF)).astype(np.int64) * width[live] >> 32)
            counts = level <= weight[live]
            part = ((v >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            slot = (owner[live] * m + part)[counts]
            xs, zs = x[counts], z[counts]
            np.minimum.at(best_x, slot, xs)
            won = best_x[slot] == xs
            best_z[slot[won]] = zs[won]
        filled = np.isfinite(best_x.reshape(n_docs, m)).all(axis=1)
        done = todo[filled[todo]]
        sig[done] = best_z.reshape(n_docs, m)[done]
        todo = todo[~filled[todo]]
        stretch *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        key = B.mix(key * _Q + sig[:, r::rows][:, :bands] + np.uint64(r + 1))
    return key.view(np.int64)


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two multisets (sorted hashes, counts)."""
    (ha, ca), (hb, cb) = a, b
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    union = int(ca.sum() + cb.sum()) - both
    return both / union if union else 0.0


def _signer(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            node, doc_id = batch.column(batch.schema.get_field_index("node")), batch.column(batch.schema.get_field_index("id"))
            for i, j in B.slices(text, SLICE_BYTES):
                h, doc, n = shingles(text.slice(i, j - i))
                keys = band_keys(signatures(*multiset(h, doc), j - i, bands * rows), bands, rows)
                flat = pa.array(keys.reshape(-1), pa.int64())
                offsets = pa.array(np.r_[0, np.cumsum(np.where(n > 0, bands, 0))].astype(np.int32))
                if not (n > 0).all():
                    flat = pa.array(keys[n > 0].reshape(-1), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [node.slice(i, j - i), doc_id.slice(i, j - i), pa.ListArray.from_arrays(offsets, flat)],
                    names=["node", "id", "keys"])
    return run


def _verify(rows: pa.Table) -> pa.Table:
    """Members of one chunk of a leader's group against the leader."""
    h, doc, _ = shingles(rows["text"])
    h, doc, count = multiset(h, doc)
    order = np.lexsort((h, doc))
    h, doc, count = h[order], doc[order], count[order]
    cut = np.searchsorted(doc, np.arange(len(rows) + 1))
    bag = [(h[a:b], count[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    lead = next((k for k, x in enumerate(rows["leads"].to_pylist()) if x), None)
    score = [0.0 if lead in (None, k) else similarity(bag[lead], bag[k]) for k in range(len(rows))]
    near = pa.array(np.flatnonzero(np.array(score) >= SIMILARITY))
    return pa.table({"a": rows["a"].take(near), "b": rows["node"].take(near), "similarity": pa.array(score, pa.float64()).take(near)})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity is high enough.

    ``n``, where the pairs have it, says about how many pairs of ``a`` there are: the
    partners are split into chunks by it, without a join on ``a``.
    """
    if "n" not in pairs.columns:
        pairs = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a")
    chunked = pairs.select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("chunk"))
    wanted = chunked.select("a", "chunk", F.col("b").alias("node"), F.lit(False).alias("leads")).unionByName(
        chunked.select("a", "chunk", F.col("a").alias("node"), F.lit(True).alias("leads")).distinct())
    return (wanted.join(texts, "node").groupBy("a", "chunk")
            .applyInArrow(_verify, "a binary, b binary, similarity double"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each linked node can reach.

    Label propagation with pointer jumping; labels are written each round.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("l")).select(
        F.col("a").alias("node"), F.least("a", "l").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        after = written(least.join(jump, "next", "left").select(
            "node", F.least("next", F.coalesce("far", "next")).alias("label"),
            (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("changed")), "labels")
        labels = after.select("node", "label")
        if after.where("changed").isEmpty():
            return labels


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one class, with their class."""
    known = members.select("band", "key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    return known.join(mixed.select("band", "key"), ["band", "key"])


def _elements(batches):
    """(node, size, element), one row per shingle occurrence: the k-th
    occurrence of a shingle is an element of its own, so the weighted similarity of
    two texts is the plain Jaccard similarity of their elements."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        for i, j in B.slices(text, SLICE_BYTES):
            h, doc, _ = shingles(text.slice(i, j - i))
            h, doc, count = multiset(h, doc)
            which = np.repeat(np.arange(len(h)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            element = B.mix(h[which] + nth.astype(np.uint64) * _GOLD)
            size = np.bincount(doc, count, j - i).astype(np.int64)
            owner = pa.array(doc[which] + i, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("node")).take(owner),
                 pa.array(size[doc[which]]), pa.array(element.view(np.int64))],
                names=["node", "size", "element"])


def prefixes(open_nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(element, node, size, nth, alone, short): the rarest elements of every node.

    Prefix filter: with the elements of every text in one order, rarest first, two
    texts of similarity s or more share one of the first n - ceil(2 s n / (1 + s)) + 1
    of the smaller (``short``) and the first n - ceil(s n) + 1 of the larger.
    Elements that can join nobody (in one text only, or in no short prefix) are left out.
    """
    rows = open_nodes.join(texts, "node").select("node", "text").mapInArrow(_elements, "node binary, size long, element long")
    rows, path = stored(rows, "elements")
    often = rows.groupBy("element").agg(F.count("*").alias("often")).where("often > 1")
    by_node = Window.partitionBy("node")
    n = F.col("size")
    long_prefix = n - F.ceil(n * SIMILARITY - 1e-9) + 1
    short_prefix = n - F.ceil(n * (2 * SIMILARITY / (1 + SIMILARITY)) - 1e-9) + 1
    first = (rows.join(often, "element", "left").withColumn("often", F.coalesce("often", F.lit(1)))
             .withColumn("nth", F.row_number().over(by_node.orderBy("often", "element")))
             .withColumn("alone", F.count(F.when(F.col("often") == 1, 1)).over(by_node))
             .where((F.col("nth") <= long_prefix) & (F.col("often") > 1))
             .withColumn("short", F.col("nth") <= short_prefix).drop("often"))
    first, all_first = stored(first, "prefixes")
    used = first.groupBy("element").agg(F.count("*").alias("m"), F.max("short").alias("has_short")).where("has_short and m > 1").select("element")
    kept = written(first.join(used, "element"), "prefixes")
    for done in (path, all_first):
        removed(first.sparkSession, done)
    return kept


def mixed(first: DataFrame, labels: DataFrame) -> DataFrame:
    """The prefix rows of the elements that several classes hold, with their class
    ``label``, the element's largest class ``dom``, its rows ``m`` and the ``k`` of
    them that are outside ``dom``."""
    known = first.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = known.groupBy("element", "label").agg(F.count("*").alias("n"))
    top = parts.groupBy("element").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("m"))
    top = top.select("element", F.col("top.label").alias("dom"), "m", (F.col("m") - F.col("top.n")).alias("k")).where("k > 0")
    return known.join(top, "element")


def leader_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """One pair for each row outside its element's largest class: it and one member of
    that class, another one each turn."""
    lead = rows.where("label = dom").groupBy("element").agg(
        F.max_by("node", F.xxhash64("node", F.lit(turn))).alias("a"))
    return (rows.where("label <> dom").join(lead, "element")
            .groupBy("a", F.col("node").alias("b")).agg(F.max("k").alias("n")))


def cross_pairs(rows: DataFrame) -> DataFrame:
    """All pairs (a < b) of different classes that can reach the similarity, and few others.

    Two rows of an element are of different classes only if one of them is outside
    the element's largest class: those ``k`` rows meet the ``m`` of the element, and
    the largest class never meets itself.  The ``k`` are split into parts of ``SPLIT``
    rows, so a hot element is many tasks.  What the places of a shared element leave
    room for must suffice.
    """
    parts = F.ceil(F.col("k") / SPLIT).cast("int")
    names = ("node", "label", "size", "nth", "alone", "short")
    p = rows.where("label <> dom").select("element", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"),
                                          *[F.col(c).alias(f"p_{c}") for c in names])
    q = rows.select("element", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
                    (F.col("label") == F.col("dom")).alias("inside"), *[F.col(c).alias(f"q_{c}") for c in names])
    least_common = (F.col("p_size") + F.col("q_size")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9
    after = F.least(F.col("p_size") - F.col("p_nth"), F.col("q_size") - F.col("q_nth"))
    # before the shared place: common elements are none of those that occur once; after it: what is left
    could = F.least(F.col("p_nth") - F.col("p_alone"), F.col("q_nth") - F.col("q_alone")) + after >= least_common
    p_smaller = F.struct("p_size", "p_node") < F.struct("q_size", "q_node")
    shared = p.join(q, ["element", "part"]).where(
        (F.col("p_label") != F.col("q_label")) & (F.col("inside") | (F.col("p_node") < F.col("q_node")))
        & F.when(p_smaller, F.col("p_short")).otherwise(F.col("q_short"))
        & (F.least("p_size", "q_size") >= SIMILARITY * F.greatest("p_size", "q_size") - 1e-9) & could)
    swap = F.col("p_node") > F.col("q_node")

    def side(one: str, other: str, c: str):
        return F.when(swap, F.col(f"{one}_{c}")).otherwise(F.col(f"{other}_{c}"))

    shared = shared.select(*[side("q", "p", c).alias(f"a_{c}") for c in ("node", "size", "nth")],
                           *[side("p", "q", c).alias(f"b_{c}") for c in ("node", "size", "nth")])
    # all common elements up to the last shared one are among the shared ones
    pairs = shared.groupBy("a_node", "b_node", "a_size", "b_size").agg(
        F.count("*").alias("c"), F.max("a_nth").alias("ia"), F.max("b_nth").alias("ib"))
    reach = F.col("c") + F.least(F.col("a_size") - F.col("ia"), F.col("b_size") - F.col("ib"))
    return pairs.where(reach >= (F.col("a_size") + F.col("b_size")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9).select(
        F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` after the links ``found``: only the classes that they join are
    worked on, not the links of earlier steps."""
    ends = found.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end, "left")
    ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    more = components(ends)
    moved = labels.join(more.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select(
        "node", F.coalesce("next", "label").alias("label"))
    return written(moved.unionByName(more.join(labels, "node", "left_anti")), "labels")


def resolve(open_nodes: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` with every link between different classes of ``open_nodes`` followed.

    Turns first: while comparing all pairs of different classes would form more than
    ``EASY`` rows for each prefix row, every row outside its element's largest class is
    compared with one member of that class, and the classes found alike are joined.
    That takes as many comparisons as there are rows and leaves less for ``cross_pairs``,
    which then finds every link that is left.  A turn that takes less than 5 % of those
    rows away is the last one: the texts are not alike, and more turns would only repeat that.
    """
    spark = texts.sparkSession
    first = prefixes(open_nodes, texts)
    n_first = first.count()
    before = None
    for turn in range(TURNS + 1):
        rows, path = stored(mixed(first, labels), "mixed")
        work = rows.where("label <> dom").agg(F.sum("m")).first()[0] or 0
        if not work:
            break
        last = turn == TURNS or work <= EASY * n_first or before is not None and work > 0.95 * before
        before = work
        found, found_path = stored(verified(cross_pairs(rows) if last else leader_pairs(rows, turn), texts), "links")
        if not found.isEmpty():
            labels = joined(labels, found)
        for done in (path, found_path):
            removed(spark, done)
        if last:
            break
    return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, id, class_id, keep_id, keep_node, class_size): one row per row of ``docs``.

    ``node`` is the digest of the text.  A class is a connected component of the
    links of similarity 0.8 or more; ``class_id`` is its least id, and
    (keep_id, keep_node) names the document that stays, the least of its class.
    Null and empty texts are exact copies of each other; texts without words are
    linked by exact equality only.  Repeated rows are copies of each other.  Null
    ids sort last.
    """
    spark = docs.sparkSession
    base = docs.select(text_digest(F.col(text_col)).alias("node"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = base.mapInArrow(_signer(bands, rows), "node binary, id long, keys array<long>")
    nodes = written(signed.groupBy("node").agg(
        F.min("id").alias("id"), F.first("keys").alias("keys"), F.count("*").alias("copies")), "nodes")
    entries = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    buckets = entries.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members, members_path = stored(entries.join(buckets, ["band", "key"]).select("band", "key", "node", "n"), "members")
    # a node that shares large buckets is near the middle of its group: it leads
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    leaders = members.join(weight, "node").groupBy("band", "key").agg(F.max(F.struct("weight", "node"))["node"].alias("a"))
    needed = members.select("node").distinct().join(nodes.select("node", "id"), "node")
    texts, texts_path = stored(
        base.alias("d").join(needed.hint("shuffle_hash").alias("w"), (F.col("d.node") == F.col("w.node")) & F.col("d.id").eqNullSafe(F.col("w.id")))
        .select("d.node", "text").dropDuplicates(["node"]), "texts")
    tested, tested_path = stored(members.join(leaders, ["band", "key"]).where("node <> a").groupBy("a", F.col("node").alias("b")).agg(
        F.max("n").alias("n")), "pairs")
    links, links_path = stored(verified(tested, texts), "links")
    labels = components(links)
    open_nodes = written(_open_buckets(members, labels).select("node").distinct(), "open")
    if not open_nodes.isEmpty():
        labels = resolve(open_nodes, texts, labels)
    for done in (members_path, texts_path, tested_path, links_path):
        removed(spark, done)
    # classes of nodes, then of rows; a large class is several keys, a text alone needs no join
    in_class = labels.join(nodes.select("node", "id", "copies"), "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    least = in_class.groupBy("label").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("s"), F.sum("copies").alias("size"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    of_class = in_class.join(least, ["label", "salt"]).select("node", "s", "size")
    single = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    node_class = nodes.join(of_class, "node", "left").select("node", F.coalesce("s", single).alias("s"), F.coalesce("size", "copies").alias("class_size"))
    node_class = node_class.select("node", F.col("s.id").alias("class_id"), F.col("s.id").alias("keep_id"),
                                   F.col("s.node").alias("keep_node"), "class_size")
    return base.select("node", "id").join(node_class, "node")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its class, the class's size and whether it stays."""
    return classes(docs).select(
        F.col("id").alias("doc_id"), "class_id", "class_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("node") == F.col("keep_node"))).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns (repeated rows: one of them)."""
    found = written(classes(docs, id_col, text_col), "classes")
    keep = found.where(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("node") == F.col("keep_node"))).groupBy("id", "node").agg(F.count("*").alias("n"))
    a, b = fresh(docs.columns, "kept_id"), fresh(docs.columns, "kept_node")
    n = fresh(docs.columns, "copies")
    keep = keep.select(F.col("id").alias(a), F.col("node").alias(b), F.col("n").alias(n))
    here = docs.withColumn(fresh([*docs.columns, a, b, n], "node"), text_digest(F.col(text_col)))
    node = here.columns[-1]
    rows = here.join(keep.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (F.col(node) == F.col(b)))
    single = rows.where(F.col(n) == 1)
    repeated = rows.where(F.col(n) > 1).dropDuplicates([a, b])
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
