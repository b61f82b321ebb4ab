"""N-gram Jaccard join by prefix trees, and the components of its links.

Every document is its set of word shingles, as 64-bit hashes in one global order: shingles of rare
words first, shingles that a sample finds in many documents last. Two sets with a Jaccard of at
least ``percent`` share an element of their prefixes (the first ``n - ceil(percent * n / 100) + 1``
elements; for the smaller set even ``n - ceil(2 * percent * n / (100 + percent)) + 1`` do), so
sets meet in blocks keyed by (prefix element, size class). The sets of a block are stored in a trie
(``trie.Trie``), which every set traverses.

1. Equal sets become one class, whose node is its smallest doc_id.
2. Every node goes to the block of its first shared element. That links nearly all near copies.
3. Blocks whose nodes are in one component already are dropped, and of blocks with equal nodes one
   stays. Pairs of the rest that could link and are in different components are joined too, so no
   link between components is lost.

Sets are large, so blocks first compare parity bits: every element flips one of about n bits, and
two sets differ in at least as many elements as their bits do. Only nodes of pairs that this bound
leaves get their sets, from a second look at their texts.

A block of many nodes or elements is split: in step 2 into parts that each hold the same few
anchors, in step 3 into all pairs of parts. So a part's sets have a bounded size together (but for
a single set that is larger), and what a task holds at a time is a part and a slice of texts.

Cases: a null or wordless text has no shingles and is its own component. A row without doc_id takes
no part; its component is null. Repeated rows are rows of their own with equal components. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.llm import words as w
from fundlens.llm.trie import Trie
from fundlens.operators.components import connected_components
from fundlens.session import materialise

SAMPLE_ROWS = 4096  # documents looked at for the order; the order changes speed only
SAMPLE_SHINGLES = 1 << 16  # frequent shingles kept from them
FREQUENT = 8  # sampled documents that make a shingle frequent
FILTER_BITS = 1 << 23  # of the filter that spares documents outside every block
PART = 1024  # sets of a block that meet in one task
ELEMENTS = 1 << 19  # elements of them, about
ANCHORS = 32
LOW_KEYS = 4  # with which a pair is told apart from its repetitions in other blocks


class ShingleOrder:
    """Ranks of shingles: the rarity of their words, or the frequency of a frequent shingle."""

    def __init__(self, words: np.ndarray, shingles: np.ndarray):
        self.words, self.shingles = words, shingles

    def elements(self, words: np.ndarray, k: int) -> np.ndarray:
        """The distinct shingles of a text, in order: rank in the upper 8 bits, hash below."""
        if not len(words):
            return words
        hashes = w.shingle_hashes(words, k)
        rank = np.zeros(len(hashes), np.uint64)
        if len(words) >= k:
            rare = self.words[words >> np.uint64(48)]
            for j in range(k):
                rank += rare[j : len(words) - k + 1 + j]
            rank = np.minimum(rank, np.uint64(63))
        rank = np.maximum(rank, self.shingles[hashes >> np.uint64(44)])
        return np.unique((rank << np.uint64(56)) | (hashes & np.uint64((1 << 56) - 1)))


def sampled_order(base: DataFrame, k: int) -> ShingleOrder:
    """The order, from about ``SAMPLE_ROWS`` documents; its tables have fixed sizes."""
    total = max(base.count(), 1)
    share = min(1.0, SAMPLE_ROWS / total)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, hashes = [], []
            for _, found in w.texts_with_words(batch.column(0).to_pylist()):
                for kind, h in ((0, found >> np.uint64(48)), (1, np.unique(w.shingle_hashes(found, k)))):
                    kinds.append(np.full(len(h), kind, np.int32))
                    hashes.append(h)
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(kinds)), pa.array(w.signed(np.concatenate(hashes)))], ["kind", "h"]
                )

    sample = base.where(F.expr(f"pmod(xxhash64(doc_id), {1 << 20})") < math.ceil(share * (1 << 20)))
    counts = sample.select("text").mapInArrow(count, "kind int, h long").groupBy("kind", "h").count()
    common = counts.where((F.col("kind") == 1) & (F.col("count") >= FREQUENT)).orderBy(F.desc("count"), "h").limit(SAMPLE_SHINGLES)
    seen = counts.where("kind = 0").unionByName(common).toPandas()
    words, shingles = np.zeros(1 << 16, np.uint64), np.zeros(1 << 20, np.uint64)
    rank = np.log2(seen["count"].to_numpy(float) + 1).astype(np.uint64)
    is_word = seen["kind"].to_numpy() == 0
    hashes = seen["h"].to_numpy(np.int64).view(np.uint64)
    words[hashes[is_word]] = rank[is_word]
    np.maximum.at(shingles, hashes[~is_word] >> np.uint64(44), np.uint64(64) + rank[~is_word])
    return ShingleOrder(words, shingles)


def _records(base: DataFrame, order: ShingleOrder, k: int, percent: int) -> DataFrame:
    """(doc_id, n, two fingerprints of the set, its prefix) of every document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _sliced(batches):
            n, one, two, prefix, bits = [], [], [], [], []
            for _, found in w.texts_with_words(texts):
                s = order.elements(found, k)
                n.append(len(s))
                mixed = w.mix(s)
                one.append(int(np.bitwise_xor.reduce(mixed)) if len(s) else 0)
                two.append(int(mixed.sum()) if len(s) else 0)
                bits.append(parity_bits(mixed))
                prefix.append(w.signed(s[: len(s) - -(-percent * len(s) // 100) + 1]) if len(s) else np.zeros(0, np.int64))
            sizes = np.array([len(p) for p in prefix])
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            values = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64())]
                + [pa.array(w.signed(np.array(x, np.uint64))) for x in (one, two)]
                + [pa.ListArray.from_arrays(offsets, values), pa.array(bits, pa.binary())],
                ["doc_id", "n", "fp1", "fp2", "prefix", "bits"],
            )

    return base.mapInArrow(sketch, "doc_id long, n long, fp1 long, fp2 long, prefix array<long>, bits binary")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(column 0, texts of column 1) of slices of rows, so that a batch is never held whole in Python."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        lo = 0
        while lo < batch.num_rows:
            start = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, start + w.SLICE_BYTES, "right")))
            yield batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_pylist()
            lo = hi


def parity_bits(mixed: np.ndarray) -> bytes:
    """One bit for each residue of the elements, odd or even; at least as many bits as elements."""
    size = max(64, 1 << int(len(mixed) - 1).bit_length()) if len(mixed) else 64
    odd = np.bincount((mixed & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def possible_pairs(bits: list[bytes], n: np.ndarray, percent: int, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later positions j in other groups) whose bits don't rule out a link."""
    size = min(map(len, bits))
    folded = np.empty((len(bits), size), np.uint8)
    for i, b in enumerate(bits):
        row = np.frombuffer(b, np.uint8)
        while len(row) > size:  # residues of half the size: both halves meet
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        folded[i] = row
    words = folded.view(np.uint64)
    for i in range(len(bits) - 1):
        differ = np.bitwise_count(words[i + 1 :] ^ words[i]).sum(1, dtype=np.int64)
        hit = ((100 + percent) * differ <= (100 - percent) * (n[i + 1 :] + n[i])) & (group[i + 1 :] != group[i])
        if hit.any():
            yield i, np.flatnonzero(hit) + i + 1


def _possible(blocks: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """From blocks (key, part, node, n, component, bits): the nodes of pairs of different components
    that may link. With ``pairs`` the pairs (a, b, ca, cb, na) themselves; the column ``low`` then has
    a node's smallest keys, and a pair is left to a smaller key that both have among them."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in w.runs(batches, ["key", "part"]):
            if block.num_rows < 2:
                continue
            node, n, group = (block.column(c).to_numpy() for c in ("node", "n", "component"))
            found = list(possible_pairs(block.column("bits").to_pylist(), n, percent, group))
            if not found:
                continue
            if pairs:
                key, low = block.column("key")[0].as_py(), [set(x) for x in block.column("low").to_pylist()]
                kept = [(x, y) for x, later in found for y in later.tolist() if min(low[x] & low[y], default=key) >= key]
                if not kept:
                    continue
                i, j = np.array(kept).T
                flip = node[i] > node[j]
                i, j = np.where(flip, j, i), np.where(flip, i, j)
                columns = [node[i], node[j], group[i], group[j], n[i]]
            else:
                columns = [node[np.unique(np.concatenate([np.append(j, i) for i, j in found]))]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "ca", "cb", "na"] if pairs else ["node"])

    return (
        blocks.repartition("key", "part").sortWithinPartitions("key", "part")
        .mapInArrow(look, "a long, b long, ca long, cb long, na long" if pairs else "node long")
    )


def _block_keys(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, key, pos): the blocks of every node; the lowest bit of a key is that of its size class.

    Sizes in a ratio of at least ``percent`` are in the same or the next size class. A node takes
    its whole prefix to its own class, and the shorter prefix of a smaller set to the next one.
    """
    short = F.expr(f"cast(n - ceil({2 * percent} * n / {100 + percent}) + 1 as int)")
    return (
        nodes.select("node", _size_class(percent).alias("c"), short.alias("short"), F.posexplode("prefix").alias("pos", "token"))
        .select(
            "node", "pos", "token",
            F.explode(F.when(F.col("pos") < F.col("short"), F.array(F.col("c"), F.col("c") + 1)).otherwise(F.array("c"))).alias("c"),
        )
        .select("node", "pos", F.xxhash64("token", "c").bitwiseAND(-2).bitwiseOR(F.col("c") % 2).alias("key"))
    )


def _size_class(percent: int) -> Column:
    return F.floor(F.log("n") / F.lit(math.log(100 / percent) * (1 + 1e-9)))


def _parts(percent: int) -> Column:
    """Parts of a block of ``m`` sets, by their number or their elements, whichever gives more.

    A node's block is of its own size class or of the next, which the key tells; so all nodes of a
    block take the same largest size.
    """
    own = _size_class(percent)
    block = own + F.abs(own % 2 - F.col("key").bitwiseAND(1))
    largest = F.pow(F.lit(100 / percent * (1 + 1e-6)), block + 1)
    return F.greatest(F.ceil(F.col("m") / PART), F.ceil(F.col("m") * largest / ELEMENTS)).cast("int")


def _id_filter(nodes: DataFrame) -> np.ndarray:
    """A bit for every hash of a node, ``FILTER_BITS`` in all."""
    bit = F.expr(f"pmod(xxhash64(node), {FILTER_BITS})")
    found = (
        nodes.select((bit / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node), {FILTER_BITS}) % 64 as int))").alias("bit"))
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    )
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[found["at"].to_numpy(int)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _linked(base: DataFrame, blocks: DataFrame, order: ShingleOrder, k: int, percent: int) -> DataFrame:
    """Links (a, b) in ``blocks`` (node, key, part, component) that join components."""
    spark = base.sparkSession
    bits = spark.sparkContext.broadcast(_id_filter(blocks))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(2).to_numpy().astype(np.uint64)
                yield batch.filter(pa.array((bits.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1))

        for ids, texts in _sliced(wanted()):
            out = [order.elements(found, k).tobytes() for _, found in w.texts_with_words(texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["node", "elements"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in w.runs(batches, ["key", "part"]):
            if block.num_rows < 2:
                continue
            nodes = block.column("node").to_numpy()
            trie = Trie([np.frombuffer(x, np.uint64) for x in block.column("elements").to_pylist()])
            links = trie.links(percent, block.column("component").to_numpy())
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    found = base.where("doc_id IS NOT NULL").select("doc_id", "text", F.expr(f"pmod(xxhash64(doc_id), {FILTER_BITS})").alias("bit")).mapInArrow(sets, "node long, elements binary")
    return (
        blocks.join(found, "node")
        .repartition("key", "part").sortWithinPartitions("key", "part")
        .mapInArrow(join, "a long, b long")
    )


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Rows link when 100 * |intersection| >= ``percent`` * |union| of their ``k``-word shingle sets;
    component_id is the smallest doc_id that links reach.
    """
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    order = sampled_order(base, k)
    records = materialise(_records(base, order, k, percent), "ngram-records")

    same = ["n", "fp1", "fp2"]
    classes = records.where("n > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("node"))
    first = records.join(classes, same).where("doc_id = node").select("node", "n", "prefix")
    keys = _block_keys(first, percent)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialise(keys.join(sizes, "key"), "ngram-members")
    shared = members.select("node").distinct()
    sketches = materialise(
        records.join(shared, records["doc_id"] == shared["node"], "left_semi").select(F.col("doc_id").alias("node"), "n", "bits"), "ngram-bits"
    )

    part = F.expr("cast(pmod(xxhash64(node, key), parts) as int)")
    # Of a split block about ANCHORS sets, or as many as make up one part.
    anchor = (F.col("parts") > 1) & (F.expr(f"pmod(xxhash64(key, node), greatest(ceil(m / {ANCHORS}), parts))") == 0)
    one = (
        members.groupBy("node").agg(F.min_by(F.struct("key", "m"), "pos").alias("b")).select("node", "b.*")
        .join(sketches.select("node", "n"), "node").withColumn("parts", _parts(percent))
        .select("node", "key", F.explode(F.when(anchor, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))).alias("part"), F.col("node").alias("component"))
    )
    near = materialise(_possible(one.join(sketches, "node"), percent, pairs=False).distinct(), "ngram-near")
    links = materialise(_linked(base, one.join(near, "node"), order, k, percent), "ngram-links")

    found = connected_components(links, "a", "b")
    known = members.join(found, "node", "left").select("key", "m", "node", F.coalesce("component", "node").alias("component"))
    mixed = (
        known.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"),
            F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"),
        )
        .where("low < high").groupBy("size", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    )
    part_pairs = F.expr("transform(sequence(0, parts - 1), i -> least(i, p) * parts + greatest(i, p))")
    blocks = known.join(mixed, "key")
    low = blocks.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOW_KEYS).alias("low"))
    parted = blocks.join(sketches.select("node", "n"), "node").withColumn("parts", _parts(percent)).withColumn("p", part).select("node", "key", F.explode(part_pairs).alias("part"), "component")
    pairs = materialise(_possible(parted.join(sketches.join(low, "node"), "node"), percent, pairs=True).distinct(), "ngram-pairs")
    # The set of a meets those of all its b; a star of many is split, with a in every part.
    split = F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.count(F.lit(1)) * F.first("na") / ELEMENTS)).cast("int")
    stars = pairs.join(pairs.groupBy("a").agg(split.alias("parts")), "a").withColumn("part", F.expr("cast(pmod(xxhash64(b), parts) as int)"))
    two = stars.select(F.col("b").alias("node"), F.col("a").alias("key"), "part", F.col("cb").alias("component")).unionByName(
        stars.select(F.col("a").alias("node"), F.col("a").alias("key"), "part", F.col("ca").alias("component")).distinct()
    )
    rest = links
    if not pairs.isEmpty():
        rest = materialise(links.unionByName(_linked(base, two, order, k, percent)), "ngram-all-links")

    final = connected_components(rest, "a", "b")
    rep = records.select("doc_id", *same).join(classes, same, "left").select("doc_id", "n", "node")
    return rep.join(final, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one whose doc_id is smallest.

    Rows without doc_id stay. Of repeated rows with one doc_id and one text all stay or go together.
    """
    gone = ngram_components(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
