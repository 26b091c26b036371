"""Near-duplicates by SimHash fingerprints, found through Golay-code fuzzy hashing.

A fingerprint is cut into segments of 21, 21 and 22 bits. Of two fingerprints that differ in at most 3 bits, two of the
three segments differ in at most one bit each. Each segment is decoded to its nearest Golay codeword and, where it lies
3 bits away, to the five next ones; for words one bit apart, the nearest codeword of one is among the near ones of the
other. So one row per pair of segments on one side and up to 36 on the other meet in a plain equality join for every link,
and each meeting is then verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from docloom.llm import golay
from docloom.llm.common import ROWS_A_FILE, SLICE_BYTES, cut_lineage, held_alone, hot_keys, lookup, slices, text_bytes, words_of
from docloom.llm.components import components

SEED = 42
#: Low bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Parts into which the rows of a frequent key are dealt.
SALTS = 16
#: Shingles that are put last because they are frequent, and shingles counted at a time to find them; any choice gives all pairs.
FREQUENT, BLOCK = 100_000, 1 << 21
#: Narrow rows that a row with counters, or with a text, counts for, where files are cut by their size: 50,000 and 1,000 a file.
COUNTERS_A_FILE, TEXTS_A_FILE = 10, 500
#: Counters of a set of shingles, a byte each, and the largest number in them.
COUNTERS, FULL = 128, 255
#: Bits that tell which texts are fetched, so at most 2 MB are broadcast; texts whose bit another one has set come along for nothing.
MARKS = 1 << 24


def _lanes() -> np.ndarray:
    """For each byte, a 64-bit word whose eight bytes are its bits: words can then be added as eight counters."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


LANES = _lanes()


def shingle_hashes(data: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of the text, A-Z lower-cased, repeats included, in blocks; texts with fewer words are one shingle."""
    kept: list[bytes] = []
    many = False
    for words in words_of(data.lower()):
        words = kept + words
        if len(words) >= width:
            many = True
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            yield np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        kept = words[-(width - 1) :] if width > 1 else []
    if not many and kept:
        yield np.array([xxh64_intdigest(b" ".join(kept), SEED)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set; eight one-byte counters are added at a time, up to 255 rows."""
    lanes = LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes, of which so many have each bit set, as a signed long."""
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(data: bytes, width: int = 3) -> int:
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(data, width):
        counts += bit_counts(hashes)
        n += len(hashes)
    return majority(counts, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc, fp): the 64-bit SimHash of each whole text as a signed long; null and wordless texts have 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return with_fingerprints(rows, "text", width).select("doc", "fp")


def with_fingerprints(docs: DataFrame, text_col: str = "text", width: int = 3, of=fingerprint) -> DataFrame:
    """The rows with their fingerprint, or what `of` gives instead, as column fp."""
    schema = StructType(list(docs.drop("fp").schema.fields)).add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            fps = pa.array([of(x, width) for x in text_bytes(part.column(text_col))], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, fps], schema.names)

    return docs.drop("fp").mapInArrow(run, schema)


def _segment(fps: np.ndarray, low: int, width: int) -> np.ndarray:
    return ((fps.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _keys(near: bool):
    """Rows (key, fp) of fingerprints: one key per pair of segments, or all near ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                fps = batch.column("fp").slice(start, 4096).to_numpy(zero_copy_only=False)
                decoded = [(golay.near_indices if near else golay.nearest_index)(_segment(fps, *s)).reshape(len(fps), -1) for s in SEGMENTS]
                for tag, (i, j) in enumerate(combinations(range(3), 2)):
                    left, right = decoded[i][:, :, None], decoded[j][:, None, :]
                    key = (tag << 24) | (left << 12) | right
                    row, a, b = np.nonzero((left >= 0) & (right >= 0))
                    yield pa.RecordBatch.from_arrays([pa.array(key[row, a, b].astype(np.int32)), pa.array(fps[row])], ["key", "fp"])

    return run


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b) with a < b: all pairs of different fingerprints that differ in at most `max_bits` (3 or fewer) bits.

    fps: column fp, distinct. Rows of a key that holds more than a thousandth of all rows are dealt to `SALTS` parts.
    """
    if max_bits > 3:
        raise ValueError("segments are decoded for at most 3 differing bits")
    one = fps.select("fp").mapInArrow(_keys(False), "key int, fp long").withColumnRenamed("fp", "x")
    many = fps.select("fp").mapInArrow(_keys(True), "key int, fp long").withColumnRenamed("fp", "y")
    hot = F.broadcast(cut_lineage(hot_keys(one, "key")).withColumn("hot", F.lit(True)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).otherwise(0)
    one = one.join(hot, "key", "left").select("key", "x", salt.alias("salt"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    many = many.join(hot, "key", "left").select("key", "y", F.explode(salts).alias("salt"))
    close = (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits)
    found = one.hint("shuffle_hash").join(many, (one.key == many.key) & (one.salt == many.salt) & close)
    return cut_lineage(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _grouped(rows: DataFrame, edges: DataFrame, by: str = "fp") -> DataFrame:
    """The rows, with doc and `by` among their columns, and label and component; edges (a, b) join values of `by`."""
    values = rows.groupBy(by).agg(F.min("doc").alias("least"))
    labels = components(edges).select(F.col("node").alias(by), "label")
    group = cut_lineage(values.join(labels, by, "left").select(by, "least", F.coalesce("label", by).alias("label")))
    tops = group.groupBy("label").agg(F.min("least").alias("component"))
    known = cut_lineage(lookup(group.select(by, "label"), tops, "label").select(by, "label", "component"))
    return lookup(rows, known, by).select(*rows.columns, "label", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc, fp, label, component): each row's fingerprint, and the smallest fingerprint and id that it reaches over links.

    Null texts and texts without words have fingerprint 0 and link like any other; rows with a null id take part, but their
    id names no component unless no other is there. Equal rows stay equal rows; an empty table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, width))
    return _grouped(rows, links(rows.select("fp").distinct(), max_bits))


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """The different shingle hashes of a text in rising order."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(data, width)]))


def identity(hashes: np.ndarray) -> int:
    """One number for all texts with the same set of shingles, as a signed long; 0 without words."""
    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def counters(hashes: np.ndarray) -> bytes:
    """How many of the hashes have each remainder modulo COUNTERS, a byte each; FULL stands for itself and all larger numbers."""
    return np.minimum(np.bincount((hashes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS), FULL).astype(np.uint8).tobytes()


def _described(width: int):
    """Rows (doc, key, fp, node, size, counts) of texts: fingerprint, identity(), and size and counters() of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_alone("near copies", tuple)  # nothing, in place of an earlier stage's model
        for part in slices(batches):
            fps, nodes, sizes, counts = [], [], [], []
            for data in text_bytes(part.column("text")):
                hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(data, width)])
                fps.append(majority(bit_counts(hashes) if len(hashes) else np.zeros(64, dtype=np.int64), len(hashes)))
                hashes = np.unique(hashes)
                nodes.append(identity(hashes))
                sizes.append(len(hashes))
                counts.append(counters(hashes))
            columns = [part.column("doc"), part.column("key"), *(pa.array(x, pa.int64()) for x in (fps, nodes, sizes)), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "fp", "node", "size", "counts"])

    return run


def _frequent(texts: DataFrame, width: int) -> np.ndarray:
    """The most frequent shingles, at most `FREQUENT`, in falling order; counted in blocks, where they must come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for batch in batches:
            for data in (x for part in slices([batch]) for x in text_bytes(part.column("text"))):
                block.append(shingle_set(data, width).view(np.int64))
                size += len(block[-1])
                if size >= BLOCK:
                    yield counted(block)
                    block, size = [], 0
        if block:
            yield counted(block)

    def counted(block: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(block), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values[n > 1]), pa.array(n[n > 1])], ["token", "n"])

    top = texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = top.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    return found.column("token").to_numpy()


def _prefixes(frequent: np.ndarray, width: int, similarity: float):
    """Rows (token, node, size, place): the first shingles of each set, the frequent ones last, that two similar sets can't both miss."""
    order = np.argsort(frequent)
    known = frequent[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            tokens, nodes, sizes, places = [], [], [], []
            for data in text_bytes(part.column("text")):
                found = shingle_set(data, width)
                hashes, n = found.view(np.int64), len(found)
                many = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                last = known[at] == hashes if len(known) else np.zeros(n, dtype=bool)
                rare = hashes[~last][:many]
                rest = frequent[np.sort(order[at[last]])[::-1][: many - len(rare)]] if len(rare) < many else hashes[:0]
                tokens += [rare, rest]
                nodes.append(np.full(many, identity(found)))
                sizes.append(np.full(many, n))
                places.append(np.arange(many))
            columns = [np.concatenate(x).astype(np.int64) for x in (tokens, nodes, sizes, places)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "node", "size", "place"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by token, place and node, those whose token several nodes have, once each, with the first one's node, size and place.

    The first one has the fewest rarer shingles, so it is the one with the fewest edits among copies of a text.
    """
    names = ["token", "node", "size", "place"]
    rest, first = np.zeros((4, 0), dtype=np.int64), None

    def out(rows: np.ndarray, hubs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows, *hubs[1:])], [*names, "hub", "hub_size", "hub_place"])

    for batch in batches:
        rows = np.concatenate([rest, np.stack([batch.column(c).to_numpy() for c in names])], axis=1)
        if not rows.shape[1]:
            continue
        rows = rows[:, np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]]
        token = rows[0]
        starts = np.r_[True, token[1:] != token[:-1]]
        hubs = rows[:, np.maximum.accumulate(np.where(starts, np.arange(len(token)), 0))]
        if first is not None and first[0] == token[0]:
            hubs[:, token == token[0]] = first[:, None]
        again = ~starts | np.r_[~starts[1:], False]
        again[0] |= first is not None and first[0] == token[0]
        again[-1] = False  # known with the next batch
        yield out(rows[:, again], hubs[:, again])
        # the last row waits; it belongs to a run before it when its hub is another row
        rest = rows[:, -1:]
        first = hubs[:, -1] if (hubs[:, -1] != rows[:, -1]).any() else None
    if rest.shape[1] and first is not None:
        yield out(rest, first[:, None])


def _possible(similarity: float):
    """Rows (a, b) of those whose counters leave it open that the sets have this similarity: no set shares more than the lesser number in each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "counts"):
            left, right = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, COUNTERS) for c in ("counts", "of"))
            both = np.minimum(left, right)
            least = similarity / (1 + similarity) * (part.column("size").to_numpy() + part.column("of_size").to_numpy()) - 1e-9
            keep = (both.sum(axis=1, dtype=np.int64) >= least) | (both == FULL).any(axis=1)
            yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _marked(words: np.ndarray):
    """Of rows with a key, those whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("key").to_numpy() & (MARKS - 1)
            yield batch.filter(pa.array((words[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) == 1))

    return run


def _marks(keys: DataFrame) -> np.ndarray:
    """MARKS bits in words of 64, one set for each key."""
    words = np.zeros(MARKS >> 6, dtype=np.uint64)
    bit = F.col("key").bitwiseAND(F.lit(MARKS - 1))
    found = keys.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def _alike(width: int, similarity: float):
    """Rows (a, b) of those whose sets of shingles have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keep, last, left = [], None, None
            for x, data, of in zip(part.column("a").to_pylist(), text_bytes(part.column("text")), text_bytes(part.column("of")), strict=True):
                if x != last:
                    last, left = x, shingle_set(data, width)
                both = np.sort(np.concatenate([left, shingle_set(of, width)]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(common / (len(both) - common) >= similarity)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_node(width: int):
    """Rows (node, text) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            nodes = [identity(shingle_set(x, width)) for x in text_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), part.column("text")], ["node", "text"])

    return run


def _fingerprint_edges(rows: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): nodes whose texts have fingerprints that differ in at most `max_bits` bits, over one node for each fingerprint."""
    held = cut_lineage(rows.select("node", "fp").distinct())
    first = cut_lineage(held.groupBy("fp").agg(F.min("node").alias("first")))
    same = lookup(held, first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = links(first.select("fp"), max_bits)
    left = found.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
    both = left.join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.union(both.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a <> b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, max_bits: int = 3) -> DataFrame:
    """(doc, key, fp, node, label, component) as near_duplicates() gives them, for copies that share `similarity` of their shingles as well.

    Texts are linked whose fingerprints differ in at most `max_bits` bits, all of them, as in near_duplicates(); and those whose sets of
    shingles have the Jaccard similarity, which at 0.8 lie ten bits of 64 apart, so fingerprints don't find them. key is Spark's
    xxhash64 of the text, by which a row is found again where ids clash; node is identity(), and label is the smallest one reached.

    For the sets, shingles are put in one order for all texts, the frequent ones last. Of two similar sets, the first shingle that both
    have is among the first fifth (at 0.8) of each, and the shingles from there on must suffice. First each text is compared with one
    holder of each such shingle, then all pairs that are still in different components are. Pairs whose counters rule the
    similarity out need no texts; every other comparison is of the whole sets, and exact. Nulls, ties and repeats are as there.
    docs is read several times, so it should be a table.
    """

    def sides(pairs: DataFrame, some: DataFrame, rows: int, **names: str) -> DataFrame:
        left = cut_lineage(lookup(pairs, some.withColumnRenamed("node", "a"), "a"), rows)
        return lookup(left, some.select(F.col("node").alias("b"), *(F.col(k).alias(v) for k, v in names.items())), "b")

    def needed(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        n = COUNTERS_A_FILE * pairs.count()
        some = cut_lineage(rows.select("node", "size", "counts").join(needed(pairs), "node", "left_semi").dropDuplicates(["node"]), n)
        both = sides(pairs, some, n, size="of_size", counts="of").select("a", "b", "size", "counts", "of_size", "of")
        pairs = cut_lineage(both.mapInArrow(_possible(similarity), "a long, b long"), n)
        n = TEXTS_A_FILE * pairs.count()
        nodes = cut_lineage(needed(pairs), n)
        marks = _marks(rows.select("node", "key").join(nodes, "node", "left_semi"))
        # only the texts that are needed are dealt and made different, to as many tasks as they fill
        held = texts.select("key", "text").mapInArrow(_marked(marks), "key long, text string").dropDuplicates(["key", "text"]).select("text").mapInArrow(_with_node(width), "node long, text string")
        some = cut_lineage(held.join(nodes, "node", "left_semi").dropDuplicates(["node"]), n)
        both = sides(pairs, some, n, text="of").select("a", "b", "text", "of")
        return cut_lineage(both.mapInArrow(_alike(width, similarity), "a long, b long"), n)

    def may(n, i, m, j):
        least = F.lit(similarity / (1 + similarity)) * (n + m) - 1e-9
        return F.least(n - i, m - j) >= least

    text, c = F.col(text_col), F.col
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))
    rows = cut_lineage(texts.mapInArrow(_described(width), "doc long, key long, fp long, node long, size long, counts binary"))
    known = cut_lineage(_fingerprint_edges(rows, max_bits))

    first = texts.select("text").mapInArrow(_prefixes(_frequent(texts, width), width, similarity), "token long, node long, size long, place long")
    schema = "token long, node long, size long, place long, hub long, hub_size long, hub_place long"
    shared = cut_lineage(first.repartition("token").sortWithinPartitions("token", "place", "node").mapInArrow(_shared, schema))
    stars = shared.where((c("node") != c("hub")) & may(c("size"), c("place"), c("hub_size"), c("hub_place")))
    edges = known.union(alike(stars.select(c("node").alias("x"), c("hub").alias("y"))))

    labels = components(edges).select("node", "label")
    held = shared.drop("hub", "hub_size", "hub_place").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = cut_lineage(held, shared.count())
    mixed = held.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    held = held.join(mixed, "token", "left_semi")
    hot = F.broadcast(cut_lineage(hot_keys(held, "token")).withColumn("hot", F.lit(True)))
    held = held.join(hot, "token", "left")
    salt = F.when(c("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(c("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    one = held.select("token", salt.alias("salt"), c("node").alias("x"), c("size").alias("n"), c("place").alias("i"), c("label").alias("k"))
    many = held.select("token", F.explode(salts).alias("salt"), c("node").alias("y"), c("size").alias("m"), c("place").alias("j"), c("label").alias("l"))
    pairs = one.join(many, ["token", "salt"]).where((c("x") < c("y")) & (c("k") != c("l")) & may(c("n"), c("i"), c("m"), c("j")))
    return _grouped(rows.select("doc", "key", "fp", "node"), edges.union(alike(pairs.select("x", "y"))), "node")
