"""Katz backoff language model over words: bigrams back off to unigrams, unigrams to one class of unknown words.

Counts are discounted by Good-Turing up to a count of K, larger ones by a small share, so that every history keeps mass for
words not seen after it; the backoff weight is that mass over what the unigrams give to those words, so that the
probabilities after each history sum to one. Tables are kept in hash partitions: the count tables of bigrams and of unigrams
by the second word, the history table by the first. A text's log-probability is a sum, so each partition adds its part to
each text, and a text's parts meet once at the end.

Rows that move are blobs of sorted, narrow and compressed columns, one per task and partition. Words that hold more than a
quarter of a partition's share of all tokens are counted beforehand and dealt out by both words of the bigram; what must meet
with such a history goes to as many partitions as its tokens fill, so no partition grows with the input.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docloom.llm.common import cut_lineage, slices, text_bytes, words_of

#: Largest count that Good-Turing discounts, and the share taken from larger ones.
K, SHARE = 5, 1e-3
#: The end of a text, which is also the history of its first word; no word contains a line end.
END = np.uint64(xxh64_intdigest(b"\n"))
BLOCK_TOKENS = 3 << 19
#: Text bytes per partition of the tables, parts in which a task goes through a partition, and texts per final group.
PARTITION_BYTES, PARTS, GROUP_TEXTS = 32 << 20, 16, 4096
#: Words that hold this share of a partition's tokens are dealt out; a history that does has parts of a quarter of a partition.
HOT_SHARE = 0.25
#: Most frequent words that each partition names; which words are dealt out doesn't change the results.
NAMED = 1000
TOKENS, TEXTS, HISTORIES, PENDING, WORDS, SUMS = range(6)
MOVED = "bucket long, part int, kind int, payload binary"
SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(*columns: np.ndarray) -> bytes:
    """Columns in the narrowest type, byte by byte plane, compressed."""
    heads, bodies = [], []
    for c in columns:
        if c.dtype.kind in "iu" and len(c) and c.min() >= 0:
            c = c.astype(np.min_scalar_type(c.max()))
        heads.append((c.dtype.str, len(c)))
        bodies.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() if len(c) else b"")
    head = json.dumps(heads).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(bodies))


def unpack(payload: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for kind, n in json.loads(data[4:at]):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return out


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, code of each)."""
    return np.unique(values, return_inverse=True)


class Sums:
    """Columns summed by key, merged whenever twice as many rows are held as there were keys."""

    def __init__(self, least: int = 500_000):
        self.parts: list[tuple] = []
        self.held, self.limit, self.least = 0, least, least

    def add(self, keys: np.ndarray, columns: list[np.ndarray]) -> None:
        self.parts.append((keys, [c.astype(np.min_scalar_type(c.max())) if c.dtype.kind == "i" and len(c) else c for c in columns]))
        self.held += len(keys)
        if self.held > self.limit:
            self.merge()

    def merge(self) -> tuple[np.ndarray, list[np.ndarray]] | None:
        if not self.parts:
            return None
        if len(self.parts) > 1:
            keys, at = coded(np.concatenate([k for k, _ in self.parts]))
            columns = []
            for column in zip(*(c for _, c in self.parts), strict=True):
                total = np.bincount(at, np.concatenate(column), len(keys))
                columns.append(total if column[0].dtype.kind == "f" else total.astype(np.int64))
            self.parts, self.held = [], 0
            self.limit = max(self.least, 2 * len(keys))
            self.add(keys, columns)
        return self.parts[0]


def counted(w: np.ndarray, v: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct triples of three code columns in order, and how often each occurs."""
    sizes = [int(c.max()) + 1 for c in (w, v, t)]
    if sizes[0] * sizes[1] * sizes[2] < 1 << 63:
        key, n = np.unique((w * sizes[1] + v) * sizes[2] + t, return_counts=True)
        rest, t = np.divmod(key, sizes[2])
        return *np.divmod(rest, sizes[1]), t, n
    order = np.lexsort((t, v, w))
    w, v, t = w[order], v[order], t[order]
    first = np.flatnonzero(np.r_[True, (np.diff(w) != 0) | (np.diff(v) != 0) | (np.diff(t) != 0)])
    return w[first], v[first], t[first], np.diff(np.r_[first, len(w)])


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discount of the counts 0 to K, and of all larger ones, from n[r], the number of things counted r times.

    A count whose ratio isn't between 0 and 1, as in small data, is discounted by half a count.
    """
    out = np.full(K + 2, 1 - SHARE)
    out[0] = 1.0
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (good - common) / (1 - common) if common != 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def capped(counts: np.ndarray) -> np.ndarray:
    """Counts up to K, larger ones as K + 1."""
    return np.minimum(counts, K + 1).astype(np.int64)


def spectrum_of(counts: np.ndarray) -> np.ndarray:
    """How many counts are 0, 1, ..., K + 1, and larger."""
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)


def hashed(data: bytes) -> Iterator[np.ndarray]:
    """Hashes of a text's tokens in blocks, the end after the last word."""
    for words in words_of(data.lower()):
        yield np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    yield np.array([END])


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], [x.split()[0] for x in MOVED.split(", ")])


def place(words: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """(partition, part of it) of word hashes."""
    return (words % np.uint64(partitions)).astype(np.int64), (words // np.uint64(partitions) % np.uint64(PARTS)).astype(np.int64)


def spread_over(counts: np.ndarray, tokens: int, partitions: int) -> np.ndarray:
    """Partitions that each frequent history's tokens are dealt to, by its count."""
    return np.clip(np.ceil(counts / max(tokens, 1) * partitions / HOT_SHARE).astype(np.int64), 1, partitions)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, for things that are dealt by both."""
    with np.errstate(over="ignore"):
        h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


# --- unigram counts -------------------------------------------------------------------------------------------------------


def _count(partitions: int):
    """Training texts to blobs of (word, count), by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket, _ = place(words, partitions)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(partitions + 1))
            rows = [(b, 0, WORDS, pack(words[r], n[r])) for b in np.unique(bucket).tolist() if len(r := order[bounds[b] : bounds[b + 1]])]
            return _table(rows).combine_chunks().to_batches()[0]

        size = 0
        for batch in slices(batches):
            for data in text_bytes(batch.column("text")):
                for tokens in hashed(data):
                    held.append(tokens)
                    size += len(tokens)
                    if size >= BLOCK_TOKENS:
                        yield out()
                        size = 0
        if held:
            yield out()

    return run


def _counted(group: pa.Table) -> pa.Table:
    """Tokens, types, counts of counts and the most frequent words of one partition."""
    parts = [unpack(p.as_py()) for p in group.column("payload")]
    words, code = coded(np.concatenate([p[0] for p in parts]))
    n = np.bincount(code, np.concatenate([p[1] for p in parts])).astype(np.int64)
    top = np.lexsort((words, -n))[:NAMED]
    times = spectrum_of(n)
    columns = [[int(n.sum())], [len(n)], [times.tolist()], [words[top].view(np.int64).tolist()], [n[top].tolist()]]
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tokens", "types", "times", "words", "counts"])


# --- bigrams ----------------------------------------------------------------------------------------------------------------


def _bigrams(partitions: int, hot: np.ndarray):
    """Texts to blobs of (word, history, text, count), by partition of the word, or of both where the word is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, row = TaskContext.get().partitionId() << 38, 0
        held: list[tuple] = []
        texts: list[tuple] = []

        def tokens_moved() -> Iterator[tuple]:
            lengths = np.array([len(h[0]) for h in held])
            rows, t = coded(np.array([h[1] for h in held]))
            t = np.repeat(t, lengths - 1)
            words, code = coded(np.concatenate([h[0] for h in held]))
            held.clear()
            ends = np.cumsum(lengths)
            w, v = np.delete(code, ends - lengths), np.delete(code, ends - 1)  # each piece starts with its first word's history
            del code
            w, v, t, n = counted(w, v, t)
            spread = np.isin(words, hot)[w]
            bucket, part = place(np.where(spread, mixed(words[w], words[v]), words[w]), partitions)
            where = bucket * PARTS + part
            order = np.argsort(where, kind="stable")
            ends = np.flatnonzero(np.r_[np.diff(where[order]) != 0, True]) + 1
            for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True):
                at = order[a:b]
                wd, wi = coded(w[at])
                vd, vi = coded(v[at])
                td, ti = coded(t[at])
                lengths = np.bincount(wi)
                starts = np.cumsum(lengths) - lengths
                steps = np.diff(vi, prepend=0)
                steps[starts] = vi[starts]
                yield int(bucket[at[0]]), int(part[at[0]]), TOKENS, pack(words[wd], lengths, words[vd], steps, rows[td], ti, n[at])

        def out() -> pa.RecordBatch:
            moved = list(tokens_moved()) if held else []
            if texts:
                columns = [np.array(c) for c in zip(*texts, strict=True)]
                groups = columns[0] // (2 * GROUP_TEXTS)
                for g in np.unique(groups).tolist():
                    moved.append((g % partitions, 0, TEXTS, pack(*(c[groups == g] for c in columns))))
                texts.clear()
            return _table(moved).combine_chunks().to_batches()[0]

        size = 0
        for batch in slices(batches):
            held_out = batch.column("held_out").to_pylist()
            for doc, data, out_of in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text")), held_out, strict=True):
                number = 2 * (base + row) + out_of  # the last bit says that the text is held out
                row += 1
                last, n = END, 0
                for tokens in hashed(data):
                    if not len(tokens):
                        continue
                    held.append((np.r_[last, tokens], number))
                    last = tokens[-1]
                    n += len(tokens)
                    size += len(tokens)
                    if size >= BLOCK_TOKENS:
                        yield out()
                        size = 0
                texts.append((number, doc or 0, doc is None, n))
        if held or texts:
            yield out()

    return run


class Part:
    """The tokens of one part of a partition, with the counts that they were seen with in training."""

    def __init__(self, payloads: list[bytes], hot: np.ndarray, hot_counts: np.ndarray):
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for p in payloads:
            words, lengths, histories, steps, rows, t, n = unpack(p)
            v = np.cumsum(steps.astype(np.int64))
            lengths = lengths.astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            v -= np.repeat(np.r_[0, v[starts[1:] - 1]], lengths)
            for into, c in zip(columns, (np.repeat(words, lengths), histories[v], rows[t].astype(np.int64), n.astype(np.int64)), strict=True):
                into.append(c)
        self.words, self.w = coded(np.concatenate(columns[0]))
        self.histories, self.v = coded(np.concatenate(columns[1]))
        self.rows, self.t = coded(np.concatenate(columns[2]))
        self.n = np.concatenate(columns[3])
        train = self.n * (1 - (self.rows & 1))[self.t]
        pairs, pair = coded(self.w * len(self.histories) + self.v)
        self.pair_w, self.pair_v = np.divmod(pairs, len(self.histories))
        self.pair_n = np.bincount(pair, train).astype(np.int64)
        self.seen = self.pair_n[pair]
        self.word_n = np.bincount(self.w, train).astype(np.int64)
        self.is_hot = np.isin(self.words, hot)
        self.word_n[self.is_hot] = hot_counts[np.searchsorted(hot, self.words[self.is_hot])]

    def by_text(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.t, values * self.n, len(self.rows))

    def followers(self) -> tuple[np.ndarray, ...]:
        """Per history seen in training: words after it by bigram count 1..K, by unigram count 1..K, and the sum of larger unigram counts."""
        seen = self.pair_n > 0
        v, a, c = self.pair_v[seen], self.pair_n[seen], self.word_n[self.pair_w[seen]]
        kept, v = coded(v)
        size = (len(kept), K + 2)
        by_pair = np.bincount(v * (K + 2) + capped(a), minlength=size[0] * size[1]).reshape(size)
        by_word = np.bincount(v * (K + 2) + capped(c), minlength=size[0] * size[1]).reshape(size)
        large = np.bincount(v, np.where(c > K, c, 0), len(kept)).astype(np.int64)
        return self.histories[kept], *by_pair[:, 1 : K + 1].T, *by_word[:, 1 : K + 1].T, large


def parts_of(group: pa.Table, hot: np.ndarray, hot_counts: np.ndarray) -> Iterator[Part]:
    kinds, parts = group.column("kind").to_numpy(), group.column("part").to_numpy()
    for part in range(PARTS):
        at = np.flatnonzero((kinds == TOKENS) & (parts == part))
        if len(at):
            yield Part([group.column("payload")[int(i)].as_py() for i in at], hot, hot_counts)


def _spectrum(hot: np.ndarray, hot_counts: np.ndarray):
    """Counts of bigram counts, and the follower counts of frequent histories, of one partition: rows (history, numbers)."""

    def run(group: pa.Table) -> pa.Table:
        times, rows = np.zeros(K + 3, dtype=np.int64), {}
        for part in parts_of(group, hot, hot_counts):
            times += spectrum_of(part.pair_n)
            history, *numbers = part.followers()
            for i in np.flatnonzero(np.isin(history, hot)).tolist():
                rows[int(history[i])] = rows.get(int(history[i]), 0) + np.array([c[i] for c in numbers])
        keys = pa.array([None, *np.array(list(rows), dtype=np.uint64).view(np.int64).tolist()], pa.int64())
        return pa.table([keys, pa.array([times.tolist(), *(x.tolist() for x in rows.values())], pa.list_(pa.int64()))], ["history", "numbers"])

    return run


def _scored(partitions: int, hot: np.ndarray, hot_counts: np.ndarray, parts_of_hot: np.ndarray):
    """Sums per text, to the group of the text; followers, words and tokens whose bigram is new, to the partition of the history."""

    def run(group: pa.Table) -> pa.Table:
        out = [tuple(r.values()) for r in group.filter(pc.equal(group.column("kind"), TEXTS)).to_pylist()]
        for i, (bucket, part, kind, payload) in enumerate(out):
            out[i] = (-1 - int(unpack(payload)[0][0]) // (2 * GROUP_TEXTS), part, kind, payload)
        texts, histories = Sums(), Sums()
        for part in parts_of(group, hot, hot_counts):
            count = part.word_n[part.w]
            seen = part.seen > 0
            sums = [part.by_text(np.log10(count + 1.0)), part.by_text(np.log10(np.maximum(count, 1.0))), part.by_text(np.log10(np.maximum(part.seen, 1.0)))]
            whole = [part.by_text((count > 0).astype(float)), *(part.by_text((capped(part.seen) == r).astype(float)) for r in range(1, K + 2))]
            texts.add(part.rows, sums + [x.astype(np.int64) for x in whole])
            history, *numbers = part.followers()
            rare = ~np.isin(history, hot)
            histories.add(history[rare], [c[rare] for c in numbers])
            known = np.flatnonzero((part.word_n > 0) & ~part.is_hot)
            for b, at in _dealt(place(part.words[known], partitions)[0]):
                out.append((b, 0, WORDS, pack(part.words[known[at]], part.word_n[known[at]])))
            new = np.flatnonzero(~seen)
            history, rows = part.histories[part.v[new]], part.rows[part.t[new]]
            bucket, _ = place(history, partitions)
            often = np.flatnonzero(np.isin(history, hot))
            parts = parts_of_hot[np.searchsorted(hot, history[often])]
            bucket[often] = (bucket[often] + (mixed(history[often], rows[often].astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)) % partitions
            for b, at in _dealt(bucket):
                keys, v = coded(history[at])
                out.append((b, 0, PENDING, pack(keys, v, rows[at], part.n[new[at]], count[new[at]])))
        if merged := texts.merge():
            rows, columns = merged
            for g, at in _dealt(rows // (2 * GROUP_TEXTS)):
                out.append((-1 - g, 0, SUMS, pack(rows[at] - 2 * g * GROUP_TEXTS, *(c[at] for c in columns))))
        if merged := histories.merge():
            history, numbers = merged
            for b, at in _dealt(place(history, partitions)[0]):
                out.append((b, 0, HISTORIES, pack(history[at], *(c[at] for c in numbers))))
        return _table(out)

    return run


def _dealt(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1) if len(order) else []:
        yield int(buckets[at[0]]), at


def weights(followers: np.ndarray, counts: np.ndarray, pair_cut: np.ndarray, word_cut: np.ndarray, tokens: int) -> np.ndarray:
    """Backoff weight of each history: the mass that discounting leaves over what unigrams give to words not seen after it."""
    by_pair, by_word, large = followers[:, :K], followers[:, K : 2 * K], followers[:, 2 * K]
    r = np.arange(1, K + 1)
    left = (by_pair * r * (1 - pair_cut[1 : K + 1])).sum(axis=1) + SHARE * (counts - (by_pair * r).sum(axis=1))
    given = ((by_word * r * word_cut[1 : K + 1]).sum(axis=1) + large * word_cut[K + 1]) / tokens
    return left / counts / (1 - given)


def unigram(counts: np.ndarray, cut: np.ndarray, tokens: int, unknown: float) -> np.ndarray:
    return np.where(counts > 0, cut[capped(counts)] * counts / max(tokens, 1), unknown)


def _by_kind(group: pa.Table) -> dict[int, list[list[np.ndarray]]]:
    found: dict[int, list] = {}
    for kind, payload in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist(), strict=True):
        if payload is not None:
            found.setdefault(kind, []).append(unpack(payload))
    return found


def _merged(bucket: int, found: dict[int, list[list[np.ndarray]]]) -> pa.Table:
    """The texts of one group and the sums that the partitions have for them, as one row each."""
    texts = [np.concatenate(c) for c in zip(*found[TEXTS], strict=True)]
    sums = np.zeros((K + 5, 2 * GROUP_TEXTS))
    for at, *columns in found.get(SUMS, []):
        for total, c in zip(sums, columns, strict=True):
            total[at] += c  # a text occurs once in each
    return _table([(bucket, 0, TEXTS, pack(*texts)), (bucket, 0, SUMS, pack(np.arange(2 * GROUP_TEXTS), *sums))])


def _backed_off(hot: np.ndarray, hot_counts: np.ndarray, word_cut: np.ndarray, tokens: int, unknown: float):
    """Scores of the tokens whose bigram is new, summed per text, to the group of the text; sums of such a group are merged."""

    def run(group: pa.Table) -> pa.Table:
        found, bucket = _by_kind(group), group.column("bucket")[0].as_py()
        if bucket < 0:
            return _merged(bucket, found)
        if PENDING not in found:
            return _table([])
        pair_cut = discounts(np.array(group.column("times")[0].as_py()[: K + 3]))
        frequent = [(x["history"], x["numbers"]) for x in group.column("frequent").to_pylist() if x is not None]
        pending = found[PENDING]
        history = np.concatenate([p[0][p[1]] for p in pending])
        rows, n, count = (np.concatenate([p[i].astype(np.int64) for p in pending]) for i in (2, 3, 4))
        table = found.get(HISTORIES, [])
        keys, at = coded(np.concatenate([*(t[0] for t in table), np.array([x for x, _ in frequent], dtype=np.int64).view(np.uint64)]))
        followers = np.zeros((len(keys), 2 * K + 1), dtype=np.int64)
        np.add.at(followers, at, np.concatenate([*(np.stack(t[1:], axis=1).astype(np.int64) for t in table), np.array([x for _, x in frequent], dtype=np.int64).reshape(-1, 2 * K + 1)]))
        words = found.get(WORDS, [])
        known = np.concatenate([*(w[0] for w in words), hot])
        known_n = np.concatenate([*(w[1].astype(np.int64) for w in words), hot_counts])
        order = np.argsort(known)
        known, known_n = known[order], known_n[order]
        asked, h = coded(history)
        is_known = np.isin(asked, known)
        counts = np.zeros(len(asked), dtype=np.int64)
        counts[is_known] = known_n[np.searchsorted(known, asked[is_known])]
        alpha = np.ones(len(asked))  # a history that training lacks leaves all to the unigrams
        alpha[is_known] = weights(followers[np.searchsorted(keys, asked[is_known])], counts[is_known], pair_cut, word_cut, tokens)
        score = np.log10(alpha[h]) + np.log10(unigram(count, word_cut, tokens, unknown)) + np.log10(np.maximum(counts[h], 1))
        texts, t = coded(rows)
        score = np.bincount(t, score * n)
        groups = texts // (2 * GROUP_TEXTS)
        return _table([(-1 - int(g), 0, PENDING, pack(texts[groups == g] - 2 * GROUP_TEXTS * g, score[groups == g])) for g in np.unique(groups)])

    return run


def _final(tokens: int, types: int):
    """Scores of a group of texts from the sums and the scores of new bigrams."""

    def run(group: pa.Table) -> pa.Table:
        found = _by_kind(group)
        number, doc, no_doc, n = (c.astype(np.int64) for c in found[TEXTS][0])
        cut = np.log10(discounts(np.array(group.column("times")[0].as_py()[: K + 3])))
        _, plus_one, history, seen, known, *by_count = found[SUMS][0]
        score = seen - history + sum(c * cut[r] for r, c in enumerate(by_count, 1))
        for at, extra in found.get(PENDING, []):
            score[at] += extra
        at = number % (2 * GROUP_TEXTS)
        plain = plus_one[at] - n * np.log10(tokens + types + 1)
        columns = [pa.array(doc, mask=no_doc.astype(bool)), pa.array((number & 1).astype(bool)), n, known[at].astype(np.int64), np.full(len(n), tokens), plain, score[at]]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [x.split()[0] for x in SCORES.split(", ")])

    return run


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: (id, held_out, n_tokens, n_known, train_tokens, base_score, score), log10 probabilities of whole texts.

    The model learns from the rows that are not held_out (null: learned from). Null and empty texts are one end token. A word
    that training lacks has the unigrams' left-over mass. Repeated rows are separate texts; null ids stay null. Without
    training texts every token has the unknown class's probability of one. Columns other than the id and the text are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    partitions = int(size // PARTITION_BYTES) + 1
    counted = rows.where(~F.col("held_out")).select("text").mapInArrow(_count(partitions), MOVED).groupBy("bucket")
    counted = cut_lineage(counted.applyInArrow(_counted, "tokens long, types long, times array<long>, words array<long>, counts array<long>"))
    times = [F.sum(F.col("times")[r]).alias(f"t{r}") for r in range(K + 3)]
    sums = counted.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), *times).first()
    tokens, types = sums["n"] or 0, sums["v"] or 0
    often = counted.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).where(F.col("x.counts") * partitions >= F.lit(HOT_SHARE) * tokens)
    often = often.select("x.words", "x.counts").collect()  # at most 1 / HOT_SHARE rows per partition
    hot = np.array([r["words"] for r in often], dtype=np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, hot_counts = hot[order], np.array([r["counts"] for r in often], dtype=np.int64)[order]
    spectrum = np.array([sums[f"t{r}"] or 0 for r in range(K + 3)])
    word_cut = discounts(spectrum)
    small = spectrum[1 : K + 1] * np.arange(1, K + 1)
    unknown = float(((1 - word_cut[1 : K + 1]) * small).sum() + SHARE * (tokens - small.sum())) / tokens if tokens else 1.0

    moved = rows.mapInArrow(_bigrams(partitions, hot), MOVED)
    numbers = moved.groupBy("bucket").applyInArrow(_spectrum(hot, hot_counts), "history long, numbers array<long>")
    numbers = numbers.groupBy("history").agg(F.array(*(F.sum(F.get("numbers", F.lit(i))) for i in range(2 * K + 1))).alias("numbers"))
    times = numbers.where(F.col("history").isNull()).select(F.col("numbers").alias("times"))
    parts_of_hot = spread_over(hot_counts, tokens, partitions)
    first = place(hot, partitions)[0]
    where = docs.sparkSession.createDataFrame(list(zip(hot.view(np.int64).tolist(), first.tolist(), parts_of_hot.tolist(), strict=True)), "history long, first long, n long")
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    frequent = numbers.join(F.broadcast(where), "history").select("history", "numbers", "first", at.alias("i")).select(
        ((F.col("first") + F.col("i")) % partitions).alias("bucket"), F.lit(0).alias("part"), F.lit(-1).alias("kind"), F.lit(None).cast("binary").alias("payload"),
        F.struct("history", "numbers").alias("frequent"),
    )
    parts = moved.groupBy("bucket").applyInArrow(_scored(partitions, hot, hot_counts, parts_of_hot), MOVED)
    parts = parts.withColumn("frequent", F.lit(None).cast(frequent.schema["frequent"].dataType)).union(frequent)
    parts = parts.crossJoin(F.broadcast(times)).groupBy("bucket").applyInArrow(_backed_off(hot, hot_counts, word_cut, tokens, unknown), MOVED)
    return parts.crossJoin(F.broadcast(times)).groupBy("bucket").applyInArrow(_final(tokens, types), SCORES)
