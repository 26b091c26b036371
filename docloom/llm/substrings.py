"""Substring dedup by recompression: runs and pairs of words are named in rounds until repeats share high-level symbols.

A round names maximal runs of one symbol, then pairs of a left and a right symbol (a bit of the name decides which it is). A
name is a hash of what it stands for, so all tasks give equal substrings the same names without exchanging a dictionary, and a
substring's interior is named alike wherever it stands. Two kinds of symbols then go through Spark rounds that group them by name:

1. Units: a symbol of `UNIT_LEVEL` rounds with what follows it as far as the windows that start in it reach. Where a
   smaller document holds the same unit, all those windows are repeats. Anchors: the least of the highest symbols that a window
   determines whatever surrounds it. Equal windows have equal anchors, so a window whose anchor only one document holds isn't repeated.
2. The windows that both leave open, by the hash of their words, compared exactly one by one.

Names of units and windows are compared on 95 bits. Tasks join equal names of a block of texts first, and send one row for
each: all but the block's smallest holder are known to be repeats there and then, so that a passage in a third of all documents sends one row a block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from docloom.llm.common import slices, text_bytes, words_of

#: Rounds of recompression after which symbols make units, symbols of the first round that make an anchor, and words that are parsed in one go.
UNIT_LEVEL, ANCHOR, PIECE_WORDS = 9, 4, 1 << 16
#: Bytes of text whose equal names are joined before they are sent.
BLOCK_BYTES = 4 << 20
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
INVERSE = np.uint64(pow(int(A), -1, 1 << 64))


def salt(number: int) -> np.uint64:
    return np.uint64(number * 0x165667B19E3779F9 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, tag: int) -> np.ndarray:
    """Names of pairs; the order of a and b counts."""
    return mix(mix(a * A + salt(tag)) + b * B)


def named_words(words: list[bytes]) -> np.ndarray:
    """(words, 2): 128 bits per word; each different word is hashed once."""
    if not words:
        return np.zeros((0, 2), dtype=np.uint64)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    known = np.frombuffer(b"".join(map(xxh3_128_digest, coded.dictionary.to_pylist())), dtype=np.uint64).reshape(-1, 2)
    return known[coded.indices.to_numpy()]


class Level:
    """Symbols after some rounds: name, first word, piece."""

    def __init__(self, name: np.ndarray, start: np.ndarray, piece: np.ndarray):
        self.name, self.start, self.piece = name, start, piece

    def round(self, number: int) -> tuple[Level, np.ndarray, np.ndarray, np.ndarray]:
        """(next level, run of each symbol, symbol of each run, whether a run is a right one): runs named, then pairs of a left and a right one."""
        n = len(self.name)
        opens = np.ones(n, dtype=bool)
        opens[1:] = (self.name[1:] != self.name[:-1]) | (self.piece[1:] != self.piece[:-1])
        run = np.cumsum(opens) - 1
        at = np.flatnonzero(opens)
        name, piece, start = self.name[at], self.piece[at], self.start[at]
        if len(at) < n:
            length = np.diff(np.r_[at, n])
            many = np.flatnonzero(length > 1)
            name[many] = joined(name[many], length[many].astype(np.uint64), 2 * number + 1)
        right = (mix(name + salt(number)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(at), dtype=bool)
        pair[:-1] = ~right[:-1] & right[1:] & (piece[1:] == piece[:-1])
        two = np.flatnonzero(pair)
        name[two] = joined(name[two], name[two + 1], 2 * number + 2)
        stays = np.ones(len(at), dtype=bool)
        stays[two + 1] = False
        return Level(name[stays], start[stays], piece[stays]), run, np.cumsum(stays) - 1, right


class Parse:
    """Pieces of texts parsed together. Window i starts at word i; `whole` says whether it lies in one piece."""

    def __init__(self, names: np.ndarray, piece: np.ndarray, width: int):
        n = len(names)
        if not 0 < width < 16:
            raise ValueError("windows are of 1 to 15 words")
        self.width, self.n, self.words = width, n, names
        self.whole = np.zeros(n, dtype=bool)
        if n >= width:
            self.whole[: n - width + 1] = piece[width - 1 :] == piece[: n - width + 1]

        self.base = Level(names[:, 0], np.arange(n), piece)
        self.first = self.sums = None

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts of whole windows, name of each one's anchor): the least run of `ANCHOR` neighbouring symbols of the first round among those that the
        window's words determine; where there are fewer, the least word.

        Of a window's runs the first and the last may go on outside. Of the symbols between, a right one in front might belong to a pair
        with what comes before it, and a left one at the end to one with what follows; all others are formed alike wherever the words stand.
        """
        level, run, symbol, right = self.first = self.first or self.base.round(0)
        starts = np.flatnonzero(self.whole)
        low = run[starts] + 1
        low += np.r_[right, False][low]
        high = run[starts + self.width - 1]  # runs before the last one
        high -= ~right[high - 1] & (high > 0)
        ends = np.r_[symbol, len(level.name)]
        low, high = ends[np.minimum(low, len(symbol))], np.where(high > 0, symbol[high - 1] + 1, 0)
        anchor = np.empty(len(starts), dtype=np.uint64)
        some = high - low >= ANCHOR
        names = level.name
        for k in range(1, ANCHOR):
            names = joined(names[:-1], level.name[k:], 3000 + k)
        anchor[some] = _least(names, low[some], high[some] - ANCHOR + 1)
        rest = starts[~some]
        anchor[~some] = _least(mix(self.words[:, 0] + B), rest, rest + self.width)
        return starts, anchor

    def units(self) -> None:
        """Sets unit, unit_check, unit_start, unit_end, where the end is that of the windows that start in a unit and lie in its piece."""
        level = (self.first or self.base.round(0))[0]
        for number in range(1, UNIT_LEVEL):
            level = level.round(number)[0]
        self._units(level)

    def _units(self, level: Level) -> None:
        n = self.n
        end = np.r_[level.start[1:], n]
        reach = end - 1 + self.width  # end of the last window that starts in the symbol
        last = np.searchsorted(level.start, reach - 1, "right") - 1  # the symbol that holds its last word
        ok = (reach <= n) & (level.piece[np.minimum(last, len(level.piece) - 1)] == level.piece) if n else np.zeros(0, dtype=bool)
        i, j = np.flatnonzero(ok), last[ok]
        unit = level.name[i]
        step = 0
        while len(at := np.flatnonzero(i + step < j)):
            step += 1
            unit[at] = joined(unit[at], level.name[i[at] + step], 1001)
        self.unit, self.unit_start, self.unit_end = mix(unit + B), level.start[i], end[i]
        self.unit_check = self.checks(level.start[i], end[j])

    def checks(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A second name of the words of each range: a polynomial of their other halves, wherever the range stands."""
        if self.sums is None:
            self.sums = np.r_[np.uint64(0), np.cumsum(self.words[:, 1] * np.cumprod(np.full(self.n, A)))]
        place = np.cumprod(np.full(self.n + 1, INVERSE))
        return mix((self.sums[high] - self.sums[low]) * place[low])

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(name, check) of the windows that start there, from all their words: names of 1, 2, 4 ... words make up those of the width."""
        size, at, name, powers = 1, starts, None, self.words[:, 0]
        while size <= self.width:
            if self.width & size:
                name = powers[at] if name is None else joined(name, powers[at], 2001)
                at = at + size
            powers = joined(powers[: max(len(powers) - size, 0)], powers[size:], 2001)
            size *= 2
        return name, self.checks(starts, starts + self.width)


def _least(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least name of each range; no range is empty or longer than 15: minima of 1, 2, 4 and 8 names in a row, two of which cover a range."""
    if not len(low):
        return np.zeros(0, dtype=np.uint64)
    rows = [names]
    for size in (1, 2, 4):
        row, n = rows[-1].copy(), max(len(names) - size, 0)
        row[:n] = np.minimum(row[:n], rows[-1][size:])
        rows.append(row)
    power = np.array([0, 0, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3])[high - low]
    flat, base = np.concatenate(rows), power * len(names)
    return np.minimum(flat[base + low], flat[base + high - (1 << power)])


def pieces(texts: list[bytes], width: int) -> Iterator[tuple[list[list[bytes]], list[int], bool]]:
    """(words of each piece, text of each, whether more follows): many short texts at a time, or a part of a long one. The last
    width - 1 words of a part that more follows are the first of the next, where the windows that start in them lie whole."""
    held, of, n = [], [], 0
    for t, data in enumerate(texts):
        rest: list[bytes] = []
        for words in words_of(data, 1 << 20):
            rest += words
            while len(rest) > PIECE_WORDS:
                yield [rest[:PIECE_WORDS]], [t], True
                rest = rest[PIECE_WORDS - width + 1 :]
        if held and n + len(rest) > PIECE_WORDS:
            yield held, of, False
            held, of, n = [], [], 0
        held.append(rest)
        of.append(t)
        n += len(rest)
    if held:
        yield held, of, False


def numbered(held: list[list[bytes]], of: list[int], width: int) -> tuple[Parse, np.ndarray]:
    """The pieces ready to be parsed, and the text of each word."""
    sizes = [len(x) for x in held]
    piece = np.repeat(np.arange(len(held)), sizes)
    return Parse(named_words([w for x in held for w in x]), piece, width), np.array(of)[piece]


class Gathered:
    """Names of a block with their documents, each name once with the smallest of them."""

    SCHEMA = "name long, check int, doc long, other boolean, own long"

    def __init__(self):
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, name: np.ndarray, check: np.ndarray | None, doc: np.ndarray) -> None:
        """check: of what is compared by its name; an anchor has none, which is 0 here."""
        short = np.zeros(len(name), dtype=np.int32) if check is None else (check >> np.uint64(33)).astype(np.int32) | 1
        self.rows.append((name, short, doc))

    def batch(self) -> pa.RecordBatch:
        """A row per name and block with the block's smallest document, and whether it has others; and of these, which are repeats, a row each
        that meets no other (own is the document there, else null). Rows are in order of documents, which spares disk."""
        name, check, doc = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
        self.rows = []
        order = np.lexsort((doc, check, name))
        name, check, doc = name[order].view(np.int64), check[order], doc[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (check[1:] != check[:-1])][: len(name)]
        fresh = new | np.r_[True, doc[1:] != doc[:-1]][: len(name)]
        name, check, doc, new = name[fresh], check[fresh], doc[fresh], new[fresh]
        others = ~np.r_[new[1:], True][: len(name)] | ~new
        order = np.argsort(doc, kind="stable")
        name, check, doc, new, others = (x[order] for x in (name, check, doc, new, others))
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(check), pa.array(doc), pa.array(others), pa.array(doc, pa.int64(), mask=new)], ["name", "check", "doc", "other", "own"])


def resolved(rows: DataFrame) -> DataFrame:
    """(doc, name, check, repeat) of the names that several documents hold: repeat says whether a smaller one than doc does.

    rows: as Gathered.batch() gives them. A name has a row per block, so no group grows as fast as the number of its holders.
    """
    same = Window.partitionBy("name", "check", "own")
    seen = rows.withColumn("least", F.min("doc").over(same)).withColumn("most", F.max("doc").over(same)).withColumn("several", F.max("other").over(same))
    repeat = F.col("own").isNotNull() | (F.col("doc") > F.col("least"))
    return seen.where((F.col("least") < F.col("most")) | F.col("several")).select("doc", "name", "check", repeat.alias("repeat"))


def _first(width: int):
    """Units and anchors of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BLOCK_BYTES):
            docs, out = part.column("doc").to_numpy(), Gathered()
            for held, of, _ in pieces(text_bytes(part.column("text")), width):
                p, text = numbered(held, of, width)
                at, anchor = p.anchors()
                p.units()
                doc = docs[text[at]]
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])][: len(at)]
                out.add(anchor[new], None, doc[new])
                out.add(p.unit, p.unit_check, docs[text[p.unit_start]])
            yield out.batch()

    return run


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, to spare disk where they move."""
    for part in slices(batches):
        data = pa.array([zlib.compress(x, 1) for x in text_bytes(part.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("doc"), data], ["doc", "packed"])


def _keyed(column: pa.Array) -> np.ndarray:
    """Sorted keys of the names that each row of a column of arrays holds; a null holds none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    names = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.sort(_key(names, np.repeat(np.arange(len(sizes)), sizes)))


def _key(names: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(names + mix(text.astype(np.uint64) * A))


def _among(names: np.ndarray, text: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each name is known for its text."""
    if not len(known):
        return np.zeros(len(names), dtype=bool)
    keys = _key(names, text)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _spread(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a range."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    return np.cumsum(edge[:-1]) > 0


def _repeated(p: Parse, text: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Whether each window starts in a unit that is a repeat."""
    hit = np.flatnonzero(_among(p.unit, text[p.unit_start], repeats))
    return _spread(p.unit_start[hit], p.unit_end[hit], p.n) & p.whole


def _second(width: int):
    """Windows that units leave open and whose anchors other documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = Gathered(), 0
        for part in slices(batches, "packed", BLOCK_BYTES // 4):
            docs, shared, repeats = pc.fill_null(part.column("doc"), 0).to_numpy(), _keyed(part.column("shared")), _keyed(part.column("repeats"))
            for held, of, _ in pieces([zlib.decompress(x) for x in part.column("packed").to_pylist()], width):
                p, text = numbered(held, of, width)
                at, anchor = p.anchors()
                at = at[_among(anchor, text[at], shared)]
                if len(repeats):
                    p.units()
                    at = at[~_repeated(p, text, repeats)[at]]
                out.add(*p.windows(at), docs[text[at]])
                size += len(at)
            if size > PIECE_WORDS:
                yield out.batch()
                size = 0
        yield out.batch()

    return run


class Kept:
    """What is left of a text whose words come in parts."""

    def __init__(self):
        self.digest, self.n, self.removed, self.tail = hashlib.sha256(), 0, 0, np.zeros(0, dtype=bool)

    def add(self, words: list[bytes], gone: np.ndarray | None = None, again: int = 0) -> None:
        """gone: which words go; the last `again` words come again in the next part, where they are judged with what is known here."""
        if gone is not None:
            gone[: len(self.tail)] |= self.tail
            own = len(words) - again
            self.tail, gone, words = gone[own:], gone[:own], words[:own]
        left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone is not None and gone.any() else words
        if left:
            self.digest.update((b" " if self.n > self.removed else b"") + b" ".join(left))
        self.n, self.removed = self.n + len(words), self.removed + len(words) - len(left)


def _last(width: int):
    """What is left of each text."""

    def judge(texts: list[bytes], repeats: pa.Array, windows: pa.Array) -> list[Kept]:
        out, repeated, found = [Kept() for _ in texts], _keyed(repeats), _keyed(windows)
        by_unit, by_window = ([bool(x) for x in c.to_pylist()] for c in (pc.list_value_length(repeats), pc.list_value_length(windows)))
        for t, data in enumerate(texts):
            if not (by_unit[t] or by_window[t]):
                for words in words_of(data):
                    out[t].add(words)
        for units in (False, True):  # texts without repeated units need no parse
            chosen = [t for t in range(len(texts)) if by_unit[t] == units and (units or by_window[t])]
            for held, of, more in pieces([texts[t] for t in chosen], width):
                p, text = numbered(held, [chosen[i] for i in of], width)
                starts = np.zeros(p.n, dtype=bool)
                if units:
                    p.units()
                    starts = _repeated(p, text, repeated)
                left = np.flatnonzero(p.whole & ~starts)
                starts[left[_among(p.windows(left)[0], text[left], found)]] = True
                at = np.flatnonzero(starts)
                gone = _spread(at, at + width, p.n)
                low = 0
                for words, i in zip(held, of, strict=True):
                    out[chosen[i]].add(words, gone[low : low + len(words)], width - 1 if more else 0)
                    low += len(words)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "packed", BLOCK_BYTES // 4):
            found = judge([zlib.decompress(x) for x in part.column("packed").to_pylist()], part.column("repeats"), part.column("windows"))
            counts = [pa.array([f.n for f in found], pa.int64()), pa.array([f.removed for f in found], pa.int64()), pa.array([f.digest.hexdigest() for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc"), *counts], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row: words go where a window of `width` words covers them that also starts in a
    document with a smaller id.

    Windows are judged on the input. Rows of one id are no repeats of each other, and each of them is judged. Rows with a null id are in no order:
    they keep all words and remove none. Null texts and texts without words have no window and the digest of the empty text. Equal
    rows stay equal rows; an empty table gives an empty result. Long texts are parsed in parts, which changes no result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = rows.where(F.col("doc").isNotNull())
    anchor = F.col("check") == 0
    found = resolved(known.mapInArrow(_first(width), Gathered.SCHEMA)).where(anchor | F.col("repeat")).groupBy("doc")
    found = found.agg(F.collect_set(F.when(anchor, F.col("name"))).alias("shared"), F.collect_set(F.when(~anchor, F.col("name"))).alias("repeats"))
    # one query reads texts and names twice, by the same exchanges; in order of id, blocks are the same ones when a task is run again
    asked = rows.mapInArrow(_packed_texts, "doc long, packed binary").join(found.hint("merge"), "doc", "left")
    open_windows = asked.sortWithinPartitions("doc", "packed").mapInArrow(_second(width), Gathered.SCHEMA)
    windows = resolved(open_windows).where("repeat").groupBy("doc").agg(F.collect_set("name").alias("windows"))
    judged = asked.join(windows.hint("merge"), "doc", "left").select("doc", "packed", "repeats", "windows", F.size("shared").alias("asked"))
    return judged.mapInArrow(_last(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")
