"""Quality rules: counts per document, and how far its distributions lie from those of a language.

Two histograms of each document are compared to language references by Jensen-Shannon distance: shares of character
classes, and shares of a language's common words among all words. Documents below a minimum length are not compared.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.common import cut_lineage, held_alone, slices, words_of
from docloom.llm.language import code_points

COMMON_WORDS = 40
#: Shares are counted in millionths, so that sums are exact; medians are found on ten-thousandths, which bounds the values of a histogram.
SHARE, FINE = 1_000_000, 100
#: Largest distance of the character classes, and largest sum of both distances, at which a document still counts as text
#: of a language. One odd histogram alone is common in short clean texts, two are not.
MAX_CHARACTERS, MAX_SUM = 0.3, 0.52
#: Fewest characters and words for the two comparisons.
LEAST_CHARACTERS, LEAST_WORDS = 200, 50
SYMBOLS = "#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CLASSES = ("upper", "vowel", "consonant", "marked lower", "other letter", "digit", "blank", "stop", "shout", "symbol", "other")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Character class of each code point."""

    def kind(c: str) -> int:
        if c.isalpha():
            return 0 if c.isupper() else 4 if not c.islower() else 3 if c > "z" else 1 if c in "aeiou" else 2
        return 5 if c.isdigit() else 6 if c.isspace() else 7 if c in ".,;:" else 8 if c in "!?" else 9 if c in SYMBOLS else 10

    return np.array([kind(chr(i)) for i in range(0x110000)], dtype=np.uint8)


def class_shares(text: str) -> np.ndarray:
    counts = np.bincount(class_table()[code_points(text)], minlength=len(CLASSES))
    return counts / max(1, counts.sum())


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, from 0 to 1) along the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.clip(parts.sum(axis=-1) / 2, 0, 1))


def whole_shares(text: str) -> np.ndarray:
    """class_shares in whole millionths."""
    counts = np.bincount(class_table()[code_points(text)], minlength=len(CLASSES))
    return counts * SHARE // max(1, counts.sum())


class References:
    """Character-class and common-word shares of each language, from the more typical half of its texts."""

    def __init__(self, found: dict[str, tuple[np.ndarray, list[tuple[bytes, int]], int]]):
        """found: for each language the class shares, the common words with their counts, and the number of all words."""
        self.languages = sorted(found)
        self.words, self.shares = [], []
        for k in self.languages:
            _, common, total = found[k]
            share = np.array([n for _, n in common]) / max(1, total)
            self.words.append({w: i for i, (w, _) in enumerate(common)})
            self.shares.append(np.append(share, 1 - share.sum()))
        self.classes = np.array([found[k][0] for k in self.languages]).reshape(-1, len(CLASSES))

    @classmethod
    def of_samples(cls, samples: dict[str, tuple[str, ...]]) -> References:
        """From excerpts, whose first and last words may be cut."""
        found = {}
        for k, excerpts in samples.items():
            shares = np.array([class_shares(x) for x in excerpts])
            far = divergence(shares, np.median(shares, axis=0))
            typical = np.argsort(far, kind="stable")[: max(1, (len(far) + 1) // 2)]
            words = Counter(w for i in typical for w in excerpts[i].lower().encode().split()[1:-1])
            common = sorted(words, key=lambda w: (-words[w], w))[:COMMON_WORDS]
            found[k] = shares[typical].mean(axis=0), [(w, words[w]) for w in common], sum(words.values())
        return cls(found)

    def distances(self, text: str, words: list[bytes]) -> tuple[float, float]:
        """The two distances to the language that is nearest by their sum; 0 without a reference or below the minimum length."""
        if not self.languages or len(text) < LEAST_CHARACTERS:
            return 0.0, 0.0
        by_class = divergence(self.classes, class_shares(text))
        by_word = np.zeros(len(self.languages))
        if len(words) >= LEAST_WORDS:
            seen = Counter(words)
            for k, common in enumerate(self.words):
                n = np.array([seen[w] for w in common])
                by_word[k] = divergence(self.shares[k], np.append(n, len(words) - n.sum()) / len(words))
        best = int(np.argmin(by_class + by_word))
        return float(by_class[best]), float(by_word[best])


def references_of(samples: tuple) -> References:
    return held_alone(("quality", samples), lambda: References.of_samples(dict(samples)))


def learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """References from every labelled text, whole. Only a language's medians, sums and common words reach the driver.

    A language's typical texts are those whose class shares lie no farther from its median shares than half of its texts do.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_alone("quality", tuple)  # nothing, in place of an earlier stage's model
        for part in slices(batches):
            found = [whole_shares(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(found, pa.list_(pa.int32()))], ["lang", "shares"])

    def distance(lang: str, found: np.ndarray) -> np.ndarray:
        return np.floor(divergence(found / SHARE, medians[lang]) * SHARE / FINE).astype(np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            far = [int(distance(k, np.array(x))) for k, x in zip(part.column("lang").to_pylist(), part.column("shares").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(far, pa.int64())], ["lang", "shares", "far"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            seen: dict[str, Counter] = defaultdict(Counter)
            for k, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                if distance(k, whole_shares(text)) <= half[k]:
                    found = text.lower().encode().split()
                    seen[k].update(found)
                    seen[k][None] += len(found)
            rows = [(k, w, n) for k, counted in seen.items() for w, n in counted.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "word", "n"), r, strict=True)) for r in rows], pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())]))

    table = cut_lineage(labelled.mapInArrow(shares, "lang string, shares array<int>"))
    each = [F.get("shares", F.lit(i)) for i in range(len(CLASSES))]
    middle = table.groupBy("lang").agg(F.array(*(F.percentile(F.floor(x / FINE), 0.5) for x in each)).alias("at")).collect()
    medians = {r["lang"]: np.array(r["at"]) * FINE / SHARE for r in middle}
    table = cut_lineage(table.mapInArrow(placed, "lang string, shares array<int>, far long"))
    limits = table.groupBy("lang").agg(F.percentile("far", 0.5).alias("half"))
    half = {r["lang"]: r["half"] for r in limits.collect()}
    typical = table.join(F.broadcast(limits), "lang").where("far <= half")
    sums = {r["lang"]: np.array(r["sums"], float) for r in typical.groupBy("lang").agg(F.array(*map(F.sum, each)).alias("sums")).collect()}
    counted = labelled.mapInArrow(words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("word").isNotNull(), F.desc("n"), "word")
    common = defaultdict(list)
    for r in counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= COMMON_WORDS + 1).orderBy("lang", "place").collect():
        common[r["lang"]].append((r["word"] and bytes(r["word"]), r["n"]))
    return References({k: (x / max(1, x.sum()), common[k][1:], common[k][0][1]) for k, x in sums.items()})


def repeated_words(codes: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    if len(codes) < 4:
        return 0
    n = int(codes.max()) + 1
    pair = codes[:-1] * n + codes[1:]
    if n > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    windows = pair[:-1] * n + codes[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    if len(times) == len(windows):
        return 0
    again = np.flatnonzero(times[which] > 1)
    covered = np.zeros(len(codes), dtype=bool)
    covered[again] = covered[again + 1] = covered[again + 2] = True
    return int(covered.sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """COUNTS of one whole text."""
    data = text.encode()
    code = defaultdict(count().__next__)
    codes = np.concatenate([np.fromiter(map(code.__getitem__, words), np.int64) for words in words_of(data)])
    lines, repeated = set(), 0
    for line in data.split(b"\n"):
        if line in lines:
            repeated += 1
        elif line.strip(BLANKS):
            lines.add(line)
    blanks = sum(map(data.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    return len(codes), len(text) - blanks, sum(map(text.count, SYMBOLS)), repeated, repeated_words(codes)


def judge(docs: DataFrame, references: References | tuple, text_col: str = "text") -> DataFrame:
    """The rows with COUNTS, base_failed, class_distance, word_distance and kept added.

    references: the result of learned(), or (language, excerpts) of a few labelled texts. Null texts count as empty and fail, as all texts below 50 words do.
    Each row is judged alone, so equal rows are judged alike. Columns of the added names are replaced, others pass through.
    """
    added = [*((c, "long") for c in COUNTS), ("base_failed", "boolean"), ("class_distance", "double"), ("word_distance", "double"), ("kept", "boolean")]
    plain = docs.select(*(c for c in docs.columns if c not in dict(added)))
    schema = StructType(list(plain.schema.fields))
    for name, kind in added:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if isinstance(references, References):
            held_alone("quality", tuple)
        refs = references if isinstance(references, References) else references_of(references)
        for part in slices(batches, text_col):
            rows = []
            for text in part.column(text_col).to_pylist():
                n = counts(text or "")
                failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
                far = refs.distances(text, text.lower().encode().split()) if not failed else (0.0, 0.0)
                rows.append((*n, failed, *far, not failed and far[0] <= MAX_CHARACTERS and sum(far) <= MAX_SUM))
            columns = [pa.array(x) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema.names)

    return plain.mapInArrow(run, schema)
