"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text accepts every string that occurs in it. A document is parsed from
left to right into the longest strings that occur in the labelled text; the language that needs the fewest phrases,
normalised by the cost of naming a phrase and the length of the document, wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.common import held_alone, slices

UNDETERMINED = "und"
#: Bounds of the labelled sample, per language: rows, and characters of the one excerpt taken from each.
SAMPLE_ROWS = 96
EXCERPT = 512
#: Rows of all languages together; with many languages each has fewer, LEAST_ROWS at least, so that the models stay in bounds.
TOTAL_ROWS, LEAST_ROWS = 4096, 8
#: Parses that go on side by side in numpy steps; the rests of the longest texts are parsed one by one.
LANES = 400
#: Cells up to which transitions lie in one plain table; where many characters are known, they lie in a hash table instead.
PLAIN_CELLS = 1 << 25


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Suffix automaton over small integers: for each state, the next state by symbol; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Absent(dict):
    def __missing__(self, key: int) -> int:
        return -1


class Steps:
    """Transitions of all automata by state + symbol, where states are multiples of the number of symbols; -1 where none is.

    one(key) looks up a single step, many(keys) an array of them.
    """

    def __init__(self, keys: np.ndarray, to: np.ndarray, cells: int):
        if cells <= PLAIN_CELLS:
            table = np.full(cells, -1, dtype=np.int32)
            table[keys] = to
            self.one, self.many = memoryview(table).__getitem__, table.__getitem__
            return
        self.one, self.many = Absent(zip(keys.tolist(), to.tolist(), strict=True)).__getitem__, self._many
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int64)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            self.keys[slot[free]] = keys[free]  # of those that want one slot, one gets it
            got = self.keys[slot[rest]] == keys[rest]
            self.to[slot[rest[got]]] = to[rest[got]]
            rest = rest[~got]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _many(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        to = np.where(held == keys, self.to[slot], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slot[rest] = at = (slot[rest] + 1) & self.mask
            held, wanted = self.keys[at], keys[rest]
            to[rest] = np.where(held == wanted, self.to[at], -1)
            rest = rest[(held != wanted) & (held >= 0)]
        return to


class Model:
    """Automata of all languages, the characters that they know and the cost of a phrase in each."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {k: self.plain("\n".join(samples[k])) for k in self.languages}
        known = np.unique(np.concatenate([np.zeros(0, dtype=np.uint32), *texts.values()]))
        self.other = len(known)  # what a character is that no language has
        self.width = self.other + 1
        self.symbol = np.full(0x110000, self.other, dtype=np.int32)
        self.symbol[known] = np.arange(len(known))
        keys, to, roots, states = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [], 0
        for k in self.languages:
            step = automaton(self.symbol[texts[k]].tolist())
            roots.append(states * self.width)
            source = np.repeat(np.arange(len(step)), [len(out) for out in step])
            keys.append((states + source) * self.width + np.fromiter((c for out in step for c in out), np.int64, len(source)))
            to.append((states + np.fromiter((t for out in step for t in out.values()), np.int64, len(source))) * self.width)
            states += len(step)
        self.root = np.array(roots, dtype=np.int64)
        self.steps = Steps(np.concatenate(keys), np.concatenate(to), states * self.width)
        self.cost = np.array([np.log2(max(len(texts[k]), 2)) for k in self.languages])

    @staticmethod
    def plain(text: str) -> np.ndarray:
        """Lower-cased code points, with every run of other characters than letters as one blank."""
        points = code_points(text.lower())
        letter = letters()[points]
        keep = letter | np.r_[True, letter[:-1]]
        return np.where(letter, points, 32)[keep]

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(texts, languages): phrases of each text, a range of the symbols; texts are ordered by falling length."""
        n = len(self.languages)
        state = np.tile(self.root, len(starts))
        root, count = state.copy(), np.zeros(len(state), dtype=np.int64)
        enough = -(-LANES // n)
        together = int(lengths[enough - 1]) if len(lengths) >= enough else 0
        active = np.searchsorted(-lengths, -np.arange(1, together + 1), side="right")
        for t, m in enumerate(active.tolist()):
            symbol = np.repeat(symbols[starts[:m] + t], n)
            to = self.steps.many(state[: m * n] + symbol)
            dead = np.flatnonzero(to < 0)
            if len(dead):
                count[dead] += state[dead] != root[dead]  # a phrase ends before this character, which begins the next one
                again = self.steps.many(root[dead] + symbol[dead])
                count[dead] += again < 0  # a character that the language lacks is a phrase of its own
                to[dead] = np.where(again < 0, root[dead], again)
            state[: m * n] = to
        for i in range(int(np.count_nonzero(lengths > together))):
            for k in range(n):
                lane = i * n + k
                for at in range(together, int(lengths[i]), 1 << 20):
                    part = symbols[starts[i] + at : starts[i] + min(at + (1 << 20), int(lengths[i]))]
                    ended, state[lane] = self.parsed(part.tolist(), int(state[lane]), int(root[lane]))
                    count[lane] += ended
        return (count + (state != root)).reshape(-1, n)

    def parsed(self, symbols: list[int], state: int, root: int) -> tuple[int, int]:
        """(phrases that end, state after the last symbol) of one parse in one language."""
        step, n = self.steps.one, 0
        for c in symbols:
            to = step(state + c)
            if to < 0:
                n += state != root
                to = step(root + c)
                if to < 0:
                    n, to = n + 1, root
            state = to
        return n, state

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """((texts, languages) bits per character, number of letters in each text)."""
        plain = [self.plain(t) for t in texts]
        n_letters = np.array([int(np.count_nonzero(x != 32)) for x in plain])
        size = np.array([len(x) for x in plain])
        symbols = self.symbol[np.concatenate([np.zeros(0, dtype=np.uint32), *plain])]
        order = np.argsort(-size, kind="stable")
        total = np.zeros((len(texts), len(self.languages)))
        total[order] = self.phrases(symbols, (np.cumsum(size) - size)[order], size[order])
        return total * self.cost / np.maximum(size, 1)[:, None], n_letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score from 0.5 to 1 or 0 without letters, phrases' bits per character) of each text.

        Where naming each character among those that are known takes fewer bits than the phrases do, no language explains a text.
        """
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.inf)
        bits, n_letters = self.entropies(texts)
        best = bits.argmin(axis=1)  # ties: the first language by name
        first = bits[np.arange(len(texts)), best]
        second = np.partition(bits, 1, axis=1)[:, 1] if len(self.languages) > 1 else np.full(len(texts), np.inf)
        score = np.where(np.isinf(second), 1.0, second / np.maximum(first + second, 1e-300))
        score = np.where(n_letters > 0, score, 0.0)
        return [self.languages[i] if k else UNDETERMINED for i, k in zip(best, n_letters, strict=True)], score, first


def model_of(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    """One per task process: the sample is small to send, the automata are built where they are used."""
    return held_alone(("language", samples), lambda: Model(dict(samples)))


def labelled_sample(docs: DataFrame, text_col: str, lang_col: str, key, rows: int = SAMPLE_ROWS, excerpt: int = EXCERPT) -> tuple:
    """Per language, one excerpt of each of about `rows` rows: those with the smallest hash, cut at a place that the hash gives.

    Rows are first counted per language from the label column alone; at most `rows` excerpts per language reach the driver.
    Every label is learned, however small its share; from TOTAL_ROWS / rows labels on, each has fewer rows, LEAST_ROWS at least.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    labelled = docs.where(lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"), F.xxhash64(key, text).alias("hash"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    number = sizes.agg(F.count("*").alias("labels"))
    bound = F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(rows), F.floor(F.lit(TOTAL_ROWS) / F.col("labels")))).cast("int")
    sizes = sizes.crossJoin(F.broadcast(number)).select("lang", "n", bound.alias("bound"))
    draw = F.pmod("hash", F.lit(1 << 30)) / F.lit(float(1 << 30))
    low = labelled.join(F.broadcast(sizes), "lang").where(draw < F.col("bound") * 1.5 / F.col("n"))
    at = F.pmod(F.shiftright("hash", 20), F.greatest(F.length("text") - excerpt, F.lit(0)) + 1).cast("int") + 1
    taken = low.select("lang", "bound", "hash", F.substring(F.col("text"), at, F.lit(excerpt)).alias("part"))
    drawn = taken.groupBy("lang").agg(F.first("bound").alias("bound"), F.sort_array(F.collect_set(F.struct("hash", "part"))).alias("parts"))
    kept = drawn.select("lang", F.slice("parts", F.lit(1), F.col("bound")).alias("parts"))
    return tuple(sorted((r["lang"], tuple(p["part"] for p in r["parts"])) for r in kept.collect()))


def identify(docs: DataFrame, samples: tuple, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred, lang_score, lang_bits and lang_known added by a model of labelled_sample()'s result; see Model.predict.

    Whole texts are parsed. Null texts and texts without a letter are `und` with score 0; without labelled text all are.
    lang_known says that there is a language and that it explains the text: it takes fewer bits than naming each character does.
    Other columns pass through unchanged, but for columns of the four names, which are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_bits", "lang_known")]
    plain = docs.select(*kept)
    schema = StructType(list(plain.schema.fields)).add("lang_pred", "string").add("lang_score", "double").add("lang_bits", "double").add("lang_known", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            model = model_of(samples)
            lang, score, bits = model.predict([x or "" for x in part.column(text_col).to_pylist()])
            known = (score > 0) & (bits <= np.log2(model.width))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), *map(pa.array, (score, bits, known))], schema.names)

    return plain.mapInArrow(run, schema)
