"""Importance resampling and substring dedup against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.test_llm import ODD, SCHEMA

from docloom.llm import importance, substrings
from docloom.llm import queries as llm
from docloom.llm.common import table

CLASHING = [(*r, *range(8)) for r in ODD]
CLASHES = ", ".join(f"{c} int" for c in ("doc", "name", "packed", "weight", "rank", "bucket", "own", "windows"))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").toPandas()


# --- 11 ---


def brute_features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute_resampled(docs, target, buckets=10_000):
    bucket = {}

    def crc(feature):
        return bucket.setdefault(feature, zlib.crc32(feature.encode()) % buckets)

    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            counts.update(map(crc, brute_features(text)[1]))
    whole, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (whole + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        words, found = brute_features(text)
        weight = sum(gain[crc(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(found), weight, score, len(words)))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = 25 * len(fit) // 100
    place = {id(r): k + 1 for k, r in enumerate(fit) if k < drawn}
    return sorted(((*r[:4], place.get(id(r))) for r in rows), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_importance_matches_brute_force(spark, sf_dir, documents):
    docs = list(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True))
    target = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    assert got(llm.op11_importance(spark, sf_dir)) == brute_resampled(docs, target)


def test_importance_awkward_rows(spark):
    docs = spark.createDataFrame(CLASHING, f"{SCHEMA}, {CLASHES}")
    target = spark.createDataFrame([("the end of",), (None,), ("",)], "text string")
    assert got(importance.resample(docs, target)) == brute_resampled([r[:2] for r in ODD], ["the end of", None, ""])
    none = spark.createDataFrame([], SCHEMA)
    assert got(importance.resample(docs, none)) == brute_resampled([r[:2] for r in ODD], [])
    assert importance.resample(none, target).count() == 0


@pytest.mark.parametrize("text", ["Ab1 céD-x" * 400, "x" * 3000, "one  two\x00three " * 300, " " * 2000, "a b"])
def test_importance_pieces_of_long_texts_agree(text):
    """Any cut of a text gives the features of the whole."""
    words, found = brute_features(text)
    data = text.encode()
    assert [w.decode() for part in importance.pieces(data, 64) for w in part] == words
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    sizes = importance.PIECE_BYTES
    try:
        importance.PIECE_BYTES = 64
        cut = [importance.features(w, r, o, 1000)[1] for _, r, w, o in importance.blocks(iter([batch]))]
    finally:
        importance.PIECE_BYTES = sizes
    assert Counter(np.concatenate(cut).tolist()) == Counter(zlib.crc32(f.encode()) % 1000 for f in found)


# --- 12 ---


def brute_deduplicated(docs, width=13):
    split = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in docs]
    first = {}
    for i, words in split:
        for k in range(len(words) - width + 1) if i is not None else ():
            window = tuple(words[k : k + width])
            first[window] = min(i, first.get(window, i))
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - width + 1) if i is not None else ():
            if first[tuple(words[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_match_brute_force(spark, sf_dir, documents):
    docs = list(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True))
    found = got(llm.op12_substrings(spark, sf_dir))
    assert found == brute_deduplicated(docs) and sum(r[2] for r in found) > 1000


def collage(seed, n=80):
    """Texts of few words, runs, and passages of earlier texts, so that windows repeat at all lengths and offsets."""
    draw, docs = random.Random(seed), []
    for i in range(n):
        size, mode = draw.choice([0, 1, 12, 13, 14, 50, 400, 900]), draw.random()
        if mode < 0.2:
            words = [draw.choice("ab") for _ in range(size)]
        elif mode < 0.4:
            words = ["a"] * size
        elif mode < 0.6 or not docs:
            words = [f"w{draw.randrange(40)}" for _ in range(size)]
        else:
            source = (draw.choice(docs)[1] or "").split(" ")
            low = draw.randrange(len(source) + 1)
            words = [f"x{draw.randrange(9)}" for _ in range(5)] + source[low : low + draw.randrange(600)] + [f"y{draw.randrange(9)}" for _ in range(5)] + source[:50]
        docs.append((draw.choice([None, 7, 8]) if draw.random() < 0.1 else i, " ".join(words)))
    return [*docs, (1000, None), (1001, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_of_collages(spark, seed):
    docs = collage(seed)
    assert got(substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute_deduplicated(docs)


def test_substrings_of_texts_longer_than_a_piece(spark):
    """Repeats that end before, lie across and begin after the cut of a long text."""
    draw = random.Random(5)
    cut = substrings.PIECE_WORDS
    words = [f"w{draw.randrange(5000)}" for _ in range(cut + 2000)]
    other = words[cut - 700 : cut + 300] + ["z"] + words[cut + 900 : cut + 913] + ["z"] + words[100:112]
    docs = [(5, " ".join(words)), (2, " ".join(other)), (9, " ".join(words[: cut + 1000]))]
    assert got(substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == brute_deduplicated(docs)


def test_substrings_awkward_rows(spark):
    docs = spark.createDataFrame(CLASHING, f"{SCHEMA}, {CLASHES}")
    assert got(substrings.dedup(docs)) == brute_deduplicated([r[:2] for r in ODD])
    assert substrings.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_windows_have_equal_anchors():
    """A window's anchor depends on nothing but its words."""
    draw = np.random.default_rng(3)
    seen = {}
    for _ in range(60):
        passage = [b"w%d" % x for x in draw.integers(0, draw.choice([1, 2, 5, 50]), draw.integers(13, 60))]
        for _ in range(2):
            words = [b"w%d" % x for x in draw.integers(0, 3, draw.integers(0, 30))] + passage + [b"w%d" % x for x in draw.integers(0, 3, draw.integers(0, 30))]
            p, _ = substrings.numbered([words], [0], 13)
            at, anchor = p.anchors()
            for i, name in zip(at.tolist(), anchor.tolist(), strict=True):
                assert seen.setdefault(tuple(words[i : i + 13]), name) == name


def test_frequent_passages_send_a_row_a_block():
    """A name that all documents of a block hold is sent once; the others are known to be repeats without meeting any."""
    out = substrings.Gathered()
    name = np.array([3] * 500 + [4], dtype=np.uint64)
    out.add(name, name << np.uint64(40), np.r_[np.arange(500)[::-1], 7])
    rows = out.batch().to_pylist()
    assert [(r["name"], r["doc"], r["other"]) for r in rows if r["own"] is None] == [(3, 0, True), (4, 7, False)]
    assert sorted(r["doc"] for r in rows if r["own"] is not None) == list(range(1, 500))
