"""Training-data operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.compare import rows, same
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from docloom.llm import bpe, golay, katz, language, packing, quality, secrets, simhash, topk, urls, warc
from docloom.llm import queries as llm
from docloom.llm.common import table, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the " * 30_000 + "end of a very long text"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "one", "en", "a", 3), (5, "one two", "en", "b", 7),
    (6, "Straße Ünï <|endoftext|> 😀 don't", "de", "b", 30), (6, "Straße Ünï <|endoftext|> 😀 don't", "de", "b", 30), (None, "no id at all here", None, "c", 17),
    (7, LONG, "en", "c", len(LONG)), (8, "日本語 テキスト", None, "c", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").toPandas()


def brute_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def test_words_of_blocks_agree():
    data = (" ".join(f"w{i}" for i in range(5000)) + "  \n x").encode()
    for block in (7, 64, 1000, 1 << 20):
        assert [w for part in words_of(data, block) for w in part] == data.split()


# --- 1 ---


def brute_fingerprint(text, width=3):
    words = [w.encode() for w in brute_words(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, near=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= near):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for i, x in zip(ids, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [least.get(x) for x in label]


def test_golay_words_two_bits_apart_share_a_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    flips = np.array([(1 << a) ^ (1 << b) for a, b in rng.integers(0, 23, (4000, 2))])
    near, other = golay.near_indices(words), golay.near_indices(words ^ flips)
    assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(near, other, strict=True))
    one = words ^ (1 << rng.integers(0, 23, 4000))
    assert all(n in set(b) for n, b in zip(golay.nearest_index(words), golay.near_indices(one), strict=True))


def test_simhash_matches_brute_force(spark, sf_dir, documents):
    found = llm.op1_simhash(spark, sf_dir).toPandas().set_index("doc_id")
    fps = np.array([brute_fingerprint(t) for t in documents.text], dtype=np.uint64)
    components = brute_components(fps, documents.doc_id)
    for i, fp, c in zip(documents.doc_id, fps, components, strict=True):
        assert found.loc[i, "fingerprint"] == f"{fp:016x}" and found.loc[i, "component_id"] == c


def test_links_lose_none_in_a_dense_group(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 62)
    fps = np.unique([centre] + [centre ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False)) for _ in range(300)]).astype(np.int64)
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long")).collect()}
    assert got == {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 3}


def test_components_of_a_long_chain(spark):
    from docloom.llm.components import components

    chain = [(i, i + 1) for i in range(100)] + [(200, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


def test_simhash_awkward_rows(odd, empty):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc].append(r)
    assert {by_doc[i][0].component for i in (1, 2, 3)} == {1} and by_doc[1][0].fp == 0
    assert [r.component for r in by_doc[6]] == [6, 6]
    assert simhash.near_duplicates(empty).count() == 0


def test_near_copies_catches_edited_texts(spark, documents):
    base = " ".join(documents.text[documents.text.str.len() > 3000].iloc[0].split()[:300])
    rng = np.random.default_rng(3)
    texts = [base]
    for _ in range(20):
        words = base.split()
        for i in rng.choice(300, 4, replace=False):
            words[i] = f"changed{i}"
        texts.append(" ".join(words))
    others = [t for t in documents.text if len(t) > 400 and base[:40] not in t][:60]
    df = spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string")
    got = {r.doc: r.component for r in simhash.near_copies(df).collect()}
    assert {got[i] for i in range(21)} == {0} and not any(got[i] == 0 for i in range(21, len(got)))


def brute_alike(texts, width=5, similarity=0.8):
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (t.split() for t in texts)]
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) / len(a | b) >= similarity}


def check_near_copies(spark, texts):
    """Components of near_copies() are those of all pairs by brute force; gives the pairs."""
    pairs = brute_alike(texts)
    label = list(range(len(texts)))
    for i, j in pairs:
        low, high = sorted((label[i], label[j]))
        label = [low if x == high else x for x in label]
    got = {r.doc: r.component for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == label
    return pairs


def prose(rng, n, tag="w"):
    return [f"{tag}{i}" for i in rng.integers(0, 10**6, n)]


def test_near_copies_need_no_common_hub(spark):
    rng = np.random.default_rng(4)
    shared, texts = prose(rng, 120, "s"), []
    for _ in range(12):  # two copies whose only unedited words are a passage that unrelated texts hold too
        own = prose(rng, 24)
        for _ in range(2):
            texts.append(" ".join(shared + own[:6] + prose(rng, 1) + own[7:18] + prose(rng, 1)))
    for _ in range(40):
        texts.append(" ".join(shared + prose(rng, int(rng.integers(60, 200)))))
    whole = prose(rng, 300, "c")  # a chain of deletions, whose ends are far apart
    texts += [" ".join(whole[: 300 - 25 * i]) for i in range(8)]
    for i in range(10):  # collages of passages that are similar to none of their sources
        parts = [prose(rng, 80, f"p{i}_") for _ in range(3)]
        texts += [" ".join(parts[0] + parts[1] + parts[2]), *(" ".join(p[:40] + ["x"] + p[43:]) for p in parts), *(" ".join(p) for p in parts)]
    assert check_near_copies(spark, texts)


def test_near_copies_find_short_texts(spark):
    rng = np.random.default_rng(5)
    texts = []
    for n in [50] * 60 + list(range(50, 200, 3)):
        words = prose(rng, n)
        texts.append(" ".join(words))
        other = list(words)
        for at in [n // 2] if n == 50 else rng.choice(n, max(1, n // 60), replace=False):
            other[at] = "edited"
        texts.append(" ".join(other))
    assert len(check_near_copies(spark, texts)) >= 60


def test_near_copies_keep_texts_below_the_similarity(spark):
    rng = np.random.default_rng(6)
    texts = []
    for share in np.linspace(0.7, 0.9, 41):  # the first n words of 200 are shared, the rest is replaced
        words = prose(rng, 204)
        same = round(200 * 2 * share / (1 + share))
        texts += [" ".join(words), " ".join(words[: same + 4] + prose(rng, 200 - same))]
    pairs = check_near_copies(spark, texts)
    assert 10 < len(pairs) < 30


def test_near_copies_link_near_fingerprints_too(spark):
    rng = np.random.default_rng(8)
    passage, texts = prose(rng, 20, "s"), []
    for _ in range(6):  # one passage forty times, and own words: near fingerprints, and sets of which a small part is shared
        texts.append(" ".join(passage * 40 + prose(rng, 60)))
    texts += [" ".join(prose(rng, 200)) for _ in range(10)]
    whole = prose(rng, 200)
    texts += [" ".join(whole), " ".join(whole[:100] + ["edited"] + whole[101:])]  # a copy with far fingerprints
    texts += [" ".join(whole) + "\n", None, ""]  # equal sets, and no words
    fps = [simhash.fingerprint((t or "").encode(), 5) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    alike = brute_alike([t or "" for t in texts])
    assert near - alike and alike - near
    label = list(range(len(texts)))
    for i, j in near | alike:
        low, high = sorted((label[i], label[j]))
        label = [low if x == high else x for x in label]
    found = {r.doc: r for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i].component for i in range(len(texts))] == label and [found[i].fp for i in range(len(texts))] == fps


def test_near_copies_counters_rule_out_no_similar_sets():
    rng = np.random.default_rng(9)
    rows = []
    for n in [1, 3, 50, 400, 4000, 60_000]:
        for share in (0.5, 0.8, 0.81, 0.95, 1.0):
            same = int(np.ceil(2 * share * n / (1 + share)))
            one = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            other = np.unique(np.concatenate([one[:same], rng.integers(0, 1 << 63, n - same, dtype=np.uint64)]))
            one = np.unique(one)
            common = len(np.intersect1d(one, other))
            rows.append((len(rows), common / (len(one) + len(other) - common), len(one), simhash.counters(one), len(other), simhash.counters(other)))
    names = ["a", "b", "size", "counts", "of_size", "of"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    kept = {i for part in simhash._possible(0.8)(iter([batch])) for i in part.column("a").to_pylist()}
    assert kept >= {r[0] for r in rows if r[1] >= 0.8}
    assert not kept & {r[0] for r in rows if r[1] < 0.6 and 50 <= r[2] <= 400}


# --- 2 ---


def test_language_held_out_accuracy(spark, sf_dir, documents):
    found = llm.op2_language(spark, sf_dir).toPandas().merge(documents, on="doc_id")
    held = found[found.held_out]
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert (held.lang == held.lang_pred).mean() > 0.95 and found.score.between(0, 1).all()


def test_language_learns_labels_of_any_share(spark):
    rare = "ŝi ĉiam manĝas ĝustan ĵaŭdan panon kaj trinkas ĥoran akvon"
    data = [(i, f"the cat sat on the mat number {i} and looked at the dog", "en") for i in range(3000)] + [(3000, rare, "eo"), (3001, rare + " hodiaŭ", "eo")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    samples = language.labelled_sample(docs, "text", "lang", "doc_id")
    assert [k for k, _ in samples] == ["en", "eo"] and len(dict(samples)["eo"]) == 2
    got = {r.doc_id: r.lang_pred for r in language.identify(docs.where("doc_id >= 2999"), samples).collect()}
    assert got == {2999: "en", 3000: "eo", 3001: "eo"}


def brute_phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("lanes", [1, 400, 10**9])
def test_language_phrases_match_brute_force(documents, monkeypatch, lanes):
    monkeypatch.setattr(language, "LANES", lanes)
    script = "".join(chr(0x4E00 + 7 * i % 2600) for i in range(3000))  # 2,600 different characters
    samples = {"a": tuple(documents.text[:6]), "b": tuple(documents.text[6:12]), "zh": (script[:1500], script[1500:])}
    model = language.Model(samples)
    assert model.other > 2000
    texts = ["the mat and the hund", "xyz", "d", "", *documents.text[12:40], "the " * 400, script[700:1400] + "the", "".join(reversed(script[:60]))]
    assert max(map(len, texts)) > 2000
    learned = ["".join(map(chr, model.plain("\n".join(samples[k])))) for k in model.languages]
    bits, _ = model.entropies(texts)
    for text, got in zip(texts, bits, strict=True):
        plain = "".join(map(chr, model.plain(text)))
        want = [brute_phrases(plain, s) * np.log2(len(s)) / max(1, len(plain)) for s in learned]
        assert list(got) == pytest.approx(want)
    assert model.predict([script[:20]])[0] == ["zh"]


def test_language_samples_shrink_with_many_labels(spark, monkeypatch):
    monkeypatch.setattr(language, "TOTAL_ROWS", 100)
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text number ', id) as text", "concat('l', id % 5) as lang")
    assert [len(parts) for _, parts in language.labelled_sample(docs, "text", "lang", "doc_id")] == [20] * 5


def test_language_awkward_rows(odd, empty):
    samples = (("de", ("der hund und die katze auf der matte",)), ("en", ("the cat sat on the mat",)))
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd, samples).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "en")} <= got
    assert language.identify(empty, samples).count() == 0
    assert {r.lang_pred for r in language.identify(odd, ()).collect()} == {"und"}
    assert language.labelled_sample(empty, "text", "lang", "doc_id") == ()


# --- 3 ---


def brute_katz(texts, held):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [brute_words((t or "").translate(lower)) + ["\n"] for t in texts]
    c, b, after = Counter(), Counter(), defaultdict(set)
    for t, h in zip(tokens, held, strict=True):
        if not h:
            c.update(t)
            for v, w in zip(["\n", *t], t, strict=False):
                b[v, w] += 1
                after[v].add(w)
    n, v = sum(c.values()), len(c)
    word_cut = katz.discounts(katz.spectrum_of(np.array(list(c.values()), dtype=np.int64)))
    pair_cut = katz.discounts(katz.spectrum_of(np.array(list(b.values()), dtype=np.int64)))
    cut = lambda table, x: table[min(x, katz.K + 1)] * x
    unknown = sum(x - cut(word_cut, x) for x in c.values()) / n if n else 1.0
    p1 = lambda w: cut(word_cut, c[w]) / n if c[w] else unknown
    alpha = lambda h: (1 - sum(cut(pair_cut, b[h, w]) for w in after[h]) / c[h]) / (1 - sum(map(p1, after[h]))) if c[h] else 1.0
    p = lambda h, w: cut(pair_cut, b[h, w]) / c[h] if b[h, w] else alpha(h) * p1(w)
    for h in list(c)[:5]:
        assert sum(p(h, w) for w in c) + alpha(h) * unknown == pytest.approx(1)
    return [(len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(h, w)) for h, w in zip(["\n", *t], t, strict=False))) for t in tokens]


def test_katz_matches_brute_force(spark, sf_dir, documents):
    found = llm.op3_katz(spark, sf_dir).toPandas().set_index("doc_id")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in documents.doc_id]
    for i, h, want in zip(documents.doc_id, held, brute_katz(documents.text, held), strict=True):
        r = found.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, *want[:3])
        assert r.base_score == pytest.approx(want[3], rel=1e-6) and r.score == pytest.approx(want[4], rel=1e-5, abs=1e-4)
    assert found[found.held_out].score.sum() > found[found.held_out].base_score.sum()


def test_katz_deals_frequent_words_to_many_partitions(spark, documents, monkeypatch):
    monkeypatch.setattr(katz, "PARTITION_BYTES", 20_000)
    texts = list(documents.text[:120]) + ["the cat the dog the end " * 400, "a b c the " * 300, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = katz.score(docs, F.col("doc_id") % 3 == 1).toPandas().set_index("id")
    for i, want in enumerate(brute_katz(texts, [i % 3 == 1 for i in range(len(texts))])):
        assert tuple(got.loc[i, ["n_tokens", "n_known", "train_tokens"]]) == want[:3]
        assert got.loc[i, "score"] == pytest.approx(want[4], rel=1e-6) and got.loc[i, "base_score"] == pytest.approx(want[3], rel=1e-6)


def test_katz_awkward_rows(spark, odd, empty):
    docs = [(r[0], r[1]) for r in ODD]
    got = katz.score(odd, F.col("doc_id") == 4).toPandas()
    want = brute_katz([t for _, t in docs], [i == 4 for i, _ in docs])
    assert sorted((r.n_tokens, r.n_known) for r in got.itertuples()) == sorted(w[:2] for w in want)
    assert sorted(round(x, 3) for x in got.score) == pytest.approx(sorted(round(w[4], 3) for w in want), abs=2e-3)
    assert katz.score(empty, F.lit(False)).count() == 0
    assert set(katz.score(odd, F.lit(True)).toPandas().score) == {0.0}


# --- 4 ---


def brute_quality(text):
    words = brute_words(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if brute_words(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_quality_counts_and_verdicts(spark, sf_dir, documents):
    found = llm.op4_quality(spark, sf_dir).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        r, want = found.loc[i], brute_quality(text)
        assert tuple(r[list(quality.COUNTS)]) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    labels = table(spark, sf_dir, "labels").toPandas()
    judged = found[~found.base_failed].merge(labels, left_index=True, right_on="doc_id")
    assert judged[judged.quality == 1].kept.mean() > 0.97
    assert quality.counts("a b c a b c\n\na b c\na b c") == brute_quality("a b c a b c\n\na b c\na b c")


def test_quality_awkward_rows(odd, empty):
    samples = (("en", ("the cat sat on the mat and the dog lay on the rug",)),)
    got = {r.doc_id: r for r in quality.judge(odd, samples).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and got[7].n_repeat_words > 0 and not got[7].kept
    assert quality.judge(empty, samples).count() == 0
    assert all(r.base_failed or r.kept for r in quality.judge(odd, ()).collect())


def test_quality_references_count_every_labelled_text(spark):
    rows = [("en", f"the cat{i} and the dog sat on word{i}") for i in range(1500)] + [("en", "ZZZ 999 ###")] * 300 + [("de", "der hund"), (None, "no label"), ("fr", None)]
    refs = quality.learned(spark.createDataFrame(rows, "lang string, text string"))
    assert refs.languages == ["de", "en"] and set(refs.words[0]) == {b"der", b"hund"}
    shares = sorted([quality.class_shares(t) for k, t in rows[:1800]], key=lambda x: float(quality.divergence(x, np.median([quality.class_shares(t) for _, t in rows[:1800]], axis=0))))
    assert refs.classes.sum(axis=1) == pytest.approx([1, 1]) and refs.classes[1] == pytest.approx(np.mean(shares[:900], axis=0), abs=0.02)
    common = {w: refs.shares[1][i] for w, i in refs.words[1].items()}
    assert common[b"the"] == pytest.approx(2 / 8) and common[b"dog"] == pytest.approx(1 / 8) and b"zzz" not in common
    once = [w for w in common if w.startswith((b"cat", b"word"))]
    assert once and all(common[w] < 1 / 8 / 800 for w in once)  # one of over 800 texts: a sample of 192 rows can't tell


# --- 5 ---


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_probability(model, host, path):
    """The same model by plain sums over the set of hashed n-grams."""
    grams = {f"{mark}{part[i : i + n]}" for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (3, 4, 5) for i in range(len(part) - n + 1)}
    buckets = {zlib.crc32(g.encode()) % 16384 for g in grams}
    return 1 / (1 + math.exp(-(sum(model[0][b] for b in buckets) / math.sqrt(max(1, len(buckets))) + model[1])))


def test_urls(spark, sf_dir):
    model = urls.train(urls.labelled_urls(spark))
    awkward = [(-1, None), (-2, ""), (-3, "nothing"), (-4, "HTTP://EXAMPLE.Org?x"), (-5, "a://b://c/d#e"), (-5, "a://b://c/d#e"), (-6, "x://notexample.org/es/1")]
    awkward += [(-7, "u://com/de/"), (-8, "u://h/" + "a" * 1_000_000), (-9, "u://a.b.EXAMPLE.org/en/1?x"), (-10, "u://example.org/en/#1")]
    pages = table(spark, sf_dir, "pages", "page_id", "url").union(spark.createDataFrame(awkward, "page_id long, url string"))
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    found = urls.judge(pages, model).collect()
    assert len(found) == pages.count()
    for r in found:
        host, path = brute_parts(r.url)
        names = [host.split(".", i)[-1] for i in range(host.count(".") + 1)]
        fits = [k for k in rules if k.split("/", 1)[0] in names and path.startswith("/" + k.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (rules[rule] if rule else "allow" if r.probability >= 0.5 else "block")
        if len(path) < 1000:
            assert r.probability == pytest.approx(brute_probability(model, *brute_parts(r.url)))
    assert llm.op5_urls(spark, sf_dir).columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    clash = urls.judge(pages.withColumn("verdict", F.lit("mine")), model)
    assert {r.verdict for r in clash.collect()} <= {"allow", "block"} and urls.judge(pages.limit(0), model).count() == 0
    assert not urls.train(urls.labelled_urls(spark).limit(0))[0].any()


def test_urls_held_out_accuracy(spark):
    labelled = urls.labelled_urls(spark)
    held = F.crc32(F.col("url").cast("binary")) % 4 == 0
    judged = urls.judge(labelled.where(held), urls.train(labelled.where(~held)), rules=()).collect()
    assert len(judged) > 200 and np.mean([(r.verdict == "allow") == r.keep for r in judged]) > 0.95
    names = [r.url.split("/")[2] for r in labelled.where("keep = 1").collect()]
    model = urls.train(labelled)
    assert np.mean([brute_probability(model, n, "/en/77") >= 0.5 for n in names]) > 0.95


# --- 6 and 9 ---


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def check_pieces(pieces, texts, tokenizer):
    pieces = pieces.copy()
    pieces["doc_id"] = pieces.doc_id.fillna(-1)
    for doc, group in pieces.sort_values(["doc_id", "start"]).groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        copies = group.length.sum() // len(ids)
        assert copies * len(ids) == group.length.sum() and (group.doc_tokens == len(ids)).all()
        covered = np.zeros(len(ids), dtype=int)
        for r in group.itertuples():
            covered[r.start : r.start + r.length] += 1
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert (covered == copies).all()
    sequences = pieces.sort_values(["sequence_id", "offset"])
    assert (sequences.groupby("sequence_id").length.cumsum() - sequences.length == sequences.offset).all()
    total = sequences.groupby("sequence_id").length.sum()
    assert total.max() <= 1024 and all(n & (n - 1) == 0 for n in total)


def test_packing_round_trip(spark, sf_dir, documents, tokenizer):
    check_pieces(llm.op6_packing(spark, sf_dir).toPandas(), dict(zip(documents.doc_id, documents.text, strict=True)), tokenizer)


def test_packing_awkward_rows(odd, empty, tokenizer):
    texts = {-1 if i is None else i: t for i, t, *_ in ODD}
    check_pieces(packing.pack(odd, llm.BYTE_BPE).toPandas().rename(columns={"id": "doc_id"}), texts, tokenizer)
    assert packing.pack(empty, llm.BYTE_BPE).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000 + "x", "a" * 1_000_000, "ab <|endoftext|> " * 20_000])
def test_packing_takes_runs_of_any_length(spark, tokenizer, text):
    docs = spark.createDataFrame([(1, text), (2, "a short one")], "doc_id long, text string")
    check_pieces(packing.pack(docs, llm.BYTE_BPE).toPandas().rename(columns={"id": "doc_id"}), {1: text, 2: "a short one"}, tokenizer)


def test_packing_takes_the_nearest_tail():
    a, b, c = np.arange(10), np.arange(100, 110), np.arange(5, 15)
    first = next(packing.fill([a, b, c], 20))
    assert [x[0] for x in first] == [0, 2]


def test_bpe_matches_the_library(spark, sf_dir, documents, odd, empty, tokenizer):
    import hashlib

    found = llm.op9_bpe(spark, sf_dir).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert found.loc[i, "n_tokens"] == len(ids) and found.loc[i, "ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert found.loc[i, "decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in bpe.round_trip(odd, llm.BYTE_BPE).collect():
        text = next(t for i, t, *_ in ODD if i == r.id) or ""
        assert list(r.ids) == tokenizer.encode(text, add_special_tokens=False).ids and r.decoded == text
    assert bpe.round_trip(empty, llm.BYTE_BPE).count() == 0


def test_bpe_merges_repeats_left_to_right(tokenizer):
    coder = bpe.ByteBpe(llm.BYTE_BPE)
    texts = ["aaaaaaa", "abababab" * 50, "\x00\xff", "ü" * 99, "x" * 5000, "", "a\n\n \n b   c"]
    ids, lengths = coder.encode(texts)
    for text, part in zip(texts, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        assert part.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# --- 7 ---


def test_warc_matches_sql(spark, sf_dir):
    same(spark, sf_dir, llm.op7_warc, llm.ORACLES["op7_warc"])


def test_warc_records(spark):
    html = "<html><head><title> A  b </title></head><body><p>x &amp;lt; y<br>z</p><script>no</script><!-- no --><a href='/q'>q</a></body></html>"
    pages = spark.createDataFrame([(1, "http://h/", html), (1, "http://h/", html), (2, None, None), (3, "", "")], "page_id long, url string, html string")
    responses = warc.responses(pages.withColumn("text", F.lit("mine")))
    got = warc.derive(responses).collect()
    assert len(got) == 8 and {r.refers_to for r in got} == {r.record_id for r in responses.collect()}
    text = next(r for r in got if r.source_id == 1 and r.warc_type == "conversion")
    assert text.block == "x &lt; y\nz\nq" and text.content_length == len(text.block.encode())
    assert text.source_headers == f"Content-Type: text/html; charset=utf-8\nContent-Length: {len(html)}"
    assert "title: A b\r\n" in next(r.block for r in got if r.source_id == 1 and r.warc_type == "metadata")
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


class Reader(HTMLParser):
    """Text of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in warc.HIDDEN:
            self.hidden.append(tag)
        elif not self.hidden and tag in warc.BREAKING:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.hidden.remove(tag)
            self.out.append("" if self.hidden else " ")
        elif not self.hidden and tag in warc.BREAKING:
            self.out.append("\n")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_warc_text_matches_the_standard_parser(spark, sf_dir):
    pages = [r.html for r in table(spark, sf_dir, "pages").collect()]
    pages += [
        "It&#8217;s &#x41; caf&eacute; &auml;&szlig; &amp;amp; &nosuch; &copy 5", "<P CLASS=a>one<DIV>two</DIV><Br/>three", "a < b and <3 <b>c</b>", "<p>x<script>var a='</p>';</script >y",
        "<!DOCTYPE html><title>t &ouml;</title>body", "<noscript>n</noscript>m<template><p>t</p></template>z", "text <!-- c <b> --> more", "",
    ]
    for html in pages:
        reader = Reader()
        reader.feed(html)
        reader.close()
        want = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f]+", " ", "".join(reader.out))).strip(" \n")
        assert warc.read_page(html)[0] == want
    assert warc.read_page("<title>caf&eacute;</title>x")[1] == "café" and warc.read_page("<a href=x><A HREF = y><a name=z>")[2] == 2


@pytest.mark.parametrize("part", ["<!--", "<script>", "<p", "<a href=", "<head>", "<title>", "</p", "<", "&", "<b>", "<noscript><template>"])
def test_warc_broken_pages_take_linear_time(part):
    start = time.process_time()
    warc.read_page("seen " + part * (1_000_000 // len(part)))
    assert time.process_time() - start < 3
    assert warc.read_page("seen <script>var a = 1;")[0] == "seen" and warc.read_page("seen <a href=")[0] == "seen" and warc.read_page("seen <head>x")[0] == "seen x"


def test_warc_files(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nServer: x\r\n\r\n<p>WARC/1.1 caf\xc3\xa9</p>"
    head = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:uuid:{}>\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nWARC-Target-URI: http://h/\r\nContent-Length: {}\r\n\r\n"
    record = lambda kind, i, block: head.format(kind, i, len(block)).encode() + block + b"\r\n\r\n"
    data = record("warcinfo", 1, b"x: y") + record("response", 2, http) + record("response", 3, http)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data) + gzip.compress(record("response", 4, http)))
    (tmp_path / "c.warc").write_bytes(data[:-30])
    found = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted(r.record_id[10:-1] for r in found.collect()) == ["2", "2", "2", "3", "3", "4"]
    made = warc.derive(found).where("warc_type = 'conversion'").collect()
    assert {(r.block, r.target_uri, r.date, r.source_headers) for r in made} == {("WARC/1.1 café", "http://h/", "2024-05-06T07:08:09Z", "Content-Type: text/html\nServer: x")}
    lines = warc.serialized(warc.derive(found)).first().record
    fields, block = next(warc.parsed(lines.encode()))
    assert fields["x-source-digest"] == made[0].source_digest and "X-Source-Header: Server: x\r\n" in lines and len(block) == int(fields["content-length"])


def test_warc_archives_as_servers_write_them(spark, tmp_path):
    """Gzip, chunks, Latin-1, an image, plain text, and codings that aren't there; digests of the bytes in the archive, and the source's own."""
    import gzip
    import hashlib

    page = "<html><title>T</title><p>Straße &amp; café</p></html>"
    squeezed = gzip.compress(page.encode())
    chunked = b"".join(b"%x;x=1\r\n%s\r\n" % (len(part), part) for part in (squeezed[:10], squeezed[10:])) + b"0\r\n\r\n"
    bodies = {
        "gzip": (b"Content-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip", squeezed), "chunked": (b"Content-Type: text/html\r\nTransfer-Encoding: chunked\r\ncontent-encoding: gzip", chunked),
        "latin": (b"Content-Type: text/html; charset=ISO-8859-1", page.encode("latin-1")), "meta": (b"X: y", ("<meta charset=windows-1252>" + page).encode("cp1252")),
        "image": (b"Content-Type: image/png", b"\x89PNG\r\n\x1a\n<p>\0"), "plain": (b"Content-Type: text/plain", b"a < b & c"), "wrong": (b"Content-Type: text/html; charset=nonsense\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked", page.encode()),
    }
    data = b""
    for name, (head, body) in bodies.items():
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
        data += f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {name}\r\nWARC-Block-Digest: sha1:{name}\r\nWARC-Payload-Digest: md5:{name}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(data)
    derived = warc.derive(warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))))
    rows = derived.collect()
    texts = {r.refers_to: r.block for r in rows if r.warc_type == "conversion"}
    assert texts == {n: "a < b & c" if n == "plain" else "Straße & café" for n in bodies if n != "image"}
    assert {r.refers_to for r in rows if r.warc_type == "metadata"} == set(bodies)
    for r in rows:
        assert r.source_digest == "sha256:" + hashlib.sha256(bodies[r.refers_to][1]).hexdigest()
        assert (r.given_block_digest, r.given_payload_digest) == (f"sha1:{r.refers_to}", f"md5:{r.refers_to}")
    assert all("X-Given-Block-Digest: sha1:" in r.record and "X-Given-Payload-Digest: md5:" in r.record for r in warc.serialized(derived).collect())


# --- 8 ---


def brute_spans(text):
    out = []
    kinds = {"assign": (r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
    for i, (kind, (pattern, group, least)) in enumerate(kinds.items()):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_secrets_base_spans(spark, sf_dir, documents):
    import hashlib

    found = llm.op8_secrets(spark, sf_dir).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        want = brute_spans(text)
        assert found.loc[i, "base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(found.loc[i, "spans"].split(","))
    for text in ("token:token:abcdefgh", "PassWord = 'abcdef'", "ſecret=abcdefgh", "AKIA" * 9, "x" + "0a" * 12, "api_key=ab.c=d apikey: 123456"):
        assert secrets.joined(secrets.base_spans(text)) == brute_spans(text)


def brute_ratio(labelled):
    """Log-likelihood ratio per character of a string, from two smoothed first-order models."""
    place = lambda c: secrets.ALPHABET.find(c) + 1 if c else 0
    seen = [Counter(), Counter()]
    for s, secret in labelled:
        seen[secret].update(zip(map(place, ["", *s[:-1]]), map(place, s), strict=True))
    size = len(secrets.ALPHABET) + 1
    total = [Counter(), Counter()]
    for t, n in zip(total, seen, strict=True):
        for (a, _), k in n.items():
            t[a] += k
    log = lambda k, a, b: math.log((seen[k][a, b] + 1) / (total[k][a] + size))
    return lambda s: sum(log(1, a, b) - log(0, a, b) for a, b in zip(map(place, ["", *s[:-1]]), map(place, s), strict=True)) / len(s)


def test_secrets_model_spans_match_brute_force(spark, sf_dir, documents):
    labelled = [tuple(r) for r in secrets.labelled_samples(spark).collect()]
    ratio, n = brute_ratio(labelled), 0
    texts = [f"{t} {labelled[37 * k % len(labelled)][0]}" for k, t in enumerate(documents.text)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(spark))).toPandas().set_index("doc_id")
    for i, text in enumerate(texts):
        want = set()
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
            s = m[0]
            digit, letter = any(c.isdigit() for c in s), any(c.isalpha() for c in s)
            small = next((k for k, c in enumerate(s) if c.islower()), len(s))
            if len(s) >= 16 and ((digit and letter) or any(c.isupper() for c in s[small:])) and ratio(s) >= secrets.LEAST_RATIO:
                want.add(f"markov:{m.start()}:{m.end()}")
        assert {x for x in found.loc[i, "spans"].split(",") if x.startswith("markov")} == want
        n += len(want)
    assert n > 20


def test_secrets_model_finds_held_out_secrets(spark):
    labelled = secrets.labelled_samples(spark)
    held = F.crc32(F.col("string").cast("binary")) % 5 == 0
    model = secrets.train(labelled.where(~held))
    rng = np.random.default_rng(8)
    planted = {0: [], 1: []}
    for r in labelled.where(held).collect():
        words = prose(rng, 12)
        at = int(rng.integers(0, 12))
        text = " ".join([*words[:at], r.string, *words[at:]])
        found = secrets.model_spans(text, model)
        planted[r.secret].append(any(text[a:b] == r.string for a, b, _ in found))
        assert all(text[a:b] == r.string for a, b, _ in found)
    assert np.mean(planted[1]) > 0.98 and np.mean(planted[0]) < 0.005 and len(planted[0]) > 1000


def test_secrets_model(odd, empty, spark):
    model = secrets.train(secrets.labelled_samples(spark))
    text = "key is q7Zx9Kp2Lm8Rt4Vw6Yb1 and name is user_account_name_2"
    _, found = secrets.spans(text, model)
    assert secrets.joined(found) == "markov:7:27" and secrets.redacted(text, found) == "key is [secret] and name is user_account_name_2"
    _, both = secrets.spans("token=q7Zx9Kp2Lm8Rt4Vw6Yb1", model)
    assert secrets.joined(both) == "assign:0:26,markov:0:26"
    assert secrets.scan(odd, model).count() == len(ODD) and secrets.scan(empty, model).count() == 0
    clash = secrets.scan(odd.withColumn("spans", F.lit("mine")), model)
    assert {r.spans for r in clash.collect()} == {""}
    assert not secrets.train(secrets.labelled_samples(spark).limit(0)).any()


@pytest.mark.parametrize("part", ["a", "A", "7", "aB", "a1", "-", "password", "token ", "AKIA", "abcdef0 "])
def test_secrets_of_long_runs_take_linear_time(part):
    """Two million characters without a break; a run of one kind of character is no candidate."""
    model = np.zeros((len(secrets.ALPHABET) + 1, len(secrets.ALPHABET) + 1))
    began = time.time()
    base, found = secrets.spans(part * (2_000_000 // len(part)), model + 1)
    assert time.time() - began < 20
    assert [s[2] for s in found if s not in base] == (["markov"] if part in ("aB", "a1") else [])


@pytest.mark.parametrize("text", ["a" * 30 + "B", "A" * 30 + "b", "aB" + "c" * 20, "1" * 20 + "a", "a" * 20 + "1", "Abcdefghijklmnopq", "ABCDEFGHIJKLMNOPq"])
def test_secrets_mixed_runs(text):
    assert secrets.mixed(text) == bool(re.search(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z]", text))


# --- 10 ---


def test_topk_matches_brute_force(spark, sf_dir):
    got = sorted(map(tuple, llm.op10_topk(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()))
    data = table(spark, sf_dir, "embeddings").toPandas()
    v, ids = np.floor(256 * np.stack(data.embedding).astype(float)).astype(int), data.vec_id.to_numpy()
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        best = sorted((-int(s), int(j)) for j, s in zip(ids, v @ v[i], strict=True) if j != ids[i])[:5]
        want += [(int(ids[i]), r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def brute_topk(rows, is_query, k=5):
    """rows: (id, vector) of usable whole-number vectors of one length; all products with Python's whole numbers."""
    want = []
    for at, (i, v) in enumerate(rows):
        if is_query(i):
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for other, (j, w) in enumerate(rows) if other != at)[:k]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(want)


def found_topk(df, is_query):
    return sorted(tuple(r)[:4] for r in topk.top_k(df, is_query).collect())


def test_topk_ties_shards_and_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(4)
    vectors = [[int(x) for x in rng.integers(-3, 4, 3)] for _ in range(150)] + [[1, 1, 1]] * 100
    good = list(enumerate(vectors)) + [(0, vectors[0]), (50, [3, 3, 3]), (50, vectors[50]), (7, vectors[7])]
    data = [(i, [float(x) for x in v]) for i, v in good]
    bad = [(1000, None), (1050, [1.0, None, 2.0]), (1100, [float("nan")] * 3), (1150, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (1200, [1.0]), (1250, [1e12] * 3)]
    df = spark.createDataFrame(data + bad, "vec_id long, vector array<double>")
    assert found_topk(df, F.col("vec_id") % 50 == 0) == brute_topk(good, lambda i: i % 50 == 0)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert sorted(tuple(r)[:2] for r in topk.top_k(spark.createDataFrame(data[:3], df.schema), F.col("vec_id") == 0).collect()) == [(0, 1), (0, 2)]
    copies = topk.top_k(df, F.col("vec_id") == 50).select("query_copy", "rank").collect()
    assert sorted(map(tuple, copies)) == [(c, r) for c in range(3) for r in range(1, 6)]


@pytest.mark.parametrize("size", [2**26, 2**30])
def test_topk_is_exact_beyond_floating_point(spark, monkeypatch, size):
    """Products of which a floating-point number keeps no last digit."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    rng = np.random.default_rng(5)
    rows = [(i, [size + int(x) for x in rng.integers(-2, 3, 2)]) for i in range(200)] + [(200, [size, 1]), (201, [size, -1]), (202, [-size, 0]), (203, [size, 0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    assert found_topk(df, F.col("vec_id") % 50 == 0) == brute_topk(rows, lambda i: i % 50 == 0)


def test_topk_skips_balls_that_the_shared_kth_score_rules_out(spark, monkeypatch):
    """Rows around well separated directions: after the first ball's hits, a query visits few of the others, and finds the same."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    rng = np.random.default_rng(6)
    centres = rng.integers(-900, 900, (12, 8))
    rows = [(i, (centres[i % 12] + rng.integers(-9, 9, 8)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    visits = []
    seen = topk.visited

    def counted(*of):
        found = seen(*of)
        visits.append(found.count())
        return found

    monkeypatch.setattr(topk, "visited", counted)
    assert found_topk(df, F.col("vec_id") % 50 == 0) == brute_topk(rows, lambda i: i % 50 == 0)
    balls = 20
    assert visits[0] == 8 and sum(visits) < 8 * balls / 3


# --- pipeline ---


def test_pipeline_stages(spark, sf_dir, documents):
    import corpus_pipeline as p

    docs = table(spark, sf_dir, "documents").limit(150)
    extra = spark.createDataFrame([(10**6, "12345 !!", "en", "x", 8), (10**6 + 1, None, None, None, None), (None, documents.text[3], "fr", "x", 5), (None, documents.text[3], "fr", "x", 5)], docs.schema)
    docs = docs.unionByName(extra)
    one = p.language_id(spark, docs, sf_dir)
    assert not one.where("doc_id >= 1000000").count() and one.columns == docs.columns
    two = p.quality_rules(spark, one, sf_dir).cache()
    assert two.count() and all(quality.counts(r.text)[0] >= 50 for r in two.collect())
    three = p.near_duplicates(spark, two, sf_dir).cache()
    texts = [r.text for r in three.collect()]
    assert len(texts) == len(set(texts)) and {t for t in texts} <= {r.text for r in two.collect()}
    ids = [r.doc_id for r in three.collect()]
    four = p.secret_scan(spark, three, sf_dir)
    assert four.count() == three.count() and not any(secrets.base_spans(r.text) for r in four.collect())
    assert {r.doc_id for r in p.packed(spark, four, sf_dir).collect()} == set(ids)


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline as p

    assert p.run(spark, sf_dir).count() > 0


def test_near_duplicate_stage_without_ids(spark, sf_dir, documents):
    import corpus_pipeline as p

    text = documents.text[documents.text.str.len() > 500].iloc[0]
    docs = spark.createDataFrame([(None, text, "en", "a", 1), (None, text, "en", "b", 2)], SCHEMA)
    assert p.near_duplicates(spark, docs, sf_dir).count() == 1
    assert rows(p.near_duplicates(spark, docs.limit(0), sf_dir).toPandas()) == []


def test_near_duplicate_stage_keeps_both_texts_of_one_id(spark, sf_dir, documents):
    import corpus_pipeline as p

    one, other = documents.text[documents.text.str.len() > 900].iloc[[0, 1]]
    docs = spark.createDataFrame([(5, one, "en", "a", 1), (5, other, "en", "b", 2), (5, one, "en", "a", 1), (9, other, "en", "b", 2)], SCHEMA)
    kept = p.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, one), (5, other)])
