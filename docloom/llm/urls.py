"""URL filter: host and path rules, and a logistic regression on hashed character n-grams of host and path for the rest."""

from __future__ import annotations

import random
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 14
NGRAMS = (3, 4, 5)
#: Rules as (host, path, verdict); the longest that fits wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Most labelled rows that the model is fitted on; of a larger table, those with the smallest hash.
LABELLED_ROWS = 20_000
#: Labelled table to begin with: words that hosts and paths of unwanted pages are made of, and of wanted ones.
UNWANTED = (
    "adult backlinks betting bingo bonus buy-now cams cash-advance casino cheap clickbait coupon-hack crack credit-fix dating debt-relief deals-now "
    "diet-pills discount escort fake-id followers forex-profit free-money free-spins full-download gambling get-rich giveaway hookup hot-singles jackpot "
    "keygen loans lottery magic-pills miracle nulled nude payday pharmacy pills poker popup porn prize-winner replica serial-key sexy slots spam "
    "sweepstakes torrent traffic-bot viagra warez weight-loss win-prize xxx"
).split()
WANTED = (
    "agenda algebra archive articles astronomy biology blog books botany bridges buildings chemistry city climate clinic coast code council courses "
    "culture docs economy energy essays exhibition farm festival films forum gallery garden geology grammar guide harbour health history hikes "
    "hospital island journal kitchen languages law lectures letters library local manual maps market medicine metro museum music news notes opera "
    "painting parish park photos physics planet poems press railway recipes research river schedule school science society sport station stories "
    "theatre tools town trail translation tutorial university village weather wiki wildlife workshop world"
).split()
LETTERS = "eeeeeaaaattttooooiiinnnsssshhhhrrrddlllluuccmmffppggbbwwyvk"
FRONTS, ZONES, TONGUES = ("", "", "www.", "m.", "blog."), ("com", "net", "org"), ("en", "de", "fr", "es", "it")


def labelled_urls(spark: SparkSession, n: int = 3000, seed: int = 1) -> DataFrame:
    """(url, keep): a labelled table to begin with; judge() takes any other of this shape.

    A third of the urls have a word of UNWANTED in the host or the path; the others are made of WANTED and of invented names.
    """
    draw, rows = random.Random(seed), []
    for i in range(n):
        keep = int(i % 3 > 0)
        name = "".join(draw.choices(LETTERS, k=draw.randint(4, 10)))
        host, path = draw.choice((name, draw.choice(WANTED), f"{draw.choice(WANTED)}-{name}")), draw.choice((draw.choice(WANTED), str(draw.randint(1, 9999)), name))
        if not keep:
            bad = draw.choice(UNWANTED)
            host, path = draw.choice(((f"{bad}-{name}", path), (f"{name}-{bad}", path), (bad, path), (host, bad), (f"{bad}-{draw.choice(UNWANTED)}", path)))
        ending = draw.choice(("", "", "/", ".html", "?page=2", "#top"))
        section = draw.choice((f"{draw.choice(TONGUES)}/", f"{draw.choice(TONGUES)}/", ""))
        rows.append((f"{draw.choice(('http', 'https'))}://{draw.choice(FRONTS)}{host}.example.{draw.choice(ZONES)}/{section}{path}{ending}", keep))
    return spark.createDataFrame(rows, "url string, keep int")


def features(host: str, path: str) -> np.ndarray:
    """Hash buckets of the character n-grams of host and path, each once; the two parts are marked and kept apart."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        data = part.encode()
        for n in NGRAMS:
            found.update(crc32(mark.encode() + data[i : i + n]) % BUCKETS for i in range(len(data) - n + 1))
    return np.fromiter(found, np.int64)


def parts_of(url: str) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) of a column; both empty where it is null or has no "://"."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def train(labelled: DataFrame, rounds: int = 400, rate: float = 3.0, penalty: float = 1e-5, most: int = LABELLED_ROWS) -> tuple[np.ndarray, float]:
    """(weights, bias) by gradient descent on all of a labelled table (url, keep), of which at most `most` rows are used.

    Rows come in the order of their hashes, so a table gives the same model wherever its rows lie. Rows with a null are left out;
    an empty table gives a model that answers one half.
    """
    host, path = parts_of("url")
    usable = labelled.where(F.col("url").isNotNull() & F.col("keep").isin(0, 1))
    taken = usable.select(host.alias("host"), path.alias("path"), "keep", F.xxhash64("url").alias("hash")).orderBy("hash", "host", "path", "keep").limit(most)
    table = taken.toPandas()
    rows = [features(h, p) for h, p in zip(table.host, table.path, strict=True)]
    y = table.keep.to_numpy(dtype=float)
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bucket, scale = np.concatenate(rows), np.sqrt([max(1, len(r)) for r in rows])
    before = weights, bias
    for i in range(rounds):
        ahead = i / (i + 3)  # accelerated gradient descent: a step from a point further along the last one
        w, c = weights + ahead * (weights - before[0]), bias + ahead * (bias - before[1])
        error = 1 / (1 + np.exp(-(np.bincount(at, w[bucket], len(rows)) / scale + c))) - y
        before = weights, bias
        weights = w - rate * (np.bincount(bucket, (error / scale)[at], BUCKETS) / len(rows) + penalty * w)
        bias = c - rate * error.mean()
    return weights, bias


def probability(host: str, path: str, model: tuple[np.ndarray, float]) -> float:
    weights, bias = model
    r = features(host, path)
    return float(1 / (1 + np.exp(-(weights[r].sum() / np.sqrt(max(1, len(r))) + bias))))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null where none does; equal lengths: the first listed."""
    fits = F.lit(None).cast("struct<rule: string, verdict: string>")
    for domain, prefix, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        match = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        fits = F.when(match, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def judge(pages: DataFrame, model: tuple[np.ndarray, float], rules: tuple = RULES, url_col: str = "url") -> DataFrame:
    """The rows with host, path, rule, verdict (allow or block) and probability (that a url is to be kept) added.

    model: the result of train(). A rule's verdict comes first; the model judges the rest, at 0.5. A null url, or one without
    "://", has empty host and path and is judged by the model alike. Each row is judged alone, urls of any length as a whole;
    columns of the added names are replaced, others pass through.
    """
    plain = pages.select(*(c for c in pages.columns if c not in ("host", "path", "rule", "probability", "verdict")))
    host, path = parts_of(url_col)

    @F.pandas_udf("double")
    def scored(hosts, paths):
        return hosts.combine(paths, lambda h, p: probability(h, p, model))

    parts = plain.withColumn("host", host).withColumn("path", path)
    ruled, modelled = rule_of(F.col("host"), F.col("path"), rules), F.when(F.col("probability") >= 0.5, "allow").otherwise("block")
    found = parts.withColumn("probability", scored("host", "path"))
    return found.select(*parts.columns, ruled["rule"].alias("rule"), F.coalesce(ruled["verdict"], modelled).alias("verdict"), "probability")
