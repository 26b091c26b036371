"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Two first-order models are trained from a labelled table. A candidate, a long run of identifier characters of mixed kinds, is
reported where the random model explains it clearly better than the ordinary one.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from importlib import import_module

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.common import slices

#: The base patterns by kind, in the order in which kinds are listed, with the group that is measured and its least length.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KINDS = (*(p[0] for p in PATTERNS), "markov")
#: A candidate is a whole run of such characters that mixes letters with digits, or has a capital after a small letter.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
DIGIT, LETTER, SMALL, CAPITAL = (re.compile(x) for x in ("[0-9]", "[A-Za-z]", "[a-z]", "[A-Z]"))
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Log-likelihood ratio per character (natural logarithm) from which a candidate counts as random.
LEAST_RATIO = 0.5
#: Where the ordinary sample comes from: modules whose names people chose, and how such names are joined in other places.
MODULES = (
    "argparse ast asyncio base64 calendar codecs collections concurrent.futures configparser csv ctypes datetime decimal dis email.message ftplib functools "
    "gettext glob gzip hashlib hmac html.parser http.client http.cookies http.server imaplib inspect io ipaddress itertools json logging logging.handlers "
    "mailbox math mimetypes multiprocessing numbers operator os pathlib pickle platform poplib pyarrow.compute pyspark.sql.functions random sched selectors "
    "shutil signal smtplib socket socketserver sqlite3 ssl statistics string struct subprocess sys tarfile tempfile textwrap threading time timeit "
    "tokenize traceback types typing unittest.mock urllib.parse urllib.request uuid warnings wave weakref xml.dom.minidom xml.sax zipfile zlib"
).split()


def _names() -> list[str]:
    """Public names of the modules and of their classes, in order."""
    found = set()
    for module in map(import_module, MODULES):
        for name, value in vars(module).items():
            found.add(name)
            found.update(vars(value) if isinstance(value, type) else ())
    return sorted(n for n in found if len(n) >= 6 and n.isascii())


def labelled_samples(spark: SparkSession, n: int = 6000, seed: int = 1) -> DataFrame:
    """(string, secret): a labelled table to begin with; scan() takes any other of this shape.

    Secrets are drawn at random as keys and digests are written; ordinary strings are names of public modules, alone and joined.
    """
    draw = random.Random(seed)
    alphabets = (ALPHABET[:62], ALPHABET[:62] + "+/", "0123456789abcdef", ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[:62] + "_-")
    unlike = ["".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(16, 64))) for i in range(n)]
    names, ends = _names(), ("", "", "2", "_v2", "-01", "_2024", "/2023/11/05", "3", "-1", "=1", "_10")
    usual = names + [draw.choice("_-/=+").join(draw.choices(names, k=draw.randint(1, 3))) + draw.choice(ends) for _ in range(n)]
    return spark.createDataFrame([(s, 1) for s in unlike] + [(s, 0) for s in usual], "string string, secret int")


def encode(s: str) -> np.ndarray:
    """Codes of the characters after a 0, which stands for the start and for any other character."""
    return np.array([0, *map(INDEX.__getitem__, map(ord, s))])


INDEX = [0] * 128
for _code, _c in enumerate(ALPHABET, 1):
    INDEX[ord(_c)] = _code


def train(labelled: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each character after another, random over ordinary, of a table (string, secret).

    Transitions are counted over all its rows, so it may be of any size; at most two counts per pair of characters reach the driver.
    Counts are smoothed by one; rows with a null are left out.
    """
    rows = labelled.where(F.col("string").isNotNull() & F.col("secret").isin(0, 1)).select("secret", F.split("string", "").alias("c"))
    pairs = rows.select("secret", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "c").alias("before"), F.col("c").alias("at"))).alias("p")).where("p.at <> ''")
    seen = np.ones((2, len(ALPHABET) + 1, len(ALPHABET) + 1))
    counts = pairs.groupBy("secret", _code_of("p.before").alias("a"), _code_of("p.at").alias("b")).agg(F.count("*").alias("n"))
    for r in counts.collect():
        seen[r["secret"], r["a"], r["b"]] += r["n"]
    log = np.log(seen / seen.sum(axis=2, keepdims=True))
    return log[1] - log[0]


def _code_of(column: str) -> Column:
    """Place of a character in the alphabet from 1, 0 for the start and for any other."""
    return F.when(F.col(column) == "", 0).otherwise(F.position(F.col(column), F.lit(ALPHABET)))


def ratio(s: str, table: np.ndarray) -> float:
    """Log-likelihood ratio per character."""
    codes = encode(s)
    return float(table[codes[:-1], codes[1:]].mean())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, non-overlapping within a kind; matches that are too short are dropped."""
    found = []
    for kind, pattern, group, least in PATTERNS:
        found += [(*m.span(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def mixed(s: str) -> bool:
    """Whether letters and digits both occur, or a capital after a small letter; each scan reads the run once."""
    small = SMALL.search(s)
    return bool(DIGIT.search(s) and LETTER.search(s)) or bool(small and CAPITAL.search(s, small.end()))


def model_spans(text: str, table: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates that the random model explains better."""
    return [(*m.span(), "markov") for m in CANDIDATE.finditer(text) if mixed(m[0]) and ratio(m[0], table) >= LEAST_RATIO]


def spans(text: str, table: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, base and model spans): a model span stands beside the base spans, also where it overlaps one."""
    base = base_spans(text)
    return base, sorted(base + model_spans(text, table), key=lambda s: (s[0], KINDS.index(s[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def redacted(text: str, found: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with every span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for start, end, _ in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, model: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows with n_assign, n_access, n_hex, base_sha256, spans and redacted added.

    model: the result of train(). Whole texts are scanned; offsets are code points, the end exclusive. Null texts count as empty: no spans, and the digest
    of the empty string. Each row is scanned alone. Columns of the added names are replaced, others pass through unchanged.
    """
    added = [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"), ("redacted", "string")]
    plain = docs.select(*(c for c in docs.columns if c not in dict(added)))
    schema = StructType(list(plain.schema.fields))
    for name, kind in added:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            rows = []
            for text in part.column(text_col).to_pylist():
                base, found = spans(text or "", model)
                kinds = [s[2] for s in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*map(kinds.count, KINDS[:3]), digest, joined(found), redacted(text, found) if found else text))
            kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in added]
            columns = [pa.array(x, kind) for kind, x in zip(kinds, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema.names)

    return plain.mapInArrow(run, schema)
