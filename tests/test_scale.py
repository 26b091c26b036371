"""Operators that go through large groups in bounded pieces, against plain computations of the same."""

import hashlib
import itertools
import math
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import formulas
from docloom.operators import aggregates, evaluation, folds, layout, profile, relational, structure
from docloom.plans import catalog
from docloom.sources import parse


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- intervals and boxes ---


def test_interval_join_gives_each_pair_once(spark):
    draw = random.Random(1)
    ranges = [("a", float(s), s + draw.choice([0.0, 0.5, 3.0, 3.0, 40.0, 900.0])) for s in (draw.randrange(-300, 1000) for _ in range(150))]
    ranges += [("b", 0.0, 1.0), ("b", 1.0, 1.0), ("b", 1.1, 2.0), ("b", 5.0, 4.0), ("b", None, 4.0), (None, 0.0, 9.0)]
    left = spark.createDataFrame(ranges[::2], "k string, start double, end double")
    right = spark.createDataFrame(ranges[1::2] + ranges[-6:], "k string, start double, end double")
    sound = lambda df: [r for r in map(tuple, df.collect()) if None not in r and r[1] <= r[2]]
    want = sorted(((k, s, e, s2, e2) for (k, s, e), (k2, s2, e2) in itertools.product(sound(left), sound(right)) if k == k2 and s <= e2 and s2 <= e), key=repr)
    for width in (0.7, 4.0, 5000.0):
        assert collect(relational.interval_join(left, right, ["k"], width)) == want


def test_a_long_interval_costs_few_rows(spark, monkeypatch):
    """A year among seconds: some rows a level, not one a second."""
    year = 365 * 86_400.0
    rows = spark.range(2000).select(F.lit("k").alias("k"), (F.col("id") * 7.0).alias("start"), (F.col("id") * 7.0 + 1).alias("end"))
    rows = rows.union(spark.createDataFrame([("k", 0.0, year)], rows.schema))
    placed = []
    explode = F.explode
    monkeypatch.setattr(relational.F, "explode", lambda c: placed.append(c) or explode(c))
    pairs = relational.interval_join(rows, rows, ["k"], 1.0)
    assert pairs.count() == 2000 + 1 + 2 * 2000
    long = rows.where(F.col("end") == year)
    level = math.ceil(math.log2(year))
    cells = long.select(F.size(F.sequence(F.floor(F.col("start") / 2.0**level), F.floor(F.col("end") / 2.0**level))).alias("n"))
    assert placed and cells.first().n <= 2


def boxes(draw, n):
    rows = []
    for i in range(n):
        x, y, w, h = draw.uniform(0, 900), draw.uniform(0, 900), draw.choice([1, 5, 5, 300]), draw.choice([1, 5, 5, 40])
        rows.append((draw.choice([1, 1, 2]), i, x, y, x + w, y + h, i % 40 == 0))
    return rows


SCHEMA = "page int, path_id int, x0 double, y0 double, x1 double, y1 double, background boolean"


def test_best_overlap_of_boxes_of_all_sizes(spark):
    ours, theirs = boxes(random.Random(1), 150), boxes(random.Random(2), 150)
    best = {}
    for (p, i, x0, y0, x1, y1, _), (q, j, a0, b0, a1, b1, _) in itertools.product(ours, theirs):
        w, h = min(x1, a1) - max(x0, a0), min(y1, b1) - max(y0, b0)
        if p == q and w > 0 and h > 0:
            best[i] = max(best.get(i, (0, 0)), (w * h, -j))
    others = spark.createDataFrame(theirs, SCHEMA).withColumnRenamed("path_id", "span")
    assert collect(layout.best_overlap(spark.createDataFrame(ours, SCHEMA), others, "path_id", "span", 16.0)) == sorted(((i, -j, a) for i, (a, j) in best.items()), key=repr)


def test_near_groups_of_boxes_of_all_sizes(spark):
    rows, gap = boxes(random.Random(3), 120), 4.0
    label = {r[1]: r[1] for r in rows}
    for a, b in itertools.combinations([r for r in rows if not r[6]], 2):
        if a[0] == b[0] and a[2] - gap <= b[4] and b[2] - gap <= a[4] and a[3] - gap <= b[5] and b[3] - gap <= a[5]:
            low, high = sorted((label[a[1]], label[b[1]]))
            label = {k: low if v == high else v for k, v in label.items()}
    assert collect(layout.near_groups(spark.createDataFrame(rows, SCHEMA), gap)) == sorted(((r[0], r[1], label[r[1]]) for r in rows), key=repr)


def _near_groups(rows, gap):
    """near_groups() pair by pair; boxes of one id are one."""
    plain = [r for r in rows if not r[6]]
    label = {(r[0], r[1]): r[1] for r in rows}
    for a, b in itertools.combinations(plain, 2):
        if a[0] == b[0] and (a[1] == b[1] or (a[2] - gap <= b[4] and b[2] - gap <= a[4] and a[3] - gap <= b[5] and b[3] - gap <= a[5])):
            low, high = sorted((label[a[:2]], label[b[:2]]))
            label = {k: low if v == high and k[0] == a[0] else v for k, v in label.items()}
    return sorted({(*r[:2], label[r[:2]]) for r in rows}, key=repr)


@pytest.mark.parametrize("seed, gap, span, sizes", [(1, 3.0, 25, (0, 1, 2)), (2, 2.0, 60, (1, 5)), (3, 0.0, 12, (0, 1, 3)), (4, 7.0, 90, (2, 30))])
def test_near_groups_of_crowded_boxes(spark, seed, gap, span, sizes):
    draw, rows = random.Random(seed), []
    for i in range(60):
        x, y = draw.randrange(-span, span) / 2, draw.randrange(-span, span) / 2
        rows.append((1 + i % 2, i // 2 if i < 50 else draw.randrange(20), x, y, x + draw.choice(sizes), y + draw.choice(sizes), False))
    assert collect(layout.near_groups(spark.createDataFrame(rows, SCHEMA), gap)) == _near_groups(rows, gap)


def test_copies_of_boxes_meet_once(spark):
    """4,000 boxes at one place would be 16 million pairs."""
    rows = spark.range(4000).selectExpr("1 AS page", "int(id) AS path_id", "id % 4 * 0.25 AS x0", "0D AS y0", "id % 4 + 1D AS x1", "5D AS y1", "false AS background")
    held = rows.selectExpr("*", "0 AS _cell", "0D AS _x", "0D AS _y").drop("background")
    assert layout._corners(held).count() <= 4
    assert layout.near_groups(rows, 3.0).where("group = 0").count() == 4000



# --- containment ---


def test_contained_finds_every_occurrence(spark, monkeypatch):
    texts = ['he said "One two three four five six" today', "[one two three four five, six]", "xone two three four fivex", "  one  two three four five", "one two three.", "one two", "ab", "", None]
    needles = ["One two three four five", "ne two three four five", "one two three four five", " one  two three four five", "one two three", "two three", "three four ", "one", "one", "b", " ", "", "e f i v e", None]
    left = spark.createDataFrame(list(enumerate(needles)), "item_id int, passage string")
    right = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(((i, d) for i, n in enumerate(needles) for d, t in enumerate(texts) if n is not None and t is not None and n in t), key=repr)
    assert collect(relational.contained(left, right, "passage", "text", "item_id", "doc_id")) == want
    monkeypatch.setattr(relational, "AUTOMATON_BYTES", 200)  # several shards
    assert collect(relational.contained(left, right, "passage", "text", "item_id", "doc_id")) == want
    assert relational.contained(left.limit(0), right, "passage", "text", "item_id", "doc_id").count() == 0


# --- quantiles ---


@pytest.mark.parametrize("kind", ["uniform", "ties", "heavy", "two", "few", "special"])
def test_quantiles_are_exact(spark, monkeypatch, kind):
    """Narrow ranges and coarse sketches, so that every step is taken."""
    monkeypatch.setattr(profile, "READ_OFF", 20)
    rng = np.random.default_rng(1)
    n = 6000
    values = {
        "uniform": rng.uniform(-5, 5, n), "ties": rng.integers(0, 4, n).astype(float), "heavy": np.exp(rng.normal(size=n) * 60), "few": np.array([3.0, 1.0, 2.0]),
        "two": np.r_[np.zeros(n), rng.uniform(0, 1e-9, 30), np.ones(n)], "special": np.r_[rng.normal(size=500), [np.inf, -np.inf] * 300],
    }[kind]
    data = [(float(v),) for v in rng.permutation(values)] + [(None,)] * 5
    found = profile.quantiles(spark.createDataFrame(data, "x double").repartition(3), ["x"], profile.QUANTILES)["x"]
    ordered = np.sort(values)
    for p, got in zip(profile.QUANTILES, found, strict=True):
        at = p * (len(ordered) - 1)
        a, b = float(ordered[math.floor(at)]), float(ordered[math.ceil(at)])
        assert got == pytest.approx(a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b, rel=1e-12)


def test_quantiles_of_nothing_and_nan(spark):
    df = spark.createDataFrame([(None, float("nan"), 1), (None, 1.0, 2)], "a double, b double, c int")
    found = profile.quantiles(df, ["a", "b", "c"], (0.0, 1.0))
    assert found["a"] == [None, None] and found["b"][0] == 1.0 and math.isnan(found["b"][1]) and found["c"] == [1.0, 2.0]


# --- digests ---


def brute_digest(rows, size=1024, levels=7):
    nodes = sorted(rows)
    for _ in range(levels):
        nodes = [(at, hashlib.sha256(";".join(f"{a}:{d}" for a, d in part).encode()).hexdigest()) for at, part in ((k, list(g)) for k, g in itertools.groupby(nodes, lambda x: x[0] // size))]
    return hashlib.sha256(";".join(f"{a}:{d}" for a, d in nodes).encode()).hexdigest()


@pytest.mark.parametrize("size", [4, 10, 1024])
def test_tree_digest(spark, size):
    rows = [("k", i, f"row {i}") for i in [*range(-50, 3000, 7), 2**40, -(2**50)]] + [("l", 5, "a"), ("l", 5, "b"), ("l", 5, "a")]
    df = spark.createDataFrame(rows, "k string, i long, t string").repartition(4)
    levels = math.ceil(63 / math.log2(size))
    want = {k: (brute_digest([(i, hashlib.sha256(t.encode()).hexdigest()) for g, i, t in rows if g == k], size, levels), sum(r[0] == k for r in rows)) for k in "kl"}
    assert {r.k: (r.digest, r.n) for r in aggregates.digest(df, ["k"], "i", F.col("t"), size, levels).collect()} == want


# --- leaders ---


def brute_leaders(rows, least):
    out, kept = [], {}
    for t, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        unit = np.array(v) / (np.linalg.norm(v) or 1.0)
        known = kept.setdefault(t, [])
        led = next((j for j, w in known if unit @ w >= least), None)
        if led is None:
            known.append((i, unit))
        out.append((t, i, i if led is None else led))
    return sorted(out, key=repr)


def test_leaders_of_one_large_topic_are_those_of_the_sequence(spark, monkeypatch):
    """One topic holds nearly all rows, over many partitions and rounds; small topics are done at once."""
    monkeypatch.setattr(folds, "ROUND_ROWS", 37)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 8))
    rows = [("hot", int(i), (centres[rng.integers(60)] + rng.normal(scale=0.25, size=8)).tolist()) for i in rng.permutation(900)]
    rows += [("warm", i, rng.normal(size=8).tolist()) for i in range(80)] + [("cold", 1, [1.0] * 8), (None, 4, [1.0] * 8), (None, 5, [2.0] * 8)]
    rows += [("hot", 1000, [0.0] * 8), ("hot", 1001, [0.0] * 8), ("hot", -1, rows[5][2])]
    df = spark.createDataFrame(rows, "t string, id long, vector array<double>").repartition(5)
    want = brute_leaders(rows, 0.9)
    assert collect(folds.leaders(df, "t", 0.9)) == want
    assert max(Counter(r[2] for r in want if r[0] == "hot").values()) > 5
    monkeypatch.setattr(folds, "ROUND_TOPICS", 1)
    assert collect(folds.leaders(df, "t", 0.9)) == want
    assert folds.leaders(df.limit(0), "t").count() == 0


# --- structure ---


PAGE = """<ol start=3><li>a<li value=7>b<ul><li>x<p><a href=#1>l</a></ul><li>c<ol reversed><li>q<li>r</ol></li><li value=no>d<li>e<li value=" 2 ">f</ol>
<ol reversed start=x><li>g<li value=4>h<li>i</ol><a href=#2>m</a><ul><li>j<ol></ol></ul>"""


def test_list_contexts(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "no lists"), (3, None), (4, "<li>stray")], "i long, html string")
    nodes = parse.parsed(df, parse.html_nodes, "html", parse.NODES, ("i",))
    text = {(r.i, r.pre): r.text for r in nodes.collect()}
    found = {text[r.i, r.pre]: (r.depth, text.get((r.i, r.parent)), r.ordered, r.item_index, r.ordinal) for r in structure.list_contexts(nodes, "i").collect()}
    assert found == {
        "a": (1, None, True, 1, 3), "b": (1, None, True, 2, 7), "x": (2, "b", False, 1, None), "c": (1, None, True, 3, 8), "q": (2, "c", True, 1, 2), "r": (2, "c", True, 2, 1),
        "d": (1, None, True, 4, None), "e": (1, None, True, 5, None), "f": (1, None, True, 6, 2), "g": (1, None, True, 1, None), "h": (1, None, True, 2, 4),
        "i": (1, None, True, 3, 3), "j": (1, None, False, 1, None),
    }


def test_nearest_owner(spark):
    nodes = parse.parsed(spark.createDataFrame([(1, PAGE)], "i long, html string"), parse.html_nodes, "html", parse.NODES, ("i",))
    links = nodes.where("href IS NOT NULL")
    owners = structure.nearest(links, nodes.where("tag IN ('li', 'p', 'ol')"), "i")
    assert [r.tag for r in owners.collect()] == ["p"]
    assert sorted(r.tag for r in structure.ancestors(links, nodes, "i").collect()) == ["li", "li", "ol", "p", "ul"]


def test_deep_and_broken_pages_are_read(spark):
    deep = "<div>" * 3000 + "<a href=#1>x</a>"
    rows = list(parse.html_nodes(deep))
    assert len(rows) == 3001 and all(r[1] == 3000 for r in rows)
    assert [r[:3] for r in parse.html_nodes("<p>a<p>b</i></p><br><td>c<td>d")] == [(0, 0, "p"), (1, 1, "p"), (2, 2, "br"), (3, 3, "td"), (4, 4, "td")]
    nodes = parse.parsed(spark.createDataFrame([(1, deep)], "i long, html string"), parse.html_nodes, "html", parse.NODES, ("i",))
    assert structure.ancestors(nodes.where("href IS NOT NULL"), nodes, "i").count() == 3000


# --- formulas ---


def test_formula_verdicts(spark):
    cases = [
        ("a+b", "a+b", None, None, "exact"), ("a + b", "a+b", None, [], "normalized"), ("(a)+b", "a+b", None, None, "structural"), ("a+b", "a-b", None, None, "different"),
        ("a+", "b", None, None, "not_evaluable"), (None, None, "absent", None, "absent"), ("a", None, None, None, "missing"), ("a", "a", "ambiguous", None, "ambiguous"),
        (None, "a", "absent", None, "unexpected"), (r"\alpha+1", "α + 1", None, None, "normalized"), ("Γ(x)", r"\Gamma x", None, None, "structural"),
        ("a+b*c", "(b*c)", None, ["b*c"], "partial"), ("a+b*c", "b*c", None, ["a"], "different"), ("a+b*c", "b*c", None, None, "different"), ("a+b*c", "b*c", None, ["b*c", "b+c"], "partial"),
        ("x^{a+b}", "a+b", None, ["a + b"], "partial"), ("a", "b", None, ["a"], "different"), ("a+b", "b", None, ["b", "("], "partial"), ("a+b*c", "c*b + a", None, None, "equivalent"),
    ]
    df = spark.createDataFrame([(i, s, r, p, q) for i, (r, p, s, q, _) in enumerate(cases)], "i int, status string, reference string, prediction string, parts array<string>")
    found = sorted(evaluation.formula_verdicts(df).collect())
    assert [r.verdict for r in found] == [c[4] for c in cases]
    assert [r.i for r in found if not r.sound] == [14, 16, 17]  # parts that aren't proper subtrees of the reference
    assert found[3].differences == ["operator_error", "structure_error"] and found[0].differences == []
    assert evaluation.formula_verdicts(df.limit(0)).count() == 0


def test_verdicts_move_no_rows(spark):
    df = spark.createDataFrame([("confirmed", "a+b", "b", ["b"])], "status string, reference string, prediction string, parts array<string>")
    assert "Exchange" not in evaluation.formula_verdicts(df)._jdf.queryExecution().executedPlan().toString()


def test_names_of_forms():
    """Formulas that share a form but for their numbers have equal names just where their trees are equal."""
    texts = [f.replace("A", a).replace("B", b) for f in (r"\frac{A}{x_B} + y", "A^B", "xA²", "x^{A2}", "(A) * B", "A.B", "A B", "-A₁₂", "[A|B|]") for a in ("1", "2", "12", "1.5") for b in ("2", "x", "1.5")]
    named = {}
    for text in texts:
        found = formulas._nodes(text)
        if found:
            named[text] = (found[0][-1], json.dumps(formulas.parse(text)), len(set(found[0][:-1])))
    assert len(named) > 60 and len({n for n, _, _ in named.values()}) == len({t for _, t, _ in named.values()}) == len({(n, t) for n, t, _ in named.values()})
    assert all(formulas._nodes(t)[1].filled(formulas._nodes(t)[2]) == formulas.parse(t) for t in named)


def test_parts_of_sizes(spark):
    references = spark.createDataFrame([("r", r"\frac{1}{x_1} + y")], "r string, f string")
    assert [evaluation.formula_parts(references, "r", "f", sizes).count() for sizes in (None, [5], [3, 5], [2])] == [5, 1, 2, 0]


def test_containing_formulas(spark):
    references = spark.createDataFrame([("r", "a+b*c"), ("s", r"\frac{b*c}{2} + b*c"), ("t", "b*c"), ("u", "("), ("v", None)], "r string, f string")
    asked = spark.createDataFrame([("p", "(b * c)"), ("q", "b"), ("w", "2+2")], "p string, f string")
    assert collect(evaluation.containing(references, asked, "r", "p", "f")) == [("r", "p"), ("s", "p")]


@pytest.mark.parametrize(
    ("left", "right", "same"),
    [
        ("a+(b+c)", "(c+a)+b", True), ("a-b", "-b+a", True), ("a-(b-c)", "a+c-b", True), ("2*3*x", "6x", True), ("x=y+1", "1+y=x", True), ("a*(-b)", "-(a*b)", True), ("x+0", "x", True), ("1*x", "x", True),
        ("a/b", "b/a", False), ("a-b", "b-a", False), ("x^2*3", "3^2*x", False), ("2(a+b)", "2a+2b", False), ("a<b", "b<a", False), ("x+1", "x+1.0", False), ("0*x", "0", True),
    ],
)
def test_canonical_forms(left, right, same):
    assert (formulas.canonical(formulas.parse(left)) == formulas.canonical(formulas.parse(right))) == same


@pytest.mark.parametrize(("letter", "command"), [("α", r"\alpha"), ("λ", r"\lambda"), ("ς", r"\varsigma"), ("Ω", r"\Omega"), ("ϕ", "ϕ")])
def test_greek_letters_are_commands(letter, command):
    assert formulas.normalized(letter) == [command]


# --- class models ---


def test_identities_match_plain_models(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, 2):
        base = rng.normal(size=(90, 3)) @ rng.normal(size=(3, 7)) + rng.normal(scale=0.1, size=(90, 7)) + label
        rows += [(len(rows) + i, v.tolist(), label) for i, v in enumerate(base)]
    df = spark.createDataFrame([*rows, (900, None, 1), (901, [1.0] * 7, None)], "id long, v array<double>, label int").repartition(3)
    found = {r.id: r for r in profile.verified_identities(df, "id", "label", "v", k=3, q_quantile=0.9, t2_quantile=0.8).collect()}
    ids, labels, m = np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    accepted = np.zeros((len(rows), 3), dtype=bool)
    scores = np.zeros((len(rows), 3, 2))
    for c in range(3):
        own = m[labels == c]
        mean, scale = own.mean(axis=0), own.std(axis=0)
        _, sizes, axes = np.linalg.svd((own - mean) / scale, full_matrices=False)
        z = (m - mean) / scale
        along = z @ axes[:3].T
        q = ((z - along @ axes[:3]) ** 2).sum(axis=1)
        t2 = (along**2 / (sizes[:3] ** 2 / (len(own) - 1))).sum(axis=1)
        scores[:, c] = np.stack([q, t2], axis=1)
        accepted[:, c] = (q <= np.quantile(q[labels == c], 0.9) + 1e-9) & (t2 <= np.quantile(t2[labels == c], 0.8) + 1e-9)
    assert set(found) == set(ids.tolist())
    for i, label, ok, (q, t2) in zip(ids.tolist(), labels.tolist(), accepted, scores[np.arange(len(rows)), labels], strict=True):
        assert (found[i].accepted, found[i].accepting) == (ok[label], ok.sum()) and found[i].q == pytest.approx(q) and found[i].t2 == pytest.approx(t2)


def test_registered_queries_read_tables():
    assert not {"s02_delimiter", "s09_config", "s17_python_symbols", "k18_run_log", "t06_run_to_end"} & set(catalog.QUERIES)
