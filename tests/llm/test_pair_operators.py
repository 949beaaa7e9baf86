"""Spelling variants, hard negatives and MinHash near-duplicates against brute force, and on awkward rows."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from oracle import compare, duck

pytest.importorskip("corpusflow.llm")
from pyspark.sql import functions as F  # noqa: E402

from corpusflow.llm import minhash, negatives, spelling  # noqa: E402
from corpusflow.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 97}x{i % 89}" for i in range(9000))
# Columns of other tables and names that the operators use inside must not clash.
SCHEMA = "doc_id long, text string, v long, component string, run string, mark long, n long"


def doc_rows(*texts):
    return [(i, t, 1, "c", "r", 7, 3) for i, t in texts]


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_hard_negatives", "op13_minhash_near_dedup"])
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), SF, name, QUERIES, ORACLES) is None


# ---- near-duplicates

def sets_of(rows, width=5):
    out = []
    for _, text, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute_near(rows, similarity=85):
    sets = sets_of(rows)
    part = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= similarity * len(x | y):
            low, high = sorted((part[a], part[b]))
            part = [low if p == high else p for p in part]
    ids = collections.defaultdict(list)
    for p, (i, *_) in zip(part, rows):
        if i is not None:
            ids[p].append(i)
    return sorted(((i, len(s), min(ids[p], default=None)) for p, s, (i, *_) in zip(part, sets, rows)), key=str)


def near(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, minhash.near_duplicates(docs, **more).collect()), key=str)


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randrange(10 ** 6)}" for w in words]


def families(seed):
    """Copies in chains, a template whose members are not alike, and texts near the threshold from both sides."""
    rng = random.Random(seed)
    rows, n = [], itertools.count(1)
    base = [f"w{i}" for i in range(120)]
    now = base
    for _ in range(12):  # each near the one before, the ends are not alike
        now = edited(rng, now, 0.02)
        rows.append((next(n), " ".join(now)))
    for _ in range(25):  # a template: a common half
        rows.append((next(n), " ".join([f"t{i}" for i in range(60)] + [f"u{rng.randrange(10 ** 6)}" for _ in range(20)])))
    for _ in range(15):
        rows.append((next(n), " ".join(edited(rng, [f"z{i}" for i in range(80)], rng.choice([0.01, 0.02, 0.03])))))
    for _ in range(6):
        rows.append((next(n), "a b c d e f g h i j"[:rng.choice([3, 9, 15, 19])]))
    rng.shuffle(rows)
    return doc_rows(*rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_families(spark, seed):
    rows = families(seed)
    assert near(spark, rows) == brute_near(rows)


def test_other_widths_and_similarities(spark):
    rows = families(3)
    assert near(spark, rows, similarity=80) == brute_near(rows, 80)


def test_awkward_documents(spark):
    rows = doc_rows((1, None), (2, ""), (3, " \n\t"), (4, "One two"), (4, "One two"), (5, "ONE two"), (6, LONG), (7, LONG + " tail"),
                    (None, LONG), (None, "only this one has no id at all here"), (8, "x" * 3000), (9, "x" * 3000), (9, "Σίσυφος İ ﬁ \x85 é"))
    assert near(spark, rows) == brute_near(rows)
    kept = {(r.doc_id, r.n_shingles): r.kept for r in minhash.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept[(1, 0)] and kept[(4, 1)] and not kept[(5, 1)] and not kept[(7, len(sets_of(rows)[7]))]
    assert minhash.digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_template_costs_few_pairs(spark, monkeypatch):
    """Members of a template that are not alike are hardly verified: their rarest shingles are their own."""
    tried = []
    alike = minhash._alike

    def counted(pairs, hashed, similarity):
        tried.append(pairs.count())
        return alike(pairs, hashed, similarity)
    monkeypatch.setattr(minhash, "_alike", counted)
    rng = random.Random(5)
    rows = doc_rows(*((i, " ".join([f"t{j}" for j in range(90)] + [f"u{rng.randrange(10 ** 9)}" for _ in range(30)])) for i in range(60)))
    assert all(c == i for i, _, c in near(spark, rows))
    assert len(tried) == 2 and tried[0] <= 60 and tried[1] == 0


@pytest.mark.parametrize("similarity", [85, 80])
def test_near_copies_cost_few_pairs(spark, monkeypatch, similarity):
    """Most edited copies of one text are like the text and not like each other: few pairs but those with it are tried."""
    tried = []
    alike = minhash._alike

    def counted(pairs, hashed, similarity):
        tried.append(pairs.count())
        return alike(pairs, hashed, similarity)
    monkeypatch.setattr(minhash, "_alike", counted)
    rng = random.Random(8)
    rows = []
    for i in range(240):
        words = [f"w{j}" for j in range(140)]
        for j in rng.sample(range(140), rng.choice([0, 1, 1, 2, 2, 3, 4, 6]) if i != 120 else 0):
            words[j] = rng.choice([f"e{rng.randrange(10 ** 6)}", "", words[j] + " and"])
        rows.append((i, " ".join(words)))
    rows = doc_rows(*rows)
    assert near(spark, rows, similarity=similarity) == brute_near(rows, similarity)
    assert len(tried) == 2 and sum(tried) <= 2 * len(rows)


def test_every_coordinate_fills_and_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 1 << 63, 4000).astype(np.uint64)
    one = minhash.sketches([np.unique(pool[:1]), np.unique(pool[:7]), np.unique(pool[:3000])])
    assert (one != minhash.NONE).all()
    for shared in (500, 1000, 1800):
        a, b = np.unique(pool[:2000]), np.unique(pool[2000 - shared:4000 - shared])
        s = minhash.sketches([a, b])
        assert abs((s[0] == s[1]).mean() - shared / (4000 - shared)) < 0.15
    # Batches and neighbours do not change a sketch.
    assert (minhash.sketches([pool[:7].copy()])[0] == minhash.sketches([pool[:900], pool[:7].copy()])[1]).all()


# ---- spelling

def brute_spelling(rows):
    count = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    near_of = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {}
    for w, found in near_of.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), n[w], len(near_of[w]), n.get(form[w])) for w in n)


def spelled(spark, rows):
    return sorted(tuple(r) for r in spelling.variants(spark.createDataFrame(rows, SCHEMA)).collect())


def test_spelling_on_awkward_texts(spark):
    rng = random.Random(4)
    stems = ["receive", "château", "straße", "aaaaaa", "aaaaaaa", "übergroß", "abcdefgh", "zzzzzzy"]
    texts = []
    for i in range(60):
        out = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                at, how = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + rng.choice(["", "e", "é"])[:1] + w[at + (how > 0):]
            out.append(rng.choice([w, w.upper(), w + "'s"]))
        texts.append((i % 50 if i % 9 else None, " ".join(out)))
    rows = doc_rows(*texts, (7, None), (8, ""), (9, "123 !?"), (10, LONG), (11, "x" * 5000), (12, "ab×cd÷ef " * 9))
    want = brute_spelling(rows)
    assert spelled(spark, rows) == want and sum(r[1] is not None for r in want) > 10
    assert spelled(spark, []) == []


def test_chains_of_forms_and_ties(spark):
    rows = doc_rows((1, "abcdefa " * 5), (2, "abcdefb " * 25), (3, "abcdexb " * 125), (4, "abcdeyb " * 125), (5, "abcwexb " * 700))
    found = {r[0]: r for r in spelled(spark, rows)}
    assert found == {r[0]: r for r in brute_spelling(rows)}


def test_neighbourhood_is_the_whole_ball(spark):
    rows = spark.createDataFrame([("abca",), ("a",)], "r string")
    for word, found in rows.select("r", spelling.neighbourhood("r", 3)).collect():
        want = {word} | {word[:i] + word[i + 1:] for i in range(len(word))}
        want |= {word[:i] + s + word[i + 1:] for i in range(len(word)) for s in "abc"}
        want |= {word[:i] + s + word[i:] for i in range(len(word) + 1) for s in "abc"}
        assert set(found) == want and len(found) == len(want)


# ---- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, key string, v long, rank int"


def brute_negatives(rows, every):
    part = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = tuple(int(np.floor(256 * x)) for x in v)
        part[(i, (label + 1) % 10 if i % 7 == 0 else label, whole)] = True
    part = list(part)
    out = []
    for i, label, v in part:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in part)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            found = [(n, m) for n, m, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(i, j, r + 1, m, -s, -n) for r, (n, m) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **more):
    return sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), **more).collect())


def vectors(seed, n=260, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    return [(i, (centres[i % 10] + 0.6 * rng.normal(size=dim)).tolist(), i % 10, "k", 1, 2) for i in range(n)]


@pytest.mark.parametrize("blocks", [(8192, 1024), (40, 7)])
def test_negatives_with_awkward_rows(spark, blocks):
    rows = vectors(1)
    rows += [(300, None, 1, "", 0, 0), (301, [float("nan")] * 6, 1, "", 0, 0), (302, [1.0, None], 1, "", 0, 0),
             (303, [float("inf")], 2, "", 0, 0), (304, [1.0] * 6, None, "", 0, 0), (None, [1.0] * 6, 3, "", 0, 0),
             (305, [], 4, "", 0, 0), (306, [1.0, 2.0], 5, "", 0, 0), (310, [2.0] * 9, 5, "", 0, 0),
             (311, [1e300], 5, "", 0, 0), rows[20], rows[20], rows[33]]
    rows += [(400 + i, rows[5][1], i % 10, "", 0, 0) for i in range(40)]  # one very common vector: ties
    want = brute_negatives([r for r in rows if r[0] != 311], 10)
    got = mined(spark, rows, every=10, block_rows=blocks[0], block_anchors=blocks[1])
    assert got == want and len(want) > 200


def test_scores_beyond_double_precision(spark):
    rows = [(i, [x * 3e5 for x in v], *rest) for i, v, *rest in vectors(2, 120)]
    assert mined(spark, rows, every=10) == brute_negatives(rows, 10)


def test_long_vectors_take_part_where_scores_fit(spark):
    """Finite rows of any length: a pair is left out only where its own score does not fit 64 bits."""
    rows = [(i, [x * 4 for x in v], *rest) for i, v, *rest in vectors(5, 120)]
    for i, far in ((23, 1e9), (31, 1e12), (45, 1e18), (50, 3e9), (67, 1e300), (81, 3e300)):  # 50 is an anchor
        rows[i] = (i, [x * far for x in rows[i][1]], 0, "", 0, 0)
        rows[i + 1] = (i + 1, [x / 2 for x in rows[i][1]], 4, "", 0, 0)
    rows[71] = (71, [0.0] * 5 + [1e16], 1, "", 0, 0)
    # Its score is within 64 bits with anchors that are zero there, and exact though its components are not.
    rows[10] = (10, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], 0, "", 0, 0)
    rows[73] = (73, [2.0 ** 60 + 2.0 ** 12, -2.0 ** 60, 0.0, 0.0, 0.0, 1e299], 0, "", 0, 0)
    rows[74] = (74, [2.0 ** 59 + 2.0 ** 11, -2.0 ** 59, 0.0, 0.0, 0.0, 1e299], 4, "", 0, 0)
    part = [(i, label if i % 7 else (label + 1) % 10, [int(np.floor(256 * x)) for x in v]) for i, v, label, *_ in rows]
    want = []
    for i, label, v in part:
        if i % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in part)
            scored = [x for x in scored if -2 ** 63 <= -x[0] < 2 ** 63 and x[1] != i]
            for s, j, _ in [x for x in scored if x[2] == label][:5]:
                found = [(n, m) for n, m, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s][:10]
                want += [(i, j, r + 1, m, -s, -n) for r, (n, m) in enumerate(found)]
    assert {23, 31, 73} <= {j for _, j, *_ in want} and any(i == 50 for i, *_ in want)
    for blocks in ((8192, 1024), (40, 7)):
        assert mined(spark, rows, every=10, block_rows=blocks[0], block_anchors=blocks[1]) == sorted(want)


def test_windows_of_positives_of_one_id(spark):
    """Rows that share a vec_id and a score are positives of their own."""
    rows = [(100, [1.0, 1.0], 0, "", 0, 0), (3, [8.0, 0.0], 0, "", 0, 0), (3, [0.0, 8.0], 0, "", 0, 0)]
    rows += [(10 + i, [2.0, 2.0 + i / 4], 1, "", 0, 0) for i in range(1, 9) if (10 + i) % 7]
    assert mined(spark, rows, every=100) == brute_negatives(rows, 100)


def test_no_vectors_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [r for r in vectors(3, 60) if r[0] % 100]) == []


def test_tree_bounds_leave_rows_unscored():
    """Near anchors and rows of very different scores: most rows are decided by their bounds."""
    rng = np.random.default_rng(7)
    anchors = np.round(256 * (np.ones(8) + 0.01 * rng.normal(size=(50, 8)))).astype(np.int64)
    rows = np.round(256 * rng.normal(size=(4000, 8)) * rng.uniform(0.1, 4, (4000, 1))).astype(np.int64)
    block = negatives.Block(np.arange(4000), np.arange(4000) % 10, rows, anchors)
    scored = []

    def look(at, low, high):
        exact = rows @ anchors[at]
        assert (low <= exact).all() and (exact <= high).all()
        places = np.flatnonzero(high >= np.partition(low, -10)[-10])
        scored.append(len(places))
        return places, lambda scores: set(np.sort(scores)[-10:]) == set(np.sort(exact)[-10:])
    assert all(block.walk(look)) and np.mean(scored) < 400
    tree = negatives.spanning_tree(anchors.astype(float))
    assert sorted(a for a, _, _ in tree) == list(range(50)) and all(p in [a for a, _, _ in tree[:i]] for i, (_, p, _) in enumerate(tree) if i)
