"""Each operator against a brute-force version, over whole small tables and over awkward rows."""

import collections
import hashlib
import importlib
import math
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("corpusflow.llm")
import corpus_pipeline  # noqa: E402
from corpusflow.llm import bpe, budget, decontam, fingerprints, langid, lattice, minhash, quality, shards, simhash, substrings  # noqa: E402
from corpusflow.llm.components import components  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score double, run long, component_id string"
LONG = " ".join(f"word{i % 97}x{i % 89}" for i in range(9000))
ROWS = [(1, None, "en", 1.0, 1, "a"), (2, "", None, None, None, None), (3, " \n\t", "en", 0.0, 2, "b"),
        (4, "One two", "en", 0.5, 3, "c"), (4, "One two", "en", 0.5, 3, "c"), (5, "ONE two", "en", 0.5, 3, "c"),
        (6, LONG, "en", 0.1, 4, "d"), (7, LONG + " tail", "de", 0.1, 4, "d"), (None, LONG, "de", 0.1, 4, "d"),
        (9, "x" * 3000, "de", None, 5, ""), (10, "Σίσυφος İstanbul ﬁ <|endoftext|> don't 漢字 \x85 é", "fr", 0.2, 6, "e"),
        (11, "!!! ??? 123", "fr", 0.2, 7, "f")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def both(table, odd):
    return [table.select("doc_id", "text", "lang"), odd]


def rows(df, *key):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: [(r[k] is None, r[k]) for k in key])


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def library():
    from tokenizers import Tokenizer
    import public_tokenizers
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def test_encoding_equals_the_library(table, odd):
    lib = library()
    for docs in both(table, odd):
        want = []
        for doc_id, text in texts(docs):
            ids = lib.encode(text, add_special_tokens=False).ids
            want.append((str(doc_id), len(ids), sha(np.array(ids, "<u4").tobytes()),
                         sha(lib.decode(ids, skip_special_tokens=False).encode())))
        got = bpe.encode_documents(docs)
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(table)).collect()}
    assert all(back[i] == lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)
               for i, t in texts(table))


def test_encoding_of_random_words():
    lib, vocab, rng = library(), bpe.vocabulary(bpe.VOCABULARY), random.Random(1)
    for alphabet in ("ab", "the ", "aeiou'st", "éàß日́ x", "0123 a!'s"):
        for _ in range(200):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert np.frombuffer(vocab.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_runs_of_a_long_text(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    vocab, text = bpe.vocabulary(bpe.VOCABULARY), "some words don't <|endoftext|> end\n" * 40
    assert np.frombuffer(vocab.encode(text), "<u4").tolist() == library().encode(text, add_special_tokens=False).ids


def test_token_counts_and_prefixes(table, odd):
    lib = library()
    for docs in both(table, odd):
        got = budget.token_counts(docs, limit=50).collect()
        want = sorted((str(i), len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in texts(docs))
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 50) for r in got)
    known, rng = budget.counter(bpe.VOCABULARY), random.Random(2)
    for _, text in texts(odd)[4:6] + texts(odd)[10:] + texts(table)[:5]:
        text = text[:600]
        whole = known.table(text)
        for at in {0, len(text), *(rng.randint(0, len(text)) for _ in range(25))}:
            assert known.at(text, at, whole) == len(lib.encode(text[:at], add_special_tokens=False).ids)
    cuts = {r.doc_id: r for r in budget.cut_to_budget(budget.prefix_tables(table), 40).collect()}
    for i, t in texts(table):
        assert len(lib.encode(t[:cuts[i].cut], add_special_tokens=False).ids) == cuts[i].n_tokens <= 40


def test_token_counts_with_full_caches(table):
    """Caches that are always full: what a part of the rows needs stays until the part is done."""
    lib, found = library(), [t for _, t in texts(table)]
    for words, chars in ((0, 1 << 30), (1 << 30, 0), (0, 0)):
        known = budget.PrefixCounts(bpe.vocabulary(bpe.VOCABULARY), words, chars)
        for at in range(0, len(found), 40):
            part = found[at:at + 40]
            assert [int(c[-1]) for c in known.tables(part)] == [len(lib.encode(t, add_special_tokens=False).ids) for t in part]
            ends, counts = known.table(part[0])
            assert len(ends) == len(counts)


def brute_fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    found = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def test_near_duplicates(table, odd):
    for docs in both(table, odd):
        pairs = [(i, brute_fingerprint(t)) for i, t in texts(docs)]
        least = {f: min((i for i, g in pairs if g == f and i is not None), default=None) for _, f in pairs}
        group = {f: {f} for f in least}
        for a in least:
            for b in least:
                if (a ^ b).bit_count() <= 2 and group[a] is not group[b]:
                    group[a] |= group[b]
                    for x in group[a]:
                        group[x] = group[a]
        want = [(str(i), f"{f:016x}", min((least[x] for x in group[f] if least[x] is not None), default=None)) for i, f in pairs]
        assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.digest(docs).collect()) == sorted(want)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and None in ids


def jaccard(one, other):
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (one.lower().split(), other.lower().split()))
    return len(a & b) / len(a | b)


def test_stage_drops_planted_near_copies(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, near = [], 0
    for k in range(150):
        w = [word() for _ in range(120)]
        docs.append((2 * k, " ".join(w)))
        for _ in range(rng.choice([1, 2, 2, 5])):
            w[rng.randrange(120)] = word()
        docs.append((2 * k + 1, " ".join(w)))
        near += jaccard(docs[-2][1], docs[-1][1]) >= 0.8
    docs += [(None, docs[0][1]), (1000, "")]
    kept = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF).collect()
    ids = {r.doc_id for r in kept}
    left = [k for k in range(150) if {2 * k, 2 * k + 1} <= ids]
    assert near > 80 and sum(jaccard(docs[2 * k][1], docs[2 * k + 1][1]) >= 0.8 for k in left) <= 0.01 * near
    assert len(left) >= 150 - near and {2 * k for k in range(150)} | {None, 1000} <= ids


def test_near_copies_that_share_a_band_without_its_least(spark, monkeypatch):
    """All sets meet in one band, whose least set is like one of the others only."""
    monkeypatch.setattr(minhash, "band_keys", lambda sketch: np.zeros((len(sketch), 1), np.int64))
    w = [f"w{i}" for i in range(300)]
    docs = [(k, " ".join([*w[100 * (k % 3):100 * (k % 3) + 100], *["x"] * (k > 2)])) for k in range(6)]
    copied = minhash.copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in copied.collect()) == [3, 4, 5]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 901), (None, 4)], "a long, b long")
    got = {r.v: r.component for r in components(chain, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_components_take_tasks_by_their_edges(spark, monkeypatch):
    """Few edges are not dealt to all partitions in every round; however many partitions they get, components are the same."""
    module = importlib.import_module("corpusflow.llm.components")
    rng = random.Random(5)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(7, i) for i in range(900, 1300)] + [(2000 + i, 2001 + i) for i in range(60)]
    root = {v: v for pair in pairs for v in pair}
    for _ in root:
        low = {v: min(root[v], root.get(root[v])) for v in root}
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if low == root:
            break
        root = low
    wanted = {v: c for v, c in root.items() if any(a != b and v in (a, b) for a, b in pairs)}
    edges = spark.createDataFrame(pairs, "a long, b long")
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("40", "false")):
            spark.conf.set(k, v)
        sc.setJobGroup("few-edges", "")
        got = {r.v: r.component for r in components(edges, "a", "b").collect()}
        stages = {s for j in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)
        assert got == wanted and 0 < tasks < 40 * 8, tasks
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        monkeypatch.setattr(module, "EDGES_A_PARTITION", 300)
        monkeypatch.setattr(module, "EDGES_SENT", 100)
        assert {r.v: r.component for r in components(edges, "a", "b").collect()} == wanted
        monkeypatch.setattr(module, "EDGES_A_PARTITION", 1)
        assert {r.v: r.component for r in components(edges, "a", "b").collect()} == wanted
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)


def test_language_model(table, odd):
    for docs in both(table, odd):
        pairs = texts(docs)
        train = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0 for i, _ in pairs]
        count = collections.Counter()
        for (_, t), x in zip(pairs, train):
            if x:
                count.update([*t.encode().lower().split(), None])
        n, v = sum(count.values()), len(count)
        want = sorted((str(i), not x, len(w), sum(count[y] > 0 for y in w),
                       round(sum(math.log10((count[y] + .1) / (n + .1 * (v + 1))) for y in w), 6))
                      for (i, t), x in zip(pairs, train) for w in [[*t.encode().lower().split(), None]])
        got = lattice.scores(docs).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == n and -math.inf < r.score < 0 for r in got)


def test_lattice_sums_all_segmentations():
    table = lattice.pieces(lattice.VOCABULARY)
    logp = np.log(table.prior)
    known = {p: math.exp(x) for p, x in zip(table.pieces, logp)}

    def every(rest):
        return 1.0 if not rest else sum(known[rest[:k]] * every(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in known)
    words = [b"the", b"thing", b"\xff", "né".encode(), b"a", b"zqx"]
    expected = np.zeros(len(logp))
    got = table.marginals(words, logp, expected)
    assert np.allclose(np.exp(got), [every("▁".encode() + w) for w in words])
    lengths = np.array([*map(len, table.pieces)])
    assert math.isclose((expected * lengths).sum(), sum(len(w) + 3 for w in words))


def test_text_probability_by_words():
    at, log10 = np.array([0, 1, 0, 0]), np.log10(np.array([.1, .2, .1, .1]))
    want, seen = 0.0, collections.Counter()
    for t, w in enumerate(at):
        want += math.log10((seen[w] + lattice.OWN * 10 ** log10[t]) / (t + lattice.OWN))
        seen[w] += 1
    want += -1.0 + math.log10(lattice.OWN / (4 + lattice.OWN))
    assert math.isclose(lattice.text_log10(at, log10, -1.0), want)


def test_quality(table, odd, empty, spark):
    found = quality.judged(table).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in found) >= 0.95 * len(found)
    assert all(r.keep for r in found if r.quality == 1 and r.weak_label > 0.5)
    assert quality.judged(odd).count() == len(ROWS)
    assert quality.good_documents(odd).columns == odd.columns
    assert quality.judged(empty).count() == 0


def test_em_recovers_accuracies():
    rng, n = np.random.default_rng(3), 20_000
    truth = rng.random(n) < 0.7
    counts = collections.Counter()
    for good in truth:
        votes = [int(good if rng.random() < 0.9 else not good), int(good if rng.random() < 0.75 else not good)]
        votes += [quality.BAD if not good and rng.random() < 0.5 else quality.NONE for _ in range(5)]
        counts[quality.pattern(votes)] += 1
    share, vote, _ = quality.accuracies(dict(counts))
    assert abs(share - 0.7) < 0.03 and abs(vote[quality.GOOD, 0, quality.GOOD] - 0.9) < 0.03


def test_language(table, odd):
    truth = {r.doc_id: r.lang for r in table.collect()}
    got = [r for r in langid.languages(table).collect() if r.held_out]
    assert got and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)
    by = {r.doc_id: r for r in langid.languages(odd).collect()}
    assert len(by) == len({r[0] for r in ROWS})
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 11))
    assert all(0 <= r.score <= 1 for r in by.values())


def test_fingerprints(table, odd):
    for docs in both(table, odd):
        ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
        ordered.sort(key=lambda r: (-(r.doc_id if r.doc_id is not None else -(1 << 63)), r.h))
        t = [r.text or "" for r in ordered]
        want = []
        for k, r in enumerate(ordered):
            after, half = t[(k + 1) % len(t)], len(t[k]) // 2
            edited = t[k][:len(t[k]) - half] + after[:half]
            want.append((str(r.doc_id), len(t[k]), sha(edited.encode()), len(os.path.commonprefix([t[k], edited])),
                         len(os.path.commonprefix([t[k], after]))))
        got = fingerprints.fingerprints(docs).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.common_edited, r.common_next) for r in got) == sorted(want)
        assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
        assert len({r.fingerprint for r in got}) == len(set(t))
    one = fingerprints.Prefixes(fingerprints.points("xabcabcy"))
    assert one.span(1, 4) == one.span(4, 7) != one.span(0, 3) and fingerprints.common_extension(one, 1, one, 4) == 3


def test_passages(table, odd, spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {(r.doc_id, r.item_id) for r in table.crossJoin(items.withColumnRenamed("text", "t")).where("contains(text, t)").collect()}
    assert held == {(r.doc_id, r.item_id) for r in decontam.passages(table, items).collect()}
    clean = decontam.without_passages(table, items)
    assert clean.columns == table.columns and clean.count() == table.count() - len({i for i, _ in held})
    assert decontam.passages(odd, items).count() == 0
    assert decontam.passages(table, items.limit(0)).count() == 0


def test_edited_passages_reach_the_recall(table, spark):
    items = [r for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    filler, rng, docs = [t for _, t in texts(table)][:40], random.Random(5), []
    for k, r in enumerate(items * 5):
        w = r.text.split()
        for _ in range(max(1, len(w) // 12)):
            at = rng.randrange(len(w))
            w[at:at + 1] = rng.choice([[], ["edit"], [w[at], "more"]])
        mine = filler[k % 40].split()
        docs.append((k, " ".join([*mine[:30], *w, *mine[30:60]])))
    near = {k for k, r in enumerate(items * 5)
            if decontam.fit_distance(b" ".join(decontam.tokens(r.text)), b" ".join(decontam.tokens(docs[k][1])))
            <= 0.2 * len(b" ".join(decontam.tokens(r.text)))}
    found = {r.doc_id for r in decontam.passages(spark.createDataFrame(docs, "doc_id long, text string"),
                                                 spark.createDataFrame(items)).collect()}
    assert len(near & found) >= 0.9 * len(near) and len(near) > 100


def letters(text, share, rng):
    """One letter changed in a share of the words."""
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            at = rng.randrange(len(w[i]))
            w[i] = w[i][:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[i][at + 1:]
    return " ".join(w)


def edited(text, share, rng):
    """Words left out, replaced or doubled."""
    w = text.split()
    for _ in range(round(len(w) * share)):
        at = rng.randrange(len(w))
        w[at:at + 1] = rng.choice([[], ["edit"], [w[at], "more"]])
    return " ".join(w)


def recall(items, change, filler, rng):
    """(passages within 0.8 of characters, those found) of edited items between other texts."""
    ready, docs, near = decontam.Items(list(enumerate(items)), 0.8), [], {}
    for k, t in enumerate(items):
        docs.append(" ".join([rng.choice(filler), change(t), rng.choice(filler)]))
        distance = decontam.fit_distance(ready.text[k], b" ".join(decontam.tokens(docs[k])))
        if distance <= ready.allowed[k]:
            near[k] = distance
    found = {(row, item): distance for row, item, distance, _ in decontam._search({"text": docs}, ready)}
    return len(near), sum(found.get((k, k)) == distance for k, distance in near.items())


@pytest.mark.parametrize("kind,share", [(letters, 0.3), (letters, 0.5), (letters, 0.7), (letters, 1), (edited, 0.1), (edited, 0.2), (edited, 0.25)])
def test_recall_by_kind_of_edit(table, spark, kind, share):
    items, rng = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()], random.Random(6)
    filler = [" ".join(t.split()[:40]) for _, t in texts(table) if t]
    near, found = recall(items, lambda t: kind(t, share, rng), filler, rng)
    assert near > 100 and found >= 0.97 * near


@pytest.mark.parametrize("size,put", [(8, 50), (10, 50), (14, 100), (18, 100)])
def test_recall_with_an_inserted_stretch(table, spark, size, put):
    one, rng = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()], random.Random(size)
    filler = [" ".join(t.split()[:40]) for _, t in texts(table) if len(t.split()) >= 40]
    items = one if put == 50 else [f"{a} {b}" for a, b in zip(one, one[1:])]
    items = [t for t in items if put <= len(t.split()) < 1.2 * put]

    def insert(text):
        w = text.split()
        at = rng.randrange(len(w))
        return " ".join([*w[:at], *rng.choice(filler).split()[:size], *w[at:]])
    near, found = recall(items, insert, filler, rng)
    assert near > 10 and found == near


def test_passages_of_short_items_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
    docs = [(k, " ".join(word() for _ in range(rng.randint(1, 80)))) for k in range(60)]
    items = [(100 + k, " ".join(word() for _ in range(rng.randint(1, 7)))) for k in range(60)] + [(99, docs[7][1][:30]), (98, docs[7][1][:30]), (97, "a")]
    text = {k: b" ".join(decontam.tokens(t)) for k, t in docs + items}
    want = {(d, i): decontam.fit_distance(text[i], text[d]) for d, _ in docs for i, _ in items}
    want = {pair: n for pair, n in want.items() if n <= int(0.2 * len(text[pair[1]]) + 1e-9)}
    got = decontam.passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == want and len(got) == len(want) and {(7, 98), (7, 99)} <= want.keys()
    assert {r.at_word for r in got if r.item_id == 99 and r.distance == 0} == {0}


def test_edit_distance():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)
    rng = random.Random(4)
    for _ in range(300):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert decontam.fit_distance(p, t) == plain(p, t)


def test_shards(table, odd, empty):
    for docs in both(table, odd):
        got = shards.shards(docs).collect()
        want = sorted((str(i), len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts(docs))
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in x) == list(range(len(x))) and 0 <= s < 40 for s, x in by.items())
        total, most = sum(r.size for r in got), max(r.size for r in got)
        assert all(sum(r.size for r in x) <= total / 40 + most for x in by.values())
    assert shards.shards(empty).count() == 0


def test_a_third_of_equal_texts_is_divided(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(
        F.concat(F.lit("text "), F.col("id"))).alias("text"))
    sizes = [r.n for r in shards.shards(docs).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) < 60


@pytest.mark.parametrize("window, start", [(13, None), (13, 3), (5, 5), (1, None)])
def test_repeated_words(table, odd, window, start):
    for docs in both(table, odd):
        pairs = [(i, t.encode().split()) for i, t in texts(docs)]
        first = {}
        for i, w in pairs:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, 1 << 63), 1 << 62 if i is None else i)
        want = []
        for i, w in pairs:
            cut = [False] * len(w)
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < (1 << 62 if i is None else i):
                    cut[k:k + window] = [True] * window
            want.append((str(i), len(w), sum(cut), sha(b" ".join(x for x, c in zip(w, cut) if not c))))
        got = substrings.repeated_words(docs, window, start).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    left = substrings.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == len(ROWS)


def test_empty_tables(empty):
    for frame in (bpe.encode_documents(empty), budget.token_counts(empty), simhash.digest(empty), lattice.scores(empty),
                  langid.languages(empty), fingerprints.fingerprints(empty), substrings.repeated_words(empty),
                  simhash.keep_one(empty), substrings.without_repeats(empty), quality.good_documents(empty)):
        assert frame.count() == 0


def test_rows_of_nulls(spark, table):
    """Each operator gives a row for a row of which nothing is known; the last two stages of the pipeline as well."""
    nothing = spark.createDataFrame([(None,) * 6] * 3, SCHEMA)
    items = spark.createDataFrame([(1, None), (None, ""), (2, "one two three four five six")], "item_id long, text string")
    for frame in (bpe.encode_documents(nothing), budget.token_counts(nothing), simhash.digest(nothing), lattice.scores(nothing),
                  quality.judged(nothing), langid.languages(nothing), fingerprints.fingerprints(nothing),
                  shards.shards(nothing), substrings.repeated_words(nothing), substrings.without_repeats(nothing),
                  decontam.without_passages(nothing, items)):
        assert frame.count() == 3
    assert decontam.passages(nothing, items).count() == 0
    assert {r.lang_pred for r in langid.languages(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_equal_texts_meet_equal_results(spark):
    """Ties: rows that repeat in all but their id are one group, and the least id stays."""
    same = spark.range(40).select((F.col("id") + 5).alias("doc_id"), F.lit("a text of some words that all the rows repeat " * 3).alias("text"),
                                  F.lit(1).alias("fp"), F.lit("x").alias("first"))
    assert {r.component_id for r in simhash.digest(same).collect()} == {5}
    assert [tuple(r) for r in simhash.keep_one(same).select("doc_id", "fp", "first").collect()] == [(5, 1, "x")]
    left = {r.doc_id: r.text for r in substrings.without_repeats(same).collect()}
    assert left[5] == same.first().text and all(t == "" for i, t in left.items() if i != 5)
    found = fingerprints.fingerprints(same).collect()
    assert len({r.fingerprint for r in found}) == 1 and all(r.near_next == 1 for r in found)


MEMORY = """
import re, sys
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from corpusflow.llm import bpe, common, runs

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024
"""


def _alone(code: str) -> list[float]:
    """What code prints in a process of its own, as numbers."""
    done = subprocess.run([sys.executable, "-c", MEMORY + code], cwd=os.path.dirname(corpus_pipeline.__file__),
                          capture_output=True, text=True, timeout=120, check=True)
    return [*map(float, done.stdout.split())]


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads Linux memory figures")
def test_bpe_worker_stays_small():
    """Pipeline on 0.51 GB: a worker keeps what the vocabulary needs, not the parsed file and the library's copy."""
    _, kept, after = _alone("""
before = held()
v = bpe.vocabulary(bpe.VOCABULARY)
kept = held() - before
encode, _ = bpe._encodings(bpe.VOCABULARY, True)
texts = [" ".join(f"w{i * 7919 % 100003}x{j}" for j in range(60)) for i in range(2000)]
n = sum(r.num_rows for r in encode(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": texts})])))
print(n, kept, held() - before)
""")
    assert kept < 65  # 89 before
    assert after < kept + 40


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads Linux memory figures")
@pytest.mark.parametrize("first", ["next(common.slices(iter([pa.RecordBatch.from_pydict({'text': ['a']})])))",
                                   "runs.unpack(blob)"])
def test_task_does_not_carry_what_earlier_ones_freed(first):
    """A worker goes from task to task and from stage to stage; memory freed in one goes back before the next works."""
    full, rest = _alone(f"""
sink = pa.BufferOutputStream()
with pa.ipc.new_stream(sink, pa.schema([("text", pa.string())])) as out:
    pass
blob = sink.getvalue().to_pybytes()
TaskContext._getOrCreate()._taskAttemptId = 1
{first}
blocks = [bytes([i % 256]) * 3000 for i in range(40_000)]
blocks = blocks[::50]  # what stays lies between what is freed
full = held()
TaskContext._getOrCreate()._taskAttemptId = 2
{first}
print(full, held())
""")
    assert rest < full - 60


def test_pipeline_follows_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in got.collect()}
    assert len(kept) == got.count() < docs.count()
    assert not any(labels[i].quality == 0 for i in kept & labels.keys())
    marks = [(i, brute_fingerprint(t)) for i, t in texts(docs) if i in kept]
    assert not any((a ^ b).bit_count() <= 2 for k, (_, a) in enumerate(marks) for _, b in marks[:k])
    assert all(len(r.ids) == r.n_tokens and sha(np.array(r.ids, "<u4").tobytes()) == r.ids_sha256 for r in got.collect())
