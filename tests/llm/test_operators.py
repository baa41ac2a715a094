"""Each operator against a plain version on a small table, and on odd rows and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from readqc.llm import ann, decontam, hmm, langid, license_scan, line_dedup, minhash, mixing, pii, toxicity
from readqc.llm.common import near_ids
from readqc.llm.components import components

DATA = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def fill(sizes, weights, budget, cap):
    """Water-filling by repeated clamping."""
    target, open_, total = {}, dict(weights), budget * sum(sizes.values())
    while open_:
        share = total / sum(open_.values())
        over = [s for s, w in open_.items() if w * share > cap * sizes[s]]
        if not over:
            return target | {s: w * share for s, w in open_.items()}
        for s in over:
            target[s] = cap * sizes[s]
            total -= target[s]
            del open_[s]
    return target


def test_mix_plain(docs, rows):
    out = mixing.mix(docs).collect()
    size = {r.doc_id: len(words(r.text)) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size[r.doc_id]
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    taken = Counter()
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.repeats * r.size + r.part
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()) == sorted((r.doc_id, r.taken) for r in out)


@pytest.mark.parametrize("copies", [1000, 7])
def test_mix_copies(spark, copies):
    """Equal rows at the cut, of several sources, and columns named like internal ones."""
    rows = [(1, "a b c d e", "s", "x", "y")] * copies + [(2, "u v w", "t", "x", "y")] * copies + [(i, "w " * (i % 7), "r", "x", "y") for i in range(10, 60)] + [(None, "n n", None, "x", "y")] * 40
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, cut string, src string")).collect()
    assert len(out) == len(rows) and {(r.cut, r.src) for r in out} == {("x", "y")}
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())


def test_many_sources(spark):
    rng = random.Random(2)
    sources = [None, *(f"s{i:04}" for i in range(700))]
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(sources)) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    assert all(r.target == pytest.approx(want[r.source], abs=1e-3) for r in out)


def test_mix_odd(docs_of, odd_rows):
    out = mixing.mix(docs_of(odd_rows)).collect()
    assert len(out) == len(odd_rows) and all(r.taken == 0 for r in out if r.size == 0)
    assert mixing.mix(docs_of([])).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs_of([(1, None, None, None, 0, None, None)])).collect())


def plain_lines(rows):
    split = [(r[0], (r[1] or "").split("\n")) for r in rows]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(" \t\n\x0b\x0c\r")
    held = defaultdict(set)
    for i, lines in split:
        for x in lines:
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= 5}
    for i, lines in split:
        kept = [x for x in lines if last.get(key(x), i) == i]
        yield i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_lines_plain(spark, rows, docs):
    common = "A line that many documents share, with More than forty characters"
    more = [(1000 + i, f"own {i}\n {common.upper() if i % 2 else common}\t\n{common}\nend\n" + "\n" * 70 + common) for i in range(7)]
    table = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + more + [(2000, None), (2001, "")], "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.dedup_summary(table).collect()))
    assert got == sorted(plain_lines(table.collect()))
    assert "udf" not in line_dedup.dedup_summary(docs)._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("slot_lines", [None, 3, 40])
def test_lines_shared_and_null_ids(spark, slot_lines):
    """Ids shared by different texts, rows without id, lines so common that they are dealt into slots, and clashing names."""
    rng = random.Random(3)
    lines = [f"line number {i} " + "x" * 40 for i in range(12)]
    line = lambda i, j: rng.choice([rng.choice(lines), lines[0], "short", f"own line {i} {j} " + "y" * 40, "", "  " + lines[1].upper() + "\t"])
    rows = [(rng.choice([None, *range(60)]), None if rng.random() < 0.03 else "\n".join(line(i, j) for j in range(rng.randint(0, 70))), "a", "b", 1) for i in range(300)]
    rows += rows[:20]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lines string, keep string, id long"), slot_lines=slot_lines)
    assert out.columns == ["doc_id", "text", "lines", "keep", "id", "n_lines", "n_dropped", "kept_text"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect()]
    with duckdb.connect() as con:
        con.register("documents", pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
        assert sorted(map(str, got)) == sorted(map(str, con.sql(line_dedup.SQL).fetchall()))


def test_lines_odd(docs_of, odd_rows):
    out = line_dedup.dedup_lines(docs_of(odd_rows))
    assert out.count() == len(odd_rows) and {r.n_lines for r in out.filter("text IS NULL").collect()} == {1}
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


def test_hmm_base_and_model(spark, docs, rows):
    out = {r.doc_id: r for r in hmm.score(docs, sample=50, warm=4, iterations=1).collect()}
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            counts.update([*words(r.text), b""])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = [*words(r.text), b""]
        o = out[r.doc_id]
        assert o.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert (o.n_tokens, o.n_known, o.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
    held = [o for o in out.values() if o.held_out]
    assert sum(o.score for o in held) > sum(o.base_score for o in held)


def test_forward_and_expectations_by_enumeration():
    rng = np.random.default_rng(1)
    k, s = 3, 5
    a, b, start = (x / x.sum(axis=ax, keepdims=True) for x, ax in ((rng.random((k, k)), 1), (rng.random((s, k)), 0), (rng.random(k), 0)))
    seqs = [[0, 2, 4, 1], [3], [1, 1]]
    flat, lengths = np.array(sum(seqs, [])), np.array([len(x) for x in seqs])
    first, moves, gamma = hmm.expected(flat, lengths, np.tile(start, (3, 1)), a, b)
    want_ll, want_moves, want_first = [], np.zeros((k, k)), []
    for x in seqs:
        total, m, f = 0.0, np.zeros((k, k)), np.zeros(k)
        for path in itertools.product(range(k), repeat=len(x)):
            p = start[path[0]] * b[x[0], path[0]]
            for t in range(1, len(x)):
                p *= a[path[t - 1], path[t]] * b[x[t], path[t]]
            total += p
            f[path[0]] += p
            for t in range(1, len(x)):
                m[path[t - 1], path[t]] += p
        want_ll.append(math.log(total))
        want_moves += m / total
        want_first.append(f / total)
    assert np.allclose(hmm.forward(flat, lengths, start, a, b), want_ll)
    assert np.allclose(moves, want_moves) and np.allclose(first, want_first) and np.allclose(gamma.sum(axis=1), 1)


def test_hmm_learns_from_all(docs_of, monkeypatch):
    """Each training text takes part once in the first pass and once in every later one; no text is left out for a sample or its size."""
    texts = [f"word{i} follows word{i % 7} " * (1 + i) for i in range(60)] + ["long " * 50_000]
    rows = [(i, x, "en", "s", len(x), None, None) for i, x in enumerate(texts)]
    seen = []
    real = hmm._full_counts
    monkeypatch.setattr(hmm, "_full_counts", lambda *x: seen.append(real(*x)) or seen[-1].copy())
    out = hmm.score(docs_of(rows), sample=2, sample_bytes=100, warm=5, iterations=2).collect()
    tokens = out[0].train_tokens
    assert len(seen) == 7 and len(out) == len(rows)
    heads = sum(bool(zlib.crc32(str(r[0]).encode()) % 10) for r in rows)
    size = len(seen[0]) - 8  # the emissions, before six rows of moves and two of starts
    for found in ([*seen[:5]], [seen[5]], [seen[6]]):
        assert sum(x[:size].sum() for x in found) == pytest.approx(tokens)
        assert sum(x[size + 6].sum() for x in found) == pytest.approx(heads)


def test_hmm_odd(docs_of, odd_rows):
    out = hmm.score(docs_of(odd_rows), iterations=1, warm=1).collect()
    assert len(out) == len(odd_rows) and {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1} and all(math.isfinite(r.score) for r in out)
    assert hmm.score(docs_of([])).count() == 0


def plain_components(table, width):
    sets = {}
    for i, text in table:
        w = words(text)
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_plain(spark, rows, width):
    rng = random.Random(width)
    table = [(r.doc_id, r.text) for r in rows]
    for k in range(40):  # chains of edits, and groups of copies
        w = [f"t{rng.randrange(300)}" for _ in range(rng.choice((4, 6, 12, 30, 120)))]
        for j in range(5):
            table.append((10_000 + k * 10 + j, " ".join(w)))
            w[rng.randrange(len(w))] = f"x{rng.randrange(300)}"
    base = [f"g{i}" for i in range(60)]
    for j in range(30):
        table.append((20_000 + j, " ".join(base[:j] + [f"y{j}"] + base[j + 1 :])))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), width=width).collect()}
    assert got == plain_components(table, width)


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_duplicates_sizes(spark, threshold):
    """Insertions and deletions at all sizes from 4 to 45, alone and in crowds whose lists are long, as by comparing all pairs."""
    rng = random.Random(threshold)
    table = []
    for n in range(4, 46):
        base = [f"b{n}x{i}" for i in range(n)]
        most = n * 100 // threshold
        for j, size in enumerate((most, most + 1, n + 1)):  # at, just below and well above the threshold
            own = [f"{w}s{j}" for w in base]
            table += [own, own + [f"i{n}x{j}x{i}" for i in range(size - n)]]
            less = [f"{w}d{j}" for w in base]
            cut = rng.sample(range(n), n - min(n - 1, (n * threshold + 99) // 100 - (j == 1)))
            table += [less, [w for i, w in enumerate(less) if i not in cut]]
    for n in (16, 18, 20, 21, 23, 25):
        base = [f"c{n}x{i}" for i in range(n)]
        for j in range(25):
            w = [x for x in base if rng.random() > 0.12]
            table.append(w + [f"e{n}x{j}x{i}" for i in range(rng.randrange(6))])
    table = [(i, " ".join(w)) for i, w in enumerate(table)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), width=1, threshold=threshold).collect()}
    sets = {i: set(t.split()) for i, t in table}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {i: c for i, c in got.items() if c != find(i)} == {}


def test_near_duplicates_odd(docs_of, odd_rows):
    out = minhash.near_duplicates(docs_of(odd_rows)).collect()
    assert len(out) == len(odd_rows) and all(r.kept for r in out if r.doc_id in (1, 2, 3, None))
    assert minhash.near_duplicates(docs_of([])).count() == 0
    assert minhash.drop_near_duplicates(docs_of(odd_rows)).count() == len(odd_rows)


@pytest.mark.parametrize("most_bits", [1 << 15, 1 << 29])
def test_near_ids(spark, most_bits):
    """All rows with an id of the set pass, whatever the size of the bitmap; few others do while it has 32 bits an id."""
    ids = {i * i - 7 for i in range(3000)}
    df = spark.range(-20_000, 60_000).selectExpr("id AS doc", "'x' AS id", "1 AS _bucket")
    out = near_ids(df, "doc", spark.createDataFrame([(i,) for i in ids], "id long"), most_bits)
    got = [r.doc for r in out.collect()]
    want = {i for i in ids if -20_000 <= i < 60_000}
    assert out.columns == df.columns and len(got) == len(set(got)) and want <= set(got)
    assert most_bits == 1 << 15 or len(got) < len(want) + 800
    assert near_ids(df, "doc", spark.createDataFrame([], "id long")).count() == 0


def test_near_groups(spark):
    """A large group of copies with edits of their own: no link is lost, and equal roots as by comparing all pairs."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    made = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"u{i}x{rng.randrange(9)}"
        made.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), width=5).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in made for w in [t.split()]}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (95, 100)], "a long, b long")
    roots = dict(map(tuple, components(links, "a", "b").collect()))
    assert all(roots[i] == 1 for i in range(2, 41)) and roots[100] == 90 and roots[95] == 90


def test_decontamination(spark):
    rng = random.Random(3)
    text = lambda n: [f"v{rng.randrange(2000)}" for _ in range(n)]
    items = [(i, text(rng.randrange(14, 60))) for i in range(60)]
    table, want = [], set()
    for i, w in items:
        x = list(w)
        for _ in range(i % 3):
            x[rng.randrange(len(x))] = "edited"
        table.append((i, " ".join(text(50) + [w.upper() + "!" for w in x] + text(50))))
        want.add((i, i))
        table.append((1000 + i, " ".join(text(150))))
    items_df = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(900, None), (901, " ")], "item_id long, text string")
    out = decontam.contaminated(spark.createDataFrame(table, "doc_id long, text string"), items_df).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert all(r.start_word == 50 and r.distance == r.item_id % 3 for r in out if r.item_id % 3 == 0)


def test_decontamination_full_tolerance(spark):
    """Every window within the tolerance is found: scattered and mixed edits, runs left out or put in, items up to 400 words."""
    rng = random.Random(11)
    items, table, want = [], [], set()
    for i, n in enumerate((1, 2, 5, 7, 14, 20, 33, 40, 80, 120, 200, 250, 400) * 3):
        item = [f"v{rng.randrange(5000)}" for _ in range(n)]
        items.append((i, " ".join(item)))
        d = int(0.15 * n + 1e-9)
        for j, kind in enumerate(("scattered", "mixed", "cut", "put", "over")):
            w = list(item)
            at = min(rng.randrange(3), n - d)
            if kind == "cut":
                del w[at : at + d]
            elif kind == "put":
                w[at:at] = ["other"] * d
            else:
                edits = sorted(rng.sample(range(n), d), reverse=True) if kind != "over" else range(n - 1, -1, -max(1, n // (d + n // 5 + 1)))
                for e in edits:
                    act = rng.randrange(3) if kind == "mixed" else 0
                    w[e : e + (act != 1)] = ["other"] * (act != 2)
            doc = i * 10 + j
            table.append((doc, " ".join(["left"] * rng.choice((0, 30)) + w + ["right"] * rng.choice((0, 30)))))
            if kind != "over":
                want.add((doc, i))
    out = decontam.contaminated(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    texts = {i: decontam_words(t) for i, t in table}
    numbers = defaultdict(itertools.count(1).__next__)
    number = lambda ws: np.array([numbers[w] for w in ws])
    kept = {(r.doc_id, r.item_id): (r.distance, r.start_word) for r in out}
    assert want <= set(kept)
    for i, t in items:
        item = number(t.split())
        for doc in range(i * 10, i * 10 + 5):
            text = number(texts[doc])
            near = min(((decontam.edit_distance(item, text[s:], len(item)), s) for s in range(len(text))), default=(9999, 0))
            assert kept.get((doc, i)) == (near if near[0] <= int(0.15 * len(item) + 1e-9) else None)


@pytest.mark.parametrize("kind", decontam.KINDS)
def test_decontamination_recall_by_kind(kind):
    """Keys of sampled steps alone find copies with all the edits allowed, of every kind and size, at the recall asked for."""
    rng = np.random.default_rng(23)
    sizes = [int(n) for n in rng.integers(7, 140, 60)]
    first = np.cumsum([1, *sizes])
    items = [(i, np.arange(first[i], first[i + 1], dtype=np.int32)) for i in range(len(sizes))]
    index = decontam.Index(items, int(first[-1]), 0.15, 0.99)
    texts, truth = [], []
    for i, n in enumerate(sizes):
        for _ in range(4):
            copy = decontam.edited(n, index.most[i], kind, rng)
            copy = np.where(copy > n, 0, copy + first[i] - 1).astype(np.int32)
            texts.append(np.concatenate([np.zeros(rng.integers(0, 40), np.int32), copy, np.zeros(rng.integers(0, 40), np.int32)]))
            truth.append((len(texts) - 1, i))
    bounds = np.cumsum([0, *map(len, texts)])
    tokens = np.append(np.concatenate(texts), np.int32(0))
    keyed = {(int(d), int(k)) for k, _, d in index.places(tokens, bounds[:-1], bounds[1:])}
    matched = {(d, index.items[k][0]) for d, k, _, _ in index.search(tokens, bounds[:-1], bounds[1:])}
    assert len(keyed & set(truth)) >= 0.97 * len(truth) and len(matched & set(truth)) >= 0.97 * len(truth)
    assert matched <= set(truth)


def test_decontamination_long_beside_short(spark):
    """A text of 300,000 words, short and empty ones and an item of 3,000 words in one batch; a copy cut off by the text's ends."""
    rng = random.Random(29)
    item = [f"i{n}" for n in range(40)]
    large = [f"l{n}" for n in range(3000)]
    filler = [f"f{rng.randrange(9000)}" for _ in range(300_000)]
    table = [(1, " ".join(filler[:150_000] + item + filler[150_000:] + large[:1500] + ["x"] * 200 + large[1700:])), (2, " ".join(item[4:])), (3, " ".join(item[:36])), (4, ""), (5, None), (6, " ".join(item[:33])), (7, "i1"), (8, " ".join(large[:-300]))]
    items = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(large))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.start_word) for r in decontam.contaminated(spark.createDataFrame(table, "doc_id long, text string").coalesce(1), items).collect()}
    assert got == {(1, 0, 0, 150_000), (1, 1, 200, 300_040), (2, 0, 4, 0), (3, 0, 4, 0), (8, 1, 300, 0)}


def test_edit_distance_plain():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontam.edit_distance(np.array(a), np.array(b), 9) == min(row)


def test_decontamination_odd(spark, docs_of, odd_rows):
    items = spark.createDataFrame([(1, "same words here again and again")], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(docs_of(odd_rows), items).collect()} == {5}
    assert decontam.contaminated(docs_of([]), items).count() == 0 and decontam.contaminated(docs_of(odd_rows), items.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs_of(odd_rows), items).count() == len(odd_rows) - 2


def test_license_scan(spark):
    table = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.py", "some code\nmore"), (3, "a/b/y.py", "words\nLicensed under the Apache License, Version 2.0.\nwords " * 3),
        (4, "c/z.py", "nothing"), (5, None, None), (6, "a/b/c/d.py", ""), (7, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ]
    out = {r.doc_id: (r.license, r.how, r.found_in) for r in license_scan.scan(spark.createDataFrame(table, "doc_id long, path string, text string")).collect()}
    assert out == {1: ("MIT", "file", "a/LICENSE"), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "header", "a/b/y.py"), 4: (None, None, None), 5: (None, None, None), 6: ("GPL-3.0", "inherited", "a/b"), 7: ("GPL-3.0", "file", "a/b/COPYING")}


def test_license_files_and_wrapped_notices(spark):
    """Whole texts, with and without a licence name, titles that differ in the version alone, and a notice wrapped over lines."""
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    table = [
        (1, "x/LICENSE", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n"), (2, "y/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n"), (3, "z/text.md", wrap(license_scan._MIT, 9)),
        (4, "w/a.py", "# This work is licensed under the GNU General Public\n# License, version 3.\n" + "code here and there\n" * 30), (5, "v/deep/er/b.py", None), (6, "v/LICENSE.txt", wrap(license_scan._BSD3, 7)),
        (7, "", "plain"), (8, "u/c.py", "nothing of interest " * 50),
    ]
    out = {r.doc_id: (r.license, r.how, r.found_in) for r in license_scan.scan(spark.createDataFrame(table, "doc_id long, path string, text string")).collect()}
    assert out == {1: ("GPL-3.0", "file", "x/LICENSE"), 2: ("GPL-2.0", "file", "y/COPYING"), 3: ("MIT", "file", "z/text.md"), 4: ("GPL-3.0", "header", "w/a.py"), 5: ("BSD-3-Clause", "inherited", "v"), 6: ("BSD-3-Clause", "file", "v/LICENSE.txt"), 7: (None, None, None), 8: (None, None, None)}


def test_license_cosine_plain(spark):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "copyright of this license belongs to nobody", "Licensed under CC BY 4.0."]
    table = spark.createDataFrame([(i, -i, x, i + 1) for i, x in enumerate(lines)], "h1 long, h2 long, line string, n long")
    got = {lines[r.h1]: (r.license, r.score) for r in license_scan.line_scores(table, license_scan.TEMPLATES, 0.0).collect()}
    terms = lambda t: Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower()))
    total, df = 10, Counter()
    for i, x in enumerate(lines):
        for w in terms(x):
            df[w] += i + 1
    vec = lambda t: {w: n * (math.log((1 + total) / (1 + df[w])) + 1) for w, n in terms(t).items()}
    cos = lambda p, q: sum(p[w] * q.get(w, 0) for w in p) / math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))
    for x in lines:
        best = max(cos(vec(x), vec(t)) for ts in license_scan.TEMPLATES.values() for t in ts)
        assert got[x][1] == pytest.approx(best, abs=1e-8)


def test_license_odd(docs_of, odd_rows):
    table = docs_of(odd_rows).withColumn("path", F.col("source"))
    assert license_scan.scan(table).count() == len(odd_rows) and license_scan.scan(table.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[7] = x[0]
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2050, [0.0] * 24, 0), (2100, [float("nan")] + [1.0] * 23, 0), (None, [1.0] * 24, 0)], "vec_id long, embedding array<float>, label int")
    out = ann.neighbours(table, shard_rows=400).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    by = defaultdict(dict)
    for r in out:
        assert r.score == pytest.approx(float(u[r.query_id] @ u[r.vec_id]), abs=1e-12) and r.query_id != r.vec_id
        by[r.query_id][r.rank] = r.vec_id
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & set(by[q].values()))
        assert sorted(by[q]) == [1, 2, 3, 4, 5]
    assert hits >= 0.9 * 30 * 5 and set(by) == set(range(0, 1500, 50)) and by[0][1] == 7


def test_neighbours_pruned(spark, monkeypatch):
    """Clusters, a vector that a fifth of the rows share, shared ids and two lengths: recall against all rows, and the share of rows retrieved."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((600, 32))
    x = [(centres[i % 600] + 0.35 * rng.standard_normal(32)).astype(np.float32).tolist() for i in range(6000)]
    table = list(enumerate(x)) + [(i, x[3]) for i in range(10_000, 11_500)] + [(i, x[i + 1][:7]) for i in range(0, 900, 9)] + [(50, x[51]), (50, x[50])]
    retrieved = []
    plain = ann.candidates
    monkeypatch.setattr(ann, "candidates", lambda classes, queries, shared: retrieved.append((plain(classes, queries, shared).distinct().count(), classes.count() * queries.count())) or plain(classes, queries, shared))
    out = ann.neighbours(spark.createDataFrame(table, "vec_id long, embedding array<float>"), shard_rows=2000).collect()
    by = defaultdict(list)
    for r in out:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for d in (7, 32):
        rows = [(i, np.array(v, float)) for i, v in table if len(v) == d]
        u = np.array([v / np.linalg.norm(v) for _, v in rows])
        for q, (i, _) in enumerate(rows):
            if i % 50 or (d == 32 and i in (50,)) or sum(r[0] == i for r in table) > 1:
                continue
            s = u @ u[q]
            s[q] = -2
            want = sorted(((-round(a, 12), rows[j][0]) for j, a in enumerate(s.tolist())))[:5]
            hits += len({(v, round(c, 9)) for _, v, c in by[i]} & {(v, round(-a, 9)) for a, v in want})
            total += 5
            assert sorted(r[0] for r in by[i]) == [1, 2, 3, 4, 5]
            if i >= 10_000:
                assert [v for _, v, _ in sorted(by[i])] == sorted([3, *range(10_000, 11_500)], key=lambda v: (v == i, v))[:5]
    assert hits >= 0.9 * total and total > 500
    assert len([r for r in out if r.query_id == 50]) == 3 * 5
    met, all_pairs = retrieved[-1]
    assert met < 0.1 * all_pairs


@pytest.mark.parametrize("parts", [ann.MOST_PARTS, 8])
def test_neighbours_in_blocks(spark, monkeypatch, parts):
    """Groups of few rows and few queries give the same neighbours; where no number of parts reaches the target, all rows are compared and nothing is missed."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 16)).astype(np.float32)
    monkeypatch.setattr(ann, "MOST_PARTS", parts)
    plain = ann._ranked

    def watched(shared, k):
        work = plain(shared, k)

        def counted(asked, held):
            assert len(asked) <= 400 and len(held) <= 400
            return work(asked, held)

        return counted

    monkeypatch.setattr(ann, "_ranked", watched)
    out = ann.neighbours(spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), every=20, shard_rows=200, reach=0 if parts == 8 else 2).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    by = defaultdict(set)
    for r in out:
        by[r.query_id].add(r.vec_id // 10)
    hits = 0
    for q in range(0, 2000, 2):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & by[q * 10])
    assert len(out) == 5000 and hits >= (5000 if parts == 8 else 4500)


def test_neighbours_odd(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.neighbours(spark.createDataFrame([], kind)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(0, [1.0, 0.0])], kind)).count() == 0
    few = ann.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], kind)).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(1, 1), (2, 2)]


def test_toxicity(spark):
    rng = random.Random(5)
    table, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        w = [f"word{rng.randrange(400)}" for _ in range(30)]
        if toxic:
            w += rng.sample(["nasty", "vile", "rottenly", "rottenest"], 2)
        table.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    out = toxicity.score(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def plain_toxicity(table, given, features, voters, least, rounds):
    """Scores by id: voters, label model and classifier row by row, without sums over sets; the classifier by many gradient steps."""
    train = [(i, t) for i, t in table if zlib.crc32(str(i).encode()) % 5]
    y = np.array([given.get(i, -1) for i, _ in train])
    feats = [toxicity.features_of(t) for _, t in train]
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    pos, neg = Counter(f for fs, v in zip(feats, y) if v == 1 for f in fs), Counter(f for fs, v in zip(feats, y) if v == 0 for f in fs)
    share = {f: ((c + 0.5) / (n1 + 1), (neg[f] + 0.5) / (n0 + 1)) for f, c in pos.items() if c >= least}
    best = sorted((f for f, (p, q) in share.items() if p > 5 * q), key=lambda f: (-pos[f] * math.log(share[f][0] / share[f][1]), f))[:features]
    x = np.array([[float(f in fs) for f in best] for fs in feats])
    lexicon = []
    while len(lexicon) < voters:
        open_ = (y == 1) & (x[:, lexicon].sum(1) == 0)
        gain = {j: x[open_, j].sum() - 4 * x[y == 0, j].sum() for j in range(len(best)) if j not in lexicon}
        if not gain or max(gain.values()) < least:
            break
        lexicon.append(max(gain, key=lambda j: (gain[j], -j)))
    hits = x[:, lexicon].sum(1)
    v = np.column_stack([x[:, lexicon], hits >= 1, hits >= 2, hits == 0]).astype(float)
    use, post = y >= 0, y.astype(float)
    for _ in range(rounds + 1):
        w, p = v[use], post[use]
        rate1, rate0 = (p @ w + 0.5) / (p.sum() + 1), ((1 - p) @ w + 0.5) / ((1 - p).sum() + 1)
        rest = w - p[:, None] * rate1 - (1 - p)[:, None] * rate0
        scale = np.sqrt((rest**2).mean(0)) + 1e-9
        say = 1 / np.maximum(np.clip(rest.T @ rest / len(w) / np.outer(scale, scale), 0, 1).sum(1), 1)
        right = {(label, c): (post if c else 1 - post)[use & (y == label)].sum() + 50 * (0.98 if label == c else 0.02) for label in (0, 1) for c in (0, 1)}
        told = {label: math.log(right[label, 1] / (right[0, 1] + right[1, 1]) / right[label, 0] * (right[0, 0] + right[1, 0])) for label in (0, 1)} | {-1: 0.0}
        prior, z = p.mean(), []
        for row, label in zip(v, y):
            z.append(math.log(prior / (1 - prior)) + told[label] + sum(s * math.log(a / b if on else (1 - a) / (1 - b)) for on, s, a, b in zip(row, say, rate1, rate0)))
        post, use = 1 / (1 + np.exp(-np.array(z))), y >= -1
    x1 = np.column_stack([x, np.ones(len(x))])
    keep, rate = 1e-4 * np.append(np.ones(len(best)), 0), 1 / (np.linalg.norm(x1, 2) ** 2 / len(x1) / 4 + 1e-4)
    a = b = np.zeros(len(best) + 1)
    for t in range(20_000):
        new = b - rate * (x1.T @ (1 / (1 + np.exp(-x1 @ b)) - post) / len(x1) + keep * b)
        a, b = new, new + (new - a) * min(t / (t + 3), 0.99)
    return {i: 1 / (1 + math.exp(-a[-1] - sum(a[j] for j, f in enumerate(best) if f in toxicity.features_of(t)))) for i, t in table}


@pytest.mark.parametrize(("features", "voters"), [(40, 12), (10, 3)])
def test_toxicity_plain(spark, features, voters):
    """The query against a plain version: half of the texts have no label, some labels are wrong."""
    rng, table, given = random.Random(11), [], {}
    for i in range(900):
        toxic = rng.random() < 0.2
        w = [f"word{rng.randrange(60)}" for _ in range(12)] + rng.sample(["nasty", "vile", "rottenly", "rottenest", "foul", "grim"], 2 if toxic else rng.random() < 0.03)
        table.append((i, " ".join(w)))
        if rng.random() < 0.5:
            given[i] = int(toxic) ^ (rng.random() < 0.02)
    labels = spark.createDataFrame([(i, v) for i, v in given.items()], "doc_id long, toxic int")
    out = toxicity.score(spark.createDataFrame(table, "doc_id long, text string").repartition(5), labels, features=features, voters=voters, rounds=6).collect()
    want = plain_toxicity(table, {i: v for i, v in given.items() if zlib.crc32(str(i).encode()) % 5}, features, voters, 4, 6)
    assert len(out) == 900 and max(abs(r.score - want[r.doc_id]) for r in out) < 1e-5
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_toxicity_learns_from_unlabelled(spark):
    """Texts without label change the posteriors, and so the scores; held out texts do not."""
    rng = random.Random(4)
    text = lambda bad: " ".join([*(f"word{rng.randrange(40)}" for _ in range(10)), *(rng.sample(["nasty", "vile", "foul"], 2) if bad else [])])
    seen = [(i, text(i % 4 == 0)) for i in range(2000) if zlib.crc32(str(i).encode()) % 5][:400]
    held = [(i, text(True)) for i in range(9000) if zlib.crc32(str(i).encode()) % 5 == 0][:100]
    more = [(i, "word1 nasty word2") for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 5][:400]
    labels = spark.createDataFrame([(i, int("nasty" in t or "vile" in t)) for i, t in seen], "doc_id long, toxic int")
    of = lambda rows: {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    alone, with_held, with_more = of(seen), of(seen + held), of(seen + more)
    assert all(abs(alone[i] - with_held[i]) < 1e-9 for i, _ in seen) and max(abs(alone[i] - with_more[i]) for i, _ in seen) > 1e-3


def test_toxicity_odd(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (4, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs_of(odd_rows), labels).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs_of([]), labels).count() == 0
    assert {r.score for r in toxicity.score(docs_of(odd_rows), labels.limit(0)).collect()} == {0.0}


def test_surrogates(spark):
    table = [
        (1, "Mail anna.b@mail.example.com, card 4111 1111 1111 1111 or 4111111111111112, +1 (555) 123-4567."), (2, "Again anna.b@mail.example.com from 10.1.2.3; Mrs. Anna Berg met Herr Müller."),
        (3, 'token = "0123456789abcdef0123" and Ms. Anna Berg; Госпожа Анна Петрова'), (4, None), (5, ""), (None, "x anna.b@mail.example.com"),
    ]
    out = {r.doc_id: r for r in pii.anonymise(spark.createDataFrame(table, "doc_id long, text string"), "k").collect()}
    pairs = dict(p for r in out.values() for p in zip(r.entities, r.surrogates, strict=True))
    assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())
    assert out[4].clean_text is None and out[5].clean_text == "" and out[None].surrogates == out[2].surrogates[:1]
    luhn = lambda s: sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(re.sub(r"\D", "", s))))) % 10 == 0
    for a, b in pairs.items():
        assert len(re.sub(r"[^@. ()+-]", "", a)) == len(re.sub(r"[^@. ()+-]", "", b)) and (not re.fullmatch(r"[\d ]{16,19}", a) or luhn(a) == luhn(b))
    assert pairs["Mrs. Anna Berg"][5:] == pairs["Ms. Anna Berg"][4:] and pairs["Mrs. Anna Berg"].split()[1] in pii.FEMALE["latin"] and pairs["Госпожа Анна Петрова"].split()[1] in pii.FEMALE["cyrillic"]
    for i, text in table:
        want, at = "", 0
        for a, b in zip(out[i].entities, out[i].surrogates, strict=True):
            j = text.index(a, at)
            want, at = want + text[at:j] + b, j + len(a)
        assert out[i].clean_text == (want + text[at:] if text is not None else None)


def test_surrogates_whole(spark):
    """Nothing of an entity stays in clear, and spellings of one card, phone number or address agree."""
    long, mail = "aB3" * 70, "x" * 70 + "@" + "sub." * 12 + "example.com"
    table = [(1, f"token={long} end"), (2, f"{mail} end"), (3, "Frau Anna Maria Schmidt, Frau Klein-Schmidt und Mr. O'Brien, Mr. J. Keller's")]
    table += [(4, "4111 1111 1111 1111 and 4111111111111111"), (5, "+49 30 1234 5678 and +493012345678"), (6, "Anna.B@Example.com and anna.b@example.com")]
    out = {r.doc_id: r for r in pii.anonymise(spark.createDataFrame(table, "doc_id long, text string"), "k").collect()}
    assert out[1].entities == [f"token={long}"] and out[2].entities == [mail] and len(out[1].clean_text) == len(table[0][1])
    assert out[3].entities == ["Frau Anna Maria Schmidt", "Frau Klein-Schmidt", "Mr. O'Brien", "Mr. J. Keller"]
    assert all(w not in out[3].clean_text for w in ("Schmidt", "Klein", "Brien", "Keller")) and out[3].surrogates[0].count(" ") == 3
    for i in (4, 5):
        a, b = out[i].surrogates
        assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and a != out[i].entities[0] and " " in a and " " not in b
    assert out[5].surrogates[1].startswith("+49") and len({x.lower() for x in out[6].surrogates}) == 1 and out[6].surrogates[0][0].isupper()


def test_surrogate_collisions(spark):
    """Crowded formats: 500 family names of two letters, given names beyond the lists, and many addresses of one net."""
    two = [f"Mr {a}{b}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrst"][:500]
    many = [f"Frau {a}{b}a Berg" for a in "BCDFGHKLMN" for b in "aeiou"]
    net = [f"1.1.{a}.{b}" for a in range(20) for b in range(250)]
    table = [(i, "x " + " and ".join(rows[j : j + 50])) for rows in (two, many, net) for i, j in enumerate(range(0, len(rows), 50))]
    found = {}
    for r in pii.anonymise(spark.createDataFrame(table, "doc_id long, text string"), "k").collect():
        for e, s in zip(r.entities, r.surrogates, strict=True):
            assert found.setdefault(e, s) == s
    assert set(found) == {*two, *many, *net} and len(set(found.values())) == len(found) and not set(found) & set(found.values())
    assert len({found[e].split()[-1] for e in many}) == 1
    assert pii.exceptions(spark.createDataFrame([], "e string"), "k").count() == 0


def test_surrogate_coreference(spark):
    """Short and plain mentions follow the full name; other people's names and parts of words stay."""
    text = "Mr John Smith met Frau Keller. Later Mr Smith left; John Smith and Keller waited, Smithson and Blacksmith too."
    (r, other) = pii.anonymise(spark.createDataFrame([(1, text, "x"), (2, "Smith and Keller", "y")], "doc_id long, text string, pieces string"), "k").orderBy("doc_id").collect()
    assert r.entities == ["Mr John Smith", "Frau Keller", "Mr Smith"] and r.pieces == "x"
    full, keller, short = r.surrogates
    assert short.split()[-1] == full.split()[-1] and keller.split()[-1] != short.split()[-1]
    name, family = full[3:], short[3:]
    assert r.clean_text == f"{full} met {keller}. Later {short} left; {name} and {keller[5:]} waited, Smithson and Blacksmith too." and family not in ("Smith", "Keller")
    assert other.clean_text == "Smith and Keller"


def test_surrogates_odd(docs_of, odd_rows):
    assert pii.summary(docs_of(odd_rows), "k").count() == len(odd_rows) and pii.summary(docs_of([]), "k").count() == 0


def test_language(spark, docs, rows):
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [r for r in rows if out[r.doc_id].held_out]
    assert len(held) > 20 and sum(out[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def ppm_bits(order, train, text):
    """Code length of text (bytes) under the counts of train, worked out byte by byte."""
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        t = b" " * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[k][t[i - k : i]][t[i]] += 1
    total, text = 0.0, b" " * order + text
    for i in range(order, len(text)):
        p = 1.0
        for k in range(order, -1, -1):
            c = seen[k][text[i - k : i]]
            if c[text[i]]:
                p *= c[text[i]] / (sum(c.values()) + len(c))
                break
            if c:
                p *= len([x for x in c.values() if x]) / (sum(c.values()) + len([x for x in c.values() if x]))
        else:
            p /= 256
        total -= math.log2(p)
    return total


@pytest.mark.parametrize("max_entries", [1 << 21, 300, 40])
def test_code_lengths_plain(spark, max_entries):
    """Twelve languages of several scripts, in one pass, some passes, and passes over ranges of bytes."""
    rng = random.Random(4)
    letters = ["abcdefgh", "ijklmnop", "абвгдежз", "иклмнопр", "αβγδεζηθ", "אבגדהוזח", "日本語文字列中", "ABCDEFGH", "áéíóúñü", "0123abc", "ابتثجح", "กขคงจฉ"]
    make = lambda i: " ".join("".join(rng.choice(letters[i]) for _ in range(rng.randint(1, 5))) for _ in range(6))
    train = [(make(i), f"l{i:02}") for i in range(12) for _ in range(3)]
    tests = [(i, make(i % 12), "x", f"y{i}", i) for i in range(12)] + [(100, "a", None, None, None), (101, "zzz ÿ zz", None, None, None), (102, "123 !", None, None, None), (103, None, None, None, None)]
    model = langid.train(spark.createDataFrame([*train, (None, "l00"), ("dropped", None)], "text string, lang string"), max_entries=max_entries)
    assert model.langs == [f"l{i:02}" for i in range(12)] and (len(model.passes) == 1) == (max_entries > 1000)
    docs = spark.createDataFrame(tests, "doc_id long, text string, sums string, bytes string, row long")
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(out) == len(tests)
    for i, text, sums, other, row in tests:
        r = out[i]
        assert (r.sums, r.bytes, r.row) == (sums, other, row)
        if text is None or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.code_bits) == ("und", 0.0, None)
            continue
        lengths = {n: ppm_bits(langid.ORDER, [t.encode() for t, x in train if x == n], text.encode()) for n in model.langs}
        least = min(lengths.values())
        assert r.code_bits == pytest.approx(least, rel=1e-9)
        assert lengths[r.lang_pred] == pytest.approx(least, rel=1e-9)
        assert r.score == pytest.approx(1 / sum(2 ** max(least - x, -1000) for x in lengths.values()), rel=1e-6)


def test_language_odd(docs_of, odd_rows):
    out = langid.identify(docs_of(odd_rows)).collect()
    assert len(out) == len(odd_rows) and {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 6)} == {"und"}
    assert langid.identify(docs_of([])).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert sorted((r.doc_id, r.taken) for r in last.collect()) == sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, DATA).collect())
    items = [" ".join(decontam_words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(t in " ".join(decontam_words(r.text)) for r in docs.collect() for t in items)


def decontam_words(text):
    return [w.decode() for w in decontam.words_of(text.encode())]


NAMES = ("row", "id", "t", "pos", "keep", "lines", "kept", "sums", "bytes", "h", "cut", "src", "pieces", "names", "odd", "of", "new", "h1", "q", "c", "key", "b", "rep", "_row", "_n", "map_id", "slot", "first")


@pytest.fixture()
def clashing(spark):
    """Rows that share ids and texts, or have no id, with columns named like internal ones, all holding the row's number."""
    texts = ["Mr John Smith wrote to a@b.org and to nobody else in this whole long line.", "second text of several words\nand more", None, "", "third text that repeats, and repeats, in many rows of this table"]
    rows = [((i % 7) or None, texts[i % 5], "en" if i % 2 else "fr", "s" if i % 3 else None, i, *([str(i)] * len(NAMES))) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))


@pytest.mark.parametrize("op", ["mix", "lines", "language", "surrogates"])
def test_clashing_names(clashing, op):
    """Operators that keep the columns of their input keep their values, row by row."""
    run = {"mix": mixing.mix, "lines": line_dedup.dedup_lines, "language": lambda d: langid.predict(d, langid.train(d)), "surrogates": lambda d: pii.anonymise(d, "k")}[op]
    out = run(clashing)
    assert set(clashing.columns) <= set(out.columns)
    got = sorted(str(tuple(r[c] for c in clashing.columns)) for r in out.collect())
    assert got == sorted(str(tuple(r)) for r in clashing.collect())


@pytest.mark.parametrize("op", ["hmm", "near", "contaminated", "licenses", "toxicity", "identify"])
def test_clashing_names_narrow(spark, clashing, op):
    """Operators that return a row a document, or the matches, do so for rows that share ids or have none."""
    items = spark.createDataFrame([(1, "third text that repeats, and repeats, in many rows", "x")], "item_id long, text string, b string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    n = clashing.count()
    if op == "hmm":
        assert hmm.score(clashing, sample=20, warm=2, iterations=1).count() == n
    elif op == "near":
        out = minhash.near_duplicates(clashing).collect()
        assert len(out) == n and all(r.kept for r in out if r.doc_id is None)
    elif op == "contaminated":
        assert {r.doc_id for r in decontam.contaminated(clashing, items).collect()} == {(i % 7) or None for i in range(60) if i % 5 == 4}
    elif op == "licenses":
        assert license_scan.scan(clashing.withColumn("path", F.col("source"))).count() == n
    elif op == "toxicity":
        assert toxicity.score(clashing, labels).count() == n
    else:
        assert langid.identify(clashing).count() == n


@pytest.mark.parametrize("name", ["language", "lines", "near_duplicates", "decontamination", "mixture"])
def test_stages_keep_columns(clashing, name):
    import corpus_pipeline

    out = dict(corpus_pipeline.STAGES)[name](clashing.sparkSession, clashing, DATA)
    assert out.columns[: len(clashing.columns)] == clashing.columns and (name == "mixture" or out.columns == clashing.columns)
    assert all(r.row == r.slot == r.key for r in out.collect())


@pytest.mark.parametrize("name", ["language", "lines", "near_duplicates", "decontamination", "mixture"])
def test_stages_odd(spark, docs_of, odd_rows, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs_of(odd_rows), DATA).count() <= len(odd_rows)
    assert stage(spark, docs_of([]), DATA).count() == 0


def test_near_duplicates_among_many_repeated_rows(spark):
    """Two near documents, 2,000 rows each under one id, and as many rows of other texts under a third id, cost no more than their rows."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:-2] + ["x", "y"])]
    rows = [(i + 1, t) for _ in range(2000) for i, t in enumerate(texts)] + [(3, f"other text number {i} of these rows") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = minhash.near_duplicates(df, width=2).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, out)) == [(1, 1, 2000), (2, 1, 2000), (3, 3, 2000)]


def test_plain_mentions_in_one_pass(spark):
    """Mentions are read in the text as it was: a surrogate that is another entity's name stays, gender and links hold; words stay words."""
    texts = ["Mrs Maria Smith called. Later Maria Smith and Smith met Mr Laura, and Maria left.", "Mr Long walked a Long way with Mr John Long and John Long.", "Mr May came in May.", "Ms Ann Lee, Ann-Marie, Lee and Leeds"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for key in ("a", "b"):
        out = {r.doc_id: r for r in pii.anonymise(rows, key).collect()}
        mrs, mr = out[0].surrogates
        given, family = mrs.removeprefix("Mrs ").rsplit(" ", 1)
        assert given in pii.FEMALE["latin"]
        assert out[0].clean_text == f"{mrs} called. Later {given} {family} and {family} met {mr}, and {given} left."
        long, john = (s.removeprefix("Mr ") for s in out[1].surrogates)
        assert out[1].clean_text == f"Mr {long} walked a Long way with Mr {john} and {john}." and john.endswith(f" {long}")
        assert out[2].clean_text == f"{out[2].surrogates[0]} came in May."
        given, family = out[3].surrogates[0].removeprefix("Ms ").rsplit(" ", 1)
        assert out[3].clean_text == f"Ms {given} {family}, {given}-Marie, {family} and Leeds"


def test_more_formats(spark):
    """IBAN keep their country and whether they check, IPv6 addresses stay addresses; local numbers are found, what looks like them is not."""
    import ipaddress

    good, bad = "GB82 WEST 1234 5698 7654 32", "DE45370400440532013000"
    found = [good, good.replace(" ", ""), bad, "NO9386011117947", "2001:db8::ff00:42:8329", "2001:DB8::FF00:42:8329", "1:2:3:4:5:6:7:8", "(030) 1234 5678", "555-123-4567", "(555) 123-4567", "078-05-1120"]
    free = ["12:30:45", "add::dead", "std::vector", "(1998) 1234-1240", "AB12CDEFGHIJKL", "2024-05-12", "1-22-333", "00:1b:44:11:3a:b7"]
    text = " ; ".join(found + free)
    out = pii.anonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert out.entities == found and len(set(out.surrogates)) == len(found) and not set(found) & set(out.surrogates)
    pairs = dict(zip(found, out.surrogates, strict=True))
    rest = lambda s: int("".join(str(int(c, 36)) for c in s.replace(" ", "")[4:] + s[:4])) % 97
    shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", s)))
    for e in found:
        assert shape(pairs[e]) == shape(e)
        if e[:2].isalpha():
            assert pairs[e][:2] == e[:2] and (rest(pairs[e]) == 1) == (rest(e) == 1) == (e != bad)
        elif ":" in e:
            ipaddress.IPv6Address(pairs[e])
    assert pairs[good].replace(" ", "") == pairs[found[1]] and pairs[found[4]].upper() == pairs[found[5]]
    assert out.clean_text == " ; ".join(list(out.surrogates) + free)


def test_initials_and_capitals(spark):
    text = "Mr John Smith came. J. Smith and SMITH agreed; K. Smith left. Mr Long, LONG ago."
    out = pii.anonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    given, family = out.surrogates[0].removeprefix("Mr ").rsplit(" ", 1)
    assert out.clean_text == f"Mr {given} {family} came. {given[0]}. {family} and {family.upper()} agreed; K. {family} left. {out.surrogates[1]}, LONG ago."


def test_surrogate_query_plain(spark):
    """The query's rows against a plain reading: entities by the pattern, rewritten text from the operator's surrogates by regular expressions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL")
    import regex

    pattern = regex.compile(pii.ANY.replace("++", "+").replace("*+", "*"))
    full = {r.doc_id: r for r in pii.anonymise(docs, "k").collect()}
    rows = {r.doc_id: r for r in pii.summary(docs, "k").collect()}
    seen = 0
    for r in docs.collect():
        found, out = pattern.findall(r.text), full[r.doc_id]
        assert list(out.entities) == found and rows[r.doc_id].n_entities == len(found)
        assert rows[r.doc_id].clean_sha256 == hashlib.sha256(out.clean_text.encode()).hexdigest()
        names, rebuilt, new = [], "", iter(out.surrogates)
        for e, s in zip(out.entities, out.surrogates, strict=True):
            if m := regex.match(rf"(?:{pii._FORMS})\.? ", e):
                a, b = e[m.end() :], s[m.end() :]
                last = [regex.search(r"[^ .]+$", x)[0] for x in (a, b)]
                parts = [(last[0], last[1]), (a[: -len(last[0])].rstrip(), b[: -len(last[1])].rstrip())]
                names += [(a, b)] * (" " in a) + [p for p in parts if p[0] and not p[0].endswith(".") and p[0].lower() not in pii.WORDS]
                more = [(f"{a[0]}. {last[0]}", f"{b[0]}. {last[1]}")] * bool(parts[1][0]) + [(last[0].upper(), last[1].upper())] * (len(last[0]) > 2)
                names += [p for p in more if p[0].lower() not in pii.WORDS]
        swap = {}
        for a, b in names:
            swap.setdefault(a, b)
        gap = regex.compile(r"(?<![\p{L}\p{M}])(?:" + "|".join(map(regex.escape, sorted(swap, key=len, reverse=True))) + r")(?![\p{L}\p{M}])") if swap else None
        plain = lambda t: gap.sub(lambda m: swap[m[0]], t) if gap else t  # noqa: E731, B023
        at = 0
        for m in pattern.finditer(r.text):
            rebuilt += plain(r.text[at : m.start()]) + next(new)
            at, seen = m.end(), seen + 1
        assert out.clean_text == rebuilt + plain(r.text[at:])
    assert seen > 50


def test_fit_sample_is_bounded(spark):
    """The driver gets about as many vectors as it asks for, whatever the number of partitions."""
    for parts in (2, 40):
        classes = spark.range(20_000).repartition(parts).select(F.array(F.rand(3), F.rand(4)).alias("v"))
        assert 350 < len(ann.fit_sample(classes, 20_000, 500)) < 650
    few = spark.range(3).select(F.array(F.col("id") + 1.0, F.lit(2.0)).alias("v"))
    assert len(ann.fit_sample(few, 3, 500)) == 3 and len(ann.fit_sample(few, 1 << 20, 1)) >= 1


def test_neighbours_broadcast_no_probes(spark, monkeypatch):
    """Neither the probes of the queries (thousands of rows a query) nor rows of classes are broadcast, however small their files are."""
    plans = {}
    plain = ann.stored

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(ann, "stored", watched)
    x = np.random.default_rng(6).standard_normal((400, 16))
    assert ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), every=20).count() == 100
    for name in ("classes", "asking", "found"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name], plans[name]
