"""Exact, near, line and passage duplicates against plain versions."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

from logweave.llm import components, exact_dedup, line_dedup, near_dedup, simhash, substring_dedup

from .conftest import ODD, prose

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def plain_components(nodes, edges):
    parent = {n: n for n in nodes}
    for a, b in edges:
        a, b = sorted((find(parent, a), find(parent, b)))
        parent[b] = a
    return {n: find(parent, n) for n in nodes}


# ---- exact


def corpus(rng):
    texts = [prose(rng, rng.randrange(1, 30)) for _ in range(25)]
    rows = [(i, rng.choice(texts)) for i in range(150)]
    rows += [(200 + i, texts[0].replace(" ", rng.choice(["", "\t", "  "]))) for i in range(60)]  # a hot group, spaced differently
    return rows + ODD


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact(spark, table, digest_bytes):
    rows = corpus(random.Random(1))
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in SPACE)].append((-len(t or ""), i is None, i or 0, i))
    want = sorted(((i is None, i or 0), (keep := min(g)[3]), len(g), i == keep, hashlib.sha256(n.encode()).hexdigest()[: 2 * digest_bytes]) for n, g in groups.items() for *_, i in g)
    got = exact_dedup.exact_dedup(table(rows), salts=4, digest_bytes=digest_bytes).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got) == want
    kept = exact_dedup.keep_first(table(rows))
    assert kept.columns == table([]).columns and {r.doc_id for r in kept.collect()} == {k for _, k, *_ in want}


def test_exact_empty(table):
    assert exact_dedup.exact_dedup(table([])).collect() == []


# ---- near


def plain_print(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, table):
    rng = random.Random(2)
    base = [prose(rng, 400) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):  # near copies, and copies of near copies
        words = rng.choice(rows)[1].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += ODD + [(9010, "A b"), (9011, "a  B")]
    prints = [(i, plain_print(t)) for i, t in rows]
    kinds = sorted({p for _, p in prints})
    linked = plain_components(kinds, [(a, b) for n, a in enumerate(kinds) for b in kinds[n:] if bin(a ^ b).count("1") <= 2])
    least = {}
    for i, p in prints:
        if i is not None:
            least[linked[p]] = min(i, least.get(linked[p], i))
    want = sorted((i is None, i or 0, p, least.get(linked[p]) or -1) for i, p in prints)
    for hot_rows in (8, 2, 1):  # with 1 every fingerprint counts as hot
        got = simhash.simhash_classes(table(rows), hot_rows).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.fp & (1 << 64) - 1, r.component_id or -1) for r in got) == want
    assert len({c for *_, c in want}) < len(rows) - 40 and simhash.simhash_classes(table([])).collect() == []
    kept = simhash.keep_one(table(rows[:68]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c if c > 0 else 0 for c in (least[linked[p]] for _, p in prints[:68])})


def test_golay_keys_meet():
    golay, rng = simhash.Golay(), np.random.default_rng(0)
    fp = rng.integers(0, 1 << 63, 200, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    keys = defaultdict(set)
    for k, f in zip(*simhash.keys_of(fp, golay), strict=True):
        keys[int(f)].add(int(k))
    for f in fp[:40]:
        near = simhash._MASKS ^ f
        reached = {int(o) for k, o in zip(*simhash.keys_of(near, golay), strict=True) if int(k) in keys[int(f)]}
        assert reached == {int(x) for x in near}


def test_large_runs_by_neighbours(monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 62, 5, dtype=np.int64).astype(np.uint64)
    run = np.unique(np.concatenate([centre, *(c ^ rng.choice(simhash._MASKS, 60) for c in centre)]))
    small = simhash.links(run)
    monkeypatch.setattr(simhash, "PAIRWISE", 0)
    large = simhash.links(run)
    assert dict(zip(*map(np.ndarray.tolist, small), strict=True)) == dict(zip(*map(np.ndarray.tolist, large), strict=True))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(7, 7), (300, 301), (301, 300)]
    edges += [(hub, 10_000 * k + i) for k, hub in enumerate((400, 90_000), 1) for i in range(1500)]  # hot nodes, smallest and largest of their component
    rng.shuffle(edges)
    want = plain_components({x for e in edges for x in e}, edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.node: r.root for r in components.components(df).collect()} == {n: r for n, r in want.items() if n != r}
    assert components.components(df.limit(0)).collect() == []


def test_component_store(spark):
    rng = random.Random(7)
    names = [rng.getrandbits(64) for _ in range(3000)]
    chain = sorted(names[:400])
    edges = list(zip(chain, chain[1:])) + [(names[500], x) for x in names[500:900]]
    edges += [(rng.choice(names[1000:]), rng.choice(names[1000:])) for _ in range(1500)]
    rng.shuffle(edges)
    want = {n: r for n, r in plain_components({x for e in edges for x in e}, edges).items() if n != r}
    signed = [[x - (1 << 64) if x >> 63 else x for x in e] for e in edges]
    df = spark.createDataFrame(signed, "a long, b long").repartition(5)

    def blocks(batches):
        return components.edge_blocks(((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), 3, 100)

    store = components.component_store(df.mapInArrow(blocks, components.BLOCK), 3)
    found = {n: r for b in range(8) for n, r in zip(*(x.tolist() for x in store.bucket(b)))}
    assert found == want and store.n == len(want)
    assert components.component_store(df.limit(0).mapInArrow(blocks, components.BLOCK), 3).n == 0


FREED = """
import sys, numpy as np, pyarrow as pa
from logweave.llm import common, hashstore
from logweave.session import session
spark = session(master="local-cluster[1,1,1024]", shuffle_partitions=2, **{"spark.checkpoint.dir": "file://" + sys.argv[1], "spark.driver.host": "127.0.0.1"})

def blocks(batches):
    for batch in batches:
        keys = np.sort(batch.column(0).to_numpy().view("u8"))
        yield hashstore.block_batch(list(hashstore.to_blocks(keys, [keys], 3)))

hashstore.build(spark.range(1000).mapInArrow(blocks, hashstore.BLOCK), "keys", 3, ["u8"], ["u8"], lambda a: ([np.unique(a[0])], []))
common.free_shuffles(spark)
print("left", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size())
"""


def test_shuffles_are_freed_on_executors(tmp_path):
    root = Path(__file__).resolve().parents[2]
    run = subprocess.run([sys.executable, "-c", FREED, str(tmp_path)], capture_output=True, text=True, timeout=180, cwd=root, env=os.environ | {"PYTHONPATH": str(root)})
    assert "left 0" in run.stdout, run.stdout + run.stderr[-2000:]


def test_near_sets(spark, table):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(2, 90))) for i in range(30)] + [(30, "a b"), (31, "A  b"), (32, "a b c")]
    for i in range(150):  # chains of edits, so that many pairs lie on either side of the threshold
        words = rng.choice(rows)[1].split()
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(len(words))] = f"changed{rng.randrange(5)}"
        rows.append((100 + i, " ".join(words)))
    rows += ODD
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    kinds = list(dict.fromkeys(sets))
    linked = plain_components(range(len(kinds)), [(a, b) for b in range(len(kinds)) for a in range(b) if len(kinds[a] & kinds[b]) >= 0.8 * len(kinds[a] | kinds[b])])
    classes = defaultdict(set)
    for (i, _), s in zip(rows, sets, strict=True):
        classes[linked[kinds.index(s)]].add((i is None, i or 0))
    assert 60 < len(classes) < len(kinds) - 10
    got = near_dedup.keep_one(table(rows))
    assert got.columns == table([]).columns
    assert {(r.doc_id is None, r.doc_id or 0) for r in got.collect()} == {min(c) for c in classes.values()}
    assert near_dedup.keep_one(table([])).collect() == []


# ---- lines


def test_lines_are_streamed(spark, table):
    """The sorted ranges feed the window without another exchange."""
    lines = line_dedup.long_lines(table([(i, "x" * 50) for i in range(20)]), 40)
    plan = line_dedup.first_occurrences(lines, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Sort [") == 1 and "Window [" in plan and "hashpartitioning(h1" not in plan


@pytest.mark.parametrize("size", [1_000_000, 50])
def test_lines(spark, table, monkeypatch, size):
    monkeypatch.setattr(line_dedup, "SLICE", size)
    rng = random.Random(4)
    lines = [prose(rng, n) for n in (3, 8, 9, 10, 11)] + ["Ä" * 40, "x" * 39, "x" * 40]
    rows = [(i, "\n".join(rng.choice([" %s\t", "%s", "%s\r"]) % rng.choice([str.upper, str])(rng.choice(lines)) for _ in range(rng.randrange(1, 9)))) for i in range(80)] + ODD
    rows += [(500 + i, lines[3]) for i in range(80)]  # a line that half of all documents hold
    docs_of = defaultdict(set)
    key = lambda line: lower(line.strip(SPACE))
    rank = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                docs_of[key(line)].add(rank(i))
    want = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(docs_of.get(key(x), ())) >= 5 and max(docs_of[key(x)]) != rank(i))]
        want.append((i is None, i or 0, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    got = line_dedup.line_dedup(table(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept) for r in got) == sorted(want)
    assert sum(w[3] for w in want) > 100
    assert line_dedup.line_dedup(table([])).collect() == []


# ---- passages


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (x != y)))
        d = new
    return d[-1]


def plain_passages(rows, shape):
    """Every paragraph, all pairs that share a key compared by their words: which are repeated, and who keeps them."""
    units, kinds, keys = [], {}, {}
    for n, (i, t) in enumerate(rows):
        p = substring_dedup.Paragraphs([(t or "").encode()], shape)
        words = WORD.findall(lower(t))
        for at, size, unit, key in zip(p.at, p.size, p.unit, p.keys(), strict=True):
            units.append((n, substring_dedup.NULL_ID if i is None else i, int(unit)))
            assert kinds.setdefault(int(unit), words[at : at + size]) == words[at : at + size]
            keys[int(unit)] = set(key.tolist())
    names = sorted(kinds)
    links, ends, of_key = [], {}, defaultdict(set)
    for _, i, unit in units:
        low, high = ends.get(unit, (i, i))
        ends[unit] = min(low, i), max(high, i)
    for unit, found in keys.items():
        for k in found:
            of_key[k].add(ends[unit])
    keys = {u: {k for k in found if len(of_key[k]) > 1} for u, found in keys.items()}  # copies of one text unite nothing
    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            if keys[a] & keys[b] and plain_distance(kinds[a], kinds[b]) <= 0.2 * max(len(kinds[a]), len(kinds[b])) + 1e-9:
                links.append((a, b))
    linked = plain_components(names, links)
    docs = defaultdict(set)
    for _, i, unit in units:
        docs[linked[unit]].add(i)
    out = defaultdict(lambda: [0, 0, 0])
    for n, i, unit in units:
        d = docs[linked[unit]]
        out[n][0] += 1
        out[n][1] += min(d) != i
        out[n][2] += min(d) == i and max(d) != i
    return out, len(links)


def test_edit_distance():
    rng = random.Random(10)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        assert substring_dedup.edit_distance(a, b) == plain_distance(a, b)
        for threshold in (0.5, 0.7, 0.8, 0.9):
            assert substring_dedup.similar(a, b, threshold) == (plain_distance(a, b) <= (1 - threshold) * max(len(a), len(b)) + 1e-9)
    packed = [rng.randbytes(5 * rng.randrange(1, 40)) for _ in range(50)]
    assert substring_dedup.word_lists(packed) == [substring_dedup.words_of(p) for p in packed]


@pytest.mark.parametrize("group", [2000, 1])
def test_passages(spark, table, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)  # with 1 all groups count as large
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (49, 52, 80, 200)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(5, 60)) for _ in range(2)]
        if i % 2:
            words = passages[i % 4 if i % 8 else 0].split()
            if i % 5 == 0:
                words[len(words) // 2] = "edited"  # a near copy
            parts.insert(1, " ".join(words) if i % 3 else "\n".join(words))
        rows.append((i, " ".join(parts)))
    rows += [(100, "The " * 120), (101, "the " * 90), (102, "short text of six words"), (103, "a short text of six words"), (104, "short text of SIX words"), (105, "a b c d")] + ODD
    # a phrase that many different paragraphs hold, so that groups stay open after the first comparisons
    rows += [(200 + i, f"{prose(rng, 20)} licensed under the terms of this licence {prose(rng, 20)}") for i in range(40)]
    shape = substring_dedup.Shape()
    want, n_links = plain_passages(rows, shape)
    assert n_links > 0
    result = substring_dedup.repeated_passages(table(rows)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_paragraphs, r.n_repeated, r.n_shared) for r in result)
    assert got == sorted((i is None, i or 0, *want[n]) for n, (i, _) in enumerate(rows))
    by_id = {r.doc_id: r for r in result}
    holders = [i for i in range(40) if i % 2 and passages[3] in rows[i][1].replace("\n", " ")]
    for i in holders[1:]:
        assert holders[0] in by_id[i].keep_ids and by_id[i].n_removed_words >= 150
        assert passages[3] not in substring_dedup.cut(rows[i][1], by_id[i].spans).replace("\n", " ")
    assert all(by_id[i].n_removed_words == 0 for i in range(0, 40, 2)) and by_id[104].n_repeated == 1 and by_id[105].n_paragraphs == 0
    assert substring_dedup.repeated_passages(table([])).collect() == []


def edited(words, rng, every):
    """A word changed, added or lost every so many words."""
    out, i = list(words), rng.randrange(every)
    while i < len(out):
        k = rng.randrange(3)
        if k == 2:
            del out[i]
        else:
            out[i : i + 1 - k] = [prose(rng, 1)]
        i += every
    return out


def test_edited_passages_are_found(spark, table):
    """Passages of 50 to 150 words with an edit every 20 words, between unlike contexts: at least 0.9 of each length are found."""
    rng = random.Random(11)
    rows, pairs = [], defaultdict(list)
    for length in (50, 60, 100, 150):
        for at in range(40):
            p = prose(rng, length).split()
            doc = 1000 * length + 2 * at
            for i, words in ((doc, p), (doc + 1, edited(p, rng, 20))):
                rows.append((i, f"{prose(rng, rng.randrange(5, 70))} {' '.join(words)} {prose(rng, rng.randrange(5, 70))}"))
            pairs[length].append(doc)
    clean = [(10**6 + i, prose(rng, 150)) for i in range(100)]
    found = {r.doc_id: r for r in substring_dedup.repeated_passages(table(rows + clean)).collect()}
    for length, docs in pairs.items():
        assert sum(found[d].n_shared > 0 and found[d + 1].keep_ids == [d] for d in docs) >= 0.9 * len(docs), length
    assert not any(found[i].n_repeated or found[i].n_shared for i, _ in clean)


def test_no_similar_paragraph_is_left_out(spark, table):
    """All pairs of paragraphs of different documents compared: whatever the edits, similar ones are found."""
    rng, rows = random.Random(21), []
    for n in [*range(5, 30), *[60] * 12]:
        words = prose(rng, n).split()
        k = n // 5
        for edits in range(1, k + 1) if n < 30 else [n // 5, n // 6]:  # spread out, so that few shingles stay
            other = list(words)
            for e in range(edits):
                other[(2 * e + 1) * n // (2 * edits)] = f"changed{len(rows)}x{e}"
            rows.append((len(rows), " ".join(other)))
        rows.append((len(rows), " ".join(words)))
    shape, units = substring_dedup.Shape(), []
    for i, t in rows:
        p = substring_dedup.Paragraphs([t.encode()], shape)
        units += [(i, t.split()[a : a + n]) for a, n in zip(p.at, p.size, strict=True)]
    want = Counter()
    for i, a in units:
        near = ((j, b) for j, b in units if i != j and abs(len(a) - len(b)) <= 6 and len(set(a) & set(b)) > 2)
        want[i] += any(plain_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for _, b in near)
    found = {r.doc_id: r.n_repeated + r.n_shared for r in substring_dedup.repeated_passages(table(rows)).collect()}
    assert sum(want.values()) > 100 and not {i: (found[i], n) for i, n in want.items() if found[i] < n}


def test_links_between_paragraphs_of_one_document(spark, table):
    """b is linked to the smaller document by a alone, which stands in b's document and shares no shingle of c's with it."""
    rng = random.Random(23)
    a = prose(rng, 25).split()
    change = lambda places: " ".join(f"changed{i}" if i in places else w for i, w in enumerate(a))
    rows = [(1, change([2, 5, 8, 11])), (5, " ".join(a)), (5, change([13, 16, 19, 22])), (7, prose(rng, 25))]
    found = substring_dedup.repeated_passages(table(rows)).collect()
    assert sorted((r.doc_id, r.n_repeated, r.n_shared) for r in found) == [(1, 0, 1), (5, 1, 0), (5, 1, 0), (7, 0, 0)]


def test_candidate_groups_hold_pairs_within_reach():
    rng = random.Random(24)
    anywhere = substring_dedup.ANYWHERE
    for spread, times in ((50, 1), (12, 1), (50, 6)):
        rows = {(key, 2 * rng.randrange(spread), unit) for key in (1, 2, 5) for unit in range(120) for _ in range(times)}
        rows |= {(key, 2 * place, unit) for key in (3, 4) for place, unit in ((3, 1000), (20, 1001), (21, 1002), (24, 1003))} | {(5, anywhere, 500)}
        rows = sorted(rows)
        got = substring_dedup.candidate_groups(np.array([k << 16 | p for k, p, _ in rows], np.uint64), np.array([u << 53 for *_, u in rows], np.uint64), 6)  # as wide as hashes are
        sets = defaultdict(set)
        for group, unit, n in zip(*map(np.ndarray.tolist, got), strict=True):
            sets[group, n].add(unit >> 53)
        near = lambda a, b: abs(a - b) <= 6 or anywhere in (a, b)
        want = {(u, v) for k, p, u in rows for key, q, v in rows if k == key and u < v and near(p, q)}
        assert all(any({u, v} <= held for held in sets.values()) for u, v in want) and all(n == len(held) for (_, n), held in sets.items())
        assert not any(1000 in held for held in sets.values())  # far from the others
        assert sum(held >= {1001, 1002} for held in sets.values()) == 1  # both keys make one


def test_large_groups_lose_no_link():
    """``unite`` against all pairs: groups of families of paragraphs and of runs of words, larger than FEW."""
    rng = random.Random(25)
    paragraphs = []
    for _ in range(12):
        base = [rng.randrange(1, 200) for _ in range(30)]
        for _ in range(8):
            paragraphs.append([w if rng.random() > 0.12 else rng.randrange(1, 200) for w in base][: rng.choice([30, 30, 27])])
    paragraphs += [[7] * i + [rng.choice([8, 9, 10])] * (30 - i) for i in range(31) for _ in range(2)]
    x = np.zeros((len(paragraphs), 30), np.uint64)
    for row, p in zip(x, paragraphs, strict=True):
        row[: len(p)] = p
    assert [r[: len(p)] for r, p in zip(substring_dedup.numbered_rows(x).tolist(), paragraphs, strict=True)] == [substring_dedup.numbered(p) for p in paragraphs]

    class Held:
        shape = substring_dedup.Shape()

        def rows(self, units):
            return x[units], np.array([len(paragraphs[u]) for u in units])

    group, unit = np.repeat([1, 2, 3], [len(x), 100, 20]), np.concatenate([np.arange(len(x)), np.arange(40, 140), np.arange(20)])
    want = [(a, b) for a in range(len(x)) for b in range(a) if substring_dedup.similar(paragraphs[a], paragraphs[b], 0.8)]
    assert plain_components(range(len(x)), list(zip(*substring_dedup.unite(group, unit, Held()), strict=True))) == plain_components(range(len(x)), want)
    some = plain_components(range(len(x)), want[::5])
    more = list(zip(*substring_dedup.unite(group, unit, Held(), np.array([some[u] for u in unit])), strict=True))
    assert plain_components(range(len(x)), more + want[::5]) == plain_components(range(len(x)), want)


def test_pairs_compared_at_once():
    rng = random.Random(22)
    some = lambda n: [rng.randrange(1, 9) for _ in range(n)]
    pairs = [(some(rng.randrange(1, 31)), some(rng.randrange(1, 31))) for _ in range(400)]
    pairs += [(a, [*a[:k], 9, *a[k + 2 :]]) for k in range(28) for a in [some(30)]]
    sides = []
    for side in (0, 1):
        rows = np.zeros((len(pairs), 30), np.uint64)
        for row, pair in zip(rows, pairs, strict=True):
            row[: len(pair[side])] = pair[side]
        sides += [rows, np.array([len(pair[side]) for pair in pairs])]
    for threshold in (0.5, 0.8, 0.9):
        want = [substring_dedup.similar(a, b, threshold) for a, b in pairs]
        assert substring_dedup.similar_rows(*sides, threshold).tolist() == want
        x, nx, y, ny = sides
        may = substring_dedup.may_be_similar(x.astype(np.uint8), y.astype(np.uint8), nx, ny, substring_dedup.edits(30, threshold))
        assert not any(w and not m for w, m in zip(want, may, strict=True))


def test_band_tuning():
    bands, rows = substring_dedup.tune_bands(0.8, 0.997, 12)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.997 and bands * rows <= 12


def test_clusters_lose_no_link():
    rng = random.Random(9)
    for _ in range(60):
        families = [[rng.randrange(60) for _ in range(26)] for _ in range(3)]
        seqs = []
        for _ in range(40):
            s = list(rng.choice(families))
            for _ in range(rng.randrange(6)):
                s[rng.randrange(26)] = rng.randrange(60)
            seqs.append(s[: rng.choice([26, 26, 20, 1])])
        alike = lambda i, j: substring_dedup.similar(seqs[i], seqs[j], 0.8)  # noqa: E731, B023
        pairs = [(a, b) for a in range(40) for b in range(a) if alike(a, b)]
        prefixes = [sorted(substring_dedup.numbered(s))[: substring_dedup.prefix_size(len(s), 0.8)] for s in seqs]
        got = substring_dedup.cluster(list(range(40)), prefixes, alike)
        want = plain_components(range(40), pairs)
        assert plain_components(range(40), got) == want and len(got) < 40
        some = plain_components(range(40), pairs[::3])
        more = substring_dedup.cluster(list(range(40)), prefixes, alike, [some[i] for i in range(40)])
        assert plain_components(range(40), more + pairs[::3]) == want
