"""Token counts, languages, toxicity, the n-gram model, decontamination and mixing against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import decontaminate, hashstore, kneser_ney, lang_id, mixing, token_counts, toxicity
from logweave.llm.words import shingle_hashes, word_hashes

from .conftest import ODD, prose

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- words and stores


def test_word_hashes():
    texts = ["a b c", "", "  A  b ", "x", "ñ é b", "\x0b\x0c", None]
    h, first = word_hashes([(t or "").encode() for t in texts])
    names = {}
    for n, t in enumerate(texts):
        own = h[first[n] : first[n + 1]].tolist()
        assert len(own) == len(tokens(t))
        for w, x in zip(tokens(t), own, strict=True):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    runs, inside = shingle_hashes(h, first, 2)
    assert runs[0] == runs[3] != runs[1] and inside.tolist() == [True, True, False, True, False, False, True, True, False]


def test_store(spark):
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    rows = [r for part in (keys[::2], keys[1::2], keys[:50]) for r in hashstore.to_blocks(part, [part, np.ones(len(part), "u4")], 3)]
    store, (total,) = hashstore.build(spark.createDataFrame(rows, hashstore.BLOCK), "t", 3, ["u8", "u4"], ["u8", "i8"], lambda a: (list(hashstore.sum_by_key(a[0], a[1].astype(np.int64))), [len(a[0])]), 1)
    assert store.n == len(keys) and total == len(keys) + 50
    (n,) = store.lookup(np.concatenate([keys, keys + np.uint64(1)]), [1])
    assert (n[:50] == 2).all() and (n[50 : len(keys)] == 1).all() and (n[len(keys) :] == 0).all()
    assert store.contains(keys).all() and not store.contains(keys + np.uint64(1)).any()


# ---- token counts


def test_token_counts(spark, table):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60)) for i in range(30)] + ODD
    rows += [(100, "it's  we'll\n\n x <|endoftext|> y<|endoftext|>"), (101, "<|endoftext|>"), (102, "  a՘b \x1c\x85 ½ ٣ 𐐀 ̀e"), (103, "a" * 5000), (104, "౜\U00010940 x")]
    library = token_counts.load(TOKENIZER)
    want = sorted((i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows)
    for share, cache in ((1e-3, 10), (1.0, 100_000)):
        got = token_counts.token_counts(table(rows), TOKENIZER, share, cache).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(table([]), TOKENIZER).collect() == []


# ---- languages


def test_languages(spark, table):
    rng = random.Random(2)
    roots = {"aa": ["bano", "celu", "dira"], "bb": ["krsto", "zvlik", "prun"], "cc": ["thoeu", "ouxai", "eail"]}
    text = lambda lang, n: " ".join("".join(rng.choice(roots[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    learnt = [(i, text(lang, 30), lang) for i in range(150) for lang in [rng.choice(list(roots))]] + [(900, "banobano", None)]
    model = lang_id.fit(table(learnt))
    assert model.langs == ["aa", "bb", "cc"]
    asked = [(1000 + i, text(lang, 12), lang) for i in range(60) for lang in [rng.choice(list(roots))]]
    got = {r.doc_id: r for r in lang_id.identify(table(asked + ODD + [(5000, "1234 !!"), (5001, "½ ² ① Ⅷ")]), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in asked]) == 1
    assert [got[i].lang_pred for i in (9001, 9002, 9003, 9004, 5000, 5001)] == ["und"] * 6 and got[9001].score == 0
    assert lang_id.words_in("x² ½ Ⅷ ab½cd é_f 9g") == ["x", "ab", "cd", "é", "f", "g"]
    assert lang_id.identify(table([]), model).collect() == []
    assert all(0 <= r.score <= 1 for r in got.values())
    # the vectorised backoff equals a plain one
    word = "celukrsto"
    for n in model.orders:
        rows = [model.rows[n][k] for g in lang_id.grams(word, n) for k in np.flatnonzero(model.keys[n] == lang_id.gram_keys(np.frombuffer(g.encode("utf-32-le"), np.uint32), n)[0])]
        if rows:
            assert np.allclose(model.unseen(["x", word])[1], model.table[rows].mean(axis=0) * model.weight, atol=1e-4)
            break
    nothing = lang_id.fit(table([(1, "text", None)]))
    assert [r.lang_pred for r in lang_id.identify(table([(1, "text")]), nothing).collect()] == ["und"]


# ---- toxicity


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(rng)
    x, mask = rng.standard_normal((4, 6, toxicity.INPUTS)), np.ones((4, 6), bool)
    mask[1, 3:], mask[2] = False, False
    y, w = np.array([0, 1, 1, 0.0]), np.array([1, 2, 1, 0.5])
    _, g, logit = net.loss(x, mask, y, w)
    for k, d in g.items():
        for _ in range(4):
            i, e = tuple(rng.integers(0, s) for s in d.shape), 1e-6
            net.p[k][i] += e
            up = net.loss(x, mask, y, w)[0]
            net.p[k][i] -= 2 * e
            down = net.loss(x, mask, y, w)[0]
            net.p[k][i] += e
            assert abs((up - down) / 2 / e - d[i]) < 1e-6
    runner = toxicity.Runner(net.p)
    f, b = runner.project(x[0].astype(np.float32))
    assert abs(runner.logits(f, b, np.arange(6)[None])[0] - logit[0]) < 1e-4


def test_windows():
    for n in (0, 1, 64, 65, 96, 97, 1000):
        starts = toxicity.window_starts(n, 64, 32)
        covered = {i for s in starts for i in range(s, min(s + 64, n))}
        assert covered == set(range(n)) and (np.diff(starts) <= 32).all() and (n <= 64 or starts[-1] == n - 64)


def test_toxicity(spark, table):
    rng = random.Random(3)
    bad = ["Vileword", "nastything", "foulspeech"]
    def text(toxic, n):
        words = prose(rng, n).split()
        for _ in range(3 * toxic):
            words[rng.randrange(n)] = rng.choice(bad) + rng.choice(["", "!", "es"])
        return " ".join(words)
    learnt = [(i, text(i % 3 == 0, rng.randrange(20, 200))) for i in range(360)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in learnt] + [(99_999, 1), (5, None)], "doc_id long, label int").where("doc_id <> 5 or label is not null")
    model = toxicity.fit(table(learnt), labels)
    asked = [(1000 + i, text(i % 2, rng.choice([30, 400]))) for i in range(80)]
    long = (2000, prose(rng, 3000) + " vileword nastything foulspeech vileword " + prose(rng, 3000))
    got = {r.doc_id: r.score for r in toxicity.score(table(asked + [long] + ODD), model).collect()}
    assert np.mean([(got[i] >= 0.7) == i % 2 for i, _ in asked]) > 0.95 and got[2000] > 0.7
    assert all(0 <= s <= 1 for s in got.values()) and got[9001] == got[9002]
    kept = toxicity.keep_clean(table(asked + ODD), model)
    assert kept.columns == table([]).columns and {r.doc_id for r in kept.collect()} == {i for i in got if i != 2000 and got[i] < 0.7}
    scorer = toxicity.Scorer(model, limit=50)  # a cache that runs over all the time gives the same
    assert np.allclose(scorer.score([t for _, t in asked]), [got[i] for i, _ in asked], atol=1e-5)
    one_kind = toxicity.fit(table(learnt), labels.where("label = 1"))
    assert {r.score for r in toxicity.score(table(ODD), one_kind).collect()} == {1.0}


# ---- n-gram model


def plain_model(texts, order):
    c, grams = Counter(), {order: Counter()}
    for t in texts:
        w = tokens(t) + ["</s>"]
        c.update(w)
        w = ["<s>"] * (order - 1) + w
        grams[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    d = {n: kneser_ney.discounts([sum(x == k for x in g.values()) for k in (1, 2, 3, 4)]) for n, g in grams.items()}
    contexts = defaultdict(lambda: [0, 0, 0, 0])
    for g in grams.values():
        for x, k in g.items():
            contexts[len(x), x[:-1]][0] += k
            contexts[len(x), x[:-1]][min(k, 3)] += 1

    def p(w, before):
        q = 1 / (len(c) + 1)
        for n in range(1, order + 1):
            context = before[len(before) - n + 1 :]
            if (n, context) in contexts:
                total, *seen = contexts[n, context]
                k = grams[n].get((*context, w), 0)
                q = (k - [0, *d[n]][min(k, 3)]) / total + sum(x * y for x, y in zip(d[n], seen, strict=True)) / total * q
        return q

    return c, p


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(spark, table, order):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["The", "a", "cat", "dog", "sat", "on"] + ["w%d" % rng.randrange(40)]) for _ in range(rng.randrange(0, 40)))) for i in range(60)] + ODD
    learnt = [r for r in rows if r[0] is not None and r[0] % 5]
    model = kneser_ney.fit(table(learnt), order, hot_share=0.1)
    assert len(model.hot_ids) > 2  # some words and the start mark
    c, p = plain_model([t for _, t in learnt], order)
    for r in kneser_ney.score(table(rows), model).collect():
        text = next(t for i, t in rows if i == r.doc_id)
        w = tokens(text) + ["</s>"]
        padded = ["<s>"] * (order - 1) + w
        n, v = sum(c.values()), len(c)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), abs_tol=1e-6)
        assert math.isclose(r.score, sum(math.log10(p(padded[i], tuple(padded[i - order + 1 : i]))) for i in range(order - 1, len(padded))), abs_tol=1e-6)
    before = ("the", "cat")[3 - order :]
    assert math.isclose(sum(p(w, before) for w in c) + p("never seen", before), 1, abs_tol=1e-9)
    empty = kneser_ney.score(table(rows[:2]), kneser_ney.fit(table([]), order)).collect()
    assert [r.score for r in empty] == [0, 0] and empty[0].train_tokens == 0


# ---- decontamination


def test_decontamination(spark, table):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randrange(15, 60))) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    held = {}
    rows = []
    for i in range(40):
        text = prose(rng, rng.randrange(5, 300))
        if i % 4 == 0:
            held[i], item = items[i % 12]
            text += " " + item.upper() + " " + prose(rng, 20)
        elif i % 4 == 1:  # reordered: five-word pieces in another order, with other words between
            held[i], item = items[i % 12]
            w = item.split()
            pieces = [w[k : k + 7] for k in range(0, len(w) - 6, 7)] + [w[-5:]]
            rng.shuffle(pieces)
            text += " " + " filler between ".join(" ".join(x) for x in pieces)
        elif i % 4 == 2:  # half of an item is not the item
            w = items[i % 12][1].split()
            text += " " + " ".join(w[: len(w) // 2])
        rows.append((i, text))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(table(rows + ODD), benchmark).collect()}
    assert {i for i, r in got.items() if r.contaminated} == set(held) and all(held[i] in got[i].item_ids for i in held)
    assert all(0.3 < got[i].coverage < 0.8 for i in range(2, 40, 4)) and got[9001].coverage == 0
    parts = {r.doc_id: (r.contaminated, r.coverage, r.item_ids) for r in decontaminate.decontaminate(table(rows), benchmark, part_bytes=500).collect()}
    assert parts == {i: (r.contaminated, r.coverage, r.item_ids) for i, r in got.items() if i in parts} and len(parts) == 40
    kept = decontaminate.keep_clean(table(rows + ODD), benchmark)
    assert kept.columns == table([]).columns and {r.doc_id for r in kept.collect()} == {i for i in got if i not in held}
    assert not any(r.contaminated for r in decontaminate.decontaminate(table(rows), benchmark.limit(0)).collect())
    assert decontaminate.decontaminate(table([]), benchmark).collect() == []
    for kind in ("decimal(10,0)", "double", "tinyint", "string"):
        typed = decontaminate.decontaminate(table(rows[:2]), benchmark.withColumn("item_id", benchmark.item_id.cast(kind)))
        assert typed.schema["item_id"].dataType.simpleString() == kind and [r.contaminated for r in typed.orderBy("doc_id").collect()] == [True, True]


def plain_tiles(doc, item, least):
    """Greedy tiling by looking at all matches each time."""
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                best = max(best, (n, -i, -d))
        n, i, d = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        for k in range(n):
            free_d[d + k] = free_i[i + k] = False
        tiles.append(n)


def test_tiles():
    rng = np.random.default_rng(6)
    for _ in range(150):
        doc, item = rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(3, 25))
        got = decontaminate.tile(doc.astype(np.uint64), item.astype(np.uint64), np.ones(len(doc), bool), 3)
        assert max((n for *_, n in got), default=0) == max(plain_tiles(doc.tolist(), item.tolist(), 3), default=0)
        used_d, used_i = [p for d, _, n in got for p in range(d, d + n)], [p for _, i, n in got for p in range(i, i + n)]
        assert len(set(used_d)) == len(used_d) and len(set(used_i)) == len(used_i)
        assert all(doc[d + k] == item[i + k] for d, i, n in got for k in range(n))
        assert not any(n >= 3 for n in plain_tiles(np.where(np.isin(np.arange(len(doc)), used_d), 100, doc).tolist(), np.where(np.isin(np.arange(len(item)), used_i), 200, item).tolist(), 3))


# ---- mixing


def test_solver():
    p = np.array([0.9, 0.06, 0.04])

    def of(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum(), (w / p).max()

    target = mixing.Target(0.9, 100)
    assert abs(of(mixing.solve(of, 3, target))[0] - 0.9 * np.log(3)) < 1e-9
    assert abs(of(mixing.solve(of, 3, mixing.Target(0.9, 1.5)))[1] - 1.5) < 1e-9
    assert mixing.solve(of, 3, mixing.Target(0.1, 2.0)) == 1.0 == mixing.solve(of, 1, target)


def _taken(got, rows):
    """(doc_id, text) -> copies, of rows and what was decided for their ids and token counts."""
    copies = {(r.doc_id, r.tokens): r.copies for r in got}
    out = Counter()
    for i, t, *_ in rows:
        out[i, t] += copies[i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))]
    return out


def test_mixing_equals_sql(spark, tmp_path):
    """The registered query against its SQL, with a hot source, null sources, repeated rows and ids, and empty texts."""
    import duckdb

    from logweave.llm import queries

    rng = random.Random(15)
    rows = [(i, prose(rng, rng.randrange(0, 60)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(500)]
    rows += [(i, None, "en", None) for i in range(500, 520)] + [(7, "one two", "en", "s1")] * 3 + [(7, "one", "en", "s1"), (None, "no id", "en", "hot"), (600, "", "en", "empty")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    df = queries.op5_mixing(spark, str(tmp_path))
    names = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.ORACLES["op5_mixing"])
    at = [d[0] for d in want.description]
    assert sorted(at) == names
    assert sorted(repr(tuple(r[at.index(c)] for c in names)) for r in want.fetchall()) == sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    assert df.select("exponent").first()[0] < 1 and df.select("copies").distinct().count() > 1


def test_mixing(spark, table):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(0, 40)), "en", "hot" if i % 10 < 8 else f"s{i % 10}") for i in range(600)] + [(i, t, "en", None) for i, t in ODD]
    target = mixing.Target(0.95, 2.0, 0.8)
    df = mixing.mix(table(rows), target, block_docs=16)
    got = df.collect()
    assert len(got) == len(rows)
    size, taken, weight = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.tokens
        taken[r.source] += r.tokens * r.copies
        weight[r.source] = r.weight
    whole = sum(size.values())
    p = {s: n / whole for s, n in size.items() if n}
    a = got[0].exponent
    z = sum(x**a for x in p.values())
    longest = max((r.tokens for r in got), default=0)
    for s, x in p.items():
        assert math.isclose(weight[s], x**a / z, rel_tol=1e-9)
        quota = round(weight[s] * whole * 0.8)
        rest = quota % size[s]
        assert quota <= taken[s] <= quota + longest or (rest == 0 and taken[s] == quota)
        mine = [r for r in got if r.source == s]
        assert max(r.copies for r in mine) - min(r.copies for r in mine) <= 1
    assert max(w * 0.8 / p[s] for s, w in weight.items() if s in p) <= 2.0 + 1e-9
    again = {(r.doc_id, r.tokens): r.copies for r in mixing.mix(table(rows, 5), target, block_docs=16).collect()}
    assert all(again[r.doc_id, r.tokens] == r.copies for r in got)
    # row by row: each source's last pass takes rows in order while fewer tokens than its rest came before
    for s in p:
        quota = round(weight[s] * whole * 0.8)
        rest, passes, before, place = quota % size[s], quota // size[s], 0, None
        at = lambda r: (r.turn, r.block, r.place, -(1 << 63) if r.doc_id is None else r.doc_id, r.tokens)
        held = 0
        for r in sorted((r for r in got if r.source == s), key=at):
            if at(r) != place:
                before, place, held = before + held, at(r), 0
            held += r.tokens
            assert r.copies == passes + (before < rest), (s, r)
    assert got[0].exponent < 1 and len({r.copies for r in got}) > 1
    real = mixing.realise(table(rows), target, block_docs=16)
    assert set(table([]).columns) - {"block", "weight"} <= set(real.columns)
    assert Counter((r.doc_id, r.text) for r in real.collect()) == Counter({k: n for k, n in _taken(got, rows).items() if n})
    assert mixing.mix(table([])).collect() == [] == mixing.realise(table([])).collect()
    silent = mixing.mix(table([(1, ""), (2, None)])).collect()
    assert [r.copies for r in silent] == [0, 0]


def test_mixing_order_can_be_replayed(spark, table):
    rng = random.Random(14)
    rows = [(i, "word " * rng.randrange(1, 9), "en", rng.choice("aab")) for i in range(300)]
    got = mixing.mix(table(rows), mixing.Target(0.95, 2.0, 0.8), block_docs=16).collect()
    for source in "ab":
        copies = [r.copies for r in sorted((r for r in got if r.source == source), key=lambda r: (r.turn, r.block, r.place, r.doc_id, r.tokens))]
        assert copies == sorted(copies, reverse=True)  # the last pass takes a prefix
    assert len({r.block for r in got}) > 5 and {r.copies for r in got if r.source == "a"} == {0, 1}
