"""The pipeline's stages one by one on a small corpus, and the registered queries' columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from logweave.llm import queries, simhash

from .conftest import prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, path = random.Random(8), tmp_path_factory.mktemp("sf")
    base = [(i, prose(rng, rng.randrange(60, 200)), "en", f"s{i % 4}") for i in range(120)]
    copies = [(200 + i, base[i][1].replace(" ", "  "), "en", "s1") for i in range(10)]
    near = [(300 + i, base[20 + i][1] + " appended", "en", "s2") for i in range(5)]
    toxic = [(400 + i, prose(rng, 40) + " vileword " + prose(rng, 30) + " nastything vileword", "en", "s0") for i in range(90)]
    items = [(i, prose(rng, 30)) for i in range(5)]
    leaks = [(600 + i, prose(rng, 40) + " " + items[i][1], "en", "s3") for i in range(5)]
    docs = [(*r, len(r[1])) for r in base + copies + near + toxic + leaks]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, int(400 <= i < 500)) for i, *_ in docs if i % 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        rows = out.collect()
        ids.append({r.doc_id for r in rows})
        assert ids[-1] <= ids[-2], name
        if name != "mixing":
            assert len(rows) == len(ids[-1])
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    lost = [a - b for a, b in zip(ids, ids[1:], strict=False)]
    assert len(lost[0] & set(range(400, 490))) >= 88 and not lost[0] - set(range(400, 490))
    assert len(lost[1]) == 10 and all(i >= 200 or 200 + i in ids[2] for i in lost[1])
    assert lost[2] <= {20 + i for i in range(5)} | {300 + i for i in range(5)}
    assert lost[3] == set(range(600, 605))
    # the mix is realised: texts come back, as often as decided, some twice and some not at all
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text for r in rows) and {r.copy for r in rows} == {1, 2} and lost[4]
    times = Counter(r.doc_id for r in rows)
    assert all(times[r.doc_id] == r.copies for r in rows) and rows[0].exponent < 1
    tokens = Counter()
    for r in rows:
        tokens[r.source] += r.tokens
    assert max(tokens.values()) < 1.1 * min(tokens.values())


def test_run_and_queries(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 80
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(queries.oracle_sql()) <= set(names)
    want = {
        "op1": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op2": {"doc_id", "fingerprint", "component_id"}, "op3": {"doc_id", "held_out", "score", "predicted"},
        "op4": {"doc_id", "n_lines", "n_dropped", "kept_sha256"}, "op6": {"doc_id", "held_out", "lang_pred", "score"}, "op7": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op9": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    }
    for name, f in queries.queries().items():
        df = f(spark, corpus)
        assert want.get(name.split("_")[0], {"doc_id"}) <= set(df.columns) and df.count() == 230


def test_near_copies_go(spark, tmp_path):
    rng = random.Random(12)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(20)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):  # one word changed in the middle
        words = t.split()
        words[len(words) // 2] = "changed"
        docs.append((100 + i, " ".join(words), "en", "s", 1))
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == list(range(20))


def test_simhash_links_go(spark, tmp_path):
    """Documents within two bits of each other's SimHash are one class, also where their sets of shingles differ much."""
    rng = random.Random(13)
    phrase = prose(rng, 7)
    texts = [f"{' '.join([phrase] * 40)} {prose(rng, 20)}" for _ in range(3)] + [prose(rng, 90) for _ in range(5)]
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= 2 for p in prints[:3]) and all((prints[0] ^ p).bit_count() > 2 for p in prints[3:])
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [0, 3, 4, 5, 6, 7]
