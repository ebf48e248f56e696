"""The pipeline's stages one by one against brute force on rows with every edge, and its queries."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import common, components, mixing, packing, queries, toxicity
from test_corpus_operators import CLASH, SCHEMA, corpus, jaccard_sets, reference_best_fit, words

STAGE = dict(corpus_pipeline.STAGES)


def edge_rows():
    """The operators' corpus with an insult, more repeated rows, and one id with two texts."""
    rng = random.Random(9)
    rows = corpus()
    rows += [(500, "you worthless idiot, you moron", "en", "src1", 30), (None, "", "en", None, 0), (501, "two texts of one id " + str(rng.random()), "en", "hot", 9), (501, "another text of that id " + str(rng.random()), "en", "hot", 9)]
    return rows + [rows[30]] * 3


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})
    return df.repartition(3).persist()


def taken(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_toxicity_stage(spark, docs, sf):
    kept = STAGE["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    fine = [r for r in taken(docs) if model.score(*model.measure(model.matcher(), r[1])) < 0.3]
    assert Counter(taken(kept)) == Counter(fine) and 500 not in {r[0] for r in fine} and len(fine) > 60


def test_near_duplicate_stage(spark, docs, sf):
    kept = STAGE["ngram_jaccard_join"](spark, docs, sf)
    assert kept.columns == docs.columns
    rows = taken(docs)
    texts = sorted({(r[1] or "").lower() for r in rows if words(r[1])})
    sets, up = [jaccard_sets(t) for t in texts], components.Sets()
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up.join(a, b)
    least = defaultdict(list)  # ids of each group's texts
    for i, t, _ in rows:
        if i is not None and words(t):
            least[up.find(texts.index(t.lower()))].append(i)
    got = Counter(taken(kept))
    loose = [r for r in rows if r[0] is None or not words(r[1])]
    assert not Counter(loose) - got and sum(got.values()) == len(loose) + len(least)
    firm = got - Counter(loose)
    assert sorted(i for i, *_ in firm.elements()) == sorted(min(ids) for ids in least.values())


def test_substring_stage(spark, docs, sf):
    cut = STAGE["substring_dedup"](spark, docs, sf)
    assert cut.columns == docs.columns and dict(cut.dtypes) == dict(docs.dtypes)
    rows, places = taken(docs), defaultdict(list)
    split = [words(r[1]) for r in rows]
    for d, w in enumerate(split):
        for k in range(len(w) - 34):
            places[tuple(w[k : k + 35])].append((d, k))
    gone = {(d, k + j) for at in places.values() if len(at) > 1 for d, k in at for j in range(35)}
    want = []
    for d, (i, t, s) in enumerate(rows):
        kept = [w for k, w in enumerate(split[d]) if (d, k) not in gone]
        if len(kept) == len(split[d]):
            want.append((i, t, s))
        elif kept:
            want.append((i, " ".join(kept), s))
    assert Counter(taken(cut)) == Counter(want)
    changed = [r for r in cut.collect() if r["text"] and r["doc_id"] is not None and 25 + 10 <= r["doc_id"] <= 40]
    assert changed and all(r["n_chars"] == len(r["text"]) for r in changed)


def test_mixing_stage(spark, docs, sf):
    mixed = STAGE["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns
    rows, got = taken(docs), Counter(taken(mixed))
    plan = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix_sources(docs).collect()}
    ids = Counter(r[0] for r in rows)
    assert set(got) <= set(rows)
    for r in set(rows):
        if not words(r[1]):
            assert got[r] == Counter(rows)[r]
        elif ids[r[0]] == 1:
            share, size = plan[r[0]]
            assert got[r] == int(share / size + 0.5) <= 3


def test_packing_stage(spark, docs, sf):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.tokenizer_path()).encode
    packed = STAGE["best_fit_packing"](spark, docs, sf).collect()
    lengths = [min(2048, n - a) for _, t, _ in taken(docs) for n in [len(encode(t or "", add_special_tokens=False).ids) + 1] for a in range(0, n, 2048)]
    assert Counter(r["length"] for r in packed) == Counter(lengths)
    held = defaultdict(list)
    for r in packed:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(held) == len(reference_best_fit(lengths, 2048))
    assert all(sorted(b)[0][0] == 0 and sum(n for _, n in b) <= 2048 and np.diff([*[a for a, _ in sorted(b)], sum(n for _, n in b)]).tolist() == [n for _, n in sorted(b)] for b in held.values())


def test_run(spark, sf):
    """All stages in turn; of what they wrote only what the last result reads is left."""
    def there():
        folder = common.shared_folder(spark)
        return set(os.listdir(folder))

    before, rows = there(), spark.read.parquet(f"{sf}/documents.parquet").count()
    packed = corpus_pipeline.run(spark, sf)
    assert 0 < packed.filter("piece = 0").count() <= 3 * rows
    assert {x.split("-")[0] for x in there() - before} <= {"mixing", "pack"}


def test_empty_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
