"""Every operator against brute force on a small corpus with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import common, components, hashing, language, licenses, mixing, neighbours, packing, quality, sharding, substrings, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["key", "ident", "size", "n", "words", "row", "label", "shard", "bucket", "score", "cluster", "range", "component", "line", "gone", "spans", "times", "copy", "pos"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuvwy") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = say(60), say(150).split()
    texts = [None, "", "   \n\t ", "one", "Two words", "a b c d", "a b c d", "A B c D", passage, passage]
    for k in range(25):  # a chain of near copies
        base[rng.randrange(150)] = f"edit{k}"
        texts.append(" ".join(base))
    texts += [say(40) + "\n" + passage + "\n" + say(30) for _ in range(6)]
    texts += [say(rng.randint(1, 120)) for _ in range(40)]
    texts += [say(9000), (say(12) + "\n") * 5, "released under the MIT License. cc-by-nc 4.0, CC BY NC, apache license, version 2.0", "x" * 5000, "naïve É ß 日本語 <|endoftext|> 'll!"]
    texts += [" ".join(["This work is licensed under the GNU General Public License, version 3.", say(50)]), "you idiot, p4thetic l0ser"]
    rows = [(k, t, ["en", "de", None][k % 3], [f"src{k % 4}", None, "hot", "hot"][k % 4], len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[20], rows[1], (None, "a text without an id", "en", "hot", 20)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return [r.asDict() for r in df.collect()]


def same_rows(found, expected, *columns):
    key = lambda r: tuple(repr(r[c]) for c in columns)
    assert Counter(map(key, found)) == Counter(map(key, expected))


def test_licenses(docs, rows, empty):
    found = got(licenses.scan_licenses(docs))
    expected = []
    for i, text, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        best, labels = 0.0, {x for _, x in places}
        for a in range(0, max(len(w) - licenses.BLOCK + licenses.STEP - 1, 0) // licenses.STEP * licenses.STEP + 1, licenses.STEP):
            block = set(w[a : a + licenses.BLOCK])
            for t, label in licenses.TEMPLATES.items():
                t = set(t.split())
                if 100 * len(t & block) >= 80 * len(t):
                    best, labels = max(best, len(t & block) / len(t)), labels | {label}
        starts = [k for k, _ in places]
        expected.append({"doc_id": i, "n_words": len(w), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted({x for _, x in places})), "labels": ",".join(sorted(labels)), "score": 1.0 if places else best})
    same_rows(found, expected, *expected[0])
    assert any(r["labels"] == "gpl" for r in found) and any(r["base_labels"] == "apache-2,cc-by-nc,mit" for r in found)
    assert got(licenses.scan_licenses(empty)) == []


def test_toxicity(spark, docs, rows, empty):
    labels = spark.createDataFrame([(k, 0, int("idiot" in (r[1] or ""))) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    found = got(toxicity.score_toxicity(docs, labels))
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert got(toxicity.score_toxicity(empty, labels.limit(0))) == []
    start = toxicity.train(docs, labels.limit(0))
    measure = lambda t: start.measure(start.matcher(), t)[0]
    assert measure("you Іd1ot") > 0 and measure("p4thetic") > 0 and measure("put it in the trash can") == 0 and measure(None) == 0
    assert start.score(*start.measure(start.matcher(), "you idiot")) >= 0.3 > start.score(*start.measure(start.matcher(), "a fine day"))


def test_toxicity_learns(spark):
    """Learned words, not the known ones, decide; look-alikes are undone; held-out rows teach nothing; quality on texts never seen."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuvwy") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    bad = ["grobnak", "vlixen", "zorpwit", "quagmutt", "snerdle"]
    data = []
    for k in range(1500):
        toxic = k % 6 == 0
        text = [rng.choice(vocab) for _ in range(rng.randint(8, 120))]
        for w in rng.sample(bad, 2) if toxic else []:
            text.insert(rng.randrange(len(text)), w.replace("o", "0") if rng.random() < 0.3 else w)
        data.append((k, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    held = {k for k, *_ in data if zlib.crc32(str(k).encode()) % 4 == 2}
    labels = spark.createDataFrame([(k, 0, 1 - t if k in held else t) for k, _, t in data], "doc_id long, quality int, toxic int")  # wrong where they may not be used
    model = toxicity.train(docs, labels)
    assert {f" {w} " for w in bad} <= {t if t.endswith(" ") else f"{t} " for t in model.lexicon} | {f" {w} " for w in bad if any(f" {w}".startswith(t) for t in model.lexicon)}
    found = {r["doc_id"]: r for r in got(toxicity.score_toxicity(docs, labels))}
    true = {k for k, _, t in data if t and k in held}
    said = {k for k in held if found[k]["predicted"]}
    assert len(true & said) >= 0.95 * len(true) and len(true & said) >= 0.95 * len(said)
    assert {r["doc_id"] for r in got(toxicity.without_toxic(docs, labels).select("doc_id"))} == {k for k in found if not found[k]["predicted"]}
    few = toxicity.train(docs, labels, most_rows=100)
    assert few.lexicon  # a smaller bound learns less, by the same rule


def test_toxicity_held_out(spark):
    """Quality on the labelled rows that are held out of the driver's table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    n = toxicity.score_toxicity(docs, labels).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in n.collect()}
    hit = n.get((1, 1), 0)
    assert hit >= 0.85 * (hit + n.get((1, 0), 0)) and hit >= 0.9 * (hit + n.get((0, 1), 0))


def test_samples_bound_rows(spark):
    """Null and repeated ids can't bring more rows than the bound; one row of each id and text."""
    rows = [(None, f"t{k}") for k in range(3000)] + [(1, f"u{k}") for k in range(3000)] + [(2, "same")] * 3000
    found = toxicity.sampled(spark.createDataFrame(rows, "doc_id long, text string"), 300, 5).collect()
    assert 100 <= len(found) <= 330 and len(set(found)) == len(found)


def jaccard_sets(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard(docs, rows, empty):
    sets, up = [jaccard_sets(r[1]) for r in rows], components.Sets()
    ids = [-(2**63) if r[0] is None else r[0] for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up.join(ids[a], ids[b])
    expected = [{"doc_id": r[0], "n_shingles": len(s), "component_id": None if r[0] is None else up.find(i)} for r, s, i in zip(rows, sets, ids, strict=True)]
    same_rows(got(neighbours.near_duplicates(docs)), expected, *expected[0])
    same_rows(got(neighbours.near_duplicates(docs, docs_per_block=7)), expected, *expected[0])  # a grid of blocks
    assert got(neighbours.near_duplicates(empty)) == []
    kept = neighbours.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in got(kept)]
    want = [r["doc_id"] for r in expected if r["doc_id"] is not None and r["doc_id"] == r["component_id"] and r["n_shingles"]]
    assert Counter(ids) == Counter({*want}) + Counter([r["doc_id"] for r in expected if not r["n_shingles"] or r["doc_id"] is None])


def test_one_of_each_group_with_null_and_repeated_ids(spark):
    """A null id keeps only its own row; an id that two texts share is marked for each text alone."""
    say = lambda x: " ".join(f"{x}{k}" for k in range(30))
    rows = [(None, say("a")), (5, say("a")), (6, say("a")), (7, say("a") + " more")]
    rows += [(1, say("b")), (2, say("b")), (2, say("c")), (3, say("c"))]
    rows += [(8, say("d")), (8, say("d")), (8, say("e")), (None, "x"), (4, None)]
    kept = neighbours.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(None, say("a")), (5, say("a")), (1, say("b")), (2, say("c")), (8, say("d")), (8, say("e")), (None, "x"), (4, None)]
    assert Counter(tuple(r) for r in kept.collect()) == Counter(want)


def test_repeated_rows_take_part_once(spark, monkeypatch):
    """Thousands of rows with one id and one text are one member, whether joins are sent, shuffled or by hubs."""
    say = lambda x: " ".join(f"{x}{k}" for k in range(30))
    rows = [(5, say("a"))] * 3000 + [(6, say("a") + " z"), (7, say("b")), (None, say("b")), (None, say("b"))] + [(k, say("c")) for k in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    plain = neighbours.link_block
    monkeypatch.setattr(neighbours, "link_block", lambda sets, *a: (seen.append(len(sets)), plain(sets, *a))[1])
    want = Counter({(5, 26, 5): 3000, (6, 27, 5): 1, (7, 26, None): 1, (None, 26, None): 2}) + Counter((k, 26, 100) for k in range(100, 160))
    for sent, hub in ((common.SENT, 1000), (300, 3), (0, 10**9)):
        monkeypatch.setattr(common, "HUB", hub)
        monkeypatch.setattr(common.joined, "__defaults__", ("inner", None, sent, None))
        assert Counter(tuple(r) for r in neighbours.near_duplicates(docs).collect()) == want
    assert neighbours.one_of_each_group(docs).count() == 2 + 1 + 2 + 0 + 0  # 5, 100, 7 and the two rows without an id


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Beyond what may be sent, copies are told from their representatives without a join of texts; the bitmap's chance hits change nothing."""
    say = lambda x: " ".join(f"{x}{k}" for k in range(30))
    rows = [(k, say(k % 40)) for k in range(120)] + [(500 + k, say(k) + " z") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, plain = [], neighbours.mapped
    monkeypatch.setattr(neighbours, "mapped", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, *a))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        monkeypatch.setattr(common, "BITS", 9)  # 512 places for 60 classes: many chance hits
        monkeypatch.setattr(common.joined, "__defaults__", ("inner", None, 0, None))
        found = {r["doc_id"]: r["component_id"] for r in neighbours.near_duplicates(docs).collect()}
        assert found == {i: (i % 40 if i < 120 else i - 500) for i, _ in rows}
        assert "SortMergeJoin" not in plans[1]  # the texts whose prefixes are posted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_frequent_shingles_are_tied(spark, monkeypatch):
    """Lists too long for pairs give the same components."""
    monkeypatch.setattr(neighbours, "FREQUENT", 3)
    rng = random.Random(1)
    shared = [str(rng.random()) for _ in range(80)]
    texts = [" ".join(shared[:70] + [f"{k}-{j}" for j in range(k % 9)]) for k in range(30)] + [" ".join([f"{k}:{j}" for j in range(100)] + shared) for k in range(20)]
    sets, up = [jaccard_sets(t) for t in texts], components.Sets()
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up.join(a, b)
    found = got(neighbours.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: up.find(k) for k in range(len(texts))}


def test_quality(docs, rows, empty):
    limit, host, expected = 1, defaultdict(set), []
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x)).strip(" ").lower()
    for _, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            if words(x):
                host[s, normal(x)].add(t or "")
    for i, t, _, s, _ in rows:
        w = words(t)
        grams = defaultdict(list)
        for k in range(len(w) - 4):
            grams[tuple(w[k : k + 5])].append(k)
        repeat = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        removed = sum(len(words(x)) for x in lines if len(host[s, normal(x)]) > limit)
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        expected.append({"doc_id": i, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeat), "base_failed": failed, "kept": not failed and 100 * (len(w) - removed) >= 30 * len(w), "n_removed": removed})
    same_rows(got(quality.line_quality(docs, line_limit=limit, line_share=0)), expected, *expected[0])
    assert any(r["n_removed"] for r in expected)
    assert got(quality.line_quality(empty)) == []


@pytest.mark.parametrize("sent", [common.SENT, 400])
def test_quality_limit_follows_the_host(spark, monkeypatch, sent):
    """A line goes where more than line_share per cent of a host's documents hold it, and more than line_limit; hot lines and hosts by hubs too."""
    monkeypatch.setattr(common, "HUB", 3)
    monkeypatch.setattr(common.joined, "__defaults__", ("inner", None, sent, None))
    say = lambda x: " ".join(f"{x}{'abcdefghijkl'[k]}" for k in range(12))
    data = [(h * 100 + k, (say("menu") + "\n" if k < shared else "") + say(f"own{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abcdefghij'[k // 26]}"), f"host{h}") for h, (n, shared) in enumerate([(40, 5), (40, 4), (4, 4), (3, 3)]) for k in range(n)]
    found = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in got(quality.line_quality(spark.createDataFrame(data, "doc_id long, text string, source string"), 3, 10, 60))}
    for i, text, _ in data:
        gone = text.startswith("menu") and i // 100 in (0, 2)  # 5 of 40 and 4 of 4; 4 of 40 is no more than a tenth, 3 no more than 3
        assert found[i] == (12 if gone else 0, not gone)


def test_quality_counts_documents(spark):
    """Exact copies under different ids each count; rows of one id and text count once, rows without an id each."""
    text = " ".join(f"w{'abcdefghijkl'[k]}" for k in range(12))
    rows = [(k, text, "copies") for k in range(4)] + [(9, text, "repeated")] * 4 + [(None, text, "nameless")] * 4 + [(k, text, "few") for k in range(3)]
    found = got(quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), line_limit=3, line_share=0))
    by_id = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"], r["kept"]) for r in found)
    assert by_id == sorted([(False, k, 12, False) for k in range(4)] + [(False, 9, 0, True)] * 4 + [(True, 0, 12, False)] * 4 + [(False, k, 0, True) for k in range(3)])


@pytest.mark.parametrize("per_range", [250_000, 5])
def test_sharding(docs, rows, empty, per_range):
    found = got(sharding.shard_documents(docs, rows_per_range=per_range))
    size = lambda t: len((t or "").encode()) + 8
    expected = [{"doc_id": r[0], "size": size(r[1]), "text_crc32": zlib.crc32((r[1] or "").encode()), "law": "bytes", "grown_shard": None} for r in rows]
    same_rows(found, expected, *expected[0])
    slots, held = defaultdict(list), Counter()
    for r in found:
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    share = sum(held.values()) / 24
    assert max(held.values()) <= share + max(r["size"] for r in found)
    assert got(sharding.shard_documents(empty)) == []
    assert sorted(map(repr, found)) == sorted(map(repr, got(sharding.shard_documents(docs, rows_per_range=per_range))))


def test_sharding_divides_repeated_rows(spark):
    """Equal rows are more than a range; their ranges are divided, and shards stay even."""
    rows = [(1, "the same row " * 5)] * 2000 + [(k, f"another text number {k} " * 4) for k in range(2, 2000)]
    found = got(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows_per_range=40))
    held, slots = Counter(), defaultdict(list)
    for r in found:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(found) == len(rows) and len(held) == 24 and max(held.values()) <= 1.05 * min(held.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_splitters_below():
    rng = np.random.default_rng(1)
    splitters = sorted({tuple(x) for x in rng.integers(0, 4, (20, 3)).tolist()})
    rows = rng.integers(-1, 5, (500, 3))
    found = sharding._below(np.array(splitters), *rows.T)
    assert found.tolist() == [sum(s <= tuple(r) for s in splitters) for r in rows.tolist()]


def test_language_held_out(spark):
    """Accuracy on rows held out of the driver's table, and what the scores promise."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = language.identify_languages(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'")
    n, right, promised = found.agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg("score")).first()
    assert n > 1000 and right >= 0.98 and abs(right - promised) <= 0.02


def test_temperature():
    rng = np.random.default_rng(4)
    z = rng.standard_normal((20_000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = (rng.random(len(z))[:, None] > p.cumsum(axis=1)).sum(axis=1)
    assert abs(language.temperature_of(3 * z, y) - 3) < 0.15  # logits three times too sure
    assert abs(language.temperature_of(np.zeros((0, 3)), np.zeros(0, dtype=int)) - 1) < 1e-6
    assert language.calibration_rows([0] * 11 + [1] * 4) == [k in (4, 9) for k in range(11)] + [False] * 4


def test_language(spark, docs, rows, empty):
    texts = {"en": "the house and the garden with this and that", "de": "das haus und der garten mit diesem und jenem"}
    rng = random.Random(3)
    data = [(k, " ".join(rng.sample(texts[lang].split(), 6)), lang, None, 0) for k, lang in ((k, ["en", "de"][k % 2]) for k in range(300))]
    data += [(900, None, "en", None, 0), (901, "123 !?", "de", None, 0), (902, "das haus und", None, None, 0), (902, "das haus und", None, None, 0)]
    found = {r["doc_id"]: r for r in got(language.identify_languages(spark.createDataFrame(data, SCHEMA)))}
    assert all(found[k]["lang_pred"] == ["en", "de"][k % 2] for k in range(300))
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and found[900]["score"] == 0 and found[902]["lang_pred"] == "de"
    assert got(language.identify_languages(empty)) == []
    assert len(got(language.identify_languages(docs))) == len(rows)


def reference_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(capacity - n)
    return bins


def test_best_fit_histogram():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([7, 20, 64, 100])
        lengths = [min(capacity, 1 + int(rng.expovariate(1 / rng.choice([3, 10, 40])))) for _ in range(rng.randint(0, 200))]
        placed, n = packing.best_fit_decreasing(Counter(lengths), capacity)
        left = [capacity] * n
        for k, (length, rank, first, each, offset) in enumerate(placed):
            end = placed[k + 1][1] if k + 1 < len(placed) and placed[k + 1][0] == length else Counter(lengths)[length]
            for r in range(end - rank):
                assert capacity - left[first + r // each] == offset + r % each * length
                left[first + r // each] -= length
        assert sorted(left) == sorted(reference_best_fit(lengths, capacity))


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.tokenizer_path()).encode
    found, expected = got(packing.pack_documents(docs, capacity=256)), []
    for i, t, *_ in rows:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected += [{"doc_id": i, "piece": k, "start": a, "length": len(ids[a : a + 256]), "ids_crc32": zlib.crc32(ids[a : a + 256].tobytes())} for k, a in enumerate(range(0, len(ids), 256))]
    same_rows(found, expected, *expected[0])
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        assert sum(n for _, n in b) <= 256 and all(a == sum(n for x, n in b if x < a) for a, _ in b)
    assert len(bins) == len(reference_best_fit([r["length"] for r in expected], 256))
    assert got(packing.pack_documents(empty)) == []


def test_substrings(docs, rows, empty):
    window, places = 35, defaultdict(list)
    split = [words(r[1]) for r in rows]
    for d, w in enumerate(split):
        for k in range(len(w) - window + 1):
            places[tuple(w[k : k + window])].append((d, k))
    gone = {(d, k + j) for at in places.values() if len(at) > 1 for d, k in at for j in range(window)}
    expected, texts = [], []
    for d, w in enumerate(split):
        kept = [x for k, x in enumerate(w) if (d, k) not in gone]
        expected.append({"doc_id": rows[d][0], "n_words": len(w), "n_removed": len(w) - len(kept), "kept_sha256": hashlib.sha256(" ".join(kept).encode()).hexdigest()})
        if len(kept) == len(w):
            texts.append(rows[d][1])
        elif kept:
            texts.append(" ".join(kept))
    same_rows(got(substrings.remove_repeats(docs)), expected, *expected[0])
    cut = substrings.documents_without_repeats(docs)
    assert cut.columns == docs.columns
    assert Counter(r["text"] for r in got(cut)) == Counter(texts)
    assert got(substrings.remove_repeats(empty)) == []


def test_mixing(docs, rows, empty):
    size = [len(words(r[1])) for r in rows]
    held = Counter()
    for r, n in zip(rows, size, strict=True):
        held[r[3]] += n
    order = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(size)), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 3 * held[s]}
        if not full:
            break
        for s in full:
            target[s] = 3 * held[s]
            left -= 3 * held[s]
        open_ -= full
        if not open_:
            break
    target |= {s: weight[s] * level for s in open_}
    found = got(mixing.mix_sources(docs))
    assert len(found) == len(rows)
    taken, source = Counter(), {r[0]: r[3] for r in rows}
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == held[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in order)
    assert sorted(map(repr, found)) == sorted(map(repr, got(mixing.mix_sources(docs))))
    assert got(mixing.mix_sources(empty)) == []
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies, share = Counter(r["doc_id"] for r in got(mixed.select("doc_id"))), Counter()
    for r, n in zip(rows, size, strict=True):
        share[r[0]] += n
    times = {r["doc_id"]: r["taken"] for r in found}
    plain = Counter(r[0] for r in rows)
    for i, n in copies.items():
        if plain[i] == 1 and share[i]:  # whole epochs, and once more if half of what is left is taken
            assert n == int(times[i] / share[i] + 0.5)
        elif plain[i] == 1:
            assert n == 1
    assert all(copies[i] for i in plain if not share[i])


def test_targets_of_many_sources(spark):
    """Ranges of sources, summed apart, give what one range gives."""
    rng = random.Random(2)
    totals = spark.createDataFrame([(f"host{k}", rng.randrange(1, 500)) for k in range(300)] + [(None, 40)], "source string, source_size long")
    one, many = ({r["source"]: r["target"] for r in mixing.source_targets(totals, rows_per_part=n).collect()} for n in (10**6, 37))
    assert one == many and abs(sum(one.values()) - totals.agg(F.sum("source_size")).first()[0]) < 1e-6


def test_running_sums(spark):
    rng = random.Random(3)
    data = [(k, rng.randrange(50)) for k in range(500)]
    found = common.running(spark.createDataFrame(data, "k long, v long").repartition(5), [F.col("v").desc(), F.col("k")], {"before": F.col("v")}, 60)
    total = 0
    for place, (k, v) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1):
        data[k] = (k, v, place, total)
        total += v
    assert sorted(tuple(r) for r in found.collect()) == data


def test_joined_by_hubs(spark, monkeypatch):
    """Sent whole, shuffled, or hubs sent and the rest shuffled: the same rows."""
    monkeypatch.setattr(common, "HUB", 10)
    big = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(300)] + [(None, -1), (99, -2)], "g long, k long")
    small = big.filter("g IS NOT NULL AND g <> 99").groupBy("g").agg(F.count("*").alias("rows"), F.max("k").alias("m"))
    for how in ("inner", "left"):
        want = Counter(map(tuple, big.join(small, "g", how).select("g", "k", "rows", "m").collect()))
        for sent in (common.SENT, 100, 0):
            for rows, sift in ((None, False), ("rows", False), (None, True), ("rows", True)):
                assert Counter(map(tuple, common.joined(big, small, "g", how, rows, sent, sift=sift).select("g", "k", "rows", "m").collect())) == want


def test_temporary_tables_go(spark):
    import os

    keep = common.written(spark.range(3), "outer")
    with common.temporary():
        gone, kept = common.written(spark.range(5), "inner"), common.written(spark.range(4), "result", outer=True)
    at = [x._written_to.removeprefix("file:") for x in (keep, gone, kept)]
    assert [os.path.isdir(p) for p in at] == [True, False, True]
    common.dropped(keep)
    common.dropped(kept)
    assert not any(map(os.path.isdir, at))


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 16))
    near = np.repeat(base[:30], 4, axis=0) + 0.05 * rng.standard_normal((120, 16))
    all_ = [*base.tolist(), *near.tolist(), *base[:3].tolist(), [0.0] * 16, None, [1.0, None], [float("nan")] * 16, [], [1.0], [2.0], [1e-300, 0.0]]
    df = spark.createDataFrame([(k, v, "clash") for k, v in enumerate(all_)], "vec_id long, embedding array<double>, key string").repartition(3)
    ok = [v if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for v in all_]
    up, links = components.Sets(), Counter()
    for a in range(len(ok)):
        for b in range(a):
            if ok[a] and ok[b] and len(ok[a]) == len(ok[b]):
                x, y = (np.array(ok[k]) / np.abs(ok[k]).max() for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                    up.join(a, b)
                    links[a] += 1
                    links[b] += 1
    expected = [{"vec_id": k, "n_links": links[k], "component_id": up.find(k), "kept": up.find(k) == k} for k in range(len(ok))]
    same_rows(got(vectors.near_vectors(df)), expected, *expected[0])
    same_rows(got(vectors.near_vectors(df, block=4)), expected, *expected[0])
    assert got(vectors.near_vectors(df.limit(0))) == []


def test_vectors_recall(spark):
    """Thousands of links of cosine 0.95 and up in 64 dimensions, single precision, against brute force."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((500, 64))
    near = np.repeat(base[:400], 8, axis=0)
    near = near + rng.uniform(0.05, 0.35, (len(near), 1)) * rng.standard_normal(near.shape)
    v = np.concatenate([base, near]).astype(np.float32)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "vec_id long, embedding array<float>").repartition(4)
    found = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df).collect()}
    true = linked.sum(axis=1)
    assert true.sum() > 5000 and all(found[k] <= true[k] for k in found)
    assert sum(found.values()) >= 0.95 * true.sum()


def test_components_of_hubs(spark, monkeypatch):
    """Stars and a chain of hubs, minima sent, shuffled, or by hubs."""
    monkeypatch.setattr(common, "HUB", 20)
    edges = [(0, k) for k in range(1, 400)] + [(399, k) for k in range(1000, 1300)] + [(5000 + k % 2, k) for k in range(2000, 2100)] + [(-5, 1299), (None, 3)]
    up = components.Sets()
    for a, b in edges[:-1]:
        up.join(a, b)
    want = {x: up.find(x) for e in edges[:-1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for sent in (common.SENT, 3000, 0):
        found = got(components.connected_components(df, "a", "b", sent=sent))
        assert {r["node"]: r["component"] for r in found} == want
    assert got(components.connected_components(df.limit(0), "a", "b")) == []


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(80)] + [(5, 5)]
    up = components.Sets()
    for a, b in edges:
        up.join(a, b)
    found = got(components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b"))
    assert {r["node"]: r["component"] for r in found} == {x: up.find(x) for e in edges if e[0] != e[1] for x in e}


def test_word_hashes():
    import pyarrow as pa

    texts = ["Ab ab", None, "", "\tab\n", "x" * 3000 + " é"]
    seen = defaultdict(set)
    for first, h, n in hashing.TextHasher(fold=True, group=4)(pa.array(texts)):
        at = 0
        for t, k in zip(texts[first : first + len(n)], n, strict=True):
            for w, x in zip(words(t), h[at : at + k], strict=True):
                seen[w.lower()].add(int(x))
            at += k
    assert set(seen) == {"ab", "x" * 3000, "é"} and all(len(v) == 1 for v in seen.values())


def test_long_texts_by_pieces():
    """Small groups and blocks cut long texts and long words; hashes and digests stay."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \té") for _ in range(rng.choice([5, 300, 4000]))) for _ in range(20)] + ["q" * 20_000, " " * 5000, "", "x" * 9000 + " y"]
    whole = hashing.TextHasher()
    small = hashing.TextHasher(group=64)
    flat = lambda h: [(f + k, x) for f, hs, n in h(pa.array(texts)) for k, x in zip(range(len(n)), np.split(hs, n.cumsum()[:-1]), strict=True)]
    for (i, a), (j, b) in zip(flat(whole), flat(small), strict=True):
        assert i == j and a.tolist() == b.tolist() and len(a) == len(words(texts[i]))
    for t in texts:
        raw = t.encode()
        assert b"".join(hashing.pieces(raw, 50)) == raw
        assert [w for p in hashing.pieces(raw, 50) for w in p.split()] == raw.split()
    gone = np.array([k % 3 == 0 for k in range(len(words(texts[0])))], dtype=bool)
    assert substrings.kept_digest(texts[0].encode(), gone) == hashlib.sha256(" ".join(w for w, g in zip(words(texts[0]), gone, strict=True) if not g).encode()).hexdigest()


def test_license_templates_are_a_parameter(spark):
    say = " ".join(f"w{k}" for k in range(30))
    filler = " ".join(["lorem"] * 3000)
    docs = spark.createDataFrame([(1, f"{filler} {say} {filler}"), (2, " ".join(say.split()[:23])), (3, " ".join(say.split()[:24])), (4, f"{' '.join(['x'] * 2040)} my own words {say}")], "doc_id long, text string")
    found = {r["doc_id"]: (r["labels"], round(r["score"], 3), r["n_base"], r["first_word"]) for r in got(licenses.scan_licenses(docs, {say: "mine"}, {"my own words": "own"}))}
    assert found == {1: ("mine", 1.0, 0, None), 2: ("", 0.0, 0, None), 3: ("mine", 0.8, 0, None), 4: ("mine,own", 1.0, 1, 2040)}
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, {" ".join(f"w{k}" for k in range(34)): "too long"})
