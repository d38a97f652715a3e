"""The corpus operators against plain versions on small tables, and their defined cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from quadrille.llm import boosting, common, components, exact_dedup, lengths, licenses, line_dedup, mixing, ngram_join, packing, pii, quality, url_filters
from quadrille.llm.queries import ORACLE_SQL, QUERIES, URL_RULES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def odd_texts():
    """Nulls, empty and long texts, ties, copies, and text that is hard for patterns."""
    r = random.Random(5)
    base = prose(r, 120)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (3, 60, 118)]
    return [
        None, "", " ", "\n", "one", "a b c d", "a b c d e", base, base, base.replace(" ", "\t "), *near, base.upper(),
        "x" * 200_000, "1 " * 30_000, "a@" * 20_000, "1.2.3.4.5.6.7.8 " * 500, "a@b.c%d@e.f g@h", "+1 (743) 555-3824 4111 1111 1111 1111 999.1.1.1 1.2.3.4",
        "ß é Ünïcödé 12 ½ ² \u212a İ ﬁ e\u0301", "\x1c\x1d word\x85next\u00a0more", "<|endoftext|> tail", "it's we'll 'tis don't", "line\n line \nLINE\n\n\nother", "same three words same three words end",
        "CC BY cc-by All rights\nreserved. GNU General Public License general public license", *[prose(r, 30) + "\nShared Line" for _ in range(12)], prose(r, 3000),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "en", f"src{k % 3}" if k % 4 else None, 0) for k, t in enumerate(odd_texts())], SCHEMA).cache()


@pytest.fixture(scope="module")
def pairs():
    return list(enumerate(odd_texts()))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(odd, pairs):
    want = sorted(brute.exact(pairs))
    assert sorted(map(tuple, exact_dedup.annotate(odd).collect())) == want
    # A digest of four bits makes texts clash; content tells them apart.
    assert sorted(map(tuple, exact_dedup.annotate(odd, bits=4).collect())) == want
    kept = exact_dedup.drop_duplicates(odd.withColumn("keep_id", F.lit("mine")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _, k, _ in want if k) and "keep_id" in kept.columns


def test_exact_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "b"), (None, "c")], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.annotate(df).collect())
    assert got == Counter({(1, 1, 3, True): 2, (None, 1, 3, False): 1, (2, 2, 2, True): 1, (None, 2, 2, False): 1, (None, None, 1, True): 1})
    assert Counter(r.doc_id for r in exact_dedup.drop_duplicates(df).collect()) == Counter([1, 2, None])


def test_look_up_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    left = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 10}") for k in range(100)], "id long, key string")
    table = spark.createDataFrame([("hot", 50, "h"), ("k0", 10, "zero"), ("k2", 10, "two")], "key string, rows long, v string")
    got = {r.id: r.v for r in common.look_up(left, "key", table, "rows", 100, "id").collect()}
    assert got == {k: "h" if k % 2 else {"0": "zero", "2": "two"}.get(str(k % 10)) for k in range(100)}


def test_lines(odd, pairs):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.clean(odd.withColumn("n_lines", F.lit("old"))).collect()]
    assert sorted(got) == brute.lines(pairs)


def test_lines_of_hot_keys(odd, pairs, monkeypatch):
    """Shards whose rows are dealt out over parts."""
    monkeypatch.setattr(line_dedup, "SHARD_ROWS", 4)
    monkeypatch.setattr(line_dedup, "LEAST_SHARDS", 3)
    assert line_dedup._hot_keys(line_dedup.reference_counts(odd), 100, 25, 10)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.clean(odd).collect()) == brute.lines(pairs)


def test_line_index_over_documents(spark):
    """A batch of documents comes and goes; the index then cleans the others as one made from them alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    stay, batch = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    refs, shards = line_dedup.reference_counts(stay).cache(), 8
    filters = line_dedup.build_filters(refs, shards, 3)
    every = line_dedup.changed(refs, batch, 1).cache()
    grown = line_dedup.changed_filters(filters, refs, every, shards, 3).cache()
    back = line_dedup.changed(every, batch, -1).cache()
    shrunk = line_dedup.changed_filters(grown, every, back, shards, 3).cache()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(line_dedup.clean(docs, 3, index=(every, grown, shards))) == rows(line_dedup.clean(docs, 3))
    assert rows(line_dedup.clean(stay, 3, index=(back, shrunk, shards))) == rows(line_dedup.clean(stay, 3))


def test_line_index_is_reversible(spark):
    r = random.Random(1)
    batch = lambda seed: spark.createDataFrame([(k, "\n".join(f"line {r.randrange(40)}" for _ in range(8))) for k in range(40)], "doc_id long, text string")
    one, two = batch(1).cache(), batch(2).cache()
    shards = 4
    refs = line_dedup.reference_counts(one).cache()
    filters = line_dedup.build_filters(refs, shards).cache()
    more = line_dedup.changed(refs, two, 1).cache()
    grown = line_dedup.changed_filters(filters, refs, more, shards).cache()
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, line_dedup.reference_counts(one.union(two)).collect()))
    both = one.union(two.withColumn("doc_id", F.col("doc_id") + 1000))
    want = sorted(map(tuple, line_dedup.clean(both).collect()))
    assert sorted(map(tuple, line_dedup.clean(both, index=(more, grown, shards)).collect())) == want
    back = line_dedup.changed(more, two, -1).cache()
    shrunk = line_dedup.changed_filters(grown, more, back, shards).cache()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, refs.collect()))
    keys = [r.key for r in refs.where("n >= 10").select("key", line_dedup._shard(shards)).collect()]
    held = {r.shard: line_dedup.CuckooFilter.load(r.filter) for r in shrunk.collect()}
    first = {r.shard: line_dedup.CuckooFilter.load(r.filter) for r in filters.collect()}
    assert sum(int((f.table > 0).sum()) for f in held.values()) == sum(int((f.table > 0).sum()) for f in first.values()) == len(keys)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys, others = (rng.integers(0, 2**63, (n, 2)).astype(np.uint64) for n in (20_000, 50_000))
    f = line_dedup.CuckooFilter.build(keys)
    assert f.contains(keys).all() and f.contains(others).mean() < 0.001
    f = line_dedup.CuckooFilter.load(f.dump())
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01


def test_quality(odd, pairs):
    got = {r.doc_id: r for r in quality.assess(odd, carry=True).collect()}
    for i, t in pairs:
        assert {k: got[i][k] for k in brute.quality(t)} == brute.quality(t)
        assert not (got[i].base_failed and got[i].kept)
    assert got[0].text is None and got[0].source is None


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = QUERIES["op4_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    right = judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert {r.quality: r.kept for r in right}[1] > 0.95 and {r.quality: r.kept for r in right}[0] < 0.1


def clean_text(r):
    return "\n".join(f"The {prose(r, 12)} of {prose(r, 8)} ended here." for _ in range(6))


def test_quality_of_junk_that_is_common(spark):
    """A third of all rows is junk that one rule alone sees."""
    r = random.Random(7)
    docs = [(k, clean_text(r) if k % 3 else clean_text(r).replace(" of ", " # $ % & ")) for k in range(300)]
    got = {x.doc_id: x.kept for x in quality.assess(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: k % 3 > 0 for k, _ in docs}


def test_quality_of_open_lines(spark):
    """Clean lists, verse and Hindi stay beside prose; symbol junk with open lines goes."""
    r = random.Random(8)
    lines = lambda n, end="": "\n".join(prose(r, n) + end for _ in range(12))
    makers = [lambda: clean_text(r), lambda: lines(6), lambda: lines(9, ","), lambda: lines(12, " \u0964"), lambda: lines(12, " # $ % &")]
    kinds = [0] * 40 + [1, 2, 3, 4] * 2
    docs = spark.createDataFrame([(k, makers[m]()) for k, m in enumerate(kinds)], "doc_id long, text string")
    assert {x.doc_id: x.kept for x in quality.assess(docs).collect()} == {k: m < 4 for k, m in enumerate(kinds)}


def vote_pattern(names, bad=(), abstain=()):
    return sum((0 if n in bad else 1 if n in abstain else 2) * 3**k for k, n in enumerate(names))


def good_chance(model, names, pattern):
    return model.posterior([pattern // 3**k % 3 for k in range(len(names))])[0]


@pytest.mark.parametrize("share", [0.01, 0.2, 1 / 3, 0.6])
@pytest.mark.parametrize("kind", quality.DEFECTS)
def test_quality_kinds_of_junk_stay_junk(kind, share):
    """Junk that its rules agree on is rejected however common it is, and so is rare junk of any other kind beside it."""
    names = list(quality.rules())
    good, bad = vote_pattern(names), vote_pattern(names, quality.DEFECTS[kind])
    counts = Counter({good: round(9000 * (1 - share)), bad: round(9000 * share)})
    others = [vote_pattern(names, rules) for rules in quality.DEFECTS.values()]
    counts.update(dict.fromkeys(others, 5))
    model = quality.fit(counts, names)
    assert good_chance(model, names, good) >= 0.5 and all(good_chance(model, names, p) < 0.5 for p in [bad, *others])


def test_quality_contradicted_votes_do_not_reject(spark):
    """The verdict isn't that of a filter which every rule must pass."""
    r = random.Random(3)
    texts = [clean_text(r) for _ in range(60)] + [clean_text(r).replace(" of ", " # $ % & ") for _ in range(10)]
    texts += ["\n".join(f"{x},;.:" for x in clean_text(r).split()) for _ in range(3)]  # few letters, no symbols
    judged = quality.assess(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    votes = F.array(*[v == 0 for v in quality.rules().values()])
    got = {x.doc_id: (x.kept, x.any_bad) for x in judged.withColumn("any_bad", F.exists(votes, lambda v: v)).collect()}
    assert [got[k] for k in range(73)] == [(True, False)] * 60 + [(False, True)] * 10 + [(True, True)] * 3


def test_quality_recovers_accuracies():
    """Rates of simulated votes, and the classes of documents that were not labelled."""
    rng = np.random.default_rng(0)
    names, kinds = ["a", "b", "c", "d", "e"], {"one": ("a", "b", "c"), "two": ("d", "e")}
    shares, rates = [0.7, 0.2, 0.1], [[0.03, 0.05, 0.02, 0.04, 0.02], [0.9, 0.7, 0.8, 0.1, 0.05], [0.05, 0.1, 0.05, 0.85, 0.9]]
    kind = rng.choice(3, 40_000, p=shares)
    bad, silent = rng.random((40_000, 5)) < np.array(rates)[kind], rng.random((40_000, 5)) < 0.1
    pattern = (np.where(silent, 1, np.where(bad, 0, 2)) * 3 ** np.arange(5)).sum(1)
    model = quality.fit(Counter(pattern.tolist()), names, kinds)
    assert np.abs(np.array(model.shares) - shares).max() < 0.03 and np.abs(np.array(model.rates) - rates).max() < 0.06
    kept = np.array([good_chance(model, names, int(p)) >= 0.5 for p in pattern[:4000]])
    assert (kept == (kind[:4000] == 0)).mean() > 0.95


def test_quality_keeps_columns(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(1, clean_text(r), "mine", 5, "p"), (2, None, "x", 6, None)], "doc_id long, text string, kept string, n_words int, __words string")
    assert [tuple(x) for x in quality.keep(docs).collect()] == [tuple(docs.first())] and quality.keep(docs).schema == docs.schema


def test_near(odd, pairs):
    assert sorted(map(tuple, ngram_join.components(odd).collect())) == brute.near(pairs)
    counted = ngram_join.components(odd, count_links=True)
    assert {r.doc_id: r.n_links for r in counted.collect()} == brute.links(pairs)
    assert sorted(map(tuple, counted.drop("n_links").collect())) == brute.near(pairs)


def test_near_links_of_repeated_ids(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    rows = [(1, " ".join(base)), (1, " ".join(base)), (2, " ".join(base[:-1])), (3, None), (4, "other"), (4, "words")]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), count_links=True)
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got.collect()) == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (4, 4, 0)]


@pytest.mark.parametrize("seed", range(2))
def test_near_families_and_tiles(spark, seed, monkeypatch):
    """Families with passages in common, in tiles of a few sets."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    r = random.Random(seed)
    passage, docs = prose(r, 30, 9999), []
    for _ in range(12):
        words = (prose(r, r.randrange(20, 200), 9999) + " " + passage).split()
        for _ in range(r.randrange(1, 9)):
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = f"n{r.randrange(9999)}"
            words = words[: len(words) - r.randrange(0, 5)]
            docs.append(" ".join(words))
    pairs = list(enumerate(docs))
    r.shuffle(pairs)
    got = ngram_join.components(spark.createDataFrame(pairs, "doc_id long, text string"), count_links=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute.near(pairs))
    assert {r.doc_id: r.n_links for r in got} == brute.links(pairs)


def test_near_large_family(spark):
    """Copies that are linked to the one original, most of them not to each other, and copies close to each other."""
    r = random.Random(9)
    base, close = prose(r, 60, 9999).split(), prose(r, 200, 9999).split()
    changed = lambda words, k: " ".join([*words[:k], f"n{r.randrange(10**6)}", *words[k + 1 :]])
    texts = [changed(base, r.randrange(60)) for _ in range(1500)] + [" ".join(base)] + [changed(close, r.randrange(200)) for _ in range(1500)]
    got = ngram_join.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: 0 if k <= 1500 else 1501 for k in range(len(texts))}


def test_near_bitmap_links_are_exact():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(1, 60), replace=False)) for _ in range(60)]
    sets += [np.sort(np.delete(s, rng.integers(len(s)))) for s in sets if len(s) > 6]
    got = ngram_join._link(sets, np.arange(len(sets)), None, 80)
    for a, b in got:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
    rows = rng.integers(1, 4, len(sets))
    partner = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    for side in (None, rng.integers(0, 2, len(sets))):
        want = [sum(rows[b] for b in range(len(sets)) if b != a and partner(a, b) and (side is None or side[a] != side[b])) for a in range(len(sets))]
        assert ngram_join._count_links(sets, rows, side, 80).tolist() == want
    head = list(range(len(sets)))
    for a, b in got:
        x, y = head[a], head[b]
        head = [x if h == y else h for h in head]
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert head[a] == head[b] or 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_components_of_a_graph(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 3)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, odd):
    weights = {"src1": 3.0, "src2": 1.0}
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 10 < 7, "src1").when(F.col("id") % 10 < 9, "src2").alias("source"))
    out = mixing.mix(docs, weights, other_weight=1.0, seed=3)
    share = {r.source: r.n / n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(share["src1"] - 0.6) < 0.04 and abs(share["src2"] - 0.2) < 0.03 and abs(share[None] - 0.2) < 0.03
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(len(v) == v[0].copies and sorted(x.copy for x in v) == list(range(len(v))) for v in by.values())
    assert sorted(map(tuple, mixing.mix(docs.repartition(7), weights, 1.0, seed=3).collect())) == sorted(map(tuple, rows))
    assert {r.source for r in mixing.mix(odd, {"src1": 1.0}).collect()} == {"src1"}
    assert mixing.mix(odd.withColumn("copy", F.lit("old")), weights, 1.0).schema["copy"].dataType.simpleString() == "int"


def test_poisson_steps():
    for rate in (0.05, 1.0, 7.5, 300.0):
        steps = np.array(mixing.poisson_steps(rate))
        assert abs(steps[-1] - 1) < 1e-9 and abs((1 - steps).sum() - rate) < 1e-6 * max(1, rate)


def check_pieces(rows, pairs, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    held, used = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), defaultdict(list)
    want = Counter()
    for i, text in pairs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), capacity):
            part = ids[s : s + capacity]
            want[(i, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert held == want
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for v in used.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return 1 - sum(r.length for r in rows) / capacity / len(used)


def test_packing_round_trip(spark, odd, pairs):
    rows = packing.pack(odd, tokenizer_path(), capacity=512).collect()
    check_pieces(rows, pairs, 512)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    copies = [(1, "a b c")] * 5 + [(2, None)] * 3 + [(None, "x y")]
    check_pieces(packing.pack(spark.createDataFrame(copies, "doc_id long, text string"), tokenizer_path(), keep_ids=False).collect(), copies, 4096)


def test_packing_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, tokenizer_path(), keep_ids=False).collect()
    assert check_pieces(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 4096) < 0.02


def test_cutting_stock():
    r = random.Random(4)
    demand = dict(Counter(min(63, int(r.expovariate(1 / 14)) + 1) for _ in range(5000)))
    made = packing.cutting_stock(demand, 64)
    total = Counter()
    for pattern, n in made:
        assert sum(s * k for s, k in pattern.items()) <= 64
        for s, k in pattern.items():
            total[s] += k * n
    assert total == demand and sum(n for _, n in made) <= 1.02 * sum(s * n for s, n in demand.items()) / 64 + 2
    assert packing.cutting_stock({}, 64) == []


def test_lengths(odd, pairs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    n = sorted(len(t.encode(x or "", add_special_tokens=False).ids) for _, x in pairs)
    totals = lengths.context_totals(lengths.histogram(odd, tokenizer_path())).cache()
    for r in totals.collect():
        assert r.n_docs == n.count(r.length) and r.docs_at_least == sum(x >= r.length for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= r.length) and r.truncated_total == sum(min(x, r.length) for x in n)
    for limit in (0, 1, 17, 5000, 10**7):
        assert lengths.truncated_total(totals, limit).first()[0] == sum(min(x, limit) for x in n)
    assert lengths.quantile(totals, 0.5).first()[0] == n[-(-len(n) // 2) - 1]


def test_licences(odd, pairs):
    for r in licenses.scan(odd).collect():
        assert tuple(r)[1:6] == brute.licence_base(pairs[r.doc_id][1])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def licence_texts():
    """Whole notices, notices with other words in them, and texts with the key words elsewhere."""
    r, texts = random.Random(2), []
    for _, notice, keys in licenses.NOTICES:
        words = notice.split()
        texts.append(f"some words before, {notice.upper()}; and words after")
        texts.append(" ".join(w if r.random() < 0.8 else "other" for w in words))
        texts.append(notice + " " + " ".join(keys) + " x " + " ".join(reversed(words)) + " " + notice)
        texts.append(" ".join(words[len(words) // 2 :] + words[: len(words) // 2]))
        texts.append(" and ".join(keys))
    return texts


def test_licence_notices_against_all_alignments(spark, odd, pairs):
    """Labels and score, as found by trying each notice at each place."""
    texts = licence_texts() + [t for _, t in pairs if t and len(t) < 5000] + [None]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    index = licenses._index(licenses.NOTICES)
    for k, t in enumerate(texts):
        labels, score = brute.licence_notices(t, index, licenses.LEAST_SCORE)
        assert set(filter(None, got[k].labels.split(","))) == labels | set(filter(None, got[k].base_labels.split(","))), t
        assert abs(got[k].score - (1.0 if got[k].n_base else score)) < 1e-9
    for k, (label, _, _) in enumerate(licenses.NOTICES):
        assert label in got[5 * k].labels.split(","), label


def test_licence_forms(spark):
    texts = ["# SPDX-License-Identifier: Apache-2.0", "the general of the public has a driving license version 2", "licensed by the apache people under a tree", "MIT License\n\nCopyright"]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "apache-2.0", 1: "", 2: "", 3: "mit"}


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x", "https://x.net/de/1#y", "http://example.net/de/81", "ftp://net/de/", "a://b://com/en/", "http://h.org/es/", "http://com/en", "http://q?com/en/", "http://İ.com/en/é"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "url string, bad int")
    for r in url_filters.judge(pages, URL_RULES, none).collect():
        host, path, rule, verdict = brute.url_base(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert url_filters.judge(pages.limit(0), URL_RULES, none).count() == 0


def test_url_tree(spark):
    """Bad templates of a host are rejected, its other pages and other hosts stay."""
    r = random.Random(0)
    rows = [(f"http://a.tld/{part}/{r.randrange(10**6)}.html", part in ("pills", "bets")) for part in ("news", "pills", "bets", "blog") for _ in range(60)]
    rows += [(f"http://b.tld/{w}/{r.randrange(99)}", False) for w in ("x", "y", "z") for _ in range(30)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    labelled = spark.createDataFrame([(u, int(b)) for u, b in rows[::3]], "url string, bad int")
    assert {(r.page_id, r.verdict) for r in url_filters.judge(pages, [], labelled).collect()} == {(k, "block" if b else "allow") for k, (_, b) in enumerate(rows)}
    merged = {(r.host, r.merged) for r in url_filters.templates(pages, labelled).collect()}
    assert ("b.tld", "/*/{n}") in merged and ("a.tld", "/*/{n}.html") not in merged


def url_verdicts(spark, rows):
    """Of (url, bad): the pages whose verdict isn't that of their label, all pages labelled."""
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)], "page_id long, url string")
    labelled = spark.createDataFrame([(u, int(b)) for u, b in rows], "url string, bad int")
    verdicts = {r.page_id: r.verdict for r in url_filters.judge(pages, [], labelled).collect()}
    return [u for k, (u, b) in enumerate(rows) if verdicts[k] != ("block" if b else "allow")]


def word(k):
    return "".join(chr(97 + int(c)) for c in str(k))


def test_url_tree_with_many_sections(spark):
    """One section in 120 differs from the others of its host, each way."""
    rows = [(f"http://{h}.tld/{word(part)}/{k}", (part == 7) == odd) for h, odd in (("a", True), ("b", False)) for part in range(120) for k in range(12)]
    assert url_verdicts(spark, rows) == []


def test_url_tree_of_hot_hosts(spark, monkeypatch):
    """The same verdicts if look-ups are shuffled, and pages named by slugs."""
    r = random.Random(5)
    slug = lambda: "-".join(word(r.randrange(10**4)) for _ in range(5))
    rows = [(f"http://a.tld/{part}/{slug()}.html", part == "pills") for part in ("news", "pills", "blog") for _ in range(40)] + [(f"http://{word(k)}.tld/x", False) for k in range(20)]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    assert url_verdicts(spark, rows) == []


def test_url_tree_with_deep_paths(spark):
    """A bad section below the third segment, pages named by words, and a very long path."""
    rows = [(f"http://a.tld/2024/05/{12 + d}/{part}/{word(k)}", part == "pills") for d in range(3) for part in ("news", "pills", "blog") for k in range(30)]
    rows += [("http://a.tld/" + "x/" * 500, False), ("http://a.tld/2024/05/12", False), ("http://a.tld", False)]
    assert url_verdicts(spark, rows) == []


def test_private(odd, pairs):
    for r in pii.report(odd).collect():
        want = brute.private_base(pairs[r.doc_id][1])
        assert tuple(r)[1:5] == tuple(Counter(k for k, _, _ in want)[k] for k in pii.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_private_model(spark):
    *_, told = pii.model(spark)
    assert told["accuracy"] > 0.97 and told["precision"] > 0.97 and told["recall"] > 0.9
    docs = spark.createDataFrame([(1, "write to ann.lee [at] mail [dot] org or call (212) 555-0199 now"), (2, "born 1999-12-31, version 12.250.300 of it"), (3, "é a@b.co z")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.spans) for r in pii.redact(docs).collect()}
    assert got[1] == ("write to [email] or call [phone] now", "email:9:36,phone:45:59")
    assert got[2][1] == "" and got[3] == ("é [email] z", "email:2:8")


def test_private_planted(spark):
    """Secrets planted in documents, which have no base pattern, are found; clean documents get no added span."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    spans = {r.doc_id: (r.spans, r.n_spans, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in pii.report(docs).collect()}
    secret = {r.doc_id for r in docs.where("lower(text) RLIKE 'token = \"[0-9a-f]{40}\"'").collect()}
    assert secret and sum("secret:" in spans[k][0] for k in secret) >= 0.9 * len(secret)
    assert sum(n > base for k, (_, n, base) in spans.items() if k not in secret) <= 0.005 * len(spans)


def test_redact_carries_columns(spark):
    docs = spark.createDataFrame([("k", 7, 'é a@b.co, token = "0123456789abcdef0123456789abcdef01234567" z', "x"), ("l", 8, None, None)], "every string, n int, text string, row string")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [("k", 7, 'é [email], token = "[secret]" z', "x", "email:2:8,secret:19:59"), ("l", 8, "", None, "")]


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (600, 4)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 2] < 2)).astype(float)
    start, trees = boosting.fit_trees(x, y)
    score = start + sum(boosting.apply_tree(t, x) for t in trees)
    assert ((score > 0) == (y > 0)).mean() > 0.99
    a, b = boosting.calibrated(score, y)
    p = 1 / (1 + np.exp(-(a * score + b)))
    bar = boosting.threshold_for(p, y, 0.99)
    assert y[p >= bar].mean() >= 0.99


def test_empty_tables(spark, empty):
    for made in (
        exact_dedup.annotate(empty), exact_dedup.drop_duplicates(empty), line_dedup.clean(empty), quality.assess(empty), ngram_join.components(empty), mixing.mix(empty, {"src1": 1.0}),
        packing.pack(empty, tokenizer_path()), lengths.context_totals(lengths.histogram(empty, tokenizer_path())), licenses.scan(empty), pii.report(empty),
    ):
        assert made.count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage against its plain version, on its own input."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        held.append(spark.read.parquet(str(tmp_path / str(k))))
    texts = [[(r.doc_id, r.text) for r in h.collect()] for h in held[:-1]]
    assert all(h.columns == docs.columns for h in held[:-1])
    assert all(not brute.quality(t)["base_failed"] for _, t in texts[1]) and set(texts[1]) <= set(texts[0])
    assert sorted(i for i, _ in texts[2]) == sorted(i for i, _, _, kept, _ in brute.exact(texts[1]) if kept)
    assert sorted(i for i, _ in texts[3]) == sorted(i for i, _, c in brute.near(texts[2]) if i == c)
    assert set(texts[4]) <= set(texts[3]) and 0.6 * len(texts[3]) < len(texts[4]) < 1.5 * len(texts[3])
    check_pieces(held[-1].collect(), texts[4], 4096)
    assert sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "start").collect())) == sorted((r.doc_id, r.start) for r in held[-1].collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "pages", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), db.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(repr, want.project(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_clashing_columns(spark):
    """Columns with the names that operators use are ignored, or carried as they were."""
    names = ["n_words", "labels", "spans", "component_id", "n_shingles", "sequence_id", "length", "id", "node", "group", "low", "words", "kept", "start"]
    base = "one two three four five six seven"
    docs = spark.createDataFrame([(k, t, *["mine"] * len(names)) for k, t in enumerate([base, base, None, "MIT License a@b.co"])], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert {r.doc_id: r.component_id for r in ngram_join.components(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    cleaned = line_dedup.clean(docs.withColumn("keys", F.lit("mine")), min_docs=2)
    assert cleaned.columns == [*docs.columns, "keys", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.id, r["keys"], r.n_dropped) for r in cleaned.collect()) == [(0, "mine", "mine", 1), (1, "mine", "mine", 1), (2, "mine", "mine", 0), (3, "mine", "mine", 0)]
    stay = ngram_join.drop_near_duplicates(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == [0, 2, 3]
    assert {r.doc_id: r.n_email for r in pii.report(docs).collect()}[3] == 1 and {r.doc_id: r.labels for r in licenses.scan(docs).collect()}[3] == "mit"
    assert quality.assess(docs).where("base_failed").count() == 4 and quality.keep(docs).count() == 0
    assert packing.pack(docs, tokenizer_path()).groupBy().agg(F.sum("length")).first()[0] > 4 and lengths.histogram(docs, tokenizer_path()).agg(F.sum("n_docs")).first()[0] == 4
    pages = spark.createDataFrame([(1, "http://org/es/", "x", "y"), (1, "http://org/es/", "x", "y"), (2, None, "x", "y")], "page_id long, url string, host string, verdict string")
    got = url_filters.judge(pages, URL_RULES, spark.createDataFrame([], "url string, bad int")).collect()
    assert sorted((r.page_id, r.host, r.verdict) for r in got) == [(1, "org", "block"), (1, "org", "block"), (2, "", "allow")]


def test_pipeline_of_odd_tables(spark, empty, tmp_path):
    """An empty table; nulls, repeated rows and columns with the names that stages use."""
    assert all(stage(spark, empty, "").count() == 0 for _, stage in corpus_pipeline.STAGES)
    r = random.Random(6)
    texts = [None, "", clean_text(r), clean_text(r)]
    held = spark.createDataFrame([(k, t, "en", None, 0, "mine", "mine", 5) for k, t in enumerate([*texts, texts[2]])], SCHEMA + ", kept string, copies string, sequence_id int")
    names = held.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, held, "").write.parquet(str(tmp_path / str(k)))
        held = spark.read.parquet(str(tmp_path / str(k)))
        assert held.columns == names and {(x.kept, x.copies, x.sequence_id) for x in held.collect()} <= {("mine", "mine", 5)}
        assert {x.doc_id for x in held.collect()} <= {2, 3, 4} and (k == 0 or {x.doc_id for x in held.collect()} <= {2, 3})


def test_closed_lines_and_repeated_windows(spark):
    texts = ["one.\ntwo. \t\r\nthree\n\n \n«four»", "पाँच।\nsix…\nseven,", "a b c", "a b c d", "x x x x", "a b c q a b c", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_lines, r.n_closed, r.n_repeat_words) for r in quality.counted(docs).collect()}
    assert found == {0: (4, 3, 0), 1: (3, 2, 0), 2: (1, 0, 0), 3: (1, 0, 0), 4: (1, 0, 4), 5: (1, 0, 6), 6: (0, 0, 0), 7: (0, 0, 0)}
