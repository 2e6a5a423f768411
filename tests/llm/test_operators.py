"""Every corpus operator on awkward tables and against brute force."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import exact_dedup, katz, minhash, mixing, ngram_jaccard, packing, resampling, substring_dedup, toxicity, url_filter
from orbweave.llm.words import grams, hash_words, split_words
from orbweave.plans.workspace import Workspace
from tests.llm.corpora import SCHEMA, awkward, clashing, components, family, frame, shingle_sets, words

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, None if i == 4 else int(i % 4 != 0), int(i % 3 == 0)) for i in range(1, 18)] + [(None, 1, 0), (7, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_follow_the_ascii_rule():
    text = "A\u00a0b c\x0bd\x1fe É"
    assert [w.decode() for w in split_words(text, lower=True)] == words(text, lower=True)
    assert split_words(None) == []
    h = hash_words([b"a", b"b", b"c"])
    assert len(grams(h, 2)) == 2 and len(grams(h, 4)) == 0
    assert (grams(h, 1) == h).all()


# Exact dedup


def test_exact_dedup_on_awkward_rows(spark, docs):
    got = exact_dedup.exact_dedup(clashing(docs)).collect()
    rows = awkward()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256((t or "").encode()).digest()].append(i)
    for r in got:
        members = groups[bytes(r["digest"])]
        keep = max((m for m in members if m is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(members), r["id"] == keep)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    kept = exact_dedup.kept_documents(clashing(docs))
    assert kept.columns == clashing(docs).columns and kept.where("own <> 'own' or row <> 'row'").count() == 0
    assert kept.count() == sum(r["kept"] for r in got)


def test_exact_dedup_splits_heavy_hitters(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 200}", "en", "a", 1) for i in range(3000)]
    df = frame(spark, rows)
    heavy = exact_dedup.heavy_hitters(exact_dedup.digests(df), 0.1).collect()
    assert [(r["keep_id"], r["group_size"]) for r in heavy] == [(2997, 1000)]
    kept = exact_dedup.exact_dedup(df, support=0.1).where("kept").count()
    assert kept == len({t for _, t, *_ in rows})
    assert exact_dedup.kept_documents(df).columns == df.columns
    assert exact_dedup.kept_documents(df).count() == kept


# N-gram Jaccard join and MinHash


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_components_equal_brute_force(spark, n, num, den):
    rows = family(n * 7 + num)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(frame(spark, rows), n, num, den).collect()}
    sets = shingle_sets(rows, n)
    want = components(sets, num, den)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def short_chains(seed: int, chains: int = 60) -> list[tuple]:
    """Short documents, each a step from the one before: few shared tokens decide."""
    rng = np.random.default_rng(seed)
    rows, say = [], lambda k: [f"v{x}" for x in rng.integers(0, 400, k)]
    for _ in range(chains):
        w = say(rng.integers(10, 26))
        for _ in range(rng.integers(2, 6)):
            rows.append(" ".join(w))
            step = rng.integers(0, 4)
            k = int(rng.integers(1, 4)) if step > 1 else 1
            w = [*w, *say(k)] if step == 0 else w[:-k] if step == 1 else [*w[k:], *say(k)] if step == 2 else [*say(k), *w[:-k]]
    ids = rng.permutation(len(rows))
    return [(int(i) + 1, t, "en", "s", len(t)) for i, t in zip(ids, rows, strict=True)]


def test_jaccard_links_a_class_that_neither_votes_nor_is_chosen(spark):
    # 1 and 3 are linked by the one block {1, 3}; 3 shares two blocks with 2 and votes for that.
    texts = {
        1: "tiger birch quilt wheat lemon ocean quilt fjord drift lemon ocean",
        2: "quilt wheat lemon ocean quilt fjord drift lemon ocean fjord birch drift",
        3: "tiger birch quilt wheat lemon ocean quilt fjord drift lemon ocean fjord",
    }
    for ids in ({1: 1, 2: 2, 3: 3}, {1: 2, 2: 1, 3: 3}):
        rows = [(ids[i], t, "en", "s", len(t)) for i, t in texts.items()]
        got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(frame(spark, rows), 3, 90, 100).collect()}
        want = components(shingle_sets(rows, 3), 90, 100)
        assert want[ids[1]] == want[3] != want[ids[2]]
        assert got == want


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_components_of_short_chains(spark, n, num, den):
    rows = short_chains(n + num)
    sets = shingle_sets(rows, n)
    want = components(sets, num, den)
    assert len(set(want.values())) < len(want)
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(frame(spark, rows), n, num, den).collect()}
    assert got == want


def chance_shares(seed: int = 5) -> list[tuple]:
    """Texts of few words, so that most share some shingles by chance, and some near copies."""
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(300):
        w = [f"v{x}" for x in rng.integers(0, 40, rng.integers(150, 200))]
        texts += [" ".join(w)] + ([" ".join([*w[1:], "x", "y"])] if i % 30 == 0 else [])
    return [(i + 1, t, "en", "s", len(t)) for i, t in enumerate(texts)]


def test_jaccard_reads_no_sets_of_classes_that_share_tokens_by_chance(spark, monkeypatch):
    saved = {}

    class Watched(Workspace):
        def save(self, df, name):
            saved[name] = super().save(df, name)
            return saved[name]

    rows = chance_shares()
    sets = shingle_sets(rows, 3)
    want = components(sets, 90, 100)
    linked = {i for i in want if i != want[i]} | {want[i] for i in want if i != want[i]}
    assert len(linked) == 20
    for hot in (ngram_jaccard.HOT, 1):
        monkeypatch.setattr(ngram_jaccard, "HOT", hot, raising=False)
        got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(frame(spark, rows), 3, 90, 100, Watched(spark)).collect()}
        assert got == want
        assert {r["doc"] for r in saved["sets"].collect()} >= linked
        assert saved["sets"].count() < 60 and saved["queries"].count() < 60


@pytest.mark.parametrize("num", [75, 80, 90, 95])
def test_jaccard_pairs_share_as_many_tokens_as_a_link_needs(spark, num):
    sizes = range(1, 700)
    for x in sizes:
        assert 1 + ngram_jaccard.slack(x, num, 100) + ngram_jaccard.spare(x, num, 100) <= -(-num * x // 100)
        assert ngram_jaccard.kept(x, num, 100) <= x
        for y in range(x, 100 * x // num + 1):
            left = 1 + ngram_jaccard.slack(x, num, 100) + ngram_jaccard.spare(x, num, 100) - max(ngram_jaccard.forgettable(z, num, 100) for z in (x, y))
            assert left >= max(ngram_jaccard.least_shared(z, num, 100) for z in (x, y))
    table = spark.range(1, 700).select("id", ngram_jaccard.least_shared_column("id", num, 100).alias("need"))
    assert [r["need"] for r in table.orderBy("id").collect()] == [ngram_jaccard.least_shared(x, num, 100) for x in sizes]


def test_jaccard_on_awkward_rows(spark, docs):
    got = ngram_jaccard.jaccard_components(clashing(docs), 3, 90, 100).collect()
    rows = awkward()
    assert len(got) == len(rows)
    sets = shingle_sets([r for r in rows if r[0] is not None], 3)
    want = components(sets, 90, 100)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert ngram_jaccard.jaccard_components(empty(spark)).count() == 0
    kept = ngram_jaccard.one_of_each_group(clashing(docs))
    assert kept.columns == clashing(docs).columns and kept.where("own <> 'own' or gone <> 'gone'").count() == 0
    assert {7, None} <= {r["doc_id"] for r in kept.collect()} and 8 not in {r["doc_id"] for r in kept.collect()}


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(i, t, "en", "a", 1) for i, t in [(3, a), (5, a), (5, b), (9, b), (10, a + " z")]]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(frame(spark, rows), 3, 90, 100).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 10: 3}


def test_prefixes_leave_a_common_token():
    for num in (50, 80, 90):
        for size in range(1, 300):
            assert ngram_jaccard.prefix_length(size, num, 100) == (100 - num) * size // 100 + 1
            assert ngram_jaccard.forgettable(size, num, 100) <= ngram_jaccard.slack(size, num, 100)


def test_minhash_components_find_the_links(spark):
    rows = family(11)
    got = {r["doc_id"]: r["component_id"] for r in minhash.minhash_components(frame(spark, rows)).collect()}
    assert got == components(shingle_sets(rows, 5), 80, 100)


def test_fingerprints(spark, docs):
    rows = [r for r in awkward() if r[0] is not None]
    rows = sorted({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: r for r in minhash.fingerprint_table(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r["fingerprint"] == minhash.as_bytes(minhash.text_signature(t)).hex()
        assert r["near_next"] == minhash.alike(minhash.text_signature(t), minhash.text_signature(following))
        assert 0 <= r["near_edited"] <= 1
    assert got[7]["fingerprint"] == got[8]["fingerprint"] and got[1]["fingerprint"] == got[2]["fingerprint"]
    assert minhash.fingerprint_table(clashing(docs)).count() == docs.count()
    assert minhash.fingerprint_table(empty(spark)).count() == 0
    one = minhash.fingerprint_table(frame(spark, [rows[6]])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_signatures_of_unrelated_sets_differ_at_every_size():
    rng = np.random.default_rng(12)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for size in (100, 1_000, 20_000, 100_000, 1_000_000):
        x, y, both = draw(size // 2), draw(size // 2), draw(size)
        assert minhash.alike(minhash.signature(x), minhash.signature(y)) < 0.05
        half = minhash.alike(minhash.signature(np.append(both, x)), minhash.signature(np.append(both, y)))
        assert abs(half - 0.5) < 0.15


def test_fingerprints_follow_the_order_of_ids(spark):
    rows = [(i, " ".join(f"w{i * k % 97}" for k in range(3 + i % 50)), "en", "a", 1) for i in range(0, 900, 3)]
    got = {r["doc_id"]: r for r in minhash.fingerprint_table(frame(spark, rows).repartition(7)).collect()}
    assert len(got) == len(rows)
    for (i, t, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_next"] == minhash.alike(minhash.text_signature(t), minhash.text_signature(after))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    y = np.concatenate([x[:1000], rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    assert abs(minhash.alike(minhash.signature(x), minhash.signature(y)) - 0.5) < 0.15


# Toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    scores, move = rng.normal(size=(3, 4)), rng.normal(size=(2, 2))
    scores[1, 3] = scores[2, 2:] = -np.inf
    p, moves, log_z = toxicity.marginals(scores, move)
    total_moves = np.zeros((2, 2))
    for r in range(3):
        z, on = 0.0, np.zeros(4)
        for path in np.ndindex(2, 2, 2, 2):
            if any(s and np.isinf(scores[r, t]) for t, s in enumerate(path)):
                continue
            states = [0, *path, 0]
            weight = math.exp(sum(scores[r, t] for t, s in enumerate(path) if s) + sum(move[a, b] for a, b in zip(states, states[1:], strict=False)))
            z += weight
            on += weight * np.array(path)
        assert np.allclose(p[r], on / z) and math.isclose(log_z[r], math.log(z))
        total_moves += 0
    assert math.isclose(moves.sum(), 12)


def test_toxicity_learns_held_out_documents(spark):
    bad = ["vile", "nasty", "foulmouth"]
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(400):
        w = [f"n{k}" for k in rng.integers(0, 900, 60)]
        if i % 4 == 0:
            for k in rng.integers(0, 60, 3):
                w[k] = bad[k % 3]
        rows.append((i, " ".join(w), "en", "a", 1))
        marks.append((i, 1, int(i % 4 == 0)))
    df, lab = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.ToxicityModel(df, lab).scored(df).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(400))
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    text = dict((i, t) for i, t, *_ in rows)
    for r in held:
        for s in r["spans"]:
            assert set(text[r["doc_id"]][s["begin"] : s["end"]].split(" ")) <= set(bad)


def test_toxicity_on_awkward_rows(spark, docs, labels):
    got = toxicity.ToxicityModel(docs, labels).scored(clashing(docs)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.ToxicityModel(docs, none).scored(docs).collect()} == {0.0}
    assert toxicity.ToxicityModel(empty(spark), labels).scored(empty(spark)).count() == 0


# Packing


def test_packing_of_long_white_space(spark):
    fast, slow = (packing.encoder(packing.default_tokenizer(), e) for e in ("tiktoken", "tokenizers"))
    for text in (" " * 2_000_000, "\n" * 2_000_000, "x" * 2_000_000):
        assert list(fast(text)) == list(slow(text))
    docs = frame(spark, [(1, " " * 1_500_000, "en", "a", 1)])
    assert packing.pack(docs).agg(F.sum("length")).first()[0] == len(slow(" " * 1_500_000)) + 1


def test_other_tokenizer_files_are_left_to_their_library():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some words, THREE times 12 of them."
    assert list(packing.encoder(path, "tiktoken")(text)) == list(packing.encoder(path, "tokenizers")(text))


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing_under_three_binding_capacities(spark, score):
    docs = frame(spark, [(i, "word " * (1 + i * 37 % 90), "en", "a", 1) for i in range(120)])
    out = packing.pack(docs, capacity=200, max_documents=4, max_attention=15_000, score=score)
    bins = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum(F.col("length") * F.col("length")).alias("cost")).collect()
    assert max(r["n"] for r in bins) <= 200 and max(r["k"] for r in bins) == 4 and 14_000 < max(r["cost"] for r in bins) <= 15_000


def test_packing_is_an_exact_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    once = docs.dropDuplicates(["doc_id", "text"]).where("doc_id is not null")
    got = packing.pack(clashing(once)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t, *_ in {r[:2]: r for r in awkward() if r[0] is not None}.values():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 2048 for r in mine[1:])
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack(docs).count() == sum(len(packing.cut(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1, 2048)) for _, t, *_ in awkward())
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_vector_best_fit_keeps_every_capacity(score):
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.minimum(rng.lognormal(4, 1.2, 5000).astype(int) + 1, 512), return_counts=True)
    counts = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    plan = packing.vector_best_fit(counts, 512, max_documents=6, max_attention=512 * 400, weights=(1.0, 0.1, 0.1), score=score, ) if max(counts) ** 2 <= 512 * 400 else packing.vector_best_fit(counts, 512, max_documents=6, weights=(1.0, 0.1, 0.1), score=score)
    placed = Counter()
    for parts, n in plan:
        assert sum(ell * k for ell, k in parts) <= 512 and sum(k for _, k in parts) <= 6
        for ell, k in parts:
            placed[ell] += k * n
    assert placed == Counter(counts)
    with pytest.raises(ValueError):
        packing.vector_best_fit({600: 1}, 512)


def test_both_tokenizer_libraries_give_the_same_ids():
    path = packing.default_tokenizer()
    a, b = packing.encoder(path, "tiktoken"), packing.encoder(path, "tokenizers")
    for _, t, *_ in awkward():
        assert list(a(t or "")) == list(b(t or ""))


# URL filter


def test_url_rules_and_verdicts(spark):
    cases = [
        ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("https://x.example.com/de/7", "x.example.com", "/de/7", "example.com/de/", "block"),
        ("ftp://sub.org/fr/", "sub.org", "/fr/", "org/fr/", "allow"),
        ("http://net", "net", "", None, None),
        ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("x://?q", "", "", None, None),
        ("http://h\nost.net/a\nb#c", "h\nost.net", "/a\nb", "net/", "block"),
    ]
    rows = [(i, c[0], "<html>") for i, c in enumerate(cases)] + [(100 + i, f"http://good{i}.example.net/en/{i}", None) for i in range(60)] + [(200 + i, f"http://bad{i}.other.net/xx/{i}", None) for i in range(60)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")
    got = url_filter.UrlModel(pages).judged(pages.withColumn("host", F.lit(1))).collect()
    assert len(got) == len(rows) + 1
    by = {r["page_id"]: r for r in got}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule)
        assert by[i]["verdict"] == verdict if verdict else by[i]["verdict"] in ("allow", "block")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.UrlModel(none).judged(none).count() == 0


def test_url_models_are_distributions_without_collisions(spark):
    urls = [f"http://host{i % 7}.net/{i}" for i in range(50)]
    counts = np.zeros((2, url_filter.BUCKETS))
    lengths, before, own = url_filter.contexts(urls)
    for b, o in zip(before, own, strict=True):
        counts[0] += np.bincount(b, minlength=url_filter.BUCKETS)
        counts[1] += np.bincount(o, minlength=url_filter.BUCKETS)
    seen, bf, ow = url_filter.contexts(["http://host1.net/" + chr(c) for c in range(1, 128)])
    last = np.cumsum(seen) - 1
    p = np.exp(url_filter.log_likelihood(bf, ow, counts))[last]
    assert 0.5 < p.sum() < 1.05


def test_url_counts_and_scores_are_exact_beyond_the_old_places(spark):
    rng = np.random.default_rng(5)
    slug = lambda: "".join(map(chr, rng.integers(97, 123, 16)))
    rows = [(i, f"http://{slug()}.org/fr/{slug()}" if i % 2 else f"http://{slug()}.net/{slug()}") for i in range(5000)]
    pages = spark.createDataFrame([*rows, (None, None), (2**60 + 1, "x")], "page_id long, url string").coalesce(1)
    model = url_filter.UrlModel(pages)
    counts = [defaultdict(int), defaultdict(int)]

    def keys(url):
        raw = b"\x02" * 5 + url.encode()
        return [(k, raw[i - k : i], raw[i]) for i in range(5, len(raw)) for k in range(6)]

    for i, url in rows:
        if zlib.crc32(str(i).encode()) % 5:
            for k, context, byte in keys(url):
                counts[i % 2][k, context] += 1
                counts[i % 2][k, context, byte] += 1
    assert model.counts.count() == len(counts[0].keys() | counts[1].keys()) > url_filter.BUCKETS
    got = {r["page_id"]: r["score"] for r in model.judged(pages).collect()}
    assert len(got) == len(rows) + 2 and got[None] == 0 and 2**60 + 1 in got
    for i, url in rows[:40]:
        score, p = 0.0, [0.0, 0.0]
        for k, context, byte in keys(url):
            for c in (0, 1):
                p[c] = (counts[c][k, context, byte] + 2 * (p[c] if k else 1 / 256)) / (counts[c][k, context] + 2)
            if k == 5:
                score += math.log(p[1] / p[0])
        assert got[i] == pytest.approx(score / len(url))


# Substring dedup


def removed(rows, window):
    first = {}
    kept = {}
    ordered = sorted({(i, t) for i, t, *_ in rows if i is not None})
    for i, t in ordered:
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, t in ordered:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    return kept


def test_substring_dedup_equals_brute_force(spark, docs):
    for rows, window, phrase in [(awkward(), 50, 8), (family(4), 20, 5), (family(9), 50, 8)]:
        got = substring_dedup.substring_dedup(clashing(frame(spark, rows)), window, phrase).collect()
        assert len(got) == len(rows)
        want = removed(rows, window)
        text = {i: t for i, t, *_ in rows}
        for r in got:
            i = r["doc_id"]
            keep = want[i] if i is not None else words(text[None])
            assert r["n_words"] == len(words(text[i])) and r["n_removed"] == r["n_words"] - len(keep)
            assert r["kept_sha256"] == hashlib.sha256(" ".join(keep).encode()).hexdigest()
            if r["kept_text"] is not None:
                assert r["kept_text"] == " ".join(keep)
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_texts_that_share_an_id_are_judged_by_themselves(spark):
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"{p} one"), (5, f"{p} two two"), (5, f"start {p} three four five"), (7, f" {p}\ttwo two "), (7, p.upper())]
    got = substring_dedup.substring_dedup(frame(spark, [(i, t, "en", "a", 1) for i, t in rows])).collect()
    kept = {hashlib.sha256(t.encode()).hexdigest(): t for t in ("two two", "start three four five", f"{p} one", "", p.upper())}
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], kept[r["kept_sha256"]]) for r in got) == [
        (1, 61, 0, f"{p} one"), (5, 62, 60, "two two"), (5, 64, 60, "start three four five"), (7, 60, 0, p.upper()), (7, 62, 62, "")
    ]


def test_window_marks_do_not_depend_on_the_place():
    words = [f"w{k}".encode() for k in range(300)]
    h, g = hash_words(words), hash_words([b"x"] * 17 + words)
    for x, y in zip(substring_dedup.window_marks(h, 50), substring_dedup.window_marks(g, 50), strict=True):
        assert len(x) == 251 and (x == y[17:]).all() and len(np.unique(x)) == 251


def test_anchors_are_sliding_minima():
    x = np.random.default_rng(0).integers(0, 1 << 62, 200).astype(np.uint64)
    for span in (1, 2, 5, 43):
        assert (substring_dedup.window_anchors(x, span) == [x[k : k + span].min() for k in range(200 - span + 1)]).all()


# Mixing


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), "en", None if i % 10 == 9 else f"s{i % 3}" if i % 2 else "s0", 1) for i in range(3000)]
    got = mixing.pareto_mix(frame(spark, rows)).collect()
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 90 and t <= 2 * size[s] + 1e-6
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values()))
    again = {r["id"]: r["taken"] for r in mixing.pareto_mix(frame(spark, rows)).collect()}
    assert again == {r["id"]: r["taken"] for r in got}
    mixed = mixing.mixed_documents(frame(spark, rows))
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {r["id"]: r["copies"] for r in got if r["copies"]}


def test_mix_on_awkward_rows(spark, docs):
    got = mixing.pareto_mix(clashing(docs)).collect()
    assert len(got) == docs.count()
    assert {r["id"]: r["size"] for r in got} == {i: len(words(t)) for i, t, *_ in awkward()}
    assert mixing.pareto_mix(empty(spark)).count() == 0
    mixed = mixing.mixed_documents(clashing(docs))
    assert mixed.columns == clashing(docs).columns and mixed.where("_key <> '_key' or row <> 'row'").count() == 0
    assert mixed.count() == sum(r["copies"] for r in got)
    tilted = mixing.pareto_mix(docs, tilt=F.lit(2.0)).agg(F.sum("taken")).first()[0]
    assert tilted > 0
    wordless = mixing.pareto_mix(frame(spark, [(1, None, None, None, 0), (2, " ", None, "x", 0)])).collect()
    assert {r["taken"] for r in wordless} == {0}


# Quality


def test_resampling_keeps_clean_documents(spark):
    rng = np.random.default_rng(6)
    rows, marks = [], []
    for i in range(600):
        w = [f"{'abc'[k % 3]}{k}" for k in rng.integers(0, 60, 50)]
        good = i % 5 != 0
        if not good:
            w = [x + "%%%" for x in w] if i % 2 else [w[0]] * 50
        rows.append((i, " ".join(w), "en", "a", 1))
        marks.append((i, int(good), 0))
    df, lab = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in resampling.resampled_documents(df, lab).collect()}
    assert kept == {i for i in range(600) if i % 5}


def test_resampling_keeps_the_highest_keys(spark):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(800):
        w = [f"{'gb'[int(rng.random() < i / 800)]}{k}" for k in rng.integers(0, 40, 30)]
        rows.append((i, " ".join(w), "en", "a", 1))
        marks.append((i, int(i < 400), 0))
    df, lab = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = resampling.Resampler(df, lab, k=300)
    got = sorted(map(tuple, model.scores.collect()))
    total, target = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    for i, t, *_ in rows:
        counts = np.bincount(resampling.features(t), minlength=resampling.BUCKETS)
        total += counts
        target += counts * (i < 400 and zlib.crc32(str(i).encode()) % 5 > 1)
    ratio = np.log((target + 1) / (target.sum() + resampling.BUCKETS)) - np.log((total + 1) / (total.sum() + resampling.BUCKETS))
    x = np.array([ratio[resampling.features(t)].sum() / (len(resampling.features(t)) + resampling.PRIOR) for _, t, *_ in rows])
    weight = model.offset + model.slope * x
    key = weight + resampling.gumbel(list(range(800)))
    assert np.allclose([r[1:] for r in got], np.stack([x, weight, key], axis=1))
    kept = {r["doc_id"] for r in model.kept_rows(df).collect()}
    assert kept == set(np.argsort(-key)[:300].tolist()) and kept != set(np.argsort(-weight)[:300].tolist())


def test_gumbel_keys_sample_by_weight():
    weight = np.repeat([0.0, np.log(2), np.log(4)], 20_000)
    kept = np.argsort(-(weight + resampling.gumbel(list(range(60_000)))))[:3000]
    shares = np.bincount(kept // 20_000, minlength=3) / 3000
    assert np.allclose(shares, [1 / 7, 2 / 7, 4 / 7], atol=0.03)


def test_resampling_on_awkward_rows(spark, docs, labels):
    kept = resampling.resampled_documents(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and 0 < kept.count() <= docs.count()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resampling.resampled_documents(docs, none).count() == docs.count()
    assert resampling.resampled_documents(empty(spark), labels).count() == 0


def test_kth_largest(spark):
    df = spark.range(50_000).select((F.xxhash64("id") % 9000 / 7.0).alias("v"))
    values = sorted((r["v"] for r in df.collect()), reverse=True)
    for k in (1, 10, 25_000, 50_000):
        assert resampling.kth_largest(df, "v", k, bins=16, most=50) == values[k - 1]
    assert resampling.kth_largest(df, "v", 0) == float("inf")


# Language model


@pytest.mark.parametrize("head", [1 << 20, 40])
def test_katz_scores_equal_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(katz.Head.__init__, "__defaults__", ("n", head, ()))
    rows = [(i, " ".join(words(t)[:200]), *r) for i, t, *r in family(21, 150)]
    model = katz.KatzModel(frame(spark, rows))
    got = {r["doc_id"]: r for r in model.scores(frame(spark, rows)).collect()}
    spans = {i: ["<b>", *words(t, lower=True), "<e>"] for i, t, *_ in rows}
    train = [w for i, w in spans.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(w, w[1:], strict=False))
    real = {w: c for w, c in one.items() if w != "<b>"}
    total, kinds = sum(real.values()), len(real)
    r1 = katz.discounts(Counter(real.values()))
    kept = sum(c * r1.get(c, 1) for c in real.values())
    lower = lambda w: real[w] * r1.get(real[w], 1) / total if w in real else 1 - kept / total
    r2 = katz.discounts(Counter(two.values()))
    mass = Counter()
    for (h, _), c in two.items():
        mass[h] += c * r2.get(c, 1)
    seen = {(h, w): c * r2.get(c, 1) / (one[h] + (mass[h] > one[h] - 1e-6)) for (h, w), c in two.items()}
    used, under = Counter(), Counter()
    for (h, w), p in seen.items():
        used[h] += p
        under[h] += lower(w)
    back = {h: (1 - used[h]) / (1 - under[h]) for h in used}
    p_of = lambda h, w: seen.get((h, w)) or back.get(h, 1) * lower(w)
    for h in list(back)[:20]:
        assert math.isclose(sum(p_of(h, w) for w in real) + back[h] * (1 - kept / total), 1, rel_tol=1e-9)
    for i, w in spans.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) - 1, sum(x in real for x in w[1:]), total)
        assert math.isclose(r["base_score"], sum(math.log10((real.get(x, 0) + 1) / (total + kinds + 1)) for x in w[1:]), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p_of(h, x)) for h, x in zip(w, w[1:], strict=False)), rel_tol=1e-9)


def test_katz_head_is_bounded_at_every_count(spark):
    table = spark.createDataFrame([(k, 20_000 + k * 7) for k in range(50)] + [(100 + k, 3) for k in range(9)], "word long, n long")
    for limit in (3, 20, 55):
        head = katz.Head(table, "word", ["n"], limit=limit)
        assert len(head.keys) <= limit and set(head.values["n"]) == {n for n in (r["n"] for r in table.collect()) if n >= head.least}


def test_katz_on_awkward_rows(spark, docs):
    got = katz.KatzModel(clashing(docs)).scores(clashing(docs)).collect()
    rows = awkward()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(words(t)) + 1) for i, t, *_ in rows)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert next(r for r in got if r["doc_id"] is None)["held_out"]
    held = frame(spark, [(i, "a b", "en", "a", 1) for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3])
    assert {r["train_tokens"] for r in katz.KatzModel(held).scores(held).collect()} == {0}
    assert katz.KatzModel(empty(spark)).scores(empty(spark)).count() == 0
