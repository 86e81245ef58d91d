"""Training-data operators against brute force, on small fixtures and edge cases."""

import collections
import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from evidara.llm import components, decontaminate, fingerprints, html, jaccard, language, licences, lm, pieces, sharding, urls
from evidara.llm.runtime import crc_residue, slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, n_words string, key string, ids string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", "x", "x", "x", "x") for i, t, lang in rows], DOCS)


def words(n, seed, vocabulary=4000):
    r = np.random.Generator(np.random.PCG64(seed))
    return [f"w{x}" for x in r.integers(0, vocabulary, n)]


def edited(base, every, tag):
    return [f"{tag}{i}" if i % every == every - 1 else w for i, w in enumerate(base)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(0, None, None), (1, "", "en"), (2, "  \n ", "en"), (3, "One", "en"), (4, "one", None), (5, "A b", "en")]
    n = 10
    for group in range(4):
        base = words((30, 90, 300, 1200)[group], group)
        for k in range(6):
            rows.append((n, " ".join(base if k < 2 else edited(base, 40 + 20 * k, f"e{k}_")), "en"))
            n += 1
    for k in range(12):
        rows.append((n, " ".join(words(25, 100 + k) + words(25, 5)), "fr"))  # half of each is shared
        n += 1
    for k in range(30):
        rows.append((n, " ".join(words(3 + k, 300 + k // 3, 40)), "de"))
        n += 1
    return frame(spark, rows), [(i, t) for i, t, _ in rows]


def brute_components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width,threshold,boundary", [(3, (9, 10), None), (3, (9, 10), 0), (3, (9, 10), 40), (5, (8, 10), None), (2, (8, 10), 16)])
def test_jaccard_components(corpus, width, threshold, boundary):
    df, rows = corpus
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_components(df, width, threshold, boundary).collect()}
    assert got == brute_components(rows, width, *threshold)


def test_jaccard_repeats_and_nulls(spark):
    df = frame(spark, [(7, "a b c d", None), (7, "a b c d", None), (None, "a b c d", None), (3, "A B C D", None), (None, None, None)])
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.near_duplicate_components(df, 3, (9, 10)).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (7, 3), (7, 3)]
    assert jaccard.near_duplicate_components(df.limit(0), 3, (9, 10)).count() == 0


def test_profile_bounds_never_cut_a_link():
    r = np.random.Generator(np.random.PCG64(1))
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[r.random(len(a)) > 0.1], r.integers(0, 2**63, 20).astype(np.uint64))))
        pa, pb = (np.frombuffer(jaccard.profile(x), np.uint16).astype(int) for x in (a, b))
        assert np.abs(pa - pb).sum() <= len(np.setxor1d(a, b))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 61 + 50


def brute_windows(text, items):
    def split(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = split(text), set(), set()
    for item, t in items:
        x = split(t)
        n = min(10, len(x))
        for i in range(len(x) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark):
    item = words(14, 50)
    items = [(1, " ".join(item)), (2, "Zeta-ETA"), (3, "solo"), (4, None), (5, ""), (10, " ".join(words(10, 51))), (11, " ".join(words(10, 51)))]
    texts = [None, "", "a " + ", ".join(item) + " b", " ".join(item[:9]), " ".join(item[2:12] + item[2:14]), "x zeta eta y SOLO", " ".join(words(10, 51)).upper(), "émile " * 5, " ".join(words(3000, 52) + item)]
    df, bench = frame(spark, [(i, t, None) for i, t in enumerate(texts)] + [(2, texts[2], None)]), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], *[r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]) for r in decontaminate.decontaminate(df, bench).collect())
    assert got == sorted((i, *brute_windows(t, items)) for i, t in [*enumerate(texts), (2, texts[2])])
    assert decontaminate.decontaminate(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
    more = frame(spark, [(None, texts[2], None), (None, texts[2], None), (5, texts[3], None), (5, texts[4], None)])
    odd = spark.createDataFrame([(None, " ".join(item), "x", "y"), (1, "zeta eta", "x", "y")], "item_id long, text string, window string, k string")
    got = sorted((r["doc_id"] or -1, r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(more, odd).collect())
    assert got == [(-1, 14, 0), (-1, 14, 0), (5, 0, 0), (5, 22, 0)]
    blocks = decontaminate.find_windows(df, bench, block=3).filter("item_id IS NOT NULL").select("doc_id", "item_id").distinct().count()
    assert blocks == decontaminate.find_windows(df, bench).filter("item_id IS NOT NULL").select("doc_id", "item_id").distinct().count()


def test_piece_sampling_is_exact_and_lossless(spark):
    v = pieces.Vocabulary.load()
    texts = [None, "", " ", "a▁b  c\n\n d\t\x00x", "ééé 日本語 🎉", "x" * 3000, "▁", " lead", "\n", "Hello there world"]
    df = frame(spark, list(zip(range(len(texts)), texts, [None] * len(texts))))
    rows = pieces.encode_documents(df, vocabulary=v).orderBy("doc_id").collect()
    assert [r["decoded"] for r in rows] == texts and rows[0]["ids"] is None and rows[1]["ids"] == []
    again = {r["doc_id"]: r["ids"] for r in pieces.encode_documents(df.repartition(3), vocabulary=v).collect()}
    assert again == {r["doc_id"]: r["ids"] for r in rows}
    other = {r["doc_id"]: r["ids"] for r in pieces.encode_documents(df, seed=2, vocabulary=v).collect()}
    assert other != again
    assert [r["text"] for r in pieces.decode_documents(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in rows], "doc_id long, ids array<int>"), vocabulary=v).orderBy("doc_id").collect()] == texts
    # Sampled frequencies against the lattice's own probabilities.
    n, word = 20000, "▁there"

    def ways(i):
        if i == len(word):
            yield (), 0.0
        for k in range(1, len(word) - i + 1):
            h = np.zeros(1, np.uint64)
            for c in word[i : i + k]:
                h = pieces.extend(h, np.array([ord(c)], np.uint32))
            found, log = v.find(k, h)
            if found[0] >= 0:
                for rest, more in ways(i + k):
                    yield (int(found[0]), *rest), 0.5 * float(log[0]) + more

    odds = dict(ways(0))
    total = np.logaddexp.reduce(list(odds.values()))
    ids, begin = pieces.sample_ids(["there"] * n, np.arange(n).astype(np.uint64), v, 1, 0.5)
    seen = collections.Counter(tuple(ids[begin[i] : begin[i + 1]].tolist()) for i in range(n))
    assert set(seen) <= set(odds) and max(abs(seen[k] / n - math.exp(x - total)) for k, x in odds.items()) < 0.02


def test_url_rules(spark):
    made = ["http://a.net/x", "http://EXAMPLE.net/en/1?q", "https://example.com/de/", "http://x.org/fr/2#t", "http://net", "ftp://evil.com/x.net/", None, "nothing", "http://notnet/", "http://spam-farm.example.org/en/1", "http://user@net:80/", "http://b.example.net/de/"]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    rules = [("net", "/", "net/", "block"), ("example.net", "/en/", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("org", "/fr/", "org/fr/", "allow")]
    for r in urls.filter_urls(df).collect():
        url = made[r["page_id"]] or ""
        host, path = "", ""
        if "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
            host, path = m[1].lower(), m[2]
        fit = max((x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])), key=lambda x: len(x[2]), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, fit and fit[2])
        assert r["verdict"] == (fit[3] if fit else "block" if "spam" in host else "allow")


def test_wildcard_automaton_against_regex():
    r = np.random.Generator(np.random.PCG64(3))
    globs = ["".join(r.choice(list("ab*"), r.integers(1, 7))) for _ in range(40)]
    strings = ["".join(r.choice(list("abc"), r.integers(0, 9))) for _ in range(200)]
    got = urls.ShiftAnd(globs).run(strings)
    for j, g in enumerate(globs):
        pattern = re.compile(".*".join(map(re.escape, re.split(r"\*+", g))), re.S)
        assert [bool(pattern.fullmatch(s)) for s in strings] == got[:, j].tolist()


def test_language_profiles(spark):
    en, fr = "the cat and the dog are in the house with that thing ", "le chat et la souris sont dans la maison avec les autres "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 3), "en" if i % 2 else "fr") for i in range(60)] + [(60, None, "en"), (61, "123 ...", None), (62, "", "fr"), (63, "the house and the cat", None)]
    got = {r["doc_id"]: r for r in language.identify_languages(frame(spark, rows)).collect()}
    for i in range(60):
        assert got[i]["lang_pred"] == ("en" if i % 2 else "fr") and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i]["lang_pred"] for i in (60, 61, 62, 63)] == ["und", "und", "und", "en"] and got[61]["score"] == 0
    assert language.identify_languages(frame(spark, rows).limit(0)).count() == 0
    assert crc_residue("doc_id", 4) is not None


def test_minimax_cuts_against_brute_force():
    r = np.random.Generator(np.random.PCG64(4))
    for _ in range(200):
        sizes, shards = r.integers(1, 30, r.integers(1, 9)).tolist(), int(r.integers(1, 5))
        cuts = sharding.minimax_cuts(sizes, shards)
        largest = max(sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)]))
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)))) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1))
        assert largest == best and cuts == sorted(cuts)


def test_sharding(spark):
    rows = [(i, "x" * (i % 50), None) for i in range(300)] + [(1000 + i, "hot" * 50, None) for i in range(200)] + [(5000, None, None), (None, "é", None)]
    got = sharding.shard_documents(frame(spark, rows), shards=8).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    by = collections.defaultdict(list)
    where = collections.defaultdict(set)
    for r in got:
        by[r["shard"]].append(r)
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values()) and all(len(x) == 1 for x in where.values())
    assert next(r for r in got if r["doc_id"] == 5000)["size"] == 16 and next(r for r in got if r["doc_id"] is None)["size"] == 18
    loads = sorted(sum(r["size"] for r in x) for x in by.values())
    assert loads[-1] == 200 * 166 and loads[-2] - loads[0] < 2 * 66 * 12  # the hot text alone, the rest even


def test_lm_scores(spark):
    rows = [(i, " ".join(words(30, i % 9, 60)), None) for i in range(200)] + [(200, None, None), (201, "", None), (202, "Unseen-Word", None), (1, "twice", None)]
    got = lm.score_corpus(frame(spark, rows)).collect()
    count = collections.Counter()
    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*(t or "").lower().split(), None])
    n, v = sum(count.values()), len(count)
    want = sorted((i, len((t or "").split()) + 1, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(t or "").lower().split(), None]), 6)) for i, t, _ in rows)
    assert sorted((r["doc_id"], r["n_tokens"], round(r["base_score"], 6)) for r in got) == want and {r["train_tokens"] for r in got} == {n}
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # repeated texts are predictable


def test_lm_is_a_distribution():
    texts = [words(20, k, 30) for k in range(8)]
    classes = lm.WordClasses([[w.encode() for w in t] for t in texts])
    model = lm.Softmax(classes.count)
    model.weights[:] = np.random.Generator(np.random.PCG64(2)).normal(0, 1, model.weights.shape)
    table = lm.WordTable(classes)
    ids, starts = table.numbers([" ".join(t) for t in texts])
    p = np.exp(model.log_probabilities(model.rows(ids, starts, table, table.hashes(), table.kinds())))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_fingerprints(spark):
    rows = [(i, " ".join(words(200, i % 30, 900)), None) for i in range(60)] + [(100, None, None), (101, "", None), (102, "é ü", None), (None, "é ü", None)]
    got = fingerprints.fingerprint_documents(frame(spark, rows)).collect()
    order = sorted(((i, t or "") for i, t, _ in rows if i is not None), reverse=True) + [(None, "é ü")]
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want[i] = (len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want
    prints = collections.defaultdict(set)
    for i, t, _ in rows:
        prints[t or ""] |= {r["fingerprint"] for r in got if r["doc_id"] == i}
    assert all(len(x) == 1 for x in prints.values())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert sum(r["near_edited"] for r in got) > 3 * sum(r["near_next"] for r in got if (r["doc_id"] or 0) < 60)
    assert fingerprints.fingerprint_documents(frame(spark, rows).limit(0)).count() == 0


def test_html_extraction(spark):
    chain = html.default_model()
    right = sum(html.extract_text(h, chain) == "\n".join(main) for h, main in html.labelled_pages(120, seed=99))
    assert right >= 0.95 * 120
    page = "<html><head><title>T</title><script>a('<p>x</p>')</script></head><body><nav><a href=1>Home</a></nav><article><h1>Head &amp; line</h1><p>One  <b>two\n</b> three.<p>Four &eacute;.</article><div class=comments><p>Nice.</p></div><footer>&copy; 2020</footer>"
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "plain <", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract_pages(pages).collect()}
    assert got[1] == ("Head & line\nOne two three.\nFour é.", 34) and got[2] == ("", 0) and got[3] == ("", 0) and len(got) == 4


def test_chain_gradient_against_enumeration():
    pages = [([["a"], ["b"], ["a", "c"]], [0, 1, 1]), ([["c"], ["b"]], [1, 0])]
    model = html.train_chain(pages, rounds=60)
    for rows, _ in pages:
        def score(path, rows=rows):
            own = sum(model.states[model.index[f]][s] for r, s in zip(rows, path, strict=True) for f in r)
            return own + sum(model.moves[a][b] for a, b in zip(path, path[1:], strict=False))

        best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
        assert model.decode(rows) == list(best)


def test_licences(spark):
    rows = [(1, "Prose of some kind.\nReleased under the MIT License.\nMore prose.", None), (2, "Licensed under the Apache License, Version 2.0.", None), (3, "he renewed his driving license last week", None), (4, None, None), (5, "", None), (6, " ".join(words(300, 1)) + " This work is licensed under the GNU General Public License, version 3.", None)]
    model = licences.fit([" ".join(words(12, k)) for k in range(300)], rounds=15)
    got = {r["doc_id"]: r for r in licences.scan_licences(frame(spark, rows), model).collect()}
    assert [got[i]["families"] for i in range(1, 7)] == ["mit", "apache-2.0", "", "", "", "gpl"]
    assert got[1]["licences"][0]["paragraph"] == 1 and got[4]["n_paragraphs"] == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(words(12, 77))
    base = words(80, 78)
    rows = [(1, " ".join(base), "en"), (2, " ".join(base), "en"), (3, " ".join(edited(base, 60, "z")), "en"), (4, item, "en"), (5, "!!! 123", "en"), (6, None, "en"), (7, " ".join(words(50, 79)), "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append(sorted(r["doc_id"] for r in docs.collect()))
    assert left == [[1, 2, 3, 4, 7], [1, 4, 7], [1, 7]]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 7] and all(r["lossless"] for r in out)


def test_lm_learns_from_every_row(spark):
    r = np.random.Generator(np.random.PCG64(1))
    order = [" ".join(f"v{x}" for x in r.integers(0, 40, 20)) + (" aa xx" if k % 2 else " bb yy") for k in range(400)]
    rows = [(i, order[i % 400], None) for i in range(800)]
    df = frame(spark, rows)
    classes = lm.fit_classes(df)
    counts = lm.count_tokens(df, classes).cache()
    depth, masses, total, _ = lm.cell_masses(counts, classes.count)
    assert total == 800 * 23
    softmax, tree = lm.fit_softmax(df, classes, depth, masses, total)
    lonely = lm.fit_softmax(df.filter("doc_id = 5"), classes, depth, masses, total)[1]
    assert np.count_nonzero(lonely.weights) and np.count_nonzero(tree.weights) > 5 * np.count_nonzero(lonely.weights)  # each row's contexts count
    table = lm.WordTable(classes)
    ids, starts = table.numbers(["aa xx", "bb yy", "aa yy"])
    hashes, kinds = table.hashes(), table.kinds()
    past = lm.history(ids, starts, table, hashes)
    tops = [(h >> np.uint64(32)).astype(np.uint32) for h in past[2:]]
    p = softmax.log_probability(softmax.rows_of(past, kinds), kinds[ids]) + tree.log_probability(kinds[ids], tree.cells(hashes, kinds)[ids], tops)
    assert p[1] > p[7] + 0.5 and p[4] > p[7] + 0.5  # the learnt second word above the other one


def test_lm_word_factor():
    depth, slots = np.array([3, 0, 4]), 1 << 10
    masses = np.random.Generator(np.random.PCG64(3)).uniform(0.5, 9, 8 + 1 + 16)
    tree = lm.WordTree(depth, masses, slots)
    kinds, cells = np.repeat([0, 1, 2], [8, 1, 16]), np.concatenate([np.arange(8), [0], np.arange(16)]).astype(np.uint32)
    past = [np.full(25, h, np.uint32) for h in (123456789, 3000000000, 77)]

    def shares():
        return np.exp(tree.log_probability(kinds, cells, past))

    assert np.allclose(shares(), masses / np.repeat([masses[:8].sum(), masses[8], masses[9:].sum()], [8, 1, 16]), rtol=1e-4)  # unlearnt: by counts
    squares, sums = np.ones(slots, np.float32), np.zeros(slots, np.float32)
    before = shares()
    for _ in range(20):
        tree.train(np.full(50, 2), np.full(50, 6, np.uint32), [h[:1].repeat(50) for h in past], squares, sums)
    after = shares()
    assert np.allclose([after[:8].sum(), after[8], after[9:].sum()], 1, atol=1e-4)  # a distribution in each class
    assert after[15] > 0.8 and after[15] / after[16] > 5 * before[15] / before[16]  # a learnt word rises within its class


def test_fingerprints_of_hot_groups(spark):
    hot, near = words(120, 501, 3000), words(120, 502, 3000)
    rows = [(i, " ".join(words(80, 600 + i, 3000)), None) for i in range(120)] + [(200 + i, " ".join(hot), None) for i in range(30)]
    rows += [(300 + i, " ".join(f"odd{i}" if j == 3 * i + 2 else w for j, w in enumerate(near)), None) for i in range(30)]
    df = frame(spark, rows)
    assert fingerprints.near_distinct(df)[1] <= 120 + 1 + 4  # each hot group counts about once
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(df).collect()}
    assert len({got[200 + i]["fingerprint"] for i in range(30)}) == 1
    assert all(set(got[i]["fingerprint"][8:]) != {"0"} for i in (*range(200, 230), *range(300, 330)))  # subset parts
    assert all(got[300 + i]["near_next"] > 0.6 for i in range(1, 30)) and all(got[i]["near_next"] < 0.3 for i in range(1, 120))


def test_fingerprints_beyond_the_broadcast_bounds(spark, monkeypatch):
    rows = [(i, " ".join(words(80, 600 + i // 2, 400)), None) for i in range(80)] + [(200, None, None), (201, "!", None)]
    got = sorted(map(tuple, fingerprints.fingerprint_documents(frame(spark, rows)).collect()))
    monkeypatch.setattr(fingerprints, "MOST_TERMS", 10)
    monkeypatch.setattr(fingerprints, "MOST_TEXTS", 1, raising=False)
    assert sorted(map(tuple, fingerprints.fingerprint_documents(frame(spark, rows)).collect())) == got


def test_licences_of_one_long_paragraph(spark):
    mit, nc = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    prose = [" ".join(words(n, 700 + n)) for n in (10, 700, 600, 300)]
    model = licences.fit([" ".join(words(12, k)) for k in range(300)], rounds=15)
    rows = [(1, " ".join([prose[0], mit, prose[1], nc, prose[2]]), None), (2, " ".join([prose[0], mit, prose[1], mit, prose[3]]), None), (3, " ".join([*words(30, 9), mit, prose[1]]), None)]
    got = {r["doc_id"]: r for r in licences.scan_licences(frame(spark, rows), model).collect()}
    assert got[1]["families"] == "cc-by-nc,mit" and got[1]["n_licences"] == 2 and [x["paragraph"] for x in got[1]["licences"]] == [0, 0]
    assert (got[2]["families"], got[2]["n_licences"]) == ("mit", 2) and (got[3]["families"], got[3]["n_licences"]) == ("mit", 1)


def test_html_formulas_and_fallbacks():
    page = "<body><article><h1>Head line</h1><p>The energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p><p>See <svg viewBox='0 0 9 9'><path d='M0 0'/><text x='1'>axis label</text></svg> above.</p><object data='x.pdf'><p>The fallback of an object.</p></object><noscript><p>The text without scripts.</p></noscript><canvas><p>A drawing in words.</p></canvas><script>no('<p>x</p>')</script><textarea>no</textarea></article></body>"
    assert [text for _, text, _ in html.leaf_blocks(page)] == ["Head line", "The energy is E=m here.", "See axis label above.", "The fallback of an object.", "The text without scripts.", "A drawing in words."]


def test_jaccard_of_texts_that_share_an_id(spark):
    a, b = words(60, 901), words(60, 902)
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, " ".join([*a, "z"])), (9, " ".join([*b, "z"])), (None, " ".join([*a, "y"])), (None, "lone text of nobody"), (12, ""), (12, None)]
    df = frame(spark, [(i, t, None) for i, t in rows])
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.near_duplicate_components(df, 3, (9, 10)).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7), (8, 7), (9, 7), (12, 12), (12, 12)]
    gone, repeats = jaccard.near_duplicates(df, 3, (9, 10))
    assert sorted(r["doc_id"] or -1 for r in gone.collect()) == [-1, 8, 9] and repeats.count() == 0  # both texts of 7 stay


def test_jaccard_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HUB_PAIRS", 8)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 4)
    monkeypatch.setattr(jaccard, "HOT_LEVEL", 6)
    base = words(80, 903)
    rows = [(i, " ".join(base[:i] + [f"odd{i}"] + base[i + 1 :])) for i in range(80)] + [(100 + i, " ".join(words(20, 904) + words(20, 910 + i // 2))) for i in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_components(frame(spark, [(i, t, None) for i, t in rows]), 3, (9, 10)).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def test_minimax_of_refined_cells_against_brute_force():
    r = np.random.Generator(np.random.PCG64(8))
    for _ in range(200):
        n, shards = int(r.integers(1, 60)), int(r.integers(1, 7))
        groups = sorted(zip(r.integers(-(2**63), 2**63 - 1, n).tolist(), r.integers(16, 400, n).tolist()))
        exact = sharding.smallest_capacity([x for _, x in groups], shards)

        def sums(bits, keep=None, groups=groups):
            by = collections.defaultdict(list)
            for h, x in groups:
                if keep is None or h >> (64 - bits + sharding.MORE_BITS) in keep:
                    by[h >> (64 - bits)].append(x)
            return [(bits, p, sum(x), len(x)) for p, x in by.items()]

        cells = sharding.Cells(sums(2))
        while at := cells.undecided(shards):
            parts = []
            for bits in {cells.cells[i][0] for i in at}:
                parts += sums(bits + sharding.MORE_BITS, {cells.cells[i][1] for i in at if cells.cells[i][0] == bits})
            cells = cells.split(at, parts)
        sizes = [c[2] for c in cells.cells]
        cuts = sharding.minimax_cuts(sizes, shards)
        assert max(sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)])) == exact and sum(sizes) == sum(x for _, x in groups)


def test_sharding_reaches_the_optimum_over_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    r = np.random.Generator(np.random.PCG64(9))
    texts = ["y" * int(k) + str(i) for i, k in enumerate(r.integers(0, 120, 300))] + ["twin"] * 5 + [None, "", "z" * 1500]
    df = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    rows = sharding.shard_documents(df, shards=7).collect()
    loads = collections.Counter()
    for x in rows:
        loads[x["shard"]] += x["size"]
    hashed = df.selectExpr("xxhash64(coalesce(text, '')) AS h", "octet_length(coalesce(text, '')) + 16 AS n").groupBy("h").agg({"n": "sum"}).orderBy("h").collect()
    assert max(loads.values()) == sharding.smallest_capacity([x[1] for x in hashed], 7) and len(rows) == len(texts)
    few = sharding.shard_documents(df.limit(3), shards=7).collect()
    assert len(few) == 3 and all(x["slot"] == 0 for x in few) and sharding.shard_documents(df.limit(0), shards=7).count() == 0


def test_urls_of_any_length(spark):
    made = ["http://x.example.net/en/" + "a" * 1_000_000, "http://" + "b." * 2000 + "net/q", "http://a.net\x01/x", "http://a.net/x", "http://a.net/x", ""] + [f"http://h{i}.org/fr/{i}" for i in range(300)]
    df = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(made)], "page_id long, url string, host string, verdict string, rule string")
    got = {r["page_id"]: r for r in urls.filter_urls(df).collect()}
    assert [got[i]["rule"] for i in range(7)] == ["example.net/en/", "net/", None, "net/", "net/", None, "org/fr/"] and len(got) == len(made)
    assert urls.filter_urls(df.limit(0)).count() == 0
    machine = urls.ShiftAnd([g for _, g, _ in urls.SITE_RULES] + urls.JUNK_GLOBS * 8)
    strings = [f".{r['host']}{urls.HOST_END}{r['path']}" for i, r in got.items() if i]
    assert machine.words > 1 and [machine._one(s) for s in strings] == machine.run(strings).tolist()


def test_html_of_pages_that_no_generator_wrote(spark):
    chain = html.default_model()
    post = """<html><body><div id="top"><a href="/">Daily Post</a><ul class="menu"><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></div>
<main><article><h1>River bridge reopens</h1><p class="lead">The old bridge over the river was opened again on Monday after two years of work.</p><figure><img src=x><figcaption>The bridge on Monday.</figcaption></figure><p>Engineers replaced all of the cables &amp; the deck.</p><div class="advertisement">Buy two, get one free!</div><h2>What comes next</h2><p>A second bridge is planned.</p></article></main>
<section id="comments"><h3>3 comments</h3><p>Great news for the town.</p><p>Finally!</p></section><footer><p>&copy; 2024 Daily Post. All rights reserved.</p></footer></body></html>"""
    soup = '<body><header>My blog</header><div class="cookie-banner">We use cookies.<button>OK</button></div><div class="content"><h1>Soup</h1><p>Boil water.<p>Add salt<p>Wait.</div><aside class="sidebar"><h3>About me</h3><p>I cook.</p></aside><div class="footer">Contact</div></body>'
    old = '<table class="nav"><tr><td><a href=1>one</a><td><a href=2>two</a></table><div><h1>Old page</h1><p>This page was written in 1999 and it has only one paragraph of text that matters.</p></div><hr><p class="copyright">Copyright 1999 by nobody</p>'
    assert html.extract_text(post, chain).split("\n") == ["River bridge reopens", "The old bridge over the river was opened again on Monday after two years of work.", "The bridge on Monday.", "Engineers replaced all of the cables & the deck.", "What comes next", "A second bridge is planned."]
    assert html.extract_text(soup, chain) == "Soup\nBoil water.\nAdd salt\nWait." and html.extract_text(old, chain).startswith("Old page\nThis page") and "Copyright" not in html.extract_text(old, chain)
    pages = spark.createDataFrame([(1, "u", soup), (1, "u", soup), (None, None, "<p>One</p>" * 3)], "page_id long, url string, html string")
    got = html.extract_pages(pages).collect()
    assert len(got) == 3 and sum(r["text"].startswith("Soup") for r in got) == 2 and html.extract_pages(pages.limit(0)).count() == 0


def test_html_of_hostile_pages():
    chain = html.default_model()
    began = time.time()
    for page in ("<div>a" * 100_000, "<b>" * 100_000 + "<li>x</li>" * 20_000 + "</i>" * 100_000, "<option>a" * 50_000, '<a title="x' * 50_000, "<!x" * 50_000 + "<" * 50_000, "<p>" + "word " * 400_000):
        html.extract_text(page, chain)
    assert time.time() - began < 60
    assert [t for _, t, _ in html.leaf_blocks('<p>a</p><a title="x>one two')] == ["a", "one two"]
    assert [t for _, t, _ in html.leaf_blocks("<p>a</ b>c</><?x y?>d</p>")] == ["acd"]
    deep = html.leaf_blocks('<div class="x"><section><article id="main"><p><b class="ad">hi</b> <i>there')
    assert [(o.own, o.near, sorted(o.tags), sorted(o.hints)) for o, _, _ in deep] == [("p", "main", ["article", "div", "p", "section"], ["main"])]


def test_pipeline_of_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    item, base = " ".join(words(12, 77)), words(80, 78)
    a, b, c = (" ".join(words(60, k)) for k in (81, 82, 83))
    rows = [(None, "x " + item), (None, a), (7, b), (7, c), (7, c), (8, a), (9, " ".join(base)), (None, " ".join(edited(base, 60, "z"))), (None, None), (10, "")]
    for labelled in (True, False):
        at = f"{tmp_path}/{labelled}"
        spark.createDataFrame([(i, t, "en" if labelled else None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(None, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs, left = spark.read.parquet(f"{at}/documents.parquet"), []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, at)
            left.append(sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()))
        near = sorted([(0, "x " + item), (7, b), (7, c), (8, a), (9, " ".join(base))])
        assert left[0] == sorted((i or 0, t) for i, t in rows if t) and left[1] == near and left[2] == [x for x in near if item not in x[1]]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_against_brute_force(spark):
    r = np.random.Generator(np.random.PCG64(12))
    letters = {"aa": "abcdé", "bb": "bcdef", "cc": "bcdef"}  # the last two are alike
    rows = [(i, " ".join("".join(r.choice(list(letters[lang]), r.integers(1, 7))) for _ in range(int(r.integers(1, 40)))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(200, "Abc " * 5000 + "1", "aa"), (201, "ÉÉ!", None), (202, "fed fed", None), (202, "fed fed", None), (203, "zzz", None)]
    profiles = language.fit_profiles(frame(spark, rows))
    profiles["dd"] = profiles["aa"]  # a tie: the first by name
    model = language.RankProfiles(profiles)

    def counts(text):
        out = collections.Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f"_{word}_"
            out.update(word)
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return out

    whole = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        if lang:
            whole[lang] += counts(text)
    assert all(profiles[k] == [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE_GRAMS]] for k, c in whole.items())
    got = collections.defaultdict(set)
    for x in language.predict_language(frame(spark, rows), profiles).collect():
        got[x["doc_id"]].add((x["lang_pred"], round(x["score"], 9)))
    for i, text, _ in rows:
        own = sorted(counts(text).items(), key=lambda x: (-x[1], model._code(x[0]) if set(x[0]) <= set(model.index) | {"_"} else 1 << 60))
        assert len(own) <= model.document_grams
        best = None
        for lang in sorted(profiles):
            rank = {g: k for k, g in enumerate(profiles[lang])}
            cost = sum(min(abs(rank[g] - k), model.penalty) if g in rank else model.penalty for k, (g, _) in enumerate(own))
            best = min(best or (cost, lang), (cost, lang))
        if i != 203:  # of n-grams outside all profiles only their number counts
            assert got[i] == {(best[1], round(1 - best[0] / (model.penalty * len(own)), 9))}
    assert got[203] == {("aa", 0.0)}


def test_fingerprints_against_recomputation(spark):
    import xxhash

    rows = [(i, " ".join(words(70, 600 + i // 2, 300)), None) for i in range(60)] + [(70, None, None), (71, "one", None), (71, "two", None), (72, "é É ü", None), (73, "x " * 30_000 + "rare", None)]
    df = frame(spark, rows)
    tier = {r["term"]: r["tier"] for r in fingerprints.lexicon(df).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def folded(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & ((1 << 64) - 1)).to_bytes(8, "little"), h)
        return h

    def brute(text):
        found = {w for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))}
        terms = [xxhash.xxh64_intdigest(w.encode(), 42) for w in found]
        entries = sorted((1 if tier.get(signed(t)) is None else tier[signed(t)]) << fingerprints.TERM_BITS | t & ((1 << fingerprints.TERM_BITS) - 1) for t in terms)
        entries = [e for e in entries if e >> fingerprints.TERM_BITS == entries[0] >> fingerprints.TERM_BITS]
        out, shift = [folded(entries) if entries else folded([text.encode(), b"no term"])], 0
        for bits, subsets in fingerprints.LEVELS:
            for k in range(subsets):
                own = [e for e in entries if e >> shift & ((1 << bits) - 1) == k]
                out.append(folded(own) if own else 0)
            shift += bits
        return out

    def alike(a, b):
        value, at = float(a[0] == b[0]), 1
        for i, (_, n) in enumerate(fingerprints.LEVELS):
            pairs = [(x, y) for x, y in zip(a[at : at + n], b[at : at + n]) if x or y]
            if len(pairs) >= (fingerprints.LEAST_PARTS if i else 1):
                value = sum(x == y for x, y in pairs) / len(pairs)
            at += n
        return value

    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        mine, other = brute(t), brute(edited)
        shown = lambda parts: "".join(f"{x:016x}" for x in parts)
        want.append((i, len(t), shown(mine), shown(other), round(alike(mine, other), 9), round(alike(mine, brute(after)), 9)))
    got = [(r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.fingerprint_documents(df).collect()]
    assert sorted(got) == sorted(want)
    alone = fingerprints.fingerprint_documents(df.filter("doc_id = 5")).first()
    assert alone["near_next"] == 1.0 and alone["near_edited"] <= 1.0


def test_licences_of_many_kinds(spark):
    notice = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    cases = [
        ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl"), ("SPDX-License-Identifier: AGPL-3.0-or-later", "agpl-3.0"), ("// SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl"), ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
        ("this page is not licensed under the MIT License", ""), ("Code is never released under the BSD license.", ""), (f"Some file.\n\n{notice}\n\nMore of it.", "gpl"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "lgpl"),
        ("Students at MIT released a licence plate reader.", ""), ("All rights of way are reserved for the king", ""), ("Released under the MIT License.\n" * 2, "mit"),
        (" ".join(words(58, 40)) + " this work is licensed under a Creative Commons Attribution 4.0 International License " + " ".join(words(90, 41)), "cc-by"), (" ".join(words(20000, 42)), ""),
    ]
    model = licences.fit([" ".join(words(12, k)) for k in range(300)])
    df = frame(spark, [(i, t, None) for i, (t, _) in enumerate(cases)])
    got = {r["doc_id"]: r for r in licences.scan_licences(df, model).collect()}
    assert {i: got[i]["families"] for i in got} == {i: f for i, (_, f) in enumerate(cases)}
    assert got[12]["n_licences"] == 2 and got[7]["n_licences"] == 1 and got[7]["licences"][0]["paragraph"] == 2 and got[7]["n_paragraphs"] == 6
    assert licences.scan_licences(df.limit(0), model).count() == 0
    told = licences.held_out(model, [" ".join(words(12, 900 + k)) for k in range(300)])
    assert told["accuracy"] > 0.9 and told["units"] > 500
    lines = licences.sample_lines(df, 5)
    assert len(lines) == 5 and lines == licences.sample_lines(df.repartition(3), 5)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_lm_tokens_of_later_slices(kind):
    r = np.random.Generator(np.random.PCG64(8))
    pool = ["Ärger", "straße", "ONE", "two", "x\u00a0y", "\t", "\n ", "é\x1cb"]
    texts = [None if i < 1000 and i % 17 == 0 else " ".join(r.choice(pool, int(r.integers(0, 60)))) for i in range(3000)]
    table, seen = lm.WordTable(lm.WordClasses([[b"one", b"two"]])), 0
    for part in slices(pa.array(texts, kind), most=5000, rows=200):
        ids, starts = table.numbers(part)
        names = {n: w for w, n in table.items()}
        want = [[*lm.tokens_of(t), lm.END] for t in part.to_pylist()]
        assert [names[i] for i in ids.tolist()] == [w for t in want for w in t]
        assert starts.tolist() == [0, *np.cumsum([len(t) for t in want])[:-1].tolist()]
        seen += len(part)
    assert seen == len(texts)
