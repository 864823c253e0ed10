import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from meshspark.llm import components, language_id, lm, minhash, mixing, sharding, spotsigs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows, percent=75):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("few", [16, 2])
def test_near_duplicates(docs, clashing, none, texts, few):
    want = brute_components(texts)
    got = minhash.near_duplicates(docs, few=few).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    if few == 16:
        assert minhash.near_duplicates(clashing).count() == len(texts)
        assert minhash.near_duplicates(none).count() == 0


def test_chains_in_large_buckets_are_not_lost(spark):
    """Neighbours of a chain are alike, its ends are not, and all fall into large buckets."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(base)))
        for _ in range(2):
            base[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(d, few=2).collect()}
    assert got == want


def test_null_ids_are_kept_alone(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0), r.component_id or 0, r.kept) for r in minhash.near_duplicates(d).collect())
    assert rows == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False)]
    assert sorted(r.doc_id or 0 for r in minhash.without_near_duplicates(d).collect()) == [0, 1]


def test_components_of_a_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 30), (41, 40), (40, 41)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 41: 40}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in done]
        left = total - sum(done.values())
        w = sum(weight[s] for s in rest)
        share = {s: left * weight[s] / w for s in rest} if w else {}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return {**done, **share}
        done |= {s: 2.0 * sizes[s] for s in over}


def test_mix(docs, clashing, none, texts):
    sizes = defaultdict(int)
    for r in texts:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(dict(sizes))
    source = {r[0]: r[3] for r in texts}
    rows = mixing.mix(docs).collect()
    assert {r.doc_id for r in rows} == set(source)
    assert sorted(rows, key=str) == sorted(mixing.mix(docs.repartition(5)).collect(), key=str)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == len(words(dict((t[0], t[1]) for t in texts)[r.doc_id])) and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mix(clashing).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mix(none).count() == 0
    copies = defaultdict(int)
    for r in mixing.mixed_rows(docs).collect():
        copies[r.doc_id] += 1
    assert all(copies[r.doc_id] == (r.taken // r.size if r.size else 0) for r in rows)


def test_mix_sql(docs, texts):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r[1:] for r in con.execute(mixing.SQL).fetchall()}
    assert {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect()} == want


def test_fingerprints(docs, clashing, none, texts):
    ordered = sorted((r[0], r[1] or "") for r in texts)
    got = {r.doc_id: r for r in spotsigs.fingerprint_report(docs).collect()}
    prints = {}
    for i, (d, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        q = len(t) // 4
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - q] + following[:q]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        assert prints.setdefault(t, got[d].fingerprint) == got[d].fingerprint
        a, b = (set(re.findall(".{8}", x)) for x in (got[d].fingerprint, got[d].edited_fingerprint))
        assert abs(got[d].near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 1e-12
    long = [r for r in got.values() if r.n_chars > 2000]
    assert sum(r.near_edited for r in long) / len(long) > 0.4
    assert spotsigs.fingerprint_report(clashing).count() == len(texts)
    assert spotsigs.fingerprint_report(none).count() == 0


def test_fingerprints_of_one_row_nulls_and_ties(spark):
    one = spark.createDataFrame([(1, "the cat of dogs runs")], "doc_id long, text string")
    assert spotsigs.fingerprint_report(one).collect()[0].near_next == 1
    d = spark.createDataFrame([(None, "b c"), (None, "a"), (2, None), (2, "x y"), (2, "x y")], "doc_id long, text string")
    assert spotsigs.fingerprint_report(d).count() == 5


def test_signatures_skip_common_words(spark):
    d = spark.createDataFrame([("The cat, of the red house", 1), ("cat red house the", 2), ("the the", 3), ("!!", 4), ("", 5)], "text string, i int")
    rows = {r.i: r.f for r in d.select("i", spotsigs.signatures(d.text).alias("f")).collect()}
    assert len(rows[1]) == 2 and len(rows[3]) == 1 and len(rows[4]) == 1 and rows[5] == []


def test_similar_pairs(spark):
    rows = [(1, list(range(20))), (2, list(range(1, 21))), (3, list(range(50, 60))), (4, list(range(20))), (5, []), (6, list(range(14)))]
    prints = spark.createDataFrame(rows, "doc_id long, found array<int>")
    got = {(r.a, r.b): round(r.likeness, 6) for r in spotsigs.similar_pairs(prints).collect()}
    assert got == {(1, 2): round(19 / 21, 6)}


@pytest.mark.parametrize("shards", [24, 3])
def test_shards(docs, clashing, none, texts, shards):
    got = sharding.shard(docs, shards).collect()
    assert len(got) == len(texts)
    by = {r[0]: r[1] or "" for r in texts}
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        assert r.size == len(by[r.id].encode()) + 8 and r.text_crc32 == zlib.crc32(by[r.id].encode()) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / shards, max(r.size for r in got)
    assert all(abs(sizes[s] - mean) <= largest + 0.06 * mean for s in range(shards))
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in sharding.shard(clashing, shards).collect())
    assert sharding.shard(none, shards).count() == 0


def test_a_hot_text_is_subdivided(spark):
    rows = [(i, "same text") for i in range(600)] + [(1000 + i, f"text {i} " * 3) for i in range(600)] + [(None, "same text")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.05 * sum(sizes.values()) / 6 and len(sizes) == 6


def test_language_evidence(spark):
    rows = [(1, "the cat and the dog of it", "http://www.example.co.uk/x"), (2, "der Hund und die Katze für mich", "https://a.example.de/"), (3, "", None), (4, "zzz qqq xxx " * 20, None), (5, "le chat et la souris dans les", "http://b.example.fr")]
    pages = spark.createDataFrame([(i, u, f'<html lang="{"en" if i == 4 else ""}"><script>der die das</script><body>{t}</body></html>') for i, t, u in rows], "page_id long, url string, html string")
    got = {r.key: (r.lang, r.accepted) for r in language_id.identify_pages(pages).collect()}
    assert got == {1: ("en", True), 2: ("de", True), 3: ("und", False), 4: ("und", False), 5: ("fr", True)}


def test_host_priors_decide_short_texts(spark):
    rows = [(i, "el perro de la casa que no es", None, "h1.example") for i in range(40)] + [(100, "zapato", None, "h1.example"), (101, "zapato", None, "h2.example")]
    rows += [(200 + i, "the house of the cat that is", None, "h2.example") for i in range(40)]
    got = {r.key: r.lang for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), declared="lang", host="source").collect()}
    assert got[100] == "es" and got[101] == "en"


def test_language_of_the_pages_table(spark, tmp_path):
    """The query judges every page; markup, suffix and the levels of hosts decide where texts do not."""
    from meshspark.llm.queries import QUERIES

    rows = [(i, f"http://h{i % 2}.example.fr/{i}", f"<html><body>{'le chat et la souris dans les' if i % 2 else 'le la les de des du et'}</body></html>") for i in range(60)]
    rows += [(100 + i, f"http://h{i % 2}.example.com/{i}", "<html><body>the cat and the dog of it is</body></html>") for i in range(60)]
    # one rare word: its host's suffix, its host and its markup tell
    rows += [(200, "http://new.example.fr/", "<html><body>zapato</body></html>"), (201, "http://new.example.com/", "<html><body>zapato</body></html>"), (202, "http://new.example.com/", '<html lang="es"><body>el zapato</body></html>'), (203, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op1_language_id_pages"](spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    assert [got[i].lang for i in (200, 201, 202, 203)] == ["fr", "en", "es", "und"] and got[202].declared == "es"
    assert all(got[i].lang == "fr" for i in range(60)) and all(got[100 + i].lang == "en" for i in range(60))


def test_language_of_documents(docs, clashing, none, texts):
    got = {r.key: r.accepted for r in language_id.identify_documents(docs).collect()}
    assert all(got[i] for i in range(90)) and not any(got[i] for i in (96, 97, 98))
    kept = language_id.accepted_documents(clashing)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, a in got.items() if a}
    assert language_id.identify_documents(none).count() == 0


def test_language_equals_a_plain_loop(docs, texts):
    """All columns, by loops over rows: chances of characters, host priors in levels, observations, posterior."""
    import math

    names = language_id.LANGUAGES
    runs, most = ({k: defaultdict(float) for k in names[:-1]} for _ in range(2))

    def kind(c):
        return 0 if not c.isalpha() or ord(c) > 0xFFFF else ord(c) - 96 if "a" <= c <= "z" else ord(c) - 0xDF + 27 if 0xDF <= ord(c) <= 0xFF else 60 if ord(c) < 0x250 else 61

    def triples(text):
        line = [0, 0, *map(kind, text.lower()), 0]
        return [(line[i], line[i + 1], line[i + 2]) for i in range(len(line) - 2)]

    for _, t, lang, _, _ in texts:
        if lang in runs:
            own = defaultdict(int)
            for g in triples(t or ""):
                own[g] += 1
            for g, n in own.items():
                if g[1:] != (0, 0):
                    weight = round(16 * math.log2(1 + n)) / 16
                    runs[lang][g] += weight
                    most[lang][g] = max(most[lang][g], weight)
    for k, v in runs.items():
        for g in v:
            v[g] -= most[k][g]
    sums = {k: [defaultdict(float) for _ in range(4)] for k in runs}
    for k, v in runs.items():
        for (a, b, c), n in v.items():
            for table, at in zip(sums[k], ((), (b,), (a, b), (c,)), strict=True):
                table[at] += n
        sums[k].append(defaultdict(float))
        for (_, b, c), n in v.items():
            sums[k][4][(b, c)] += n

    def gain(k, g):
        a, b, c = g
        if b == c == 0:
            return 0.0
        base = 1 / 6 if c == 0 else 1 / 36
        every, by_b, by_ab, only_c, bc = sums[k]
        p = (only_c[(c,)] + 20000 * base) / (every[()] + 20000)
        p = (bc[(b, c)] + 64 * p) / (by_b[(b,)] + 64)
        n = sum(r[2] == k for r in texts)
        return math.log(0.8 * (runs[k][g] + 64 * p) / (by_ab[(a, b)] + 64) / base + 0.2) * n / (n + 500)

    seen = []
    for d, t, lang, source, _ in texts:
        words_only, n = language_id.text_evidence([t or ""])
        marks = sum(map((t or "").lower().count, "".join(language_id.LETTERS.values())))
        temper = 40 / (40 + n[0] + marks)
        chars = [0.3 * sum(gain(k, g) for g in triples(t or "")) * temper * bool(n[0]) for k in runs]
        seen.append((d, [x + y for x, y in zip(words_only[0], [*chars, 0.0], strict=True)], n[0], lang, source or ""))
    hosts, every = defaultdict(lambda: [0.0] * 5), [0.0] * 5
    for _, ll, n, _, host in seen:
        if n:
            top = max(ll)
            raised = [math.exp(x - top) for x in ll]
            for j, x in enumerate(raised):
                hosts[host][j] += x / sum(raised)
                every[j] += x / sum(raised)
    want = {}
    for d, ll, n, lang, host in seen:
        q = []
        for j, k in enumerate(names):
            middle = (every[j] + 50 * (every[j] + 1) / (sum(every) + 5)) / (sum(every) + 50)  # no host has a suffix: one group
            prior = (hosts[host][j] + 20 * middle) / (sum(hosts[host]) + 20)
            said = 1.0 if lang is None else (0.125 if lang in runs else 0.5) if k == "und" else 0.9 if lang == k else 0.025
            q.append(ll[j] + math.log(prior) + math.log(said))
        share = 1 / sum(math.exp(x - max(q)) for x in q)
        best = names[q.index(max(q))] if n else "und"
        want[d] = (best, share, lang, n, best != "und" and share >= 0.5)
    got = {r.key: r for r in language_id.identify_documents(docs).collect()}
    assert set(got) == set(want)
    for d, (best, share, lang, n, accepted) in want.items():
        r = got[d]
        assert (r.lang, r.declared, r.n_words, r.accepted) == (best, lang, n, accepted) and r.confidence == pytest.approx(share, rel=1e-4), d


def test_characters_tell_texts_without_common_words(spark):
    """Rows of made-up words, declared by some: the others are told from letters alone, those of no language are not."""
    rng = random.Random(9)
    parts = {"en": ["th", "er", "ing", "wh", "sh", "ed"], "de": ["sch", "ung", "pf", "ich", "keit", "tz"], "fr": ["eau", "ou", "ai", "oi", "eux", "que"]}
    line = lambda own: " | ".join("".join(rng.choice(own) for _ in range(3)) for _ in range(60))
    rows = [(i, line(parts[k]), k, None) for k, at in (("en", 0), ("de", 200), ("fr", 400)) for i in range(at, at + 150)]
    rows += [(i, line(parts[k]), None, None) for k, at in (("en", 1000), ("de", 1200), ("fr", 1400)) for i in range(at, at + 20)]
    rows += [(2000, line(["xq", "vj", "kz", "wx"]), None, None), (2001, None, "en", None), (2001, None, "en", None), (None, line(parts["de"]), None, None)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.key: r.lang for r in language_id.identify_documents(data).collect()}
    assert [got[i] for i in (*range(1000, 1020), *range(1200, 1220), *range(1400, 1420))] == ["en"] * 20 + ["de"] * 20 + ["fr"] * 20
    assert got[2000] == "und" and got[2001] == "und" and got[None] == "de"
    few = {r.key: r.lang for r in language_id.identify_documents(data, fit_rows=300).collect()}
    assert sum(few[k] == got[k] for k in got) >= 0.95 * len(got)
    nobody = language_id.identify_documents(data.withColumn("lang", data.lang.substr(9, 1))).collect()
    assert len(nobody) == len(rows) and {r.lang for r in nobody if r.key == 2001} == {"und"}


@pytest.mark.parametrize("step", [1, 2, 3, 7])
def test_blocks_of_a_text_hold_the_same_runs(step, monkeypatch):
    for text in ("", "a", "ab", "the été der 漢字 x😀y", "abc" * 5):
        whole = [int(x) for b in language_id.grams(text) for x in b]
        with monkeypatch.context() as m:
            m.setattr(language_id, "STEP", step)
            assert [int(x) for b in language_id.grams(text) for x in b] == whole and len(whole) == len(text) + 1


def test_lm_scores(docs, clashing, none, texts):
    import math
    from collections import Counter

    tokens = {r[0]: words((r[1] or "").translate(LOW)) + [None] for r in texts}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    counts = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    n, v = sum(counts.values()), len(counts)
    scores = []
    for frequent in (1 << 17, 20):
        got = {r.doc_id: r for r in lm.score(docs, frequent=frequent).collect()}
        for d, t in tokens.items():
            r = got[d]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(counts[w] > 0 for w in t), n)
            assert abs(r.base_score - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) < 1e-6 * len(t)
            assert r.score < 0
        scores.append({d: r.score for d, r in got.items()})
    # a word is scored alike in and out of the words that are broadcast, and wherever its row lies
    scores.append({r.doc_id: r.score for r in lm.score(docs.repartition(7)).collect()})
    assert all(abs(s[d] - scores[0][d]) < 1e-4 * len(t) for s in scores for d, t in tokens.items())
    assert lm.score(clashing).count() == len(texts)
    assert lm.score(none).count() == 0


def test_lm_scores_of_null_ids_repeats_and_ties(spark):
    rows = [(None, "a b c", "en"), (None, None, None), (3, "a b c", "en"), (3, "a b c", "en"), (4, "c b a", "en")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 4, 4, 4, 4]
    same = [r for r in got if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]


def test_lm_learns_what_context_tells(spark):
    """Documents keep to one of two vocabularies; words before tell which."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.choice('klmnop')}{rng.choice('aeiou')}" for _ in range(60)), "xy"[i % 2]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    out = lm.score(d, epochs=5).where("held_out").collect()
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.2


def test_lm_predicts_words_from_context(spark):
    """One language, so no table of counts tells more than another: only the words before tell the next."""
    cycle = ["remembering", "rememberable", "unremembered", "forgettable", "forgetting", "unforgotten"]
    rows = [(i, " ".join(cycle[(i + j) % 6] for j in range(60)), "xy") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    out = lm.score(d, epochs=8).where("held_out").collect()
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.3


def test_all_subwords_of_words():
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = lm.vocabulary_path()
    made, own = lm.coder(path), Tokenizer.from_file(path)
    texts = ["The Unrememberingly \u00e9t\u00e9 \x01b", "", None, "zz\tunrememberingly"]
    ids, size, n = made(pa.array(texts))
    want = [own.encode(" " + w, add_special_tokens=False).ids for w in ("the", "unrememberingly", "\u00e9t\u00e9")]
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])][:3] == want and len(want[1]) > 1
    assert n.tolist() == [5, 1, 1, 3] and size.sum() == len(ids) and (ids == made.end).sum() == 4 and made.begins[ids].sum() == 10
    ends = np.cumsum(size)[np.cumsum(n) - 1]
    packed = pa.array([p.astype(made.kind).tobytes() for p in np.split(ids, ends[:-1])], pa.binary())
    for a, b in zip((ids, size, n), lm.unpacked(packed, made), strict=True):
        assert a.tolist() == b.tolist()
    h = lm.token_hashes(ids, size)
    assert h[1] == h[-2] and len(set(h.tolist())) == 6


def small_lexicon(seed=0, n=40):
    """A vocabulary of ``n`` subwords, the last a text's end; every third one and the end begin tokens."""
    import numpy as np

    rng = np.random.default_rng(seed)
    begins = np.arange(n) % 3 == 0
    begins[-1] = True
    counts = rng.integers(0, 50, (n, lm.SLOTS)).astype(float)
    firsts = np.where(begins[:, None], counts, 0)
    return lm.Lexicon(counts, firsts, np.minimum(firsts, 3), begins), begins


def some_tokens(begins, n_tokens, seed=1):
    """Ids and sizes of tokens, the last one a text's end."""
    import numpy as np

    rng = np.random.default_rng(seed)
    size = rng.integers(1, 13, n_tokens)
    size[-1] = 1
    ids = np.flatnonzero(~begins)[rng.integers(0, (~begins).sum(), size.sum())]
    first = np.cumsum(size) - size
    ids[first] = np.flatnonzero(begins)[rng.integers(0, begins.sum() - 1, n_tokens)]
    ids[-1] = len(begins) - 1
    return ids, size


def plain_attention(p, x):
    """What each place knows and its logits, one place at a time in double precision."""
    import numpy as np

    x = x + p["pos"][: len(x)]
    out = []
    for t in range(len(x)):
        weights = np.array([x[t] @ p["match"] @ x[s] for s in range(t + 1)])
        weights = np.exp(weights - weights.max())
        c = (weights / weights.sum()) @ x[: t + 1]
        out.append((c @ p["value"] + x[t]) @ p["out"] + p["bias"])
    return np.array(out)


def softmax(z):
    import numpy as np

    e = np.exp(z - z.max())
    return e / e.sum()


def test_scores_equal_a_plain_loop():
    """Chances of a text's tokens by the outer and the inner model, window by window and place by place."""
    import numpy as np

    words_, begins = small_lexicon()
    ids, size = some_tokens(begins, 70)
    outer, inner = lm.Outer(words_), lm.Inner(words_)
    p = {k: v.astype(float) for k, v in outer.p.items()}
    tokens = np.split(ids, np.cumsum(size)[:-1])
    vectors = [p["emb"][-1], *[np.mean([p["emb"][words_.bins[i]] for i in t], axis=0) for t in tokens]]
    got = outer.score(ids, size, np.array([len(tokens)]))
    begin = 0
    for place in range(len(tokens)):
        while place - begin >= lm.WIDTH:
            begin += lm.STRIDE
        z = plain_attention(p, np.array(vectors[begin : place + 1]))[-1]
        shares, f = softmax(z[outer.classes :]), tokens[place][0]
        own = softmax(z[: outer.classes])[words_.classes[0][f]] * np.exp(words_.share[0][f])
        assert np.allclose(got[place], shares * np.append(words_.first[f], own), rtol=1e-3, atol=1e-9)
    p = {k: v.astype(float) for k, v in inner.p.items()}
    for token, got in zip(tokens, inner.score(ids, size), strict=True):
        log, begin = 0.0, 0
        for place in range(len(token) if token[0] != len(begins) - 1 else 0):
            while place - begin >= lm.INNER_WIDTH:
                begin += lm.INNER_STRIDE
            z = plain_attention(p, np.array([p["emb"][words_.bins[i]] for i in token[begin : place + 1]]))[-1]
            follow = token[place + 1] if place + 1 < len(token) else len(begins)
            log += np.log(softmax(z)[words_.classes[1][follow]]) + words_.share[1][follow]
        assert abs(log - got) < 1e-3 * max(1, len(token))


def test_chances_of_all_subwords_are_one():
    import numpy as np

    words_, begins = small_lexicon()
    for kind, own in ((0, begins), (1, np.append(~begins, True))):
        mass = np.bincount(words_.classes[kind][own], np.exp(words_.share[kind][own]))
        assert np.allclose(mass, 1) and len(mass) == words_.n_classes[kind]
    assert np.allclose(words_.first[begins].sum(axis=0), 1) and (words_.first[~begins] == 0).all()
    heavy = lm.equal_masses(np.array([100.0, 1, 1, 1, 1]), np.zeros(5, int), np.zeros(5, int), 4)
    assert (heavy[1:] != heavy[0]).all()


def test_gradients_of_the_models():
    import numpy as np

    words_, begins = small_lexicon()
    rng = np.random.default_rng(3)
    for model, t, shares in ((lm.Outer(words_), lm.WIDTH, lm.SLOTS + 1), (lm.Inner(words_), 5, 0)):
        model.p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in model.p.items()}
        x = rng.standard_normal((3, t, lm.DIM)) * 0.5
        target, weight = rng.integers(0, model.classes, 3 * t), rng.random(3 * t)
        chances = rng.random((3 * t, shares)) if shares else None

        def value(model=model, x=x, target=target, weight=weight, chances=chances):
            e, sums, _ = model.forward(x)
            logs = np.log(e[np.arange(len(e)), target] / sums[:, 0])
            if chances is not None:
                logs += np.log((e[:, model.classes :] * chances).sum(axis=1) / sums[:, 1])
            return (logs * weight).sum()

        e, sums, known = model.forward(x)
        grad, dx = model.backward(known, model.logits(e, sums, target, weight, chances))
        for name, whole in [*grad.items(), ("x", dx)]:
            array = x if name == "x" else model.p[name]
            place = tuple(rng.integers(0, min(s, t) if name == "pos" else s) for s in whole.shape)
            keep = array[place]
            array[place] = keep + 1e-5
            above = value()
            array[place] = keep - 1e-5
            below = value()
            array[place] = keep
            assert abs((above - below) / 2e-5 - whole[place]) < 1e-5 + 1e-3 * abs(whole[place]), name


def test_every_token_is_scored_once_and_learnt_from_once():
    import numpy as np

    words_, _ = small_lexicon()
    n = np.array([1, 5, 23, 24, 25, 42, 43, 300])
    for stride in (lm.STRIDE, lm.WIDTH):
        token, before, scored = lm.Outer(words_).places(n, stride)
        assert sorted(token[scored].tolist()) == list(range(n.sum()))
        starts = np.cumsum(n) - n
        assert ((before == -1) == np.isin(token, starts)).all() and (before[before >= 0] == (token - 1)[before >= 0]).all()
        assert ((np.arange(lm.WIDTH) >= lm.WIDTH - stride) | (before[:, :1] == -1))[scored].all()


def test_chunks_do_not_depend_on_batches():
    import pyarrow as pa

    rows = [(c, i) for c, n in ((0, 5), (3, 1), (4, 9), (6, 4)) for i in range(n)]
    want = None
    for step in (1, 2, 5, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[a : a + step]]) for j in (0, 1)], ["chunk", "x"]) for a in range(0, len(rows), step)]
        got = [(c, t.column(1).to_pylist()) for c, t in lm._runs(batches, 4)]
        want = want or got
        assert got == want
    assert [(c, len(x)) for c, x in want] == [(0, 4), (0, 1), (3, 1), (4, 4), (4, 4), (4, 1), (6, 4)]


def test_lm_vectors_of_tokens_are_means_of_their_subwords():
    import types

    import numpy as np

    rng = np.random.default_rng(7)
    size = np.r_[rng.integers(1, 5, 40), 300, 1]
    bins = rng.integers(0, 9, int(size.sum()))
    model = types.SimpleNamespace(p={"emb": rng.normal(size=(10, lm.DIM)).astype(np.float32)})
    for sizes in (size, size[:0], np.array([40_000, 2])):  # beyond 16 bits too
        own = np.resize(bins, int(sizes.sum()))
        want = [model.p["emb"][part].mean(axis=0) for part in np.split(own, np.cumsum(sizes)[:-1]) if len(part)]
        got = lm.Outer.vectors(model, own, sizes)
        assert got.shape == (len(sizes) + 1, lm.DIM) and np.allclose(got[-1], model.p["emb"][-1])
        assert not len(sizes) or np.allclose(got[:-1], want, atol=2e-4)


def test_lm_computes_only_the_places_it_scores(monkeypatch):
    import numpy as np

    words_, begins = small_lexicon()
    ids, size = some_tokens(begins, 24 + 18 * 9)
    made, forward = [], lm.Outer.forward

    def counted(self, x, *more):
        e, *rest = forward(self, x, *more)
        made.append(len(e))
        return e, *rest

    monkeypatch.setattr(lm.Outer, "forward", counted)
    assert len(lm.Outer(words_).score(ids, size, np.array([len(size)]))) == sum(made) == len(size)


def test_lm_finds_common_words_by_their_first_bits():
    import numpy as np

    rng = np.random.default_rng(4)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    spread = rng.integers(low, high, 500)
    for known in (spread[:0], spread, np.r_[low, np.arange(-3, 90), high], np.array([7])):
        known = np.unique(known)
        asked = np.r_[known, known[known < high] + 1, spread, low, 0, high]
        at, there = lm.Found(known, bits=6)(asked)
        assert (there == np.isin(asked, known)).all() and (known[at[there]] == asked[there]).all()


def test_lm_encodes_alike_in_batches_of_any_size():
    import pyarrow as pa

    made = lm.Coder(lm.vocabulary_path())
    texts = ["One two,\tone", None, "", " TWO  one\n", "été one\x0btwo, x\x01y"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    want = [[x.tolist() for x in made(pa.array([t], pa.string()))] for t in texts]
    for step, most in ((1, 1 << 20), (2, 1), (15, 1 << 20)):
        ids, size, n = [], [], []
        for b in lm._joined((batch.slice(i, step) for i in range(0, len(texts), step)), most):
            for kept, x in zip((ids, size, n), made(b.column(0)), strict=True):
                kept += x.tolist()
        assert [ids, size, n] == [sum((w[k] for w in want), []) for k in range(3)]
