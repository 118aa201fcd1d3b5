"""URL reputation, SimHash, decontamination, line dedup and the pipeline against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tracelake.llm import components, decontamination, line_dedup, simhash, url_reputation

SF = "/root/testdata/sf0.001"


def docs(spark, texts):
    rows = [(i, t, "x", 5, "y") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, kept_id string, cut_id int, node string")


# URLs.


def test_hosts_paths_rules(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/7x?q#f", "x://y://z", "ftp://example.net", "http://b.net/de/9", "http://example.net/de/81", "http://net/de/", "http://o.org/es/1", "http://xcom/en/", "http://É.com/en/", "http://a.com?x/en/", "http://deep.example.com/en/8"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, good int")
    rows = {r["page_id"]: r for r in url_reputation.judge(pages, none).collect()}
    got = [(rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) for i in range(len(urls))]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("y:", "//z", None, "allow"), ("example.net", "", None, "allow"),
        ("b.net", "/de/9", "net/de/", "allow"), ("example.net", "/de/81", "example.net/de/8", "block"), ("net", "/de/", "net/de/", "allow"), ("o.org", "/es/1", "org/es/", "block"),
        ("xcom", "/en/", None, "allow"), ("É.com", "/en/", "com/en/", "block"), ("a.com", "", None, "allow"), ("deep.example.com", "/en/8", "com/en/", "block"),
    ]
    assert url_reputation.judge(pages.limit(0), none).count() == 0


def test_shrinkage(spark):
    """A host with many bad outcomes is blocked; one with a single bad outcome is not; a new host takes its domain's view."""
    urls, good = [], []
    for host, n_bad, n_good in (("bad.a.com", 60, 0), ("one.b.com", 1, 0), *((f"h{i}.c{i % 7}.com", 1, 9) for i in range(60)), ("z.co.uk", 0, 5)):
        urls += [f"http://{host}/p"] * (n_bad + n_good)
        good += [0] * n_bad + [1] * n_good
    urls += ["http://new.a.com/", "http://new.c1.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([*enumerate(good), (None, 1), (3, None)], "page_id long, good int")
    rep = {r["host"]: r for r in url_reputation.reputations(pages, outcomes).collect()}
    assert rep["bad.a.com"]["upper"] < 0.5 < rep["one.b.com"]["upper"]
    assert rep["new.a.com"]["posterior_mean"] < rep["new.c1.com"]["posterior_mean"]
    assert rep["bad.a.com"]["n"] == 60 and rep["new.a.com"]["n"] == 0
    verdicts = {r["host"]: r["verdict"] for r in url_reputation.judge(pages, outcomes).collect()}
    assert verdicts["bad.a.com"] == "block" and verdicts["one.b.com"] == "allow"


# Components and SimHash.


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    low = {n: n for e in edges for n in e}
    for _ in range(len(low)):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in low.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    pieces = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def variants(r, base, n, changes):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(r.randrange(changes + 1)):
            words[r.randrange(len(words))] = "w%d" % r.randrange(10**6)
        out.append(" ".join(words))
    return out


def test_simhash_against_brute_force(spark):
    r = random.Random(1)
    bases = [" ".join("w%d" % r.randrange(5000) for _ in range(300)) for _ in range(4)]
    texts = [None, "", " \n", "one", "ONE", "one two", "É é", "x" * 100_000] + [t for b in bases for t in variants(r, b, 25, 3)] + ["common words here " * 40] * 30
    r.shuffle(texts)
    prints = [brute_fingerprint(t) for t in texts]
    low = list(range(len(texts)))
    for _ in range(20):
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    low[i] = low[j] = min(low[i], low[j])
    rows = simhash.duplicates(docs(spark, texts)).collect()
    assert [(x["fingerprint"], x["component_id"]) for x in sorted(rows, key=lambda x: x["doc_id"])] == [(f"{p:016x}", c) for p, c in zip(prints, low, strict=True)]
    assert simhash.duplicates(docs(spark, [])).count() == 0


def test_simhash_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, None)], "doc_id long, text string")
    got = sorted(((x["doc_id"], x["component_id"]) for x in simhash.duplicates(rows).collect()), key=str)
    assert got == [(3, 3), (5, 5), (5, 5), (None, 5)]


@pytest.mark.parametrize("n", [2, 40, 700])
def test_spanning_links_connect_all(n):
    """Small groups by comparison, large ones by lookup: the same components."""
    r = random.Random(n)
    mask = simhash.block_masks(2)[0]
    free = [i for i in range(64) if not mask >> i & 1]
    x = {0}
    while len(x) < n:
        v = r.choice(sorted(x)) if r.random() < 0.9 else 0
        for _ in range(r.choice([1, 2, 3])):
            v ^= 1 << r.choice(free)
        x.add(v)
    x = np.array(sorted(x), dtype=np.uint64)

    def roots(links):
        low = list(range(len(x)))

        def find(i):
            while low[i] != i:
                i = low[i]
            return i

        for a, b in links:
            low[find(a)] = find(b)
        return [find(i) for i in range(len(x))]

    close = [(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2).tolist()]
    links = simhash.spanning_links(x, 2, mask)
    assert all(np.bitwise_count(x[a] ^ x[b]) <= 2 for a, b in links) and len(links) < len(x)
    a, b = roots(close), roots(links)
    assert len(set(a)) == len(set(b)) == len(set(zip(a, b, strict=True)))


def test_masks_lose_no_pair():
    masks = simhash.block_masks(2)
    for i in range(64):
        for j in range(i + 1):
            flip = 1 << i | 1 << j
            assert any(not m & flip for m in masks)
    assert min(m.bit_count() for m in masks) >= 40


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 65, 254, 255, 256, 1000, 20_000])
def test_majorities(n):
    x = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    x[: n // 2] |= np.uint64(0xFF)
    x[: n // 2 + 1] |= np.uint64(0xFF00)
    want = sum(1 << i for i in range(64) if 2 * int(((x >> np.uint64(i)) & np.uint64(1)).sum()) > n)
    assert simhash._majority(x) == want
    assert n == 0 or simhash.wide_fingerprint(x, 3)[0] != 0


def jaccard(a, b, k=5):
    s = [{tuple(t.lower().split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_duplicates_at_the_wanted_similarity(spark):
    r = random.Random(7)
    clean = [" ".join("w%d" % r.randrange(10**5) for _ in range(r.randrange(20, 400))) for _ in range(60)]
    near = [t for i in range(30) for t in [clean[i], *variants(r, clean[i], 1, max(1, len(clean[i].split()) // 80))]]
    texts = dict(enumerate([*near, *clean[30:], clean[0], "", " "]))
    out = simhash.keep_one_of_each(docs(spark, texts))
    kept = {x["doc_id"] for x in out.collect()}
    assert out.columns == ["doc_id", "text", "kept_id", "cut_id", "node"]
    assert set(range(60, 90)) <= kept and 90 not in kept and len(kept & {91, 92}) == 1
    for i in range(30):
        j = jaccard(texts[2 * i], texts[2 * i + 1])
        pair = kept & {2 * i, 2 * i + 1}
        assert 2 * i in pair
        if j >= 0.84:
            assert pair == {2 * i}
        if j <= 0.7:
            assert len(pair) == 2


def test_near_duplicates_go_by_text_and_not_by_id(spark):
    r = random.Random(23)
    a, b = (" ".join("w%d" % r.randrange(10**6) for _ in range(200)) for _ in range(2))
    near = a + " more"

    def kept(rows, kind="long"):
        return sorted((str(x["doc_id"]), x["text"]) for x in simhash.keep_one_of_each(spark.createDataFrame(rows, f"doc_id {kind}, text string, __text string, node int")).collect())

    add = lambda rows: [(*x, "clash", 1) for x in rows]
    assert kept(add([(5, a), (5, b), (6, a), (7, b)])) == sorted([("5", a), ("5", b)])
    assert kept(add([(5, a), (5, b), (6, near)])) == sorted([("5", a), ("5", b)])
    assert kept(add([(None, a), (None, a), (None, b), (3, near), (3, near)])) == sorted([("3", near), ("None", b)])
    assert kept(add([("x", a), ("b", near), (None, None), ("q", ""), ("p", " ")]), "string") == [("b", near), ("p", " ")]
    assert kept(add([(None, "a"), (None, "a"), (1, "a"), (1, "a")])) == [("1", "a")]
    assert kept([]) == []


def brute_groups(texts, similarity=0.8):
    """The smallest number of each text's group, by comparing all pairs."""
    low = list(range(len(texts)))
    split = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    for _ in range(len(texts)):
        old = list(low)
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
        if low == old:
            return low, near


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 4])
def test_near_duplicates_against_all_pairs(spark, group_rows):
    """Families of texts around the limit: no link below it, and at most 2 % of those above it are lost; also where keys are split."""
    r = random.Random(29)
    texts = []
    for n in (12, 60, 70, 150, 300, 900):
        for _ in range(4):
            base = " ".join("w%d" % r.randrange(10**6) for _ in range(n))
            texts += [base, *(t for k in (n // 120 + 1, n // 60 + 1, n // 40 + 1) for t in variants(r, base, 5, k))]
    low, near = brute_groups(texts)
    got = {x["doc_id"]: x["similar"] for x in simhash.similar_groups(docs(spark, texts), group_rows=group_rows).collect()}
    same = {}
    for i, g in got.items():
        same.setdefault(g, set()).add(low[i])
    assert all(len(v) == 1 for v in same.values())
    assert len(near) > 300 and sum(got[i] == got[j] for i, j in near) >= 0.98 * len(near)


@pytest.mark.parametrize("texts", [10, 10**6, 10**10])
def test_tables_grow_with_the_corpus(texts):
    """The chance that a pair at the limit shares no table stays at some 1 %, and a key holds few unrelated texts."""
    t = simhash.Tables.fit(texts, 0.8)
    r = np.random.default_rng(1)
    flips = np.packbits((r.random((400, simhash.BLOCKS * t.half)) < simhash.differing_share(0.8)).astype(np.uint8), axis=1)
    assert (t.first_shared(flips) >= 0).mean() > 0.97 and texts / 4**t.half <= 4 and t.size * 64 == simhash.BLOCKS * t.half
    assert (np.bitwise_count(flips.view(np.uint64)).sum(axis=1) <= t.limit).all()


def test_shingle_sets():
    """Equal sets exactly where the texts' sets of shingles are equal."""
    r = random.Random(3)
    texts = [" ".join(r.choice("aBcd") for _ in range(r.randrange(9))) + r.choice(["", " ", "\n\t"]) for _ in range(300)] + [None, "", "  a", "É É"]
    def plain(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()
    pairs = [(plain(t), s.tobytes()) for t, s in zip(texts, simhash.shingle_sets(pa.array(texts), 3), strict=True)]
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(set(pairs)) and all(len(a) * 8 == len(b) for a, b in pairs)


def test_near_duplicates_are_verified_exactly(spark):
    r = random.Random(17)
    say = lambda n: ["w%d" % r.randrange(10**7) for _ in range(n)]
    texts, pairs = [], []
    for n, more in [(8, 1), (9, 1), (10, 1), (7, 1), (84, 20), (84, 21), (304, 75), (304, 76), (404, 100), (404, 101)] * 6:
        a = say(n)
        pairs.append((n - 4) / (n - 4 + more) >= 0.8)  # n - 4 shingles against those and ``more``
        texts += [" ".join(a), " ".join(a + say(more))]
    kept = {x["doc_id"] for x in simhash.keep_one_of_each(docs(spark, texts)).collect()}
    assert [(2 * i in kept, 2 * i + 1 in kept) for i in range(len(pairs))] == [(True, not p) for p in pairs]


# Decontamination.

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(texts, items, size=10):
    out = {}
    wins = {i: {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} for i, t in items.items() if (w := WORD.findall(ascii_lower(t)))}
    for d, t in texts.items():
        w = WORD.findall(ascii_lower(t))
        hit, found = set(), set()
        for i, windows in wins.items():
            for win in windows:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("limit", [100_000, 0])
def test_decontamination_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", limit)
    r = random.Random(9)
    say = lambda n, v: " ".join(r.choice(["the", "of", f"w{r.randrange(v)}", "É", "a1"]) + r.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = {i: say(r.choice([1, 2, 3, 5, 9, 10, 11, 25]), 30) for i in range(25)} | {90: "", 91: None, 92: "!!", 93: "the"}
    texts = {i: say(r.randrange(0, 80), 30) for i in range(40)} | {50: None, 51: "", 52: "a b"}
    for i in range(40, 50):
        parts = say(60, 30).split(" ")
        parts.insert(r.randrange(60), (items[r.randrange(25)] or "").upper())
        texts[i] = " ".join(parts)
    bench = spark.createDataFrame([*items.items(), (None, "the")], "item_id long, text string")
    rows = decontamination.hits(docs(spark, texts), bench).withColumn("n_hit", decontamination.covered(F.col("spans")))
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["items"]) for x in rows.collect()}
    want = brute_hits(texts, items)
    assert got == want
    kept = decontamination.clean(docs(spark, texts), bench)
    assert {x["doc_id"] for x in kept.collect()} == {d for d, v in want.items() if not v[1]}


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = spark.createDataFrame([(None, "ALPHA beta-gamma"), (1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "none")], "doc_id long, text string")
    got = sorted(str((x["doc_id"], len(x["spans"]))) for x in decontamination.hits(rows, bench).collect())
    assert got == ["(1, 0)", "(1, 1)", "(1, 1)", "(None, 1)"]
    assert decontamination.hits(rows, bench.limit(0)).count() == 4
    clash = rows.withColumns({"spans": F.lit(1), "items": F.lit("x"), "same": F.lit(2), "found_id": F.lit(3)})
    assert decontamination.hits(clash, bench).count() == 4 and decontamination.clean(clash, bench).columns == clash.columns
    assert decontamination.hits(rows.limit(0), bench).count() == 0


def test_decontamination_cleans_rows_without_an_id(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = spark.createDataFrame([(None, "so ALPHA beta-gamma"), (None, "none"), (None, None), (1, "alpha beta gamma"), (1, "none"), (2, None)], "doc_id long, text string")
    got = sorted(str((x["doc_id"], x["text"])) for x in decontamination.clean(rows, bench).collect())
    assert got == ["(1, 'none')", "(2, None)", "(None, 'none')", "(None, None)"]


def test_decontamination_plan_is_native(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plan = decontamination.hits(d, spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


# Lines.


def lines_of(r, n, words=9):
    return [" ".join("w%d" % r.randrange(10**6) for _ in range(words)) for _ in range(n)]


def test_line_dedup(spark):
    r = random.Random(4)
    passage = lines_of(r, 6)
    own = {i: lines_of(r, 8) for i in range(6)}
    short = ["nine words that everyone has in every text here"]
    texts = {
        0: own[0][:4] + passage + own[0][4:],
        1: own[1][:2] + passage + own[1][2:] + short,
        2: passage[:3] + own[2] + passage[3:] + short,  # moved and cut: 27 words each side stay
        3: passage + own[3] + passage,  # twice
        4: [" " + x + "\t" for x in own[0][:4] + passage + own[0][4:]],  # a copy
        5: own[5] + [""] + passage[:4] + ["", *passage[4:]] + short,
    }
    rows = {x["doc_id"]: x for x in line_dedup.dedup(docs(spark, {k: "\n".join(v) for k, v in texts.items()} | {9: None, 10: "", 11: "\n\n"})).collect()}
    assert rows[0]["deleted_spans"] is None and rows[0]["text"] == "\n".join(texts[0])
    assert rows[1]["text"] == "\n".join(own[1] + short) and rows[1]["copied_from"] == [0]
    assert rows[2]["deleted_spans"] is None
    assert rows[3]["text"] == "\n".join(own[3])
    assert rows[4]["text"] == "" and rows[4]["copied_from"] == [0]
    assert rows[5]["text"].split("\n")[:8] == own[5] and rows[5]["text"].endswith(short[0]) and passage[0] not in rows[5]["text"]
    assert [rows[i]["text"] for i in (9, 10, 11)] == [None, "", "\n\n"]
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def brute_blocks(a, b, words, least):
    """Every line of b that lies in some run equal to a run of a with enough words."""
    inside = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(words[j : j + n]) >= least:
                inside |= set(range(j, j + n))
    return inside


@pytest.mark.parametrize("seed", range(40))
def test_blocks_are_common_and_long(seed):
    r = random.Random(seed)
    a = np.array([r.randrange(1, 1000) for _ in range(30)])
    parts = []
    for _ in range(4):
        if r.random() < 0.6:
            i = r.randrange(25)
            parts += a[i : i + r.randrange(1, 6)].tolist()
        parts += [r.randrange(2000, 9000) for _ in range(r.randrange(4))]
    b = np.array(parts or [1])
    words = np.full(len(b), 10)
    spans = line_dedup.common_blocks(a, b, words, 30)
    covered = {j for x, y in spans for j in range(x, y)}
    assert sum(y - x for x, y in spans) == len(covered)
    assert covered <= brute_blocks(a.tolist(), b.tolist(), words.tolist(), 30)
    text = b.tolist()
    for x, y in spans:
        assert (y - x) * 10 >= 30 and any(a[i : i + y - x].tolist() == text[x:y] for i in range(len(a)))
    if len(set(a.tolist())) == len(a):
        assert covered == brute_blocks(a.tolist(), b.tolist(), words.tolist(), 30)


def test_long_documents_are_aligned_in_parts(spark, monkeypatch):
    r = random.Random(8)
    passage = lines_of(r, 10)
    texts = {i: lines_of(r, 300) for i in range(3)}
    texts[1][125:125] = passage
    texts[2][250:250] = passage
    rows = {x["doc_id"]: x for x in line_dedup.dedup(docs(spark, {k: "\n".join(v) for k, v in texts.items()})).collect()}
    assert rows[1]["deleted_spans"] is None and not any(p in rows[2]["text"] for p in passage) and len(rows[2]["text"].split("\n")) == 300


def test_later_holders_of_a_passage_are_aligned(spark):
    r = random.Random(11)
    x, y = lines_of(r, 2, 20)
    own = {i: lines_of(r, 4, 12) for i in range(1, 5)}
    texts = {1: [x, *own[1]], 2: [y, *own[2]], 3: [*own[3], x, y], 4: [x, y, *own[4]]}
    rows = {k["doc_id"]: k for k in line_dedup.dedup(docs(spark, {k: "\n".join(v) for k, v in texts.items()})).collect()}
    assert [rows[i]["deleted_spans"] for i in (1, 2, 3)] == [None] * 3
    assert rows[4]["text"] == "\n".join(own[4]) and rows[4]["copied_from"] == [3]


def test_passages_in_short_lines(spark):
    r = random.Random(13)
    verse = [x for line in lines_of(r, 30, 3) for x in (line, "")]
    items = [lines_of(r, 1, 1)[0] for _ in range(400)]
    leads = lines_of(r, 1, 9)
    texts = {1: verse, 2: verse, 3: items[:200] + leads + items[200:], 4: ["own", *items[:200], *leads, *items[200:]]}
    rows = {k["doc_id"]: k for k in line_dedup.dedup(docs(spark, {k: "\n".join(v) for k, v in texts.items()})).collect()}
    assert [rows[i]["deleted_spans"] for i in (1, 3)] == [None] * 2
    assert rows[2]["text"].strip() == "" and rows[4]["text"] == "own"


def test_no_long_common_block_is_lost(spark):
    r = random.Random(12)
    pool = [(" ".join(f"p{i}" for _ in range(i % 17)), i % 17) for i in range(24)]
    texts = {d: [pool[r.randrange(24)] for _ in range(r.randrange(1, 14))] for d in range(60)}
    for d in range(20, 60):
        other = texts[r.randrange(d)]
        texts[d][2:2] = other[: r.randrange(9)]
    rows = {k["doc_id"]: k for k in line_dedup.dedup(docs(spark, {k: "\n".join(x for x, _ in v) for k, v in texts.items()})).collect()}
    for d, v in texts.items():
        b, words = [x for x, _ in v], [n for _, n in v]
        want = set().union(*(brute_blocks([x for x, _ in texts[e]], b, words, 30) for e in range(d)))
        got = {i for s in rows[d]["deleted_spans"] or [] for i in range(s["start"], s["stop"])}
        assert {i for i in want if words[i]} <= got <= want


def test_texts_that_share_an_id_lose_their_own_lines_only(spark):
    r = random.Random(16)
    passage, own = lines_of(r, 6), lines_of(r, 6)
    rows = [(1, "\n".join(passage)), (2, "\n".join([*own, *passage])), (2, "\n".join([*passage, *own])), (2, "\n".join([*passage, *own])), (None, "\n".join(passage))]
    got = sorted((str(x["doc_id"]), x["text"]) for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", "\n".join(passage)), *[("2", "\n".join(own))] * 3, ("None", "\n".join(passage))])


def test_clean_keeps_columns(spark):
    r = random.Random(6)
    text = "\n".join(lines_of(r, 6))
    rows = spark.createDataFrame([(1, text, 7, "clash"), (2, text, 7, "clash"), (3, "own\n" + text, 7, "clash"), (4, None, 7, "clash")], "doc_id long, text string, n_chars long, copied_from string")
    out = line_dedup.clean(rows)
    assert out.dtypes == rows.select(*out.columns).dtypes and set(out.columns) == {"doc_id", "text", "n_chars", "copied_from"}
    assert {x["doc_id"]: (x["text"], x["n_chars"]) for x in out.collect()} == {1: (text, len(text)), 3: ("own", 3), 4: (None, None)}


# Pipeline.


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns = d.columns
    sizes = [d.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near duplicates", "benchmark decontamination", "best-fit packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = d
        path = str(tmp_path / str(i))
        stage(spark, d, SF).write.parquet(path)
        d = spark.read.parquet(path)
        if i < 4:
            assert d.columns == columns and d.select("doc_id").subtract(before.select("doc_id")).count() == 0
            sizes.append(d.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] >= sizes[4] > 0.6 * sizes[0]
    kept = spark.read.parquet(str(tmp_path / "3"))
    dirty = brute_hits({r["doc_id"]: r["text"] for r in kept.collect()}, {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()})
    assert not any(v[1] for v in dirty.values())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "0")).collect()}
    assert all(i in first for i, q in labels.items() if q == 1 and i in {r["doc_id"] for r in before.collect()})
    assert {r["doc_id"] for r in d.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.collect()}
    rows = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, rows.drop("sequence_id", "offset").collect())) == sorted(map(str, d.drop("sequence_id", "offset").collect()))


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    big = 2**60 + 1
    rows = [(None, None, None, None, None), (None, "a b c", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", None), (3, " \n", "en", "s", 2), (4, "x" * 200_000, "en", "s", 200_000),
            (5, "word " * 30_000, "en", "s", 1), (big, "Some plain words here, of one kind. And more.\nThen another line.", "en", "s", 9), (big, "Some plain words here, of one kind. And more.\nThen another line.", "en", "s", 9),
            (6, None, None, None, None), (7, "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("odd", rows), ("none", [])):
        whole = spark.createDataFrame(data, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{i}")
            stage(spark, whole, SF).write.parquet(path)  # each stage on all odd rows
            out = spark.read.parquet(path)
            assert i == 4 or out.columns == whole.columns
            if not data:
                assert out.count() == 0
            elif i in (1, 2, 3):
                ids = [r["doc_id"] for r in out.collect()]
                assert big in ids and None in ids
            elif i == 4:
                assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}


def test_registered_queries():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
