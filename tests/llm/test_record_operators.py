"""WARC, URL filter, SimHash, packing, chat and the pipeline against brute force."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pointloom.llm import chat, packing, queries, simhash, url_filter, warc

# ------------------------------------------------------------------ WARC

PAGES = [
    (1, "http://a/1", "same"),
    (2, "http://a/2", "same"),
    (3, None, "same"),
    (3, None, "same"),
    (4, "http://a/4\r\nX: y", "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (7, "http://a/7", "\r\n\r\nWARC/1.0\r\n" * 400),
    (8, "http://a/8", "é" * 30_000),
    (None, "http://a/9", "no id"),
    (9, "http://a/9", "WARC/1.0\r\n"),
]


def brute_warc(rows, least=0):
    best, out = {}, Counter()
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    for i, _, h in rows:
        data = (h or "").encode()
        top = best[h or ""]
        visit = len(data) >= least and top >= 0 and i != top
        out[i, len(data), warc.sha1_base32(data), "revisit" if visit else "response", top if visit else None] += 1
    return out


def as_rows(df):
    return Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect())


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("off", F.lit(1))
    assert as_rows(warc.page_records(pages, least)) == brute_warc(PAGES, least)


def test_warc_splits(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "WARC/1.0\r\nContent-Length: 5\r\n\r\n" * (i % 7) + "z" * (i * 37 % 3000)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "5k", "64k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.headers["WARC-Record-ID"]: bytes(r.payload) for r in warc.read_archives(spark, path).collect() if r.headers["WARC-Type"] == "response"}
            best = {h: i for i, _, h in rows}
            assert got == {f"<urn:page:{i}>": h.encode() for h, i in best.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_warc_damage(spark, tmp_path):
    good = warc.record(1, "u", b"abc", None, "D", 0, "d") + warc.END
    for name, data, n in (("cut", good + good[:-3], 1), ("junk", b"junk" + good, 0), ("empty", b"", 0), ("no_length", good + warc.MAGIC + b"A: b\r\n\r\n\r\n\r\n" + good, 1)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data)
        assert warc.read_archives(spark, str(tmp_path / name)).count() == n
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_records(empty).count() == 0


# ------------------------------------------------------------------ URL filter

URLS = ["http://com/en/x", "https://m.Example.COM/en/7?x", "http://example.com/en/8", "http://x.example.net/de/81#a", "ftp://net/de/", "http://netx/de/", "http://org/es", "http://a.org/es/q", None, "", "no scheme/en/", "http://a.com/en/://b.org/es/", "http://", "http://com.:80/en/", "x\ny://a.com/en/\nz?q", "://.com/en/7"]


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


@pytest.mark.parametrize("first,then", [(1e-3, 0.5), (0.9, 0.9)])
def test_url_filter(spark, first, then):
    random.seed(3)
    rules = queries.RULES + [url_filter.Rule(random.choice(("allow", "block")), f"h{i}.com", f"/p{i % 3}") for i in range(40)]
    urls = URLS + [f"http://w.h{random.randint(0, 80)}.com/p{random.randint(0, 4)}/z" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules, first_rate=first, next_rate=then).collect()}
    assert got == {i: brute_rule(u, rules) for i, u in enumerate(urls)}


def test_url_lists_beyond_the_plan_are_joined(spark, monkeypatch):
    rules = queries.RULES + [url_filter.Rule("block" if i % 3 else "allow", f"h{i}.com", f"/p{i % 3}") for i in range(40)] + [url_filter.Rule("allow", "h1.com", "/p1")]
    urls = URLS + [f"http://w.h{i % 50}.com/p{i % 4}/z" for i in range(300)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    key = lambda: {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()}
    within = key()
    monkeypatch.setattr(url_filter, "MAX_BITS", 64)
    assert key() == within == {i: brute_rule(u, rules[:-1]) for i, u in enumerate(urls)}


def test_url_cascade_has_levels_and_empty_lists(spark):
    keys = lambda r: spark.createDataFrame([(f"k{i}",) for i in r], "key string")
    cascade = url_filter.build_cascade(keys(range(200)), keys(range(3000)), 0.9, 0.9)
    assert len(cascade.levels) > 2
    got = {r.key for r in keys(range(3000)).where(cascade.contains(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(200)}
    df = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert url_filter.judge(df, []).collect()[0].verdict == "allow"
    assert url_filter.judge(df.where("false"), queries.RULES).count() == 0


# ------------------------------------------------------------------ SimHash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(prints))]


def test_fingerprints(spark, sf_dir):
    texts = [None, "", "a", "A b", "a b c d a b c", "É é " * 50] + [r.text for r in queries.table(spark, sf_dir, "documents").collect()]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


def test_simhash_components(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", "a b", "a b", rows[0][1], rows[0][1] + " end"])]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))).collect()}
    prints = [brute_print(t) for _, t in rows]
    want = brute_components(prints, [d for d, _ in rows])
    assert got == {d: (p, c) for (d, _), p, c in zip(rows, prints, want)}
    assert simhash.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_connect_chains_groups_and_slices(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(300)]
    chain = [rng.getrandbits(64)]
    for _ in range(60):
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    group = [base[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)]
    # One band value for many fingerprints, so that it is dealt into slices.
    hot = [(b >> 16 << 16) | 77 for b in base]
    prints = sorted(set(base + chain + group + hot + [0, 1, 2]))
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    monkeypatch.setattr(simhash, "ITEM", 64)
    df = spark.createDataFrame([(p, p) for p in signed], "node long, fp long")
    want = brute_components(prints, signed)
    together = defaultdict(set)
    for s, w in zip(signed, want):
        together[w].add(s)
    for m in (1, 2, 3):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, m=m)).collect()}
        for members in together.values():
            assert {roots.get(x, x) for x in members} == {min(members)}
    assert [simhash.bands_in_key(n, 3) for n in (0, 10**6, 10**8, 10**11)] == [1, 1, 2, 3]


def test_more_words_find_near_copies_and_leave_others(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows, near = [], []
    for i in range(150):
        ws = rng.choices(vocabulary, k=300)
        rows.append((i, " ".join(ws)))
        if i < 40:  # 0.8 and more of the 5-word shingles
            for _ in range(6):
                ws[rng.randrange(300)] = rng.choice(vocabulary)
            near.append((1000 + i, " ".join(ws)))
    df = spark.createDataFrame(rows + near + [(2000, rows[0][1]), (2001, None), (2002, "")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_components(df, words=64).collect()}
    assert sum(got[1000 + i] == i for i in range(40)) >= 34
    assert all(got[i] == i for i in range(150)) and got[2000] == 0 and got[2002] == 2001
    h = np.array([[rng.getrandbits(64) for _ in range(3)] for _ in range(777)], np.uint64)
    want = [[sum(int(x) >> b & 1 for x in h[:, w]) for b in range(64)] for w in range(3)]
    assert simhash.bit_counts(h).tolist() == want


def test_forest_is_made_of_links_and_spans(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    prints = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)])
    a, b, bits = simhash.links_in(prints, 3)
    assert (np.bitwise_count(prints[a] ^ prints[b]) == bits).all() and (bits <= 3).all()
    want = brute_components([int(p) for p in prints], list(range(len(prints))))
    assert len(a) == len(prints) - len(set(want))
    kept, label = simhash.forest(len(prints), a, b)
    assert len(kept) == len(a) and [want[i] for i in label] == want


def test_checked_links_hold_the_similarity(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows = []
    for i in range(60):  # families of texts that share from 0.5 to 1 of their shingles
        ws = rng.choices(vocabulary, k=200)
        for j, edits in enumerate((0, 1, 3, 6, 9, 12)):
            own = list(ws)
            for _ in range(edits):
                own[rng.randrange(200)] = rng.choice(vocabulary)
            rows.append((10 * i + j, " ".join(own)))
    rows += [(5000, None), (5001, ""), (5002, "one"), (5003, "one"), (5004, "one two"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set", F.lit("x"))
    got = simhash.near_components(df, words=32, similarity=0.8)
    assert got.count() == len(rows)
    found = {r.doc_id: r.component_id for r in got.collect()}
    sets = {d: set(simhash.shingles(t, 5).tolist()) for d, t in rows}
    alike = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    linked = missed = 0
    for i in range(60):
        ids = [10 * i + j for j in range(6)]
        want = {d: d for d in ids}
        for x in ids:
            for y in ids:
                if y < x and alike(x, y):
                    low, high = sorted((want[x], want[y]))
                    want = {k: low if v == high else v for k, v in want.items()}
        for d in ids:
            assert found[d] == d or want[found[d]] == want[d]
            linked += want[d] != d
            missed += want[d] != d and found[d] == d
    assert linked > 60 and missed <= 0.1 * linked
    assert [found[d] for d in (5000, 5001, 5002, 5003, 5004)] == [5000, 5000, 5002, 5002, 5004]
    assert simhash.near_components(spark.createDataFrame([], "doc_id long, text string"), words=2, similarity=0.8).count() == 0


def test_no_similar_pair_of_a_group_is_lost(spark, monkeypatch):
    """Copies of a text that are 0.8-similar to it and not to each other."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 60, 300)
    stars = [np.unique(np.concatenate((rng.permutation(base)[:270], rng.integers(0, 1 << 60, 20)))) for _ in range(2000)]
    sets = [np.unique(rng.integers(0, 1 << 60, n)) for n in (1, 5, 300)] + stars[:1000] + [np.unique(base)] + stars[1000:]
    flat, size = np.concatenate(sets), np.array([len(x) for x in sets])
    a, b = simhash.alike(flat, size, 0.8)
    assert len(a) == 2000 and not {0, 1, 2} & {*a.tolist(), *b.tolist()}
    held = [set(x.tolist()) for x in sets]
    assert all(len(held[x] & held[y]) >= 0.8 * len(held[x] | held[y]) for x, y in zip(a, b))
    monkeypatch.setattr(simhash, "PART", 50_000)  # 12 slices
    rows = [(i, x.tolist()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, set array<long>")
    roots = simhash.components(simhash.similar(df.select("node", F.lit(0).cast("long").alias("root")), df, 0.8)).collect()
    assert {r.node for r in roots} == set(range(3, 2004)) and {r.root for r in roots} == {3}


@pytest.mark.parametrize("size,appended", [(200, True), (200, False), (400, True), (400, False)])
def test_block_edits_near_the_least_similarity_are_found(spark, size, appended):
    rng = random.Random(size + appended)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for i in range(150):
        ws = [word() for _ in range(size)]
        share = rng.uniform(0.8, 0.85)
        n = size - 4
        if appended:
            other = ws + [word() for _ in range(int(n / share) - n)]
        else:
            gone = int(n * (1 - share) / (1 + share)) - 4
            at = rng.randrange(size - gone)
            other = ws[:at] + [word() for _ in range(gone)] + ws[at + gone :]
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(other))]
        one, two = (set(simhash.shingles(r[1], 5).tolist()) for r in rows[-2:])
        assert 0.8 <= len(one & two) / len(one | two) < 0.87
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(150)) >= 149 and all(got[2 * i] == 2 * i for i in range(150))


# ------------------------------------------------------------------ packing


def test_tokenizer_by_words_equals_the_whole_text(spark, sf_dir):
    tok = packing.WordTokenizer.at(queries.tokenizer_path())
    texts = [r.text for r in queries.table(spark, sf_dir, "documents").collect()]
    texts += [None, "", "  a b c ", "ΑΣ ΑΣ.", "é ́x", "<|endoftext|>x <|startoftext|>", "it's 42nd\x1cx\x85y", "ﬁ İ ẞ 漢字 🙂", "a*** b$$$ c's, don't. x<|endoftext|>, y<|endoftext|>. z_ q`~ é, ñ. É*"]
    for t in texts:
        assert tok.ids(t) == np.array(tok.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_do_not_depend_on_slices_or_on_words_remembered(spark, sf_dir, monkeypatch):
    path = queries.tokenizer_path()
    texts = [r.text for r in queries.table(spark, sf_dir, "documents").collect()][:60]
    texts += [None, "", " \n", "Word. <|endoftext|>", "a" * 5000, "\tx\x1cy ", None, "Word. word, WORD!"]
    tok = packing.WordTokenizer(path)
    want = [np.array(tok.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(packing, "CACHE", 50)
    for size in (1, 700, 1 << 20):
        monkeypatch.setattr(packing, "SLICE", size)
        own = packing.WordTokenizer(path)
        assert list(own.all_ids(pa.array(texts, pa.string()))) == want
        assert list(own.all_ids(pa.array(texts, pa.string()).slice(55, 10))) == want[55:65]
        assert len(own.words) <= 51
    assert list(tok.all_ids(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("length,segments,loss", [(4096, 512, None), (64, 3, None), (128, 512, 50), (100, 4, 30)])
def test_packing(spark, sf_dir, length, segments, loss):
    tok = packing.WordTokenizer.at(queries.tokenizer_path())
    rows = [(r.doc_id, r.text, r.doc_id % 9) for r in queries.table(spark, sf_dir, "documents").limit(60).collect()] + [(500, None, None), (501, "", 3), (501, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt long").withColumn("start", F.lit("x"))
    got = packing.pack(df, queries.tokenizer_path(), length, segments, loss, prompt="prompt").collect()
    whole, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        whole[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for d, t, p in rows:
        ids = tok.ids(t) + np.array([2], "<u4").tobytes()
        own = sorted(whole[d], key=lambda r: r.start)
        if d == 501:
            own = own[:1]
        assert b"".join(bytes(r.ids) for r in own) == ids
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]])) and {r.doc_tokens for r in own} == {len(ids) // 4}
        assert sum(r.loss_tokens for r in own) == max(0, len(ids) // 4 - (p or 0))
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        n = sum(r.length for r in own)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert n <= length and len(own) <= segments and sum(r.loss_tokens for r in own) <= (loss or length)
        assert n == length or n & (n - 1) == 0


def test_packing_holds_few_open_tokens(monkeypatch):
    monkeypatch.setattr(packing, "POOL_TOKENS", 5_000)
    most, add = [], packing.Packer.add

    def seen(self, *a):
        add(self, *a)
        most.append(self.tokens() - self.sizes[-1, 0])

    monkeypatch.setattr(packing.Packer, "add", seen)
    monkeypatch.setattr(packing.TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": lambda s: 0})()))
    rng = random.Random(6)
    texts = [" ".join(["word"] * rng.choice([1, 30, 900, 20_000])) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts), pa.array([0] * 300)], ["doc_id", "text", "prompt"])
    out = list(packing._pack(queries.tokenizer_path(), 4096, 512, 4096, 2)(iter([batch])))
    assert max(most) <= 5_000 and max(len(b) for b in out) < 5_000
    assert sum(sum(b.column(2).to_pylist()) for b in out) == sum(len(t.split()) + 1 for t in texts)


def test_the_loss_limit_binds(spark):
    """Prompts bear no loss, so more tokens fit beside a few that do."""
    rows = [(i, "word " * 60, 50) for i in range(200)] + [(1000 + i, "word " * 60, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt long").coalesce(1)
    seqs = defaultdict(list)
    for r in packing.pack(df, queries.tokenizer_path(), 512, 64, 100, prompt="prompt").collect():
        seqs[r.sequence_id].append(r)
    loss = [sum(r.loss_tokens for r in own) for own in seqs.values()]
    assert 95 <= max(loss) <= 100 and sum(loss) == 200 * 11 + 40 * 61
    assert any(sum(r.length for r in own) == 512 for own in seqs.values())


# ------------------------------------------------------------------ chat


def brute_chat(roles):
    """Least cost over all ways to treat each turn, by depth-first search."""

    def go(i, s):
        if i == len(roles):
            return {0: 0, 1: 4, 2: 2, 3: 0}[s]
        best = 99
        for q in (1, 2, 3):
            change = 0 if roles[i] == q else 3 if roles[i] else 1
            if q in chat.LEGAL[s]:
                best = min(best, change + go(i + 1, q))
            for x in chat.LEGAL[s]:
                if q in chat.LEGAL[x]:
                    best = min(best, change + 2 + go(i + 1, q))
            if q == s:
                best = min(best, change + 1 + go(i + 1, q))
        return best

    return go(0, 0)


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def test_chat_costs():
    for n in range(6):
        for roles in itertools.product(range(4), repeat=n):
            assert chat.costs_to_go(list(roles), chat.FINAL)[0][0] == brute_chat(roles)


def rows_of(df):
    return sorted(((-1 if r.conv_id is None else r.conv_id, r.position, r.step, r.action, r.role, r.text, r.rendered) for r in df.collect()))


def test_chat_repair_legal_and_independent_of_splits(spark, sf_dir):
    rng = random.Random(8)
    turns = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").collect()]
    turns += [(7000, i, rng.choice(["user", "assistant", "system", None, "gpt", "odd"]), f"t{i}") for i in range(900)]
    turns += [(7001, 0, "assistant", None), (7001, 0, "assistant", None), (None, None, "user", "x"), (7002, 3, "system", "only")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "5", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(rows_of(chat.repair(df)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1] == out[2]
    by = defaultdict(list)
    for r in out[0]:
        by[r[0]].append(r)
    assert sum(r[2] == 1 for r in out[0]) == len(turns)
    for own in by.values():
        assert legal([r[4] for r in own if "merge" not in r[3]])
        assert "".join(r[6] for r in own).count("<|im_end|>\n") == sum("merge" not in r[3] for r in own)
    assert chat.repair(df.where("false")).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = queries.table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).persist()
        assert out.count() <= docs.count() or name == "packing"
        if name != "packing":
            assert out.columns == columns and out.count() > 0
            docs = out
    tok = packing.WordTokenizer.at(queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == set(texts)
    for r in pieces[:50]:
        ids = np.frombuffer(tok.ids(texts[r.doc_id]) + np.array([2], "<u4").tobytes(), "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_pipeline_judges_rows_with_null_and_repeated_ids_apart(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    clean, leaked, junk = [text() for _ in range(4)], text(), "too short"
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda stage, rows: Counter((r.doc_id, r.text) for r in stage(spark, frame(rows), str(tmp_path)).collect())
    good = [(None, clean[0]), (None, clean[1]), (7, clean[2]), (8, clean[3])]
    for stage, bad in ((corpus_pipeline.quality_rules, junk), (corpus_pipeline.clean_of_benchmark, leaked)):
        assert left(stage, [*good, (None, bad), (7, bad), (9, bad)]) == Counter(good)
    copies = [(None, clean[0]), (None, clean[0]), (None, clean[1]), (5, clean[1]), (7, clean[2]), (7, clean[2]), (7, clean[2] + " more"), (7, clean[3]), (None, clean[3])]
    got = left(corpus_pipeline.near_duplicates, copies)
    assert got.total() == 4 and got[None, clean[0]] == 1 and got[5, clean[1]] == 1 and got[7, clean[3]] == 1
    assert got[7, clean[2]] + got[7, clean[2] + " more"] == 1


ODD = ["__id", "__drop", "row", "text_hash", "__doc", "__hit", "node", "kept", "a b.c", "n_chars"]


def test_pipeline_stages_of_odd_rows(spark, tmp_path, monkeypatch):
    """Nulls, empty and long texts, repeats, clashing columns, empty tables; broadcast or shuffled alike."""
    import corpus_pipeline
    from pointloom.llm import common, line_dedup

    rng = random.Random(14)
    text = lambda n=80: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    line = "a line that many documents share and that is long enough to go"
    long = text(200_000)
    leak, one = text(), text()
    rows = [(1, None), (2, ""), (3, long), (4, long + " x"), (5, leak), (None, one), (None, one), (6, one), (6, one), (7, "short")]
    rows += [(10 + i, text(60) + "\n" + line + "\n" + text(60)) for i in range(6)]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ODD:
        docs = docs.withColumn(c, F.lit(5).cast("long") if c == "n_chars" else F.lit(f"of {c}"))
    left = {}
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            if name in ("quality_rules", "benchmark_decontamination"):
                assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
            got = out.collect()
            assert all(r[c] == f"of {c}" for r in got for c in ODD[:-1])
            found = Counter((r.doc_id, r.text) for r in got)
            assert left.setdefault(name, found) == found
            if most:
                assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert left["quality_rules"] == Counter(x for x in rows if x[1] and len(x[1].split()) >= 50)
    assert left["benchmark_decontamination"] == Counter(x for x in rows if x[1] != leak)
    shorter = Counter((d, t if d is None or d < 10 or d == 15 else t.replace(line + "\n", "")) for d, t in rows)
    assert left["line_dedup"] == shorter
    near = left["simhash_near_dedup"]
    assert near.total() == 5 + 6 and near[6, one] == 1 and near[3, long] == 1 and near[1, None] + near[2, ""] == 1
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(d for d, _ in rows)
    assert corpus_pipeline.pack(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_warc_and_lines_with_shuffled_sides(spark, monkeypatch):
    """Beyond the size for a broadcast hot keys go apart, the rest by a shuffle: equal results."""
    from pointloom.llm import common, line_dedup

    pages = spark.createDataFrame([(i, f"http://a/{i}", "same" if i % 3 else f"p{i // 6}") for i in range(300)], "page_id long, url string, html string")
    line = "a line that very many documents share, long enough to be a key"
    docs = spark.createDataFrame([(i, f"{line}\nsecond line of some documents, number {i // 6}, with forty characters\nown {i}") for i in range(300)], "doc_id long, text string")
    runs = lambda: (as_rows(warc.page_records(pages)), Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup(docs).collect()))
    want = runs()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(warc, "SPLIT_ROWS", 0)
    for hot in (common.HOT_KEYS, 10):
        monkeypatch.setattr(common, "HOT_KEYS", hot)
        assert runs() == want
    assert want[0] == brute_warc([tuple(r) for r in pages.collect()]) and any(r[2] == 2 for r in want[1])


def test_packing_remembers_words_in_bounded_room(monkeypatch):
    calls = []
    words = packing._Words(lambda w: calls.append(w) or b"\0" * 4)
    for i in range(300):
        words[b"%d" % i * 10_000]
    assert not words and not words.old
    monkeypatch.setattr(packing, "CACHE", 20_000)
    words = packing._Words(lambda w: calls.append(w) or b"\0" * 4)
    for i in range(5000):
        words[b"w%d" % i]
        assert len(words) < 70 and len(words.old) < 70
    del calls[:]
    assert words[b"w4999"] == b"\0" * 4 and calls == []


def test_near_rows_link_by_fingerprints_too(spark, monkeypatch):
    """Texts within three bits are near copies, whatever shingles of five words they share."""
    words = [f"w{i}" for i in range(400)]
    other = list(words)
    for i in range(4, 400, 40):
        other[i] = f"x{i}"
    a, b, apart = " ".join(words), " ".join(other), " ".join(f"y{i}" for i in range(400))
    plain = {r.doc_id: r.fp for r in simhash.near_components(spark.createDataFrame([(1, a), (2, b), (3, apart)], "doc_id long, text string")).collect()}
    bits = {(i, j): (plain[i] ^ plain[j]).bit_count() if plain[i] ^ plain[j] >= 0 else ((plain[i] ^ plain[j]) & (2**64 - 1)).bit_count() for i in plain for j in plain}
    monkeypatch.setattr(simhash, "RADIUS", bits[1, 2])
    assert bits[1, 2] < min(bits[1, 3], bits[2, 3])
    got = simhash.near_rows(spark.createDataFrame([(1, a), (2, b), (3, apart)], "doc_id long, text string"), 0.99)
    assert {r.doc_id: r.first for r in got.collect()} == {1: True, 2: False, 3: True}
