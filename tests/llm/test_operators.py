"""Each operator against a brute-force version or the library, with the edge cases its docstring states."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import bpe, decontaminate, html_text, language_id, near_duplicates, quality, repeats, token_counts, topk, url_filter

ODD = [(1, None), (2, ""), (3, " \n\t  "), (4, "the"), (4, "the"), (None, "null id here"), (5, "x" * 60_000), (6, "日本語 été ÉTÉ ß \x1c\x85　 0½"), (7, "a  b\n \n c   "), (8, "<|endoftext|> it's <|endoftext|>we'LL 'S")]
SCHEMA = "doc_id long, text string"


def frame(spark, rows, parts=3):
    """Rows with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n_tokens", "score", "n", "k", "h", "node", "ids", "kept", "spans", "lang_pred", "label"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(parts)


def noisy(seed=1, count=300):
    r = random.Random(seed)
    letters = " \n\t  aAeé'sdlrt0123$%_ß中日👍\u0301\u200b\xa0\x1c\x85²Ⅷ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(count)]
    return texts + ["".join(chr(r.choice([r.randrange(1, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(count)]


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(byte_bpe):
    own = bpe.BacktrackingBPE(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for _, t in ODD] + noisy() + ["the" * 500, " " * 100, "\n" * 50 + "x"]
    for text, want in zip(texts, byte_bpe.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode(text)
        assert ids.tolist() == want.ids, ascii(text)
        assert own.decode(ids) == text


def test_bpe_decodes_broken_sequences_like_the_library(byte_bpe):
    own, r = bpe.BacktrackingBPE(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    for _ in range(500):
        ids = [r.randrange(50257) if r.random() < 0.5 else r.randrange(256) for _ in range(8)]
        assert own.decode(np.array(ids, np.int32)) == byte_bpe.decode(ids, skip_special_tokens=False)


def test_bpe_frame(spark, byte_bpe):
    rows = bpe.digests(bpe.encode_decode(frame(spark, ODD), public_tokenizers.path("byte_bpe_50k.json"))).collect()
    want = []
    for k, t in ODD:
        ids = byte_bpe.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, rows)) == Counter(want)
    assert bpe.digests(bpe.encode_decode(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("frequent", [2, 1000])
def test_token_counts_equal_the_library(spark, frequent):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = ODD + [(100 + k, t) for k, t in enumerate(noisy(2))]
    library = Tokenizer.from_file(path)
    want = Counter((k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows)
    assert Counter(map(tuple, token_counts.count_tokens(frame(spark, rows), path, frequent=frequent).collect())) == want
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


URLS = [None, "", "no scheme/casino", "http://", "https://EXAMPLE.org/es/x?y#z", "https://a.example.org/en/12", "http://notexample.org/es/", "http://x.org", "http://x.org/", "http://Ex.com/fr/a", "http://ex.com/de/?porn", "http://cheap-pills.net/", "http://cheap.net/cheap", "http://casinos.net/", "ftp://a.net/my-CASINO.html", "http://free.net/?win=1", "http://x.net/ads/ad", "http://x.net/ads/ad?free", "http://x.net/pornography", "HTTP://É.NET/ÄB", "a://b://c/d", "http://u:p@h.net:80/x"]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c)[0]
        host, _, tail = rest.partition("/")
        path = "/" + tail if "/" in rest else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(((len(rule), rule, v) for rule, v in url_filter.RULES for h, _, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), default=(0, None, None))
    words = Counter("".join(c if c.isascii() and c.isalnum() else " " for c in (url or "").lower() if True).split())
    bad = any(w in words for x in url_filter.STRICT for w in x) or sum(any(w in words for w in x) for x in url_filter.SOFT) >= 2
    return host, path, best[1], best[2] or ("block" if bad else "allow")


def test_url_filter(spark):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)] + [(0, None)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect())
    assert got == Counter([(k, *brute_url(u)) for k, u in enumerate(URLS)] + [(0, *brute_url(None))])
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def brute_top(rows, k, every):
    ok = [(i, [int(np.floor(x * 64)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in ok if i % every == 0}:
        v = min(v for i, v in ok if i == q)
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "FIRST_DEPTH", 2)
    r = random.Random(seed)
    rows = [(k, [r.choice([0.0, 0.25, -0.5, r.random() * (3 if k % 7 == 0 else 1)]) for _ in range(4)]) for k in range(120)]
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0]), (240, [float("nan")] * 4), (260, [float("inf")] * 4), (None, [1.0] * 4), (300, [0.0] * 4), (301, [2.0] * 4), (302, [2.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    assert {tuple(x) for x in topk.top_k(df, k=5, every=20, queries=3).collect()} == brute_top(rows, 5, 20)
    assert topk.top_k(df.where("vec_id < 3"), k=5).count() == 2
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_vectors_of_several_lengths_and_sizes(spark):
    r = random.Random(5)
    rows = [(k, [float(r.randint(-3, 3)) for _ in range(r.choice([0, 1, 3, 5]))]) for k in range(80)]
    rows += [(100, [3e6, -2e6]), (101, [2.5e6, 1.0]), (102, [1.0, -9e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {k: [int(np.floor(64 * x)) for x in v] for k, v in rows}
    want = set()
    for q in (k for k in whole if k % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))[:4]
        want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(scores)}
    assert {tuple(x) for x in topk.top_k(df, k=4).collect()} == want


def test_threshold_algorithm_computes_few_products(monkeypatch):
    r = np.random.default_rng(1)
    x = r.integers(-5, 5, (5000, 3))
    x[7] = 60
    asked = []
    monkeypatch.setattr(topk, "products", lambda q, v, f=topk.products: asked.append(len(q) * len(v)) or f(q, v))
    best = topk.BestOfQueries(np.array([-1]), np.array([[5, 4, 3]]), 1)
    block = topk.Candidates(np.arange(5000), x)
    assert best.search(block) == sum(asked) < 100 and best.found[0, 0] == 7
    # Known scores spare a later block nearly all work.
    asked.clear()
    assert best.search(topk.Candidates(np.arange(5000, 10_000), np.delete(np.vstack([x, x[:1]]), 7, 0))) == sum(asked) < 100


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    r = random.Random(2)
    for _ in range(500):
        a = [r.randint(0, r.choice([2, 50])) for _ in range(r.randint(0, 25))]
        b = list(a)
        for _ in range(r.randint(0, 8)):
            p = r.randint(0, len(b))
            b[p : p + r.randint(0, 1)] = [r.randint(0, 50)] * r.randint(0, 1)
        limit = r.randint(0, 9)
        assert near_duplicates.banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), limit) == min(levenshtein(a, b), limit + 1)


@pytest.mark.parametrize("band", [1, 1 << 20])
def test_pairs_are_verified_together(band, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BAND", band)
    r = random.Random(3)
    pairs = []
    for _ in range(400):
        a = [r.randint(0, r.choice([2, 50])) for _ in range(r.choice([0, 1, 4, 25, 60]))]
        b = list(a)
        for _ in range(r.randint(0, 1 + len(a) // 4)):
            p = r.randint(0, len(b))
            b[p : p + r.randint(0, 1)] = [r.randint(0, 50)] * r.randint(0, 1)
        pairs.append((a, b))
    for similarity in (0.8, 0.95):
        want = [levenshtein(a, b) <= int(max(len(a), len(b)) * (1 - similarity) + 1e-9) for a, b in pairs]
        got = near_duplicates.within([(np.array(a, np.uint32), np.array(b, np.uint32)) for a, b in pairs], similarity)
        assert got.tolist() == want and 0 < sum(want) < len(pairs)
    assert near_duplicates.within([], 0.8).tolist() == []


@pytest.mark.parametrize("pairs", [1, 1 << 20])
def test_close_pairs_join_what_all_pairs_join(pairs, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PAIRS", pairs)
    r = random.Random(7)
    for _ in range(60):
        words = []
        for _ in range(12):
            base = [r.randint(0, r.choice([3, 9, 40])) for _ in range(r.choice([1, 2, 5, 10, 30]))]
            words += [np.array(varied_numbers(r, base, r.randint(0, 1 + len(base) // 4)), np.uint32) for _ in range(2)]
        words = [w for w in words if len(w)]
        group, side = np.array([r.randint(0, 1) for _ in words]), np.array([r.randint(0, 1) for _ in words])
        side[group == 0] = 0
        label = np.arange(len(words))
        got, want = list(range(len(words))), list(range(len(words)))
        for links, at in ((near_duplicates.close_pairs(words, group, side, label, 0.8), got), ([(a, b) for a in range(len(words)) for b in range(a) if group[a] == group[b] and (side[a] != side[b] or not side[group == group[a]].any()) and levenshtein(words[a].tolist(), words[b].tolist()) <= int(max(len(words[a]), len(words[b])) * 0.2 + 1e-9)], want)):
            for a, b in links:
                old, new = at[a], at[b]
                at[:] = [new if x == old else x for x in at]
        assert [[x == y for y in got] for x in got] == [[x == y for y in want] for x in want]


def test_components(spark):
    r = random.Random(8)
    paths = [(k, k + 1) for k in range(20, 45)] + [(60, k) for k in range(61, 90)] + [(99, k) for k in range(91, 99)]
    more = [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)]
    links = [x for x in paths + more if x[0] != x[1]]

    def brute(links):
        label = {x: x for link in links for x in link}
        for a, b in links:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {x: new if y == old else y for x, y in label.items()}
        return label

    frame_of = lambda x: spark.createDataFrame(x, "a long, b long")
    labels = near_duplicates.components(frame_of(links))
    assert dict(map(tuple, labels.collect())) == brute(links)
    new = [(30, 70), (95, 200), (300, 301), (30, 31)]
    assert dict(map(tuple, near_duplicates.joined_labels(labels, frame_of(new)).collect())) == brute(links + new)
    assert near_duplicates.components(frame_of([])).count() == 0


def varied_numbers(r, base, edits):
    base = list(base)
    for _ in range(edits):
        p = r.randint(0, len(base))
        base[p : p + r.randint(0, 1)] = [r.randint(0, 40)] * r.randint(0, 1)
    return base


def test_recall_at_the_threshold(spark):
    """Pairs with words replaced, put in or taken out all over the text, up to the edits that are allowed."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    rows, kinds = [], []
    for rate in (0.05, 0.1, 0.15, 0.18, 0.2):
        for n in (50, 100, 300):
            for _ in range(40):
                base = [word() for _ in range(n)]
                other = list(base)
                for p in sorted(r.sample(range(n), int(n * rate)), reverse=True):
                    other[p : p + 1] = r.choice([[word()], [word()], [word()], [], [other[p], word()]]) if rate < 0.15 else [word()]
                kinds.append(rate)
                rows += [(2 * len(kinds) - 2, " ".join(base)), (2 * len(kinds) - 1, " ".join(other))]
    got = {x.doc_id: x.class_id for x in near_duplicates.classes(frame(spark, rows)).collect()}
    found = defaultdict(list)
    for k, rate in enumerate(kinds):
        assert got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1)
        found[rate].append(got[2 * k + 1] == 2 * k)
    assert {rate: np.mean(x) for rate, x in found.items() if np.mean(x) < 0.9} == {}


def test_classes_equal_those_of_all_pairs(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    words = {k: np.frombuffer(near_duplicates.Words().of(t or ""), np.uint32) for k, t in rows}
    parent = {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by_text = {}
    for k, t in rows:
        if t is not None:
            parent[root(k)] = root(by_text.setdefault(t, k))
    ids = sorted((k for k in by_text.values() if len(words[k])), key=lambda k: len(words[k]))
    for i, a in enumerate(ids):
        others = []
        for b in ids[i + 1 :]:
            if len(words[b]) * 0.8 > len(words[a]) + 1e-9:
                break
            others.append(b)
        for b, ok in zip(others, near_duplicates.within([(words[a], words[b]) for b in others], 0.8), strict=True):
            if ok:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = defaultdict(list)
    for k, _ in rows:
        want[root(k)].append(k)
    got = {x.doc_id: x.class_id for x in near_duplicates.classes(frame(spark, rows)).collect()}
    assert got == {k: min(v) for v in want.values() for k in v}


def varied(r, words, edits):
    words = list(words)
    for _ in range(edits):
        p = r.randrange(len(words))
        words[p : p + r.randint(0, 1)] = ["".join(r.choice("xyz") for _ in range(6))] * r.randint(0, 1)
    return words


def test_near_duplicates(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, group = [], {}
    for g in range(12):
        base = [word() for _ in range(r.choice([8, 60, 300]))]
        for _ in range(r.choice([1, 2, 5, 30])):
            k = len(rows)
            rows.append((k, " ".join(varied(r, base, r.randint(0, len(base) // 25)))))
            group.setdefault(g, []).append(k)
    passage = " ".join(word() for _ in range(40))  # in many texts that are no copies
    for _ in range(20):
        group[len(group)] = [len(rows)]
        rows.append((len(rows), " ".join(word() for _ in range(100)) + " " + passage))
    n = len(rows)
    rows += [(n, None), (n + 1, None), (n + 2, ""), (n + 3, ""), (n + 4, "One two"), (n + 5, "one, TWO"), (n + 6, "z " * 30_000), (n + 7, "?!")]
    want = {k: min(v) for v in group.values() for k in v} | {n: n, n + 1: n + 1, n + 2: n + 2, n + 3: n + 2, n + 4: n + 4, n + 5: n + 4, n + 6: n + 6, n + 7: n + 7}
    df = frame(spark, rows)
    got = {x.doc_id: (x.class_id, x.class_size) for x in near_duplicates.classes(df).collect()}
    sizes = Counter(want.values())
    assert got == {k: (c, sizes[c]) for k, c in want.items()}
    kept = near_duplicates.keep_one(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))
    twice = frame(spark, [(1, "same words here"), (1, "same words here"), (None, "same words here"), (None, "other")])
    assert Counter((x.doc_id, x.text) for x in near_duplicates.keep_one(twice).collect()) == Counter([(1, "same words here"), (None, "other")])
    assert near_duplicates.classes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [250_000, 20_000])
def test_near_duplicates_inside_a_large_bucket(spark, block, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_WORDS", block, raising=False)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    passage = [word() for _ in range(156)]  # 78 % of each text
    tails = [[word() for _ in range(44)] for _ in range(2000)]
    texts = tails + [[word() for _ in range(22)] + tail[22:] for tail in tails[:150]]
    rows = [(k, " ".join(passage + tail)) for k, tail in enumerate(texts)]
    got = {x.doc_id: x.class_id for x in near_duplicates.classes(frame(spark, rows)).collect()}
    assert got == {k: k if k < 2000 else k - 2000 for k in range(len(rows))}


def test_bpe_words_are_remembered_once():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text, coder = "one two, three; four (five) six. seven  two, 8 it's", bpe.BacktrackingBPE(path)
    assert coder.encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert not [w for w in coder.tokens if w[0] == " " and w[1:].isalpha()]


def test_common_words_in_order_bound_the_alignment():
    r = random.Random(4)
    pairs = []
    for _ in range(60):
        a = [r.randrange(2000) for _ in range(r.randrange(90, 200))]
        b = [w if r.random() > 0.2 else r.randrange(2000) for w in a if r.random() > 0.02]
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [last for last in [0] for j, y in enumerate(b) for last in [row[j] + 1 if x == y else max(row[j + 1], last)]]
        assert near_duplicates.in_order(a, b) == row[-1]
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
    want = [near_duplicates.banded_distance(a, b, limit) <= limit for a, b in pairs for limit in [int(max(len(a), len(b)) * 0.2 + 1e-9)]]
    assert near_duplicates.within(pairs, 0.8).tolist() == want and 0 < sum(want) < len(want)


def test_a_task_hands_on_a_forest_of_links():
    r = random.Random(5)
    texts = [[k * 1000 + x for x in range(100)] for k in (0, 1) for _ in range(12)]
    texts = [np.array([r.randrange(10**6) if r.random() < 0.05 else w for w in t], np.uint32) for t in texts]
    pairs = [(a, b) for b in range(24) for a in range(b)]
    batch = pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "x": [texts[a].tobytes() for a, _ in pairs], "y": [texts[b].tobytes() for _, b in pairs]})
    links = [tuple(x.values()) for out in near_duplicates._verified(0.8)(iter([batch.slice(0, 100), batch.slice(100)])) for x in out.to_pylist()]
    assert len(links) == 22
    found = near_duplicates.Forest()
    assert all(a // 12 == b // 12 and found.join(a, b) for a, b in links)


def test_a_pair_of_several_buckets_is_verified_once(monkeypatch):
    base = list(range(100))
    texts = [np.array([w if (w + k) % 8 > 1 else 1000 * k + w for w in base], np.uint32) for k in range(1, 9)]  # further apart than 0.8
    texts += [np.array(base[:-1] + [77777 + k], np.uint32) for k in range(2)]
    tried, real = Counter(), near_duplicates.within
    monkeypatch.setattr(near_duplicates, "within", lambda pairs, similarity: (tried.update(tuple(sorted((x.tobytes(), y.tobytes()))) for x, y in pairs), real(pairs, similarity))[1])
    links = set()
    for key in range(6):
        rows = [{"key": key, "i": 0, "j": 0, "own": 0, "node": k, "label": k, "keys": list(range(6)), "words": t.tobytes()} for k, t in enumerate(texts)]
        links |= {tuple(x.values()) for out in near_duplicates._compared(0.8)(iter([pa.RecordBatch.from_pylist(rows)])) for x in out.to_pylist()}
    assert max(tried.values()) == 1
    assert (8, 9) in links


def brute_cut(rows, depth):
    seen = Counter()
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        for p in range(len(b) - depth + 1):
            seen[b[p : p + depth]] += 1
    out = []
    for (k, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if seen[b[p : p + depth]] > 1:
                gone[p : p + depth] = b"\1" * depth
        out.append((k, bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    return Counter(out)


@pytest.mark.parametrize("largest", [5_000, 20, 3, 1])
def test_repeats(spark, largest):
    r = random.Random(5)
    mk = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(n))
    shared = [mk(r.randint(15, 80)) for _ in range(8)]
    rows = []
    for k in range(90):
        text = " ".join(r.choice([mk(r.randint(1, 30)), r.choice(shared), r.choice(shared)[r.randint(0, 60) :]]) for _ in range(r.randint(1, 6)))
        if r.random() < 0.3:
            p = r.randrange(len(text))
            text = text[:p] + "#" + text[p + 1 :]
        rows.append((k, text))
    rows += [(1, None), (2, ""), (3, "a" * 150), (4, "b" * 250), (5, "c" * 199), (5, "c" * 200), (6, "d" * 200), (6, "d" * 200), (7, "xyz" * 400), (None, "d" * 201), (8, mk(3000))]
    rows += [(500 + k, shared[0]) for k in range(40)]
    df = frame(spark, rows)
    found = repeats.remove_repeats(df, largest=largest).collect()
    assert Counter((x.doc_id, bytes(x.kept)) for x in found) == brute_cut(rows, 200)
    cut = repeats.cut_repeats(df, largest=largest)
    assert cut.columns == df.columns
    want = Counter((k, b.decode("utf-8", "ignore")) for (k, b), n in brute_cut(rows, 200).items() for _ in range(n) if b)
    assert Counter((x.doc_id, x.text) for x in cut.where("text is not null").collect()) == want
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("depth", [33, 40])
def test_repeats_of_short_windows_under_large_digits(spark, depth):
    r = random.Random(depth)
    shared = "".join(r.choice("abcdefgh") for _ in range(depth + 3))
    mk = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60)))
    rows = [(k, mk() + shared[r.randint(0, 3) :] + mk()) for k in range(60)] + [(60, ""), (61, None)]
    found = repeats.remove_repeats(frame(spark, rows), depth=depth, largest=2).collect()
    assert Counter((x.doc_id, bytes(x.kept)) for x in found) == brute_cut(rows, depth)


ITEMS = [(k, t) for k, t in enumerate(["Which of the seven small rivers runs north into the quiet lake at dawn?", "How many grey stones did the mason carry up the long hill before noon on that day?", "too short", None, ""])]


def test_decontaminate(spark):
    r = random.Random(6)
    noise = lambda n: " ".join("".join(r.choice("klmno") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        i = r.randrange(2)
        words = decontaminate.words_of(ITEMS[i][1])
        edits = r.randint(0, 5)
        for p in r.sample(range(len(words)), edits):
            words[p] = "q" * (p + 1)
        rows.append((k, f"{noise(r.randint(0, 40))} {' '.join(words).title()}! {noise(r.randint(0, 40))}"))
        if edits <= int(len(words) * 0.2 + 1e-9):
            want[k, i] = edits
    rows += [(100, None), (101, ""), (102, "of the " * 5000), (103, "too short"), (104, noise(20_000) + " " + ITEMS[0][1]), (None, ITEMS[1][1]), (105, ITEMS[1][1].upper()), (105, ITEMS[1][1])]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = frame(spark, rows)
    for size in (20_000, 1):
        found = decontaminate.find_leaks(df, items, block_items=size).collect()
        assert {(x.doc_id, x.item_id): x.edits for x in found} == want | {(103, 2): 0, (104, 0): 0, (None, 1): 0, (105, 1): 0}
        assert len(found) == len(want) + 5
    clean = decontaminate.drop_leaks(df, items)
    assert clean.columns == df.columns
    leaky = {k for k, _ in want} | {103, 104, 105, None}
    assert sorted(x.doc_id for x in clean.collect()) == sorted(k for k, _ in rows if k not in leaky)
    assert decontaminate.find_leaks(df, items.limit(0)).count() == 0 and decontaminate.find_leaks(frame(spark, []), items).count() == 0


@pytest.mark.parametrize("again", [3, 4, 9, 200])
def test_decontaminate_at_the_end_of_a_repeated_word(again):
    items = [(0, "alpha very very very bad"), (1, "bad very very very omega")]
    searched = decontaminate.Benchmark(items, 0.8, 8, 400, 2)
    text = "it was " + "very " * again + "bad it seems"
    assert {(x[1], x[3]) for x in searched.matches([text])} == {(0, 1)}
    text = "it was bad " + "very " * again + "it seems"
    assert {(x[1], x[3]) for x in searched.matches([text])} == {(1, 1)}


def brute_leaks(rows, items):
    """{(row, item): (edits, first place that ends a best match)} by plain dynamic programming."""
    out = {}
    for k, t in rows:
        words = decontaminate.words_of(t or "")
        for i, x in items:
            item = decontaminate.words_of(x or "")
            column = list(range(len(item) + 1))
            best, end = len(item), 0
            for place, w in enumerate(words):
                new = [0]
                for j, v in enumerate(item, 1):
                    new.append(min(column[j] + 1, new[-1] + 1, column[j - 1] + (v != w)))
                column = new
                if column[-1] < best:
                    best, end = column[-1], place + 1
            if item and best <= int(len(item) * 0.2 + 1e-9):
                out[k, i] = (best, end)
    return out


def test_decontaminate_equals_brute_force(spark):
    """Substitutions, insertions and deletions up to and beyond the limit; items of one to forty words."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("klmnopq") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 4, 5, 6, 9, 10, 14, 15, 20, 40])] + [(50, "?!"), (51, None)]
    rows = []
    for k in range(250):
        _, text = items[r.randrange(13)]
        words = text.split()
        part = varied(r, words, r.randint(0, 1 + len(words) // 4))
        rows.append((k, " ".join([word() for _ in range(r.randint(0, 30))] + part + [word() for _ in range(r.randint(0, 30))])))
    want = brute_leaks(rows, items)
    given = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id): x.edits for x in decontaminate.find_leaks(frame(spark, rows), given).collect()}
    assert set(found) <= set(want) and all(found[x] == want[x][0] for x in found)
    assert len(found) >= 0.995 * len(want) and len(want) > 100
    assert {x for x in want if x[1] < 5} <= set(found)


def tiny_model():
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = language_id.Pieces(path, 4)
    return language_id.LanguageModel(["a", "b"], np.random.default_rng(1).dirichlet(np.ones(len(pieces.pieces)), 2).T, path, 4), pieces


def segmentations(word, place):
    """Every way to cut `word` into pieces (their numbers) and single letters that stand for themselves (-1)."""
    if not word:
        yield []
        return
    for n in range(1, min(4, len(word)) + 1):
        if word[:n] in place:
            yield from ([place[word[:n]], *rest] for rest in segmentations(word[n:], place))
    yield from ([-1, *rest] for rest in segmentations(word[1:], place))


def test_forward_and_expected_counts_equal_enumeration():
    model, pieces = tiny_model()
    place = {p: k for k, p in enumerate(pieces.pieces)}
    for word in ("the", "haus", "quest", "été", "a", "\ua500", "no\ua500"):
        ways = list(segmentations(word, place))
        for language in (0, 1):
            p = model.probabilities[:, language]
            chance = [np.prod([language_id.UNKNOWN if k < 0 else p[k] for k in way]) for way in ways]
            assert language_id.word_logs(pieces, model.probabilities, pieces.codes([word], len(word)))[0, language] == pytest.approx(np.log(sum(chance)))
            want, sums = np.zeros(len(p)), np.zeros(model.probabilities.shape)
            for c, way in zip(chance, ways, strict=True):
                for k in way:
                    want[k] += 3 * c / sum(chance) if k >= 0 else 0
            language_id.expected_counts(pieces, model.probabilities, language, Counter({word: 3}), sums)
            assert sums[:, language] == pytest.approx(want)


def log_sum_with_unknown(word, p, place):
    """Log of the sum over segmentations, in logs all the way."""
    total = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        total[end] = np.logaddexp.reduce([total[end - 1] + np.log(language_id.UNKNOWN)] + [total[start] + np.log(p[place[word[start:end]]]) for start in range(max(0, end - 4), end) if word[start:end] in place])
    return total[-1]


@pytest.mark.parametrize("block", [1, 5, 256])
def test_words_of_any_length(block, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", block)
    model, pieces = tiny_model()
    place = {p: k for k, p in enumerate(pieces.pieces)}
    scorer, run = language_id.Scorer(model), "\ua500" * 5000
    for n in (16, 17, 47, 63, 64, 255, 256, 257, 5000):
        assert scorer.words([run[:n]])[0] == pytest.approx([n * np.log(language_id.UNKNOWN)] * 2)
    words = ["thequesthausoflanguagequest", "thequest" + run[:40] + "haus", "thequesthaus" * 60]
    for word in words:
        assert scorer.words([word])[0] == pytest.approx([log_sum_with_unknown(word, model.probabilities[:, k], place) for k in (0, 1)])
        sums, p = np.zeros(model.probabilities.shape), model.probabilities[:, 0]
        language_id.expected_counts(pieces, model.probabilities, 0, Counter([word]), sums)
        want, whole = np.zeros(len(p)), log_sum_with_unknown(word, p, place)
        for a in range(len(word) if len(word) < 100 else 0):
            for b in range(a + 1, min(len(word), a + 4) + 1):
                if (k := place.get(word[a:b])) is not None:
                    want[k] += np.exp(log_sum_with_unknown(word[:a], p, place) + np.log(p[k]) + log_sum_with_unknown(word[b:], p, place) - whole)
        assert len(word) >= 100 or sums[:, 0] == pytest.approx(want)
        # All letters lie in some piece or stand for themselves.
        assert np.isfinite(sums).all() and (sums[:, 0] * [len(x) for x in pieces.pieces]).sum() <= len(word) + 1e-6
    best, score, _ = scorer.texts(["the house and the garden", f"the house and {run} the garden"])
    assert best[0] == best[1] and score[1] == pytest.approx(score[0], abs=1e-6) and 0 < score[1] <= 1
    assert scorer.texts([run, "", "1 2"])[0] == ["a", "und", "und"] and scorer.texts([run])[1] == pytest.approx([0.5])


def test_odd_training_rows_do_not_change_a_model(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the house and the garden of the king", "en"), ("das haus und der garten ist schön", "de")] * 8)]
    rows.append((90, "a " + "\u1200" * 60, "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True), public_tokenizers.path("piece_bpe_32k.model"))
    assert np.isfinite(model.probabilities).all()
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, model, "doc_id").collect()}
    assert all(got[k][0] == lang and 0 <= got[k][1] <= 1 for k, _, lang in rows)
    with pytest.raises(ValueError):
        language_id.train(df, F.lit(True), public_tokenizers.path("piece_bpe_32k.model"), most_languages=1)


def test_language_id(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the house and the garden of the king", "en"), ("das haus und der garten ist schön", "de"), ("la maison et le jardin du roi est", "fr")] * 8)]
    rows += [(90, None, "en"), (91, "", "en"), (92, "12 !!", None), (None, "the the", "en"), (93, "THE KING, the garden.", None), (94, "und der garten" * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.train(df, F.lit(True), path)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, model, "doc_id").collect()}
    assert all(got[k][0] == lang for k, t, lang in rows[:24]) and got[93][0] == "en" and got[94][0] == "de"
    assert got[90] == got[91] == got[92] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    kept = language_id.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert {r.doc_id: r.lang for r in kept.collect()} == {k: v[0] for k, v in got.items() if v[0] != "und"}
    none = language_id.train(df, F.lit(False), path)
    assert Counter((r.doc_id, r.lang) for r in language_id.keep_known(df, none).collect()) == Counter((k, lang) for k, _, lang in rows if k not in (90, 91, 92))
    assert {r.lang_pred for r in language_id.predict(df, none, "doc_id").collect()} == {"und"}
    assert language_id.predict(df.limit(0), model, "doc_id").count() == 0


def test_language_id_held_out(spark):
    from tallyweave.llm.queries import op9_language_id

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    assert op9_language_id(spark, sf).join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_quality_held_out(spark):
    from tallyweave.llm.queries import op6_quality

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    assert op6_quality(spark, sf).join(truth, "doc_id").where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.95


def test_factorisation_identity():
    r = np.random.default_rng(2)
    machine = quality.Machine(8, 0.3, r.normal(size=8 + 2), r.normal(size=(8 + 2, 3)))
    where, values, stats = np.array([1, 4, 7]), r.random(3), r.random((1, 2))
    x = np.zeros(10)
    x[where], x[8:] = values, stats[0]
    raw = 0.3 + machine.weights @ x + sum(machine.factors[i] @ machine.factors[j] * x[i] * x[j] for i in range(10) for j in range(i))
    assert machine.scores(np.zeros(3, int), where, values, stats)[0] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_fit_follows_the_gradient():
    """One step of one batch moves every parameter against the loss's slope as finite differences tell it."""
    r = np.random.default_rng(4)
    rows = [(np.sort(r.choice(6, 3, replace=False)), r.random(3)) for _ in range(5)]
    stats, labels = r.random((5, 2)), np.array([0.0, 1, 1, 0, 1])

    def loss(machine):
        row = np.repeat(np.arange(5), 3)
        p = machine.scores(row, np.concatenate([x for x, _ in rows]), np.concatenate([v for _, v in rows]), stats)
        return -np.mean(np.log(np.where(labels == 1, p, 1 - p)))

    start = quality.Machine(6, 0.0, np.zeros(8), np.random.default_rng(7).normal(0, 0.05, (8, 3)))
    after = quality.fit(rows, stats, labels, 6, rank=3, epochs=1, rate=1e-3, seed=7)
    for name in ("weights", "factors"):
        old, step = getattr(start, name), getattr(after, name) - getattr(start, name)
        for place in np.ndindex(old.shape):
            values = []
            for d in (1e-5, -1e-5):
                moved = old.copy()
                moved[place] += d
                values.append(loss(quality.Machine(6, 0.0, *(moved if name == x else getattr(start, x) for x in ("weights", "factors")))))
            slope = (values[0] - values[1]) / 2e-5
            if abs(slope) > 1e-4:
                assert step[place] * slope < 0, (name, place)


def test_long_rows_are_learnt_whole(spark):
    text = " ".join(f"w{k}" for k in range(9000))
    df = spark.createDataFrame([(1, text, None), (2, "short", None)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    machine = quality.train(df, labels, F.lit(True))
    row, where, values, stats = quality.Features(1 << 13).of([text], np.array([np.nan]))
    assert len(where) > 4000 and (machine.weights[where] != 0).all()


def test_quality_edge_cases(spark):
    df = frame(spark, ODD).withColumn("n_chars", F.when(F.col("doc_id") > 3, F.length("text")))
    labels = spark.createDataFrame([(k, q) for k in (1, 4, 5, 6) for q in (k % 2, None)] + [(None, 1), (99, 0)], "doc_id long, quality int")
    for chosen in (F.lit(True), F.lit(False)):
        rows = quality.score(df, quality.train(df, labels, chosen)).collect()
        assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows} == {0.5}
    assert quality.score(df.limit(0), quality.train(df.limit(0), labels, F.lit(True))).count() == 0


def test_marginals_equal_enumeration():
    r = random.Random(7)
    for _ in range(20):
        n = r.randint(1, 7)
        parents = [-1] + [r.randrange(k) for k in range(1, n)]
        unary, joint = [r.uniform(-2, 2) for _ in range(n)], [tuple(r.uniform(-2, 2) for _ in range(4)) for _ in range(n)]
        weight, pairs = defaultdict(float), defaultdict(float)
        for bits in range(1 << n):
            x = [bits >> k & 1 for k in range(n)]
            w = np.exp(sum(u for u, v in zip(unary, x, strict=True) if v) + sum(joint[k][2 * x[parents[k]] + x[k]] for k in range(1, n)))
            for k in range(n):
                weight[k, x[k]] += w
                if k:
                    pairs[k, 2 * x[parents[k]] + x[k]] += w
        odds, found = html_text.marginals(parents, unary, joint)
        total = weight[0, 0] + weight[0, 1]
        for k in range(n):
            assert odds[k] == pytest.approx(np.log(weight[k, 1] / weight[k, 0]))
            assert not k or found[k] == pytest.approx([pairs[k, j] / total for j in range(4)])


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div><div class="ad">Buy this fine thing now.</div><article><h1>A  title &amp; more&hellip;</h1><p><b>First line\nof text.<br><p>Second &#233;t&eacute; with <a href="/x">a link</a> in it.</p><!-- c --><ul><li>One point here.</li></ul></article><aside><h3>Related</h3><p>Other long story to read here today.</p></aside><form><p>Sign up for our letter.</p><input><button>Go</button></form><div id="comments"><h3>Comments</h3><p>I think that this is quite wrong.</p></div><footer>&copy; site &middot; All rights.</footer></body></html>'


def test_html_text(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "plain  text"), (4, "plain  text"), (5, "<p>a &amp b<p>c<script>x<p>"), (6, "<div>x<!-- open"), (None, "<" * 5000 + "<p "), (7, "<div>" * 3000 + "deep text in here.")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")).withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text) for r in html_text.extract_text(df).collect()]
    text = dict(got)
    assert text[1] == "A title & more…\nFirst line of text.\nSecond été with a link in it.\nOne point here."
    assert (text[2], text[3], text[4], text[5], text[6]) == ("", "", "plain text", "a & b\nc", "x") and len(got) == len(rows) and text[7] == "deep text in here."
    assert html_text.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("value", ['"12.5"', '""', '"top"', '"0"', "'1'", "x"])
def test_data_y_of_real_pages_is_not_read(value):
    model = html_text.fit(html_text.labelled_pages(20))
    plain = html_text.extract(PAGE, model)
    assert html_text.extract(PAGE.replace("<p>", f"<p data-y={value}>").replace("<nav>", f"<nav data-y={value}>"), model) == plain


def wrong_share(model, pages):
    wrong = total = 0
    for source in pages:
        nodes = html_text.parse(source).nodes
        odds, _ = html_text.marginals([n.parent for n in nodes], [html_text.ROOT, *(sum(model.unary[f] for f in html_text.features(n)) for n in nodes[1:])], [model.joint[html_text.child_kind(n)] for n in nodes])
        for n, o in zip(nodes[1:], odds[1:], strict=True):
            total += 1
            wrong += (o >= 0) != (n.label == 1)
    return wrong / total


def test_labelled_pages_that_were_not_trained_on():
    assert wrong_share(html_text.fit(html_text.labelled_pages()), html_text.labelled_pages(100, seed=99)) < 0.03


def test_names_that_were_not_trained_on():
    """Half of the names of each kind train the model, the other half are on the pages it reads."""
    halves = [{kind: " ".join(words.split()[k::2]) for kind, words in html_text.NAMES.items()} for k in (0, 1)]
    model = html_text.fit(html_text.labelled_pages(names=halves[0]))
    assert wrong_share(model, html_text.labelled_pages(100, seed=99, names=halves[1])) < 0.03


LAYOUTS = [
    ('<body><table><tr><td class="sidebar"><a href="/">Home</a> <a href="/n">News</a> <a href="/o">Other</a></td><td><h1>Title of it</h1><p>First paragraph of a long story that is told here.</p><p>Second one.</p></td></tr></table><div id="bottom">Copyright &copy; us.</div></body>', "Title of it\nFirst paragraph of a long story that is told here.\nSecond one."),
    ('<body class="home"><div id="masthead"><h2>The Site</h2></div><div class="entry-content"><h1>On <i>x</i></h1><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be a number in this text.</p><pre>code\n here</pre></div><div class="comment-list"><p>I do not agree with that.</p></div></body>', "On x\nLet x=2 be a number in this text.\ncode here"),
    ('<main><section><h2>Part one</h2><dl><dt>Term</dt><dd>What it means in full.</dd></dl></section><aside class="newsletter"><p>Subscribe to our letter.</p></aside></main><nav><a href="/a">a</a></nav>', "Part one\nTerm\nWhat it means in full."),
]


@pytest.mark.parametrize("source, want", LAYOUTS)
def test_other_layouts(source, want):
    assert "\n".join(html_text.extract(source, html_text.fit(html_text.labelled_pages()))) == want


BAD = ["<div>{n}</p>{n}", "<a {n}", "</a {n}", "<a '{n}>", "<a \" {n}>", "<a '> {n}", "<b>{n}<div></b>{n}", "<div>{n}<dt></dt>{n}", "<dd><ul><div>{n}<dt></dt>{n}", "<li>{n}", "<!{n}", "<!-- {n}", "<p>x{n}", "<script>{n}", "<a><p>{n}</a>{n}", "<{n}", "<span>{n}<li>{n}", "<td>{n}<tr>{n}", "</{n}>"]


@pytest.mark.parametrize("bad", BAD)
def test_pages_are_read_in_linear_time(bad):
    import time

    def seconds(n):
        parts = bad.split("{n}")
        source = "".join(p * (n if k < len(parts) - 1 else 1) for k, p in enumerate(parts))
        best = 9e9
        for _ in range(2):
            began = time.process_time()
            html_text.parse(source, labelled=False)
            best = min(best, time.process_time() - began)
        return best

    seconds(100)
    assert seconds(20_000) < 2 or seconds(40_000) < 3 * seconds(20_000)


def test_pages_of_the_table_give_their_article(spark):
    import html
    import re

    model = html_text.fit(html_text.labelled_pages())
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert "\n".join(html_text.extract(r.html, model)) == "\n".join(b for b in blocks if b)
