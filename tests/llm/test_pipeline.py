"""The pipeline against a brute-force version on a small table with planted cases."""

import hashlib
import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallyweave.llm.decontaminate import words_of

from .test_operators import brute_cut, levenshtein

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def small_table(seed=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, item = prose(60), prose(16)
    rows = [(k, prose(r.randint(30, 90))) for k in range(12)]
    rows += [(20, rows[3][1]), (21, rows[3][1].upper() + "!"), (22, rows[4][1].replace(" ", "  ", 3))]
    near = rows[5][1].split()
    near[4] = "changed"
    rows += [(23, " ".join(near)), (30, prose(60) + " " + passage + " " + prose(70)), (31, prose(80) + " " + passage), (32, passage + " " + prose(65))]
    rows += [(40, prose(20) + " " + item + " " + prose(20)), (41, "123 456 !!"), (42, None), (43, ""), (44, "é" * 150 + " " + prose(5)), (45, prose(30) + " " + "é" * 150)]
    docs = [(k, t, r.choice(["en", "fr"]), "s", len(t or "")) for k, t in rows]
    return docs, [(1, item), (2, None)]


def brute(docs, items):
    rows = [(k, t) for k, t, *_ in docs if t and any(c.isalpha() for c in t)]
    labels = {k: k for k, _ in rows}
    for i, (k, t) in enumerate(rows):
        for j, u in rows[:i]:
            a, b = words_of(t), words_of(u)
            if levenshtein(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                old, new = max(labels[k], labels[j]), min(labels[k], labels[j])
                labels = {x: new if y == old else y for x, y in labels.items()}
    rows = [(k, t) for k, t in rows if labels[k] == k]
    rows = [(k, t) for k, b in brute_cut(rows, 200) if (t := b.decode("utf-8", "ignore"))]

    def leaks(text):
        words = words_of(text)
        for _, item in items:
            want = words_of(item or "")
            d = int(len(want) * 0.2 + 1e-9)
            if want and any(levenshtein(want, words[s : s + n]) <= d for s in range(len(words)) for n in range(len(want) - d, len(want) + d + 1)):
                return True
        return False

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for k, t in rows:
        if not leaks(t):
            ids = library.encode(t, add_special_tokens=False).ids
            out[k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def test_pipeline(spark, tmp_path):
    docs, items = small_table()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, found.collect())) == brute(docs, items)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items = small_table()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = spark.createDataFrame(docs, SCHEMA)
    for empty in (False, True):
        df = given.limit(0) if empty else given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.dtypes == given.dtypes and (out.count() == 0) == empty
