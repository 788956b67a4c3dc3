"""The pipeline against the same stages done plainly on a small table."""

import hashlib
import itertools
import random
import re
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from codeweft.llm.quality import THRESHOLD, fit

WORDS = "the of and to in under version stone river light tree house running water long short over".split()


def passage(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(n))


def junk(seed):
    rnd = random.Random(seed)
    return " | ".join(rnd.choice("!$%&#") * 3 + w for w in passage(seed, 50).split())


def test_pipeline(spark, tmp_path):
    texts = {i: junk(i) if i % 4 == 0 else passage(i, 60) for i in range(120)}
    leak = passage(5000, 12)
    texts |= {200: texts[1], 201: texts[1], 202: texts[2] + " end", 203: texts[2] + " end more", 204: passage(7, 30) + " " + leak + " " + passage(8, 30), 205: passage(300, 60) + " <|endoftext|> é"}
    labels = [(i, int(i % 4 != 0)) for i in range(110)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = dict(zip(texts, model.score([t.encode() for t in texts.values()])))
    kept = {i: t for i, t in texts.items() if scores[i] >= THRESHOLD}
    kept = {i: t for i, t in kept.items() if i == max(j for j, u in kept.items() if u == t)}
    sets = {i: set(zip(*[t.lower().split()[k:] for k in range(5)])) for i, t in kept.items()}
    root = {i: i for i in kept}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(kept), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    kept = {i: t for i, t in kept.items() if find(i) == i}
    window = re.findall("[a-z0-9]+", leak)
    grams = {tuple(window[i : i + 10]) for i in range(len(window) - 9)}
    kept = {i: t for i, t in kept.items() if not grams & set(zip(*[re.findall("[a-z0-9]+", t.lower())[k:] for k in range(10)]))}
    assert 200 not in kept and 203 not in kept and 204 not in kept and not any(i % 4 == 0 for i in kept if i < 120)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(kept)
    for i, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and list(struct.unpack(f"<{len(ids)}I", got[i].ids)) == ids
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
