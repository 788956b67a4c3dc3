"""Proximity matches against every window and place, looked at one by one."""

import random
from collections import Counter

from codeweft.llm import decontaminate
from tests.llm.test_operators import alnum


def brute(texts, items, window, slop):
    words = [alnum(t) for t in texts]
    often = Counter(w for own in words for w in own)
    out = [set() for _ in texts]
    for item, body in items:
        own = alnum(body)
        for p in range(max(1, len(own) - window + 1) if own else 0):
            terms = own[p : p + window]
            rare = min(terms, key=lambda t: often[t])  # the first of several
            for d, doc in enumerate(words):
                for q, w in enumerate(doc):
                    if w == rare and set(terms) <= set(doc[max(0, q - slop) : q + slop + 1]):
                        out[d].add(str(item))
    return [sorted(x) for x in out]


def test_proximity_is_whole(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)] + ["é"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 4, 6, 9]))) for k in range(12)] + [(1, "w1 W2"), (20, None), (21, ""), (22, "w1 absent"), (23, "w3 w3 w3 w3")]
    texts = [say(rng.choice([0, 1, 5, 30, 60])) for _ in range(40)] + [None, "", "w3", "w3 w3"]
    # A reordered, an interrupted and a far-flung copy.
    texts += ["zz yy xx vv", "xx zz yy vv", "xx a yy b zz c vv", "xx a a a a a a yy zz vv"]
    items.append((30, "xx yy zz vv"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 1, 4, 9):
        want = brute(texts, items, 4, slop)
        for block in (decontaminate.BLOCK_BYTES, 30):
            rows = decontaminate.decontaminate(docs, bench, 4, block, slop).collect()
            assert {r.doc_id: list(r.near) for r in rows} == dict(enumerate(want))
    assert brute(texts, items, 4, 6)[-3:] == [["30"], ["30"], []]
    places = decontaminate.proximity_match(decontaminate.build_index(docs), bench, 4, 4).collect()
    assert {(r.doc_id, r.item_id) for r in places} == {(d, i) for d, found in enumerate(brute(texts, items, 4, 4)) for i in found}
    # Exact passages are near as well; without slop there is no such column.
    exact = decontaminate.decontaminate(docs, bench, 4, slop=4).collect()
    assert all(set(r["items"]) <= set(r.near) for r in exact)
    assert decontaminate.decontaminate(docs, bench, 4).columns == ["doc_id", "n_words", "spans", "items"]
    none = decontaminate.decontaminate(docs.limit(0), bench, 4, slop=4)
    assert none.count() == 0 and none.columns[-1] == "near"
    assert {len(r.near) for r in decontaminate.decontaminate(docs, bench.limit(0), 4, slop=4).collect()} == {0}
