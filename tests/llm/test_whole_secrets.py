"""Keys of letters alone reach the battery of op4, ordinary words don't pass it."""

import random
import string

from codeweft.llm import secret_scan


def test_keys_without_digits(spark):
    rnd = random.Random(5)
    keys = ["".join(rnd.choice(a) for _ in range(n)) for a, n in ((string.ascii_letters, 40), (string.ascii_uppercase, 32), (string.ascii_lowercase, 40), (string.ascii_letters, 24))]
    words = ["Donaudampfschifffahrtsgesellschaft", "internationalization", "Rechtsschutzversicherungsgesellschaften", "counterrevolutionaries", "src/components/navigation/header", "some_rather_long_identifier_name", "-" * 40, "x" * 30]
    texts = [f"before {x} after" for x in keys + words]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r.doc_id][s.start : s.end] for r in secret_scan.secret_scan(docs).collect() for s in r.added}
    assert got == set(keys)
