import random

import corpus_pipeline as cp
from gneiss.llm.simhash import fingerprint
from tests.llm.test_simhash import slow_components

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(texts, least=0.8):
    """Ids that stay, by brute force over all pairs: SimHash within two bits or Jaccard from least."""
    root = slow_components({i: fingerprint(t, 5) % 2**64 for i, t in texts.items()})

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingles(t) for i, t in texts.items()}
    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    similar = 0
    for b in sets:
        for a in {a for x in sets[b] for a in where[x] if a < b}:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                similar += texts[a] != texts[b]
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in texts if find(i) == i}, similar


def changed(rnd, base, count):
    words = base.split()
    for k in rnd.sample(range(len(words)), count):
        words[k] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def test_stage_matches_brute_force_jaccard(spark):
    rnd = random.Random(8)
    bases = [" ".join(f"w{rnd.randrange(10**5)}" for _ in range(n)) for n in (60, 200, 390, 450, 3000)]
    made = [changed(rnd, b, int(len(b.split()) * share)) for b in bases for share in (0, 0.005, 0.01, 0.015, 0.02, 0.04, 0.1) for _ in range(2)]
    hot = " ".join(f"h{rnd.randrange(10**5)}" for _ in range(150))
    made += [changed(rnd, hot, 1) for _ in range(60)] + ["a b", "A  b", "a b c d e", "a b c d f", "", " \n", None]
    rnd.shuffle(made)
    texts = dict(enumerate(made))
    docs = spark.createDataFrame([*texts.items(), (None, made[0])], "doc_id long, text string")
    want, similar = slow_kept(texts)
    left = [r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()]
    assert similar > 50 and None in left and sorted(i for i in left if i is not None) == sorted(want)
    assert cp.drop_near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, similar = slow_kept({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert similar > 0 and {r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()} == want
