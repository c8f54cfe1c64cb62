"""SimHash near-duplicates against brute force, and the odd inputs."""

import random
import re

import xxhash

from costlake.llm import simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, prints[i], least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        docs = docs.selectExpr("*", "'x' as fingerprint", "1 as component_id", "2 as id", "3 as u")
    got = simhash.near_duplicates(docs).collect()
    return sorted(((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in got), key=str)


def test_copies_near_copies_and_odd_rows(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["Éa", "ẞ", "İx"]
    rows, base = [], [rng.choice(vocab) for _ in range(300)]
    for i in range(160):
        words = list(base) if i % 2 else [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 60]))]
        for _ in range(i % 9 if i % 2 else 0):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((1000 - i, "\t ".join(words) if i % 3 else " ".join(words).upper()))
    rows += [(5, None), (6, ""), (7, " \n\t"), (8, " "), (None, rows[1][1]), (None, "alone here"), rows[3], rows[3],
             (9, "long " * 70000)]
    assert found(spark, rows, extra=True) == brute(rows)


def test_every_small_distance_is_linked(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base:
        for flips in range(1, 8):
            x = b
            for bit in rng.sample(range(64), flips):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    pairs = {(p, q) for p in prints for q in prints if p < q and bin(p ^ q).count("1") <= 4}

    def classes(links):
        root = {p: p for p in prints}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in links:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        return {p: top(p) for p in prints}

    for bits in (2, 7):
        links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.ball_links(df, 4, bits).collect()]
        assert classes(links) == classes(pairs)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    got = dict(simhash.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 50))


def test_empty_table(spark):
    assert found(spark, []) == []


def test_slices_of_variants_find_the_same():
    import numpy as np
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = np.array(sorted({base ^ (1 << i) ^ (1 << j) for i in range(0, 40, 3) for j in range(0, 20)}), np.uint64)
    spent = np.zeros(len(prints), int)
    near = lambda i, j: np.bitwise_count(prints[i] ^ prints[j]) <= 4
    nodes = [sorted(simhash.meet(prints, spent, 62, 2, near, prints, most)) for most in (10**9, 5000)]
    assert {n for n, _ in nodes[0]} == {n for n, _ in nodes[1]} and {r for _, r in nodes[0]} == {r for _, r in nodes[1]}


def test_a_dense_cluster_grows_no_slice_and_no_group(spark, monkeypatch):
    import numpy as np
    rng = random.Random(11)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 1200:  # within 3 bits of one print: nearly all of their variants share the leading bits
        x = base
        for bit in rng.sample(range(40), rng.randrange(1, 4)):
            x ^= 1 << bit
        prints.add(x)
    prints = np.array(sorted(prints), np.uint64)
    near = lambda i, j: np.bitwise_count(prints[i] ^ prints[j]) <= 4
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **k: (sizes.append(len(a)), sort(a, *x, **k))[1])
    links = simhash.meet(prints, np.zeros(len(prints), int), 62, 2, near, prints, 20_000)
    assert max(sizes) <= 20_000 and len({n for n, _ in links}) == len(prints) - 1
    monkeypatch.undo()
    signed = [(int(p),) for p in prints.view(np.int64)]
    df = spark.createDataFrame(signed, "fingerprint long")
    sent = df.selectExpr("fingerprint", "0 as spent", "shiftrightunsigned(fingerprint, 62) as prefix")
    dealt = simhash._split_by_bits(sent, 62, 2, 700)
    assert dealt.groupBy("low", "prefix").count().agg({"count": "max"}).first()[0] <= 700
    one = simhash.components(simhash.ball_links(df, 4, 2, most_rows=700))
    assert one.count() == len(prints) - 1 and one.select("root").distinct().count() == 1


def test_first_rows_of_groups(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    near = [*words[:-1], "changed"]
    rows = [(3, " ".join(words), "b"), (3, " ".join(words), "a"), (7, " ".join(near), "c"), (None, "alone", "e"), (None, "alone", "d"),
            (None, "other words", "f"), (9, None, "g"), (8, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string")
    got = {r.place: (r.component_id, r.is_first) for r in simhash.near_groups(docs, carry=("place",)).collect()}
    same = brute_print(rows[0][1]) ^ brute_print(rows[2][1])
    assert same.bit_count() <= 4
    assert got == {"a": (3, True), "b": (3, False), "c": (3, False), "d": (None, True), "e": (None, False), "f": (None, True),
                   "g": (8, False), "h": (8, True)}
