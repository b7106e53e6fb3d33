import random
import re

import xxhash

from careline.llm.simhash import linked, meetings, simhash_groups


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = ([" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
                if len(words) >= 3 else [" ".join(words)])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, bits=2):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f"{fp:016x}", least.get(find(k))) for k, (i, fp) in enumerate(prints)),
                  key=str)


def result(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_against_brute_force_with_chains_and_copies(docs_of):
    rng = random.Random(5)
    words = [f"w{i}É" for i in range(60)]
    rows = []
    for i in range(0, 300, 3):
        base = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        near = list(base)
        if near:
            near[rng.randrange(len(near))] = "CHANGED"
        rows += [(i + 2, " ".join(base)), (i + 1, "\t".join(near)), (i, " ".join(near).upper())]
    assert result(simhash_groups(docs_of(rows))) == brute_groups(rows)


def test_odd_rows(docs_of):
    rows = [(7, None), (5, ""), (9, " \n"), (None, "a b"), (3, "one two"), (3, "one two"),
            (1, "x y z " * 60_000), (2, "X y z " * 60_000)]
    got = result(simhash_groups(docs_of(rows)))
    assert got == brute_groups(rows)
    assert (7, "0" * 16, 5) in got and (9, "0" * 16, 5) in got
    assert simhash_groups(docs_of([])).count() == 0


def test_more_bits(docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(3, 12))))
            for i in range(300)]
    got = result(simhash_groups(docs_of(rows), max_bits=3))
    assert got == brute_groups(rows, 3)


def test_tally_drops_pairs_that_share_too_few_bytes(spark):
    """Five shared bytes meet once, six in six postings, seven in twenty-one."""
    base = 0x0102030405060708
    rows = [base, base ^ 0x010101, base ^ 0x0101, base ^ 1, base ^ 0xFF, base ^ 0x01010101]
    classes = spark.createDataFrame([(r,) for r in rows], "fp long")
    met = {(r.a, r.b): r.n for r in meetings(classes).collect()}

    def n(x, y):
        return met.get((min(x, y), max(x, y)), 0)
    assert [n(base, r) for r in rows[1:]] == [1, 6, 21, 21, 0]
    got = {(r.a, r.b) for r in linked(classes).collect()}
    want = {(min(x, y), max(x, y)) for x in rows for y in rows
            if x != y and (x ^ y).bit_count() <= 2}
    assert got == want and len(met) > len(want)


def test_postings_are_not_broadcast_whatever_their_classes_weigh(spark):
    """56 postings a class: by their estimate even those of many classes would be broadcast."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    classes = spark.range(60).selectExpr("shiftleft(1L, CAST(id AS INT)) AS fp")  # of known size
    met = meetings(classes)
    assert met.count() > 0
    for plan in (met._jdf.queryExecution().executedPlan().toString(),
                 linked(classes)._jdf.queryExecution().executedPlan().toString()):
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_links_against_all_pairs_of_close_fingerprints(spark):
    rng = random.Random(9)
    rows = {rng.getrandbits(63) for _ in range(20)}
    for fp in [*rows]:
        for _ in range(12):
            for bit in rng.sample(range(63), rng.randint(1, 4)):
                fp ^= 1 << bit
            rows.add(fp)
    classes = spark.createDataFrame([(r,) for r in rows], "fp long")
    for bits in (1, 2, 3, 7):
        got = sorted((r.a, r.b) for r in linked(classes, bits).collect())
        assert got == sorted((x, y) for x in rows for y in rows
                             if x < y and (x ^ y).bit_count() <= bits)
