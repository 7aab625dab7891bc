from collections import Counter

import xxhash

from pyspark.sql import functions as F

from docloom.llm import simhash


def fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=4):
    fps = [(i, fingerprint(t)) for i, t in rows]
    known = {f for i, f in fps if i is not None}  # fingerprints of rows without an id link by equality only
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] == fps[b][1] or known >= {fps[a][1], fps[b][1]}) and (fps[a][1] ^ fps[b][1]).bit_count() <= distance:
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, f"{f:016x}", low.get(find(k))) for k, (i, f) in enumerate(fps))


def test_matches_brute_force(docs, rows):
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_chunked_buckets_lose_no_link(spark):
    rng = __import__("random").Random(3)
    base = rng.getrandbits(63)
    fps = {base}
    for _ in range(400):
        fps.add(base ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)))
    fps |= {rng.getrandbits(63) for _ in range(200)}
    nodes = spark.createDataFrame(list(enumerate(sorted(fps))), "rep long, fp long")
    from docloom.llm.common import components

    got = {(r.node, r.component) for r in components(simhash.near_links(nodes, chunk=50)).collect()}
    ids = {f: i for i, f in enumerate(sorted(fps))}
    near = [f for f in fps if any(f != g and (f ^ g).bit_count() <= 4 for g in fps)]
    assert {n for n, _ in got} == {ids[f] for f in near}
    cluster = {c for n, c in got if n == ids[base]}
    assert cluster == {min(ids[f] for f in fps if (f ^ base).bit_count() <= 2 or f == base)}


def test_empty_and_single(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(5, "a b c d e")], "doc_id long, text string")
    assert [tuple(r)[0::2] for r in simhash.near_duplicates(one).collect()] == [(5, 5)]


def test_keep_one(docs, rows):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    groups = {}
    for (i, _, c), _ in brute(rows).items():
        groups.setdefault(c, set()).add(i)
    assert len([i for i in kept if i in groups[3]]) == 1 and kept.count(165) <= 1


def largest_task(spark, frame, parts=16):
    """Share of the rows that the fullest partition of a shuffled result has, without broadcasts and without partitions put together."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(keep, (str(parts), "-1", "false")):
            spark.conf.set(k, v)
        sizes = [r[1] for r in frame().groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    return max(sizes) / sum(sizes)


def test_wordless_half_is_dealt(spark):
    """Half of the rows have no words, a third of them no id: fingerprint zero is no single task's."""
    rows = [(i if i % 3 else None, " ") for i in range(1500)] + [(2000 + i, f"text {i} of some {i * 7} words here {i % 11} more") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert largest_task(spark, lambda: simhash.near_duplicates(docs)) < 0.2
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect() if r.fingerprint == "0" * 16}
    assert got == {(i, 1) for i, _ in rows[:1500]}


def test_keep_one_is_the_smallest_text(spark):
    rows = [(1, "b b b b b", "x"), (1, "a a a a a", "z"), (1, "a a a a a", "y"), (None, "c c", "n"), (None, "c c", "m")]
    kept = lambda data: sorted(map(tuple, simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()), key=str)
    first = kept(rows)
    assert first == kept(rows[::-1]) and [r[:2] for r in first] == [(1, "a a a a a"), (None, "c c")]
