import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from treewright.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(rows, radius=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{fp:016x}", least[find(i)]) for i, ((d, _), fp) in enumerate(zip(rows, fps)) if d is not None)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def near_rows(n):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, None if i % 17 == 0 else "" if i % 19 == 0 else " ".join(r.choices(words, k=r.choice([1, 2, 3, 40, 400])))) for i in range(n)]
    for i in range(n, 2 * n):
        text = (rows[r.randrange(n)][1] or "").split()
        if text:
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((i, "\t ".join(text)))
    return rows + rows[:5]


def test_components_equal_brute_force_with_any_bucket_size(spark):
    rows = near_rows(150)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    for bucket in (4096, 6, 2):
        got = simhash.near_duplicates(docs, bucket=bucket).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted(map(tuple, got)) == plain(rows)


def test_all_pairs_within_radius_are_found():
    import numpy as np

    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(7))) for b in base for _ in range(15)]
    end = np.full(len(fps), len(fps))
    got = {(int(i), int(j)) for u, v in simhash.within_radius(np.array(fps, np.uint64), end, 4) for i, j in zip(u, v)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4}


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (4, "a  B"), (None, "c")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in got) == [(-1, -1), (-1, 4), (4, 4)]
