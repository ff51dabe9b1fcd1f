import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from millrace.llm.components import components
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.simhash import compare, fingerprint, near_groups

UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def norm(text):
    return (text or "").translate(UP)


def want_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(t.encode()).hexdigest()
        for k, i in enumerate(sorted(ids, key=lambda x: -1 if x is None else x, reverse=True)):
            out.append((i, keep, len(ids), k == 0, digest))
    return sorted(out, key=str)


def got_exact(df, **kw):
    return sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df, **kw).collect()), key=str
    )


def test_exact_against_brute_force(make, odd_rows):
    assert got_exact(make(odd_rows)) == want_exact(odd_rows)


def test_exact_with_narrow_digits(make, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 400]
    assert got_exact(make(rows), first_digit=3, growth=2) == want_exact(rows)


def test_exact_prefixes_and_a_hot_group(make):
    rows = [(i, "Same text of the hot group") for i in range(300)]
    rows += [(1000 + i, "same text of the hot group" + "!" * i) for i in range(40)]
    rows += [(2000 + i, "ab" * i) for i in range(40)]
    assert got_exact(make(rows, extra=False), first_digit=4, growth=2) == want_exact(rows)


def test_exact_empty(make):
    assert exact_dedup(make([])).collect() == []


def slow_fingerprint(text):
    words = norm(text).replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def near(rows, radius=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_simhash_against_brute_force(make, odd_rows):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = list(odd_rows)
    for i in range(40):
        base = [draw.choice(words) for _ in range(80)]
        for k in range(4):
            other = list(base)
            for _ in range(k):
                other[draw.randrange(80)] = draw.choice(words)
            rows.append((100 + 10 * i + k, " ".join(other)))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_groups(make(rows)).collect()), key=str)
    assert got == near(rows)


def test_simhash_whitespace_and_nul():
    for t in ("a\x0bb\x0cc d e", "A b c d e", "x\x1cy z", "\x00 a b c d"):
        assert fingerprint(t) == slow_fingerprint(t)


def test_simhash_of_one_text_repeated(make):
    draw = random.Random(14)
    rows = [(i, "one text that nearly all rows have in common") for i in range(900)]
    rows += [(1000 + i, " ".join(f"w{draw.randrange(900)}" for _ in range(60))) for i in range(60)] + [(None, "w1 w2")] * 40
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_groups(make(rows)).collect()), key=str)
    assert got == near(rows)


@pytest.mark.parametrize(("block", "row"), [(64, 2), (16, 3)])
def test_simhash_in_many_blocks(make, monkeypatch, block, row):
    import millrace.llm.simhash as simhash

    monkeypatch.setattr(simhash, "BLOCK_LEAST", block)
    monkeypatch.setattr(simhash, "ROW_OF_TILES", row)
    draw = random.Random(15)
    base = [[f"w{draw.randrange(300)}" for _ in range(90)] for _ in range(130)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(1000 + i, " ".join([*w[:45], "z", *w[46:]])) for i, w in enumerate(base)]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_groups(make(rows)).collect()), key=str)
    assert got == near(rows)


def test_simhash_empty(make):
    assert near_groups(make([])).collect() == []


@pytest.mark.parametrize("size", [40, 700])
def test_tiles_find_every_link(size):
    draw = np.random.default_rng(size)
    base = draw.integers(0, 1 << 63, size=size // 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << draw.integers(0, 64, len(base), dtype=np.uint64)) for _ in range(3)]))
    half = len(fps) // 2
    links = []
    for left, right in ((fps[:half], None), (fps[half:], None), (fps[:half], fps[half:])):
        a, b = compare(left.copy(), None if right is None else right.copy(), 4)
        assert len(a) <= len(fps)
        links += list(zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True))
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        parent[find(x)] = find(y)
    listed = [int(f) for f in fps]
    truth = {f: f for f in listed}

    def root(x):
        while truth[x] != x:
            x = truth[x]
        return x

    for i, x in enumerate(listed):
        for y in listed[:i]:
            if (x ^ y).bit_count() <= 4:
                truth[root(x)] = root(y)
    pairs = {(x, y): (find(x) == find(y), root(x) == root(y)) for i, x in enumerate(listed) for y in listed[:i]}
    assert all(a == b for a, b in pairs.values())


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 200)] + [(5, 5), (300, 301), (301, 300)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 201)} | {300: 300, 301: 300}
    assert got == want
    assert components(df.where("a < 0")).collect() == []
