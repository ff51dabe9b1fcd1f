import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm.common import fresh_path
from millrace.llm.packing import fullest, min_bin_slack, pack, recipe
from millrace.llm.sharding import position, shard
from millrace.llm.tokens import WordEncoder, count_huge, count_tokens, open_tokenizer
from millrace.llm.warc import file_system, members, parse, read_archives, write_archives

pytest.importorskip("public_tokenizers")
BYTE, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def test_sharding(make, odd_rows):
    rows = [*odd_rows, *[(1000 + i, f"text {i}") for i in range(500)]]
    got = shard(make(rows)).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        place = position(r.row_number, len(rows), 20240)
        assert (r.shard, r.slot) == (place % 24, place // 24)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(24)]
    assert max(counts) - min(counts) <= 1
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want


def test_sharding_does_not_depend_on_layout(make, odd_rows):
    a, b = (sorted(map(str, shard(make(odd_rows, partitions=p)).collect())) for p in (1, 5))
    assert a == b


def test_sharding_small_and_repeated(make):
    assert shard(make([])).collect() == []
    for n in (1, 2, 3, 25):
        got = shard(make([(7, "same")] * n), shards=4).collect()
        assert sorted((r.slot, r.shard) for r in got) == sorted((p // 4, p % 4) for p in range(n))


def test_sharding_of_a_row_repeated_beyond_a_run(make, monkeypatch):
    import millrace.llm.sharding as sharding

    monkeypatch.setattr(sharding, "RUN", 50)
    rows = [(7, "same")] * 1800 + [(None, None)] * 101 + [(i, f"t{i}") for i in range(99)]
    got = shard(make(rows), buckets=64)
    assert got.select("row_number").distinct().count() == len(rows)
    slots = defaultdict(list)
    for r in got.collect():
        place = position(r.row_number, len(rows), 20240)
        assert (r.shard, r.slot) == (place % 24, place // 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_cycles_are_walked_to_their_end(make, monkeypatch):
    import millrace.llm.sharding as sharding

    monkeypatch.setattr(sharding, "WALK", 1)
    rows = [(i, f"t{i}") for i in range(43)]  # a grid of 49 cells
    got = shard(make(rows), shards=5).collect()
    assert sorted((r.slot, r.shard) for r in got) == sorted((p // 5, p % 5) for p in range(43))


def test_packing_of_one_row_repeated(make):
    rows = [(3, "the same row of text")] * 900 + [(i, "tok " * (i % 50)) for i in range(100)]
    got = pack(make(rows), capacity=64).collect()
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 1000
    for taken in places.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= 64
    # Ten of the repeated rows, of six tokens, fill 60 of 64.
    assert len(places) <= -(-sum(r.length for r in got) // 60) + 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000])
def test_permutation(n):
    assert sorted(position(i, n, 5) for i in range(n)) == list(range(n))


def test_huge_counts_equal_the_library():
    draw, tok = random.Random(1), open_tokenizer(BYTE)
    parts = ["a", "b", "é", " ", "  ", "\n", "\t", "'ll", "'r", "e", "1", "22", "<|endoftext|>", "<|endof", "!?", "日本", " x x x", "ab" * 30]
    for _ in range(600):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 300)))
        want = len(tok.encode(text, add_special_tokens=False).ids)
        assert count_huge(tok, text, draw.choice([20, 64, 200]), draw.choice([4, 16])) == want
    assert count_huge(tok, "a" * 9000, 500, 20) == len(tok.encode("a" * 9000).ids)


def test_token_counts(make, odd_rows):
    tok = open_tokenizer(BYTE)
    rows = [*odd_rows, (60, "x <|endoftext|> y"), (61, "bye  now\n\n")]
    got = sorted(map(tuple, count_tokens(make(rows), huge=2000, chunk=700, overlap=40).collect()), key=str)
    want = []
    for i, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert count_tokens(make([])).collect() == []


def test_token_counts_of_a_sentencepiece_model(make, odd_rows):
    tok = open_tokenizer("piece_bpe_32k.model")
    got = {r.doc_id: r.n_tokens for r in count_tokens(make(odd_rows), "piece_bpe_32k.model").collect()}
    assert got[4] == len(tok.encode(odd_rows[3][1])) and got[2] == 0


def test_word_encoder_equals_the_library():
    draw, encoder = random.Random(2), WordEncoder(WORDS, limit=50)
    parts = ["a", "B", "é", "é", "́", " ", "  ", "\n", "\t", "\x1c", " ", "　", "'ll", "'r", "1", "22",
             "<|endoftext|>", "<|endof", "!?", "日本", "İ", "ß", "Σ", ".", "_", "ª", "µ", "\x00"]
    for _ in range(1500):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))
        want = np.array(encoder.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.ids(text) == want, text


def test_fullest_is_optimal():
    draw = random.Random(6)
    for _ in range(200):
        counts = {draw.randint(1, 20): draw.randint(1, 3) for _ in range(5)}
        room = draw.randint(0, 40)
        chosen = fullest(sorted(counts.items(), reverse=True), room)
        assert all(chosen.count(k) <= counts.get(k, 0) for k in chosen)
        sums = {0}
        for k, n in counts.items():
            for _ in range(n):
                sums |= {s + k for s in sums}
        assert sum(chosen) == max(s for s in sums if s <= room)


def test_patterns_use_up_all_pieces():
    counts = {k: (k * 7919) % 13 + 1 for k in range(1, 101)}
    used = defaultdict(int)
    for times, pattern in min_bin_slack(counts, 100):
        assert sum(k * c for k, c in pattern.items()) <= 100
        for k, c in pattern.items():
            used[k] += times * c
    assert used == counts
    bins = sum(t for t, _ in min_bin_slack(counts, 100))
    least = max(-(-sum(k * n for k, n in counts.items()) // 100), sum(n for k, n in counts.items() if k > 50))
    assert bins <= 1.01 * least + 1
    assert len(recipe({})["key"]) == 0


def test_packing(make, odd_rows):
    rows = [*odd_rows, *[(100 + i, "tok " * (i % 50)) for i in range(400)]]
    got = pack(make(rows), capacity=256).collect()
    tok = open_tokenizer(WORDS)
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[a : a + 256], dtype="<u4").tobytes()
            want.append((i, k, a, len(part) // 4, zlib.crc32(part)))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 256) + 2
    assert pack(make([])).collect() == []


PAGES = "page_id bigint, url string, html string, digest string, kind string, shard string"


def want_warc(rows):
    import hashlib

    by = defaultdict(list)
    for i, _, h in rows:
        by[h or ""].append(i)
    out = []
    for h, ids in by.items():
        data = h.encode()
        order = sorted(ids, key=lambda x: -1 if x is None else x, reverse=True)
        for k, i in enumerate(order):
            again = k > 0 and len(data) >= 1000
            out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", order[0] if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 1000
    rows = [(i, f"http://h/{i}", f"<html>{i}</html>" * (i + 1)) for i in range(40)]
    rows += [(100, "http://h/a b\r\nX: y", big), (101, None, big), (102, "http://h/é", big), (102, "http://h/é", big)]
    rows += [(200, "u", None), (201, "u", ""), (202, "u", "é" * 499), (203, "u", "é" * 500), (204, "u", "é" * 500), (None, "u", big)]
    rows += [(300, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (301, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "d", "k", "s") for r in rows], PAGES).repartition(5)
    folder = fresh_path(spark, "warc-test")
    manifest = write_archives(df, folder, roll_bytes=2000, shard_bytes=4000)
    got = sorted(map(tuple, read_archives(spark, folder).collect()), key=str)
    assert got == want_warc(rows)
    again = fresh_path(spark, "warc-test")
    other = write_archives(df.repartition(2), again, roll_bytes=2000, shard_bytes=4000)
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, manifest.collect()))
    files, top = file_system(folder)
    last = None
    for r in sorted(manifest.collect()):
        with files.open_input_stream(f"{top}/{r.file}", compression=None) as stream:
            kinds = [parse(m)[0]["WARC-Type"] for m in members(stream)]
        assert kinds[0] == "warcinfo" and len(kinds) == r.records + 1
        last = r
    assert last is not None
    with files.open_output_stream(f"{top}/{last.file}", compression=None) as out:
        out.write(b"broken")
    with pytest.raises(Exception):  # noqa: B017  whatever Spark wraps it in
        read_archives(spark, folder).collect()


def test_warc_of_rows_repeated_beyond_a_shard(spark, monkeypatch):
    import millrace.llm.warc as warc

    monkeypatch.setattr(warc, "RUN", 64)
    big = "y" * 1200
    rows = [(7, "http://h/7", big)] * 500 + [(7, "http://h/8", big)] * 3 + [(8, None, "small")] * 700 + [(None, "u", big)] * 200
    rows += [(i, f"http://h/{i}", big if i % 3 else f"page {i}" * 30) for i in range(100, 160)]
    df = spark.createDataFrame([(*r, "d", "k", "s") for r in rows], PAGES)
    found = []
    for parts in (2, 7):
        folder = fresh_path(spark, "warc-test")
        manifest = write_archives(df.repartition(parts), folder, shard_bytes=20_000)
        assert sorted(map(tuple, read_archives(spark, folder).collect()), key=str) == want_warc(rows)
        files = sorted(map(tuple, manifest.collect()))
        assert max(r[1] for r in files) <= 200 and len(files) >= 15
        found.append(files)
    assert found[0] == found[1]


def test_warc_without_a_manifest_is_no_archive(spark):
    folder = fresh_path(spark, "warc-test")
    write_archives(spark.createDataFrame([(1, "u", "x", "d", "k", "s")], PAGES), folder)
    files, top = file_system(folder)
    files.delete_file(f"{top}/manifest.parquet")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_archives(spark, folder).collect()


def test_warc_empty(spark):
    folder = fresh_path(spark, "warc-test")
    assert write_archives(spark.createDataFrame([], PAGES), folder).collect() == []
    assert read_archives(spark, folder).collect() == []
