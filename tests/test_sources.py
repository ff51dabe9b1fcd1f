import gzip

import pytest
from pyspark.sql import functions as F

from millrace.functions import byte_length, extract_words, is_blank, split_lines
from millrace.sources import immediate, match_all, match_files, matches, read_all, read_matches, read_text
from millrace.sources import read_with_filename, synthetic_ranges, synthetic_source, synthetic_step, write_single
from millrace.sources.files import Compression, EmptyMatch, read_content
from millrace.sources.synthetic import SourceConfig


@pytest.fixture
def bucket(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "mixed.txt").write_bytes(b"a\r\nb\rc\n\nlast")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "z.gz").write_bytes(gzip.compress(b"gz1\ngz2\n"))
    (tmp_path / "sub" / "y.txt").write_bytes(b"y\n")
    (tmp_path / "odd [1].txt").write_bytes("é\n".encode())
    return "file://" + str(tmp_path)


@pytest.mark.parametrize(
    ("glob", "key", "yes"),
    [
        ("*", "a", True), ("*", "a/b", False), ("a/*", "a/b", True), ("?", "/", False), ("a?c", "abc", True),
        ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[^a-c]x", "dx", True), ("[^a]", "/", False),
        ("\\*", "*", True), ("\\*", "a", False), ("[", "[", False), ("a\\", "a\\", False), ("[]a]", "]", False),
        ("[\\]]", "]", True), ("[-]", "-", False), ("[b-a]", "a", False), ("", "", True), ("a", "ab", False), ("é*", "éa", True),
    ],
)
def test_globs(glob, key, yes):
    assert matches(glob, key) is yes


def keys(df):
    return sorted(r.key for r in df.collect())


def test_match_files(spark, bucket):
    assert keys(match_files(spark, bucket, "*.txt")) == ["empty.txt", "mixed.txt", "odd [1].txt"]
    assert keys(match_files(spark, bucket, "sub/*.txt")) == ["sub/y.txt"]
    assert keys(match_files(spark, bucket, "*/*")) == ["sub/y.txt"]
    row = match_files(spark, bucket, "mixed.txt").first()
    assert (row.bucket, row.size) == (bucket, 12) and row.last_modified is not None


def test_empty_matches(spark, bucket):
    assert keys(match_files(spark, bucket, "nope-*")) == []
    with pytest.raises(FileNotFoundError):
        match_files(spark, bucket, "nope")
    with pytest.raises(FileNotFoundError):
        match_files(spark, bucket, "nope-*", EmptyMatch.DISALLOW)
    assert keys(match_files(spark, bucket, "nope", EmptyMatch.ALLOW)) == []
    assert keys(match_files(spark, bucket, "[", EmptyMatch.ALLOW)) == []


def test_match_all(spark, bucket):
    globs = spark.createDataFrame([(bucket, "*.gz"), (bucket, "sub/*"), (bucket, " ")], "key string, value string")
    assert keys(match_all(globs)) == ["sub/y.txt", "z.gz"]
    with pytest.raises(ValueError):
        match_all(globs, most=1)
    assert sorted(r.value for r in read_all(globs).collect()) == ["gz1", "gz2", "y"]


def test_read_matches(spark, bucket):
    listed = match_files(spark, bucket, "*")
    extra = listed.select("bucket", F.lit("dir/").alias("key"), "size", "last_modified").limit(1)
    blobs = read_matches(listed.unionByName(extra))
    assert keys(blobs) == ["empty.txt", "mixed.txt", "odd [1].txt", "z.gz"]
    with pytest.raises(IsADirectoryError):
        read_matches(listed.unionByName(extra), directories="disallow")
    assert {r.key: r.gzipped for r in blobs.collect()}["z.gz"]
    got = {r.key: r.content for r in read_content(read_matches(match_files(spark, bucket, "[emz]*")), text=True).collect()}
    assert got == {"empty.txt": "", "mixed.txt": "a\r\nb\rc\n\nlast", "z.gz": "gz1\ngz2\n"}
    raw = read_content(read_matches(match_files(spark, bucket, "*.gz"), Compression.NONE)).first().content
    assert gzip.decompress(bytes(raw)) == b"gz1\ngz2\n"


def test_read_text(spark, bucket):
    assert [r.value for r in read_text(spark, bucket, "mixed.txt").collect()] == ["a\r", "b\rc", "", "last"]
    assert read_text(spark, bucket, "empty.txt").collect() == []
    assert sorted(r.value for r in read_text(spark, bucket, "*.gz").collect()) == ["gz1", "gz2"]
    assert read_text(spark, bucket, "nope").collect() == []
    assert [r.value for r in read_text(spark, bucket, "odd \\[1\\].txt").collect()] == ["é"]


def test_read_with_filename(spark, bucket):
    got = sorted((r.key, r.value) for r in read_with_filename(spark, bucket, "sub/*").collect())
    assert got == [("sub/y.txt", "y")]
    assert read_with_filename(spark, bucket, "odd*").first().key == "odd [1].txt"
    assert read_with_filename(spark, bucket, "nope").columns == ["key", "value"]


def test_write_single(spark, tmp_path):
    top = "file://" + str(tmp_path / "new")
    out = write_single(spark.createDataFrame([("a",), ("b",), ("",)], "value string"), top, "x/out.txt")
    assert [r.value for r in out.collect()] == [top + "/x/out.txt"]
    assert sorted((tmp_path / "new/x/out.txt").read_text().split("\n")) == ["", "", "a", "b"]
    again = write_single(spark.createDataFrame([("c",)], "value string"), top, "x/out.txt")
    assert again.count() == 1 and (tmp_path / "new/x/out.txt").read_text() == "c\n"
    none = write_single(spark.createDataFrame([], "value string"), top, "none.txt")
    assert none.collect() == [] and not (tmp_path / "new/none.txt").exists()
    assert not [p for p in (tmp_path / "new").iterdir() if p.name.startswith("_temporary")]


def test_immediate(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"a\r\nb\n\nc")
    assert [r.value for r in immediate(spark, str(tmp_path / "f")).collect()] == ["a", "b", "", "c"]


def test_text_functions(spark):
    df = spark.createDataFrame([("it's King Lear's o'clock", " \t"), ("é\nx\n", "x ")], "t string, s string")
    rows = df.select(extract_words(F.col("t")).alias("w"), byte_length(F.col("t")).alias("n"), is_blank(F.col("s")).alias("b"), split_lines(F.col("t")).alias("l")).collect()
    assert rows[0].w == ["it's", "King", "Lear's", "o'c", "lock"] and rows[0].b and not rows[1].b
    assert rows[1].n == 5 and rows[1].l == ["é", "x"]


def test_synthetic(spark):
    source = synthetic_source(spark, SourceConfig(20, key_size=5, value_size=40, initial_splits=4))
    rows = source.collect()
    assert source.rdd.getNumPartitions() == 4 and len(rows) == 20
    assert {(len(r.key), len(r.value)) for r in rows} == {(5, 40)} and len({bytes(r.key) for r in rows}) == 20
    assert SourceConfig(100, 10, 10, desired_split_bytes=500).splits() == 4
    df = spark.range(1000)
    assert synthetic_step(df, outputs=3).count() == 3000
    assert 300 < synthetic_step(df, filter_ratio=0.5, seed=1).count() < 700
    assert synthetic_ranges(df, 4).count() == 4000
    assert synthetic_step(df, per_element_ns=1000, per_bundle_ns=1000).count() == 1000
    with pytest.raises(ValueError):
        synthetic_step(df, filter_ratio=2)
    with pytest.raises(ValueError):
        SourceConfig(-1).splits()
