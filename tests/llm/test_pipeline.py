import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_dedup import near, norm  # noqa: E402
from test_text_ops import contamination  # noqa: E402

from millrace.llm.packing import WordEncoder  # noqa: E402
from millrace.llm.toxicity import train  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with each kind of copy, toxic ones and contaminated ones."""
    draw = random.Random(9)
    common = [f"word{i}" for i in range(400)]
    passage = [" ".join(draw.choice(common) for _ in range(40)) for _ in range(5)]

    def prose(n=60):
        return [draw.choice(common) for _ in range(n)]

    rows, labels = [], []
    for i in range(300):
        text = prose()
        if i % 5 == 0:
            for bad in ("vile", "nasty", "awful"):
                text[draw.randrange(60)] = bad
            labels.append((i, 1, 1))
        elif i % 3 == 0:
            labels.append((i, 1, 0))
        rows.append((i, " ".join(text)))
    base = [" ".join(prose()) for _ in range(10)]
    for k, t in enumerate(base):
        rows += [(1000 + 10 * k + j, t.upper() if j % 2 else t) for j in range(4)]
        rows += [(2000 + 10 * k + j, t + " tail" * j) for j in range(1, 4)]
    rows += [(3000 + k, " ".join(prose(30)) + " " + passage[k % 5] + " " + " ".join(prose(30))) for k in range(20)]
    rows += [(4000, None), (4001, ""), (4002, "  "), (4003, base[0]), (4003, base[0]), (None, "no id here at all")]
    # Columns of clashing names, nulls in any column.
    rows = [(i, t, "en", "src" if i else None, len(t or ""), "x", None, "y", "z", 1) for i, t in rows]
    top = tmp_path_factory.mktemp("corpus")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash_ string, maybe_ string, key_ string, rid string, gone_ int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(enumerate(passage)), "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), rows, list(enumerate(passage))


def test_stages_against_brute_force(spark, corpus, tmp_path):
    top, rows, items = corpus
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns = docs.columns
    model = train(docs, spark.read.parquet(f"{top}/labels.parquet"))
    kept = [(i, t) for i, t, *_ in rows]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, top).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        before = len(kept)
        if k == 0:
            kept = [(i, t) for i, t in kept if model.score(t or "") < 0.7]
        elif k == 1:
            best = {}
            for i, t in kept:
                best[norm(t)] = max(best.get(norm(t), -1), -1 if i is None else i)
            found = sorted(((-1 if i is None else i, norm(t)) for i, t in got), key=str)
            assert found == sorted(((i, t) for t, i in best.items()), key=str)
            kept = got
        elif k == 2:
            keep = {d for d, _, c in near(kept) if d == c}
            kept = [(i, t) for i, t in kept if i in keep or i is None]
        else:
            bad = {r[0] for r in contamination(kept, items) if r[5]}
            kept = [(i, t) for i, t in kept if i not in bad]
        assert got == sorted(kept, key=str), name
        assert len(kept) < before, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, top).collect()
    encoder = WordEncoder("word_bpe_49k.json")
    want = {i: len(encoder.ids(t or "")) // 4 + 1 for i, t in kept}
    assert {r.doc_id: r.length for r in pieces} == want


def test_run_is_all_stages(spark, corpus, tmp_path):
    top, _, _ = corpus
    assert corpus_pipeline.run(spark, top).count() > 100


def test_empty_documents(spark, corpus, tmp_path):
    top, _, items = corpus
    docs = spark.read.parquet(f"{top}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, top).collect() == []


def test_stages_judge_rows_that_share_an_id(spark, corpus, make):
    top, _, items = corpus
    draw = random.Random(12)
    prose = [" ".join(f"u{draw.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    passage = items[0][1]
    rows = [(None, prose[0]), (None, prose[1]), (None, passage), (7, prose[2]), (7, passage + " more")]
    got = corpus_pipeline.decontamination_stage(spark, make(rows), top).collect()
    assert sorted((r.text for r in got)) == sorted(prose[:3])
    # Equal but for white space: near copies that exact deduplication leaves.
    rows = [(None, prose[0]), (None, prose[0] + " "), (None, prose[1]), (7, prose[2]), (7, prose[2] + " "),
            (7, prose[3]), (9, prose[4]), (None, prose[4] + " "), (11, prose[5]), (11, prose[5])]
    got = corpus_pipeline.near_stage(spark, make(rows), top).collect()
    assert sorted((str(r.doc_id), r.text.strip()) for r in got) == sorted(
        zip(("None", "None", "7", "7", "9", "11"), prose, strict=True)
    )


def test_stages_keep_whole_rows_whatever_repeats(spark, corpus):
    """Rows that share an id, a text, or all but another column; the verdict is each row's own."""
    top, _, items = corpus
    draw = random.Random(13)
    a, b, c = (" ".join(f"u{draw.randrange(5000)}" for _ in range(80)) for _ in range(3))
    schema = "doc_id bigint, text string, lang string, tags map<string,string>, row_ string, rid_ string"

    def make_rows(rows):
        return spark.createDataFrame([(i, t, lang, {"k": lang}, "x", None) for i, t, lang in rows], schema).repartition(3)

    # (5, a) is alone; (5, b) is a near copy of (3, b), which stays.
    got = corpus_pipeline.near_stage(spark, make_rows([(5, a, "de"), (5, b, "fr"), (3, b + " ", "en")]), top)
    assert got.columns == ["doc_id", "text", "lang", "tags", "row_", "rid_"]
    assert sorted((r.doc_id, r.text, r.tags["k"]) for r in got.collect()) == sorted([(5, a, "de"), (3, b + " ", "en")])
    # Two near copies that share an id: one stays, the same in every layout.
    found = set()
    for parts in (1, 2, 5):
        df = make_rows([(7, c, "de"), (7, c + " ", "fr"), (7, c, "en")]).repartition(parts)
        found.add(tuple((r.text, r.lang) for r in corpus_pipeline.near_stage(spark, df, top).collect()))
        exact = corpus_pipeline.exact_stage(spark, df, top).collect()
        assert sorted(r.text for r in exact) == sorted([c, c + " "])
        found.add(tuple(sorted((r.text, r.lang) for r in exact)))
    assert len(found) == 2
    bad = items[0][1]
    rows = [(None, bad, "de"), (None, a, "de"), (8, bad, "fr"), (8, a, "fr"), (8, a, "fr")]
    got = corpus_pipeline.decontamination_stage(spark, make_rows(rows), top).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", a), ("8", a), ("8", a)])
