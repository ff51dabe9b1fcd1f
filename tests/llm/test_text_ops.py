import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm.decontamination import decontaminate
from millrace.llm.licences import OTHERS, TEMPLATES, UNKNOWN, examples, held_out_logits, least_confidence, prose_sample, scan, train
from millrace.llm.pii import find, luhn, personal_data, plain
from millrace.llm.toxicity import features, fit, hashed, held_out, risk, score, telling, toxic_share, toxicity, votes
from millrace.llm.toxicity import train as train_toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(UP))


def contamination(docs, items, window=13):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                if g in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        listed = ",".join(sorted(str(i) for i in found if i is not None))
        out.append(
            (doc, len(w), len(hit), len({i for i in found if i is not None}), hashlib.sha256(listed.encode()).hexdigest(),
             bool(hit) and 20 * len(hit) >= len(w))
        )
    return sorted(out, key=str)


def got_contamination(spark, docs, items, **kw):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(
        (tuple(r)[:6] for r in decontaminate(docs, bench, **kw).collect()), key=str
    )


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_decontamination_against_brute_force(spark, make, odd_rows, most):
    draw = random.Random(2)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([3, 7, 12, 13, 14, 40])))) for i in range(15)]
    items += [(50, None), (51, "..."), (52, "Solo"), (53, items[4][1]), (53, items[4][1]), (None, "null id item of words"),
              (54, " ".join(["again"] * 30)), (55, "hello world")]
    rows = list(odd_rows) + [(200, "again " * 60), (201, "solo"), (202, "the null id item of words here")]
    for i in range(40):
        text = [draw.choice(vocabulary) for _ in range(draw.randrange(120))]
        if i % 2:
            at = draw.randrange(len(text) + 1)
            text[at:at] = draw.choice(items[:15])[1].split()
        rows.append((300 + i, " ".join(text)))
    assert got_contamination(spark, make(rows), items, broadcast_bytes=most) == contamination(rows, items)


def test_decontamination_finds_every_shared_span(spark, make):
    item = " ".join(f"i{k}" for k in range(60))
    rows = [(i, f"x y {' '.join(item.split()[i : i + 13])} z") for i in range(48)]
    rows += [(100 + i, f"x y {' '.join(item.split()[i : i + 12])} z") for i in range(48)]
    got = got_contamination(spark, make(rows), [(1, item)])
    assert [r[2] for r in got if r[0] < 100] == [13] * 48 and [r[2] for r in got if r[0] >= 100] == [0] * 48


def test_decontamination_empty(spark, make, odd_rows):
    assert got_contamination(spark, make([]), [(1, "a b c")]) == []
    got = got_contamination(spark, make(odd_rows), [])
    assert len(got) == len(odd_rows) and not any(r[5] for r in got)


KINDS_IN_ORDER = ("email", "ip", "card", "phone")


def brute_pii(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            digits = [c for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn("".join(digits))):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return out


def test_plain_identifiers_against_brute_force():
    draw = random.Random(3)
    parts = ["@", ".", "1", "12", "255", "300", "+", "-", " ", "(", ")", "a", "b.c", "é", "4111111111111111", "x@y.z", "@@", "%"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        assert plain(text) == brute_pii(text), text


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write to john dot doe at example dot com now", [("john dot doe at example dot com", "email")]),
        ("john [at] example.com", [("john [at] example.com", "email")]),
        ("j.doe(at)mail(dot)example(dot)org", [("j.doe(at)mail(dot)example(dot)org", "email")]),
        ("jоhn@еxаmple.com", [("jоhn@еxаmple.com", "email")]),
        ("john​@ex​ample.com", [("john​@ex​ample.com", "email")]),
        ("192[.]168[.]1[.]1", [("192[.]168[.]1[.]1", "ip")]),
        ("call plus one four one five five five five two six seven one", [("plus one four one five five five five two six seven one", "phone")]),
        ("４" + "１" * 15, [("４" + "１" * 15, "card")]),
        ("john_at_example_dot_com", [("john_at_example_dot_com", "email")]),
        ("john @ example . com", [("john @ example . com", "email")]),
        ("42 dot 144 dot 35 dot 254", [("42 dot 144 dot 35 dot 254", "ip")]),
        ("look at example.com please", []),
        ("look at the dot on the wall", []),
        ("one two three four five", []),
        ("", []),
    ],
)
def test_disguises(text, found):
    base, more = find(text)
    assert base == [] and [(text[a:b], k) for a, b, k in more] == found


def test_plain_findings_stay_beside_disguises():
    text = "a@b.com and c [at] d.org"
    base, more = find(text)
    assert [text[a:b] for a, b, _ in base] == ["a@b.com"] and [text[a:b] for a, b, _ in more] == ["c [at] d.org"]


def test_pii_query_rows(make, odd_rows):
    rows = [*odd_rows, (50, "a@b.co and 10.0.0.1, +1 (415) 555-2671 or 4111 1111 1111 1111")]
    got = {r.doc_id: r for r in personal_data(make(rows)).collect()}
    r = got[50]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert personal_data(make([])).collect() == []
    assert personal_data(make(rows)).count() == len(rows)


def disguise_all(draw):
    """Identifiers in many disguises, each with its kind: ``(written, kind)``."""
    name, host = (draw.choice(x) for x in (["anna", "bob.lee", "c-3po", "maria_k"], ["mail.example", "uni-x.ac", "shop", "corp.intra"]))
    end = draw.choice(["com", "org", "de", "es", "fr", "io"])
    at = draw.choice(["[at]", "(at)", " (at) ", "{AT}", "<at>", "-at-", "_at_", " [@] ", "(a)", "&#64;", "&commat;", "%40", " @ ", "@", " at ", " arroba "])
    bare = at.strip().isalpha()
    dot = draw.choice(["[.]", "(dot)", " [dot] ", " dot ", "_dot_", "&#46;", "(punto)"] if bare or at == "@" else [".", "[.]", "(dot)", " dot ", "&period;"])
    yield (name + at + host.replace(".", dot) + dot + end).replace("..", "."), "email"
    plain_mail = f"{name}@{host}.{end}"
    twin = {"a": "а", "e": "е", "o": "ο", "p": "р", "c": "с", "x": "х", "n": "ｎ", "m": "𝗆", "b": "ｂ", "i": "і", "k": "κ"}
    yield "".join(twin.get(c, c) for c in plain_mail), "email"
    yield " ".join(plain_mail), "email"
    yield plain_mail.replace("@", "\u200b@\u2060"), "email"
    ip = [str(draw.randint(1, 255)) for _ in range(4)]
    yield draw.choice(["[.]", "(.)", " dot ", "[dot]", " . ", "{punkt}", "&#46;"]).join(ip), "ip"
    yield "".join(chr(ord(c) + 0xFEE0) for c in ".".join(ip)), "ip"
    words = draw.choice(["zero one two three four five six seven eight nine", "cero uno dos tres cuatro cinco seis siete ocho nueve",
                         "zéro un deux trois quatre cinq six sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun"]).split()
    number = "".join(str(draw.randint(0, 9)) for _ in range(11))
    spoken = [words[int(d)] for d in number]
    yield "plus " + draw.choice([" ", "-", ", "]).join(spoken), "phone"
    yield "+1 " + " ".join(w if i % 2 else d for i, (w, d) in enumerate(zip(spoken, number, strict=True))), "phone"
    yield f"+1 ({number[:3]}) {number[3:6]}-".replace("0", "O").replace("1)", "l)") + "5O67", "phone"
    card = "".join(str(draw.randint(0, 9)) for _ in range(15))
    card += next(str(d) for d in range(10) if luhn(card + str(d)))
    yield " ".join(words[int(d)] for d in card), "card"
    yield "".join(chr(0x660 + int(d)) for d in card), "card"


def test_recall_of_disguises():
    draw, missed, n = random.Random(21), [], 0
    for _ in range(150):
        for written, kind in disguise_all(draw):
            base, more = find(f"bitte: {written} , danke")
            n += 1
            if not any(k == kind for _, _, k in base + more):
                missed.append((written, kind))
    assert len(missed) <= 0.03 * n, missed[:10]


@pytest.mark.parametrize(
    "text",
    [
        "We met at noon. The dot on the map marks it.", "point of order at this point it is clear", "one two three, seven of nine",
        "prices rose 5 . 3 percent at home", "options (a) first (b) second", "I saw 10 of 12 at 7 . 30", "un deux trois",
        "see section 1 . 2 . 3", "version 2 dot 0 at last", "R&D at 50% off @ home", "lol I oO lI 10l",
    ],
)
def test_prose_has_no_disguises(text):
    assert find(text) == ([], [])


@pytest.mark.parametrize("text", ["a" * 100_000 + "@", "a a " * 30_000 + "ab@", "1 l " * 30_000 + "x", "& %" * 30_000, " @ a.b" * 20_000, "1" * 100_000, "1." * 50_000, "one " * 20_000, "a dot " * 20_000, "[at] " * 20_000, "x-at-" * 20_000, "x dot " * 20_000 + "@", "x_at_x_dot_" * 9_000])
def test_pii_is_linear(text):
    import time

    began = time.process_time()
    find(text)
    assert time.process_time() - began < 5


def test_toxicity_on_held_out_rows(spark, make):
    draw = random.Random(1)
    common = [f"c{i}" for i in range(300)]
    bad = ["vile", "awful", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(900):
        text = [draw.choice(common) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            text[draw.randrange(40)] = draw.choice(bad)
            text[draw.randrange(40)] = draw.choice(bad)
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity(make([*rows, (5000, None), (5001, ""), (None, "vile")]), table).collect()
    assert len(got) == len(rows) + 3
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert by[5000].score == by[5001].score and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    hidden = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in hidden) >= 0.95 * len(hidden)


def toxic_corpus(draw, n, every, start=0):
    common = [f"c{i}" for i in range(300)]
    rows = []
    for i in range(start, start + n):
        text = [draw.choice(common) for _ in range(40)]
        if i % every == 0:
            for bad in draw.sample(["vile", "awful", "nasty", "rotten"], 2):
                text[draw.randrange(40)] = bad
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("every", [2, 40])
def test_toxic_prior_follows_all_documents(spark, make, every):
    """A tenth of the labels is toxic; of the other documents, more or fewer are."""
    draw = random.Random(6)
    known, others = toxic_corpus(draw, 600, 10), toxic_corpus(draw, 1200, every, 10_000)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in known], "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity(make(known + others), labels).collect()}
    truth = {i: int(i % (10 if i < 10_000 else every) == 0) for i, _ in known + others}
    own = labels.where(~held_out("doc_id")).withColumnRenamed("doc_id", "of")
    voted = votes(make(known + others), own, "doc_id", "text")
    names = [features(w)[0] for w in ("vile", "awful", "nasty", "rotten")]
    share = toxic_share(make(known + others), voted, names, "text")
    assert abs(share - sum(truth.values()) / 1800) < 0.02
    found = sum(got[i] for i, y in truth.items() if y)
    assert found >= 0.8 * sum(truth.values()) and sum(got.values()) - found <= 9


def test_copies_do_not_fill_the_training_sample(spark, make):
    rows = toxic_corpus(random.Random(7), 1200, 6)
    copy = "vile awful " + " ".join(f"q{i}" for i in range(38))
    labels = [(i, int(i % 6 == 0)) for i, _ in rows] + [(5000 + i, 1) for i in range(0, 4000, 2)]
    docs = make(rows + [(5000 + i, copy) for i in range(4000)])
    model = train_toxicity(
        docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), most_positive=120, most_unlabelled=700
    )
    found = [i for i, t in rows if model.score(t) >= 0.7]
    assert model.score(copy) >= 0.7
    assert sum(i % 6 == 0 for i in found) >= 190 and sum(i % 6 != 0 for i in found) <= 5


def test_toxicity_ignores_held_out_labels(spark, make):
    rows = [(i, "vile words" if i % 2 else "kind words") for i in range(60)]
    docs = make(rows)
    labels = [(i, i % 2) for i in range(60)]
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, y in labels]
    a, b = (
        sorted(map(tuple, toxicity(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")).collect()))
        for x in (labels, flipped)
    )
    assert a == b


def test_toxicity_without_labels(spark, make, odd_rows):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity(make(odd_rows), none).collect()
    assert len(got) == len(odd_rows) and not any(r.predicted for r in got)
    assert toxicity(make([]), none).collect() == []


def test_non_negative_risk_keeps_clean_texts_clean():
    model = fit(["bad one", "bad two", "bad three", "bad four", "bad six"] * 4, ["good day"] * 60 + ["bad day"] * 5, 0.1)
    assert model.score("bad words") > 0.5 > model.score("good words")


def test_no_quota_on_texts_called_toxic():
    model = fit([f"bad p{i}" for i in range(40)], ["good day"] * 60 + ["bad day"] * 40, 0.31)
    assert model.score("bad day") >= 0.7 > model.score("good day")


def test_gradient_of_the_risk():
    draw = np.random.default_rng(3)
    row, col = draw.integers(0, 30, 90), draw.integers(0, 6, 90)
    pos = np.arange(30) < 8
    for prior, shift in ((0.2, 0.0), (0.9, 0.0), (0.5, -1.0), (0.95, 2.0)):
        w, b = draw.normal(size=6), shift
        value, gw, gb = risk(w, b, row, col, pos, prior)
        z = np.bincount(row, weights=w[col], minlength=30) + b
        hinge = np.log1p(np.exp(z))
        negative = hinge[~pos].mean() - prior * hinge[pos].mean()
        assert abs(value - (prior * np.log1p(np.exp(-z))[pos].mean() + negative if negative >= 0 else -negative)) < 1e-9
        for k in range(6):
            step = np.eye(6)[k] * 1e-6
            slope = (risk(w + step, b, row, col, pos, prior)[0] - risk(w - step, b, row, col, pos, prior)[0]) / 2e-6
            assert abs(slope - gw[k]) < 1e-5
        slope = (risk(w, b + 1e-6, row, col, pos, prior)[0] - risk(w, b - 1e-6, row, col, pos, prior)[0]) / 2e-6
        assert abs(slope - gb) < 1e-5


def test_telling_features_against_brute_force():
    rows = toxic_corpus(random.Random(5), 400, 4)
    pos, un = [t for i, t in rows if i % 4 == 0], [t for _, t in rows]
    names = telling([hashed(t) for t in pos], [hashed(t) for t in un])
    every = {f for t in pos for w in t.split() for f in features(w)}
    gain = {}
    for f in every:
        a, b = (sum(any(f in features(w) for w in t.split()) for t in ts) for ts in (pos, un))
        e = len(pos) * (b + 1) / (len(un) + 2)
        gain[f] = (a - e) / (e + 0.5) ** 0.5
    bound = (2 * np.log(len(every))) ** 0.5
    assert names == sorted((f for f, x in gain.items() if x >= bound), key=lambda f: (-gain[f], f))
    assert {features(w)[0] for w in ("vile", "awful", "nasty", "rotten")} <= set(names)


def test_toxicity_query_against_brute_force(spark, make):
    """Scores of the query are the sums of the model's weights, whatever the layout."""
    rows = toxic_corpus(random.Random(4), 400, 5) + [(7, "vile awful c1"), (7, "c1 c2"), (8, None), (None, "nasty c3 vile")]
    labels = [(i, int(i % 5 == 0)) for i, _ in rows[:400:2]] + [(7, 1), (7, 0)]
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = train_toxicity(make(rows), table)
    want = []
    for i, t in rows:
        z = model.bias + sum(model.weights.get(f, 0.0) for w in set((t or "").lower().split()) for f in features(w))
        want.append((str(i), round(1 / (1 + np.exp(-z)), 9)))
    for parts in (1, 3, 7):
        got = toxicity(make(rows, partitions=parts), table.repartition(parts)).collect()
        assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted(want)
        assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_score_sees_texts_only(spark, make):
    model = fit(["bad one"] * 10, ["good"] * 50, 0.1)
    a = score(make([(1, "bad"), (4, "bad")]), model).collect()
    assert len({r.score for r in a}) == 1
    assert {c for c in held_out("doc_id")._jc.toString() if c}  # built from the id alone


@pytest.fixture(scope="module")
def licence_model():
    draw = random.Random(8)
    common = [f"c{i}" for i in range(300)]
    return train([[draw.choice(common) for _ in range(30)] for _ in range(300)])


def test_licences(make, licence_model, odd_rows):
    said = [(f, t) for f, t in TEMPLATES if len(t.split()) > 2]
    rows = [(100 + i, f"Some prose here.\n{t.upper()}.\nMore prose.") for i, (_, t) in enumerate(said)]
    rows += [(500 + i, f"Licensed under the {t}.") for i, t in enumerate(OTHERS)]
    got = {r.doc_id: r for r in scan(make([*odd_rows, *rows]), licence_model).collect()}
    right = sum(got[100 + i].families == f for i, (f, _) in enumerate(said))
    assert right >= 0.95 * len(said)
    assert all(got[100 + i].confirmed == got[100 + i].families for i in range(len(said)))
    assert sum(got[500 + i].n_unknown for i in range(len(OTHERS))) >= 0.9 * len(OTHERS)
    assert got[102].n_paragraphs == 3
    for i in (1, 2, 3):
        assert (got[i].n_paragraphs, got[i].n_licence, got[i].families) == (0, 0, "")
    assert scan(make([]), licence_model).collect() == []
    assert scan(make(odd_rows), licence_model).count() == len(odd_rows)


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
    'documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation',
    "gpl": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU "
    "General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided "
    "that the following conditions are\n# met:",
    "apache": ' * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in '
    "compliance\n * with the License.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser "
    "General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License",
    "agpl": "This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU Affero "
    "General Public License as published by the\nFree Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is "
    "hereby granted, provided that the above",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
}


def test_wrapped_licences_are_one_paragraph(make, licence_model):
    rows = [(i, f"Prose before.\n\n{t}\n\nProse after.") for i, t in enumerate(WRAPPED.values())]
    got = {r.doc_id: r for r in scan(make(rows), licence_model).collect()}
    for i, family in enumerate(WRAPPED):
        assert (got[i].families, got[i].confirmed) == (family, family), family


def test_confidence_holds_on_wording_that_was_not_trained_on():
    draw = random.Random(8)
    prose = [[draw.choice([f"c{i}" for i in range(300)]) for _ in range(30)] for _ in range(300)]
    data, classes, _ = examples(prose, 16, 5)
    z = held_out_logits(data, len(classes), 60)
    y, n = np.array([e.label for e in data]), len(classes)
    probs = np.exp(z - z.max(axis=1, keepdims=True))
    probs /= probs.sum(axis=1, keepdims=True)
    c = least_confidence(probs, y)
    sure = (probs.argmax(axis=1) < n - 2) & (probs.max(axis=1) >= c)
    assert (probs.argmax(axis=1) == y)[sure].mean() >= 0.98 and sure[y < n - 2].mean() >= 0.8


def test_confirmed_against_brute_force(make, licence_model):
    draw = random.Random(11)
    rows = []
    for i in range(120):
        _, t = draw.choice(TEMPLATES)
        w = t.split()
        for _ in range(draw.choice([0, 0, 1, 2, 5])):
            w[draw.randrange(len(w))] = f"q{draw.randrange(9)}"
        rows.append((i, "Licensed " * draw.randint(0, 1) + " ".join(w) + draw.choice(["", " mit license", " the gpl"])))
    got = {r.doc_id: r for r in scan(make(rows), licence_model).collect()}
    for i, text in rows:
        w = words(text)
        found = {" ".join(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w))}
        want = set()
        for family, t in TEMPLATES:
            parts = t.split()
            shingles = {" ".join(parts[a : a + 3]) for a in range(max(len(parts) - 2, 1))}
            if family == got[i].families and len(shingles & found) >= 0.8 * len(shingles):
                want.add(family)
        assert got[i].confirmed == ",".join(sorted(want)), text


def test_prose_sample(make, odd_rows):
    assert prose_sample(make([])) == [] and prose_sample(make([(None, "a"), (None, None)])) == []
    assert prose_sample(make([(1, None), (2, "")])) == [[], []]
    copies = make([(1, f"text {i}") for i in range(50)] + [(2, "x y"), (3, "w " * 1000)])
    found = prose_sample(copies, most=3)
    assert len(found) == 3 and max(map(len, found)) == 300
    assert train([]).classes[-1] == "none"


def test_licence_scores_equal_the_model(make, licence_model):
    texts = ["she studied physics at mit before moving abroad", "released under the mit license", "all rights reserved by us",
             "licensed under the eclipse public license version 1 0", "plain words of prose", "license"]
    got = {r.doc_id: r for r in scan(make(list(enumerate(texts))), licence_model).collect()}
    for i, t in enumerate(texts):
        z = licence_model.logits(words(t))
        label = licence_model.classes[int(z.argmax())]
        confidence = 1 / sum(2.718281828459045 ** (z - z.max()))
        prose = z[:-1].max() <= z[-1]
        unknown = not prose and (label == UNKNOWN or confidence < licence_model.confidence)
        assert got[i].n_unknown == int(unknown)
        assert got[i].families == ("" if prose or unknown else label)
