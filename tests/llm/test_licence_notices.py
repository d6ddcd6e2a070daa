"""Notices without usual words, wrapped notices, and the bound that spares the classifier."""

import random
import textwrap

import pytest

from quarry.llm import licences


def test_notices_without_anchor_words_and_wrapped_ones():
    m = licences.train()
    found = lambda text: [(x[0], x[1]) for x in m.scan(text)]
    assert found("This article is available under CC BY-SA 4.0.") == [(0, "cc-by-sa")]
    assert found("Shared under CC BY 4.0.") == [(0, "cc-by")]
    grant = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin the Software without restriction, including the rights to use and copy."
    assert found(grant) == [(2, "mit")]
    bsd = "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following\nconditions are met:"
    assert found(bsd) == [(0, "bsd")]


def test_the_bound_rules_nothing_out():
    m, rng = licences.train(), random.Random(2)
    words = [w for group in licences.TEMPLATES.values() for t in group for w in t.split()]
    for group in licences.TEMPLATES.values():
        for t in group:
            for _ in range(20):
                w = [x if rng.random() > 0.15 else rng.choice(words) for x in t.split()]
                line = " ".join(w)
                if m.classify(line)[0] != licences.UNKNOWN:
                    assert m.possible(licences._TOKEN.findall(line.lower())), line


@pytest.mark.parametrize("width", [40, 60, 80, 100])
@pytest.mark.parametrize(("family", "k"), [("mit", -2), ("bsd", 3), ("gpl", 1), ("apache", 1), ("lgpl", -1)])
def test_notices_wrapped_at_any_width(family, k, width):
    text = "Some prose before.\n\n" + "\n".join(textwrap.wrap(licences.TEMPLATES[family][k], width)) + "\n\nSome prose after."
    assert family in {x[1] for x in licences.train().scan(text)}  # a line of it may be a notice of a related family too


def plain_scan(model, text):
    """Lines, and shortest runs of lines, by trying all of them; no bound spares the classifier."""
    lines, out, block = (text or "").split("\n"), [], []
    for k, line in enumerate([*lines, ""]):
        if line.strip():
            block.append(k)
            continue
        own = {j: model.classify(lines[j]) for j in block}
        own = {j: c for j, c in own.items() if c[0] != licences.UNKNOWN}
        at = 0
        while at < len(block):
            j = block[at]
            if j in own:
                out.append((j, *own[j]))
                at += 1
                continue
            hit, end = None, at + 1
            while end < len(block) and block[end] not in own and not hit:
                got = model.classify(" ".join(lines[block[at] : block[end] + 1]))
                hit = (j, *got) if got[0] != licences.UNKNOWN else None
                end += 1
            out += [hit] if hit else []
            at = end if hit else at + 1
        block = []
    return out


def test_scan_equals_trying_everything(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = licences.train(licences.unrelated_paragraphs(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng, notices = random.Random(4), [t for g in licences.TEMPLATES.values() for t in g]
    texts |= {10_000 + i: "\n".join(textwrap.wrap(f"{rng.choice(notices)} {t[:120]} {rng.choice(notices)}", rng.choice([30, 60, 90]))) for i, t in enumerate(list(texts.values())[:40])}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(rows).collect()}
    model = licences.train(licences.unrelated_paragraphs(rows))
    found = 0
    for i, text in texts.items():
        want = plain_scan(model, text)
        assert [(n.paragraph, n.family) for n in got[i].notices] == [w[:2] for w in want], text
        found += len(want)
    assert found > 40


def test_wordings_that_the_fit_has_not_seen(monkeypatch):
    """Every third template is left out; a third of these at least are named right, far more than by chance."""
    held = {f: g[2::3] for f, g in licences.TEMPLATES.items()}
    monkeypatch.setattr(licences, "TEMPLATES", {f: [t for t in g if t not in held[f]] for f, g in licences.TEMPLATES.items()})
    m = licences.train.__wrapped__()
    right = [(f, m.logits(licences.grams(t)).argmax() == m.families.index(f)) for f, g in held.items() for t in g]
    assert sum(ok for _, ok in right) >= len(right) / 3


def test_paragraphs_for_training_are_bounded_and_stable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = licences.unrelated_paragraphs(docs), licences.unrelated_paragraphs(docs.repartition(7))
    assert a == b and 0 < len(a) <= licences.DOCUMENTS * licences.EACH
    assert licences.unrelated_paragraphs(docs.filter("false")) == ()


def test_ties_go_to_the_first_family(spark):
    text = "Released under the MIT License.\nLicensed under CC BY 4.0."
    row = licences.scan(spark.createDataFrame([(1, text), (2, None), (1, text)], "doc_id long, text string")).collect()
    assert [(r.licence, r.families) for r in row if r.doc_id == 1] == [("cc-by", ["cc-by", "mit"])] * 2
    assert [(r.licence, r.n_paragraphs) for r in row if r.doc_id == 2] == [(licences.UNKNOWN, 0)]
