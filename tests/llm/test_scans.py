"""License and secret scans against plain Python."""

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from quernstone.llm import licenses, secrets

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII = str.maketrans(licenses.UPPER, licenses.LOWER)
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_licenses(text):
    words = WORD.findall(text.translate(ASCII))
    places = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(docs):
    got = licenses.summary(licenses.scan(docs, "doc_id", "text")).collect()
    want = Counter((r.doc_id, *base_licenses(r.text or "")) for r in docs.collect())
    assert Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert {*filter(None, r.base_labels.split(","))} <= {*filter(None, r.labels.split(","))} and 0 <= r.score <= 1


def test_containment_and_priority(spark):
    docs = spark.createDataFrame([(1, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC-SA 4.0. SPDX-License-Identifier: MPL-2.0")], "doc_id long, text string")
    found = licenses.scan(docs, "doc_id", "text").collect()
    kept = {(r.label, r.start, r.end) for r in found if r.label and not r.suppressed and not r.base}
    assert ("gpl", 0, 12) in kept and not any(a == "gpl" and s > 0 for a, s, _ in kept)
    assert {a for a, _, _ in kept} == {"gpl", "cc-by-nc-sa", "mpl"}
    assert any(r.base and r.label == "gpl" and r.start == 7 for r in found)
    assert len(licenses.rules()) > 200


def test_no_rule_is_gated_away(spark):
    """Texts that a rule matches are looked at though they name no license in so many words, or wrap between two words."""
    texts = {
        "This software is released under the terms of the MPL 2.0": "mpl", "Distributed under CC BY 4.0": "cc-by", "Shared by the GNU GPL v3": "gpl",
        "Use is governed by the MPL": "mpl", "SPDX-LICENSE-IDENTIFIER: ISC": "isc", "the zlib licence": "zlib", "License: WTFPL": "wtfpl",
        "ALL RIGHTS\nRESERVED": "all-rights-reserved", "is in the public-domain": "public-domain", "Copyright (c) 2020": "copyright", "under the MPL": "",
    }
    docs = spark.createDataFrame([*texts], "string").toDF("text").select("text", F.col("text").alias("doc_id"))
    assert {r.id: r.labels for r in licenses.summary(licenses.scan(docs, "doc_id", "text")).collect()} == texts
    own = licenses.summary(licenses.scan(docs, "doc_id", "text", {"use is": "own"})).where("base_labels <> ''").collect()
    assert [(r.id, r.base_labels) for r in own] == [("Use is governed by the MPL", "own")]


def instance(pattern):
    """Some text that a signature matches: first alternatives, optional parts left out, gaps empty."""
    text = pattern
    while (m := re.search(r"\(\?([:=])([^()]*)\)(\??)", text)):
        inner = "" if m[3] else m[2].split("|")[0]
        text = text[: m.start()] + inner + text[m.end() :]
    text = text.split("|")[0]
    text = re.sub(r"\.\{(\d+),\d+\}", lambda m: "x" * int(m[1]), text)
    text = re.sub(r"\[0-9\]\+?", "7", re.sub(r"\[0-9\]\{4\}", "2019", text)).replace("[sc]", "s")
    return re.sub(" +", " ", re.sub(r".\?", "", text))


def test_every_signature_of_a_text(spark):
    """Each passage is found where it stands alone: no gate or keyword hides it, and it outranks what it contains."""
    texts = [(k, "Some words first; " + instance(pattern).upper() + ". And some after.", label) for k, (label, pattern) in enumerate(licenses.TEXTS)]
    found = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string, label string"), "doc_id", "text").where("label is not null and confidence = 0.98 and not base").collect()
    held = {(r.id, r.label) for r in found}
    assert not [(k, label, text) for k, text, label in texts if (k, label) not in held]
    for r in licenses.rules():
        assert r.base or r.keyword == "" or re.search(r.pattern, f" {r.keyword} ") or r.keyword.split()[0] in r.pattern
    assert len(licenses.TEXTS) < 200 and len({label for label, _ in licenses.TEXTS}) > 100


def test_long_license(spark):
    """A whole license text gives its label, not those of the phrases inside it."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
    r = licenses.summary(licenses.scan(spark.createDataFrame([(1, mit)], "doc_id long, text string"), "doc_id", "text")).first()
    assert r.labels == "mit" and r.score == 0.98 and r.base_labels == ""


def test_many_places_in_one_text(spark):
    docs = spark.createDataFrame([(1, "MIT license. " * 20000)], "doc_id long, text string")
    r = licenses.summary(licenses.scan(docs, "doc_id", "text")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (40000, 20000, 0, 39998, "mit")


def base_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def entropy_spans(text):
    out = []
    for m in re.finditer(secrets.CANDIDATE, text):
        s = m[0]
        if any(re.search(a, s) for a in [*secrets.ALLOWED, *secrets.BASE_RUNS]):
            continue
        bound = next(b for _, p, b in secrets.CLASSES if re.search(p, s))
        harmless = {k for h in re.finditer(secrets.HARMLESS, s) for k in range(*h.span())}
        windows = [Counter(s[k : k + 20]) for k in range(len(s) - 19) if not harmless & {*range(k, k + 20)}]
        if max((-sum(n / 20 * math.log2(n / 20) for n in w.values()) for w in windows), default=0) >= bound:
            out.append((m.start(), 3, m.end()))
    return out


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secrets(docs):
    got = secrets.summary(secrets.spans(docs, "doc_id", "text")).collect()
    want = Counter()
    for r in docs.collect():
        base, text = base_secrets(r.text or ""), r.text or ""
        n = Counter(k for _, k, _ in base)
        want[r.doc_id, n[0], n[1], n[2], hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + entropy_spans(text))] += 1
    assert Counter((r.id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == want
    assert any("entropy" in r.spans for r in got)


def test_harmless_parts(spark):
    """A placeholder, alphabet or ruler takes its own windows away, not the token beside it."""
    token = "zQ3vR8tLp0XkW7mN2bYc9Hs1"
    texts = {f"sample/{token}": 1, f"======{token}": 1, f"{token}12345678": 1, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/": 0, f"{token[:12]}example{token[12:]}": 0}
    got = {r.id: r.n_entropy for r in secrets.summary(secrets.spans(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string"), "doc_id", "text")).collect()}
    assert got == texts


def test_windows_across_chunks(spark):
    """A window that two chunks share is seen: the only rich one lies across the first border."""
    for shift in (0, 5, 10, 19, 20):
        text = "a1" * ((secrets.CHUNK - shift) // 2) + "zQ3vR8tLp0XkW7mN2bYc" + "b2" * 700
        df = spark.createDataFrame([(text,)], "t string")
        got = df.select(secrets.entropy(F.col("t"))).first()[0]
        windows = (Counter(text[k : k + 20]) for k in range(len(text) - 19))
        assert abs(got - max(-sum(n / 20 * math.log2(n / 20) for n in w.values()) for w in windows)) < 1e-9


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "token = hunter2secret", 1, 1), (2, "clean", 2, 2)], "doc_id long, text string, __gone_id int, gone_hash int")
    assert [tuple(r) for r in secrets.without_secrets(df, "doc_id", "text").collect()] == [(2, "clean", 2, 2)]


def test_long_candidates(spark):
    """A candidate is scanned in chunks where it stands; a long path is allowed without a deep stack."""
    blob = "".join(hashlib.sha512(str(k).encode()).hexdigest()[:50] + "Zq+" for k in range(2000))
    docs = spark.createDataFrame([(1, blob), (2, "a1/" * 200_000 + "b")], "doc_id long, text string")
    got = {r.id: r for r in secrets.summary(secrets.spans(docs, "doc_id", "text")).collect()}
    assert got[1].n_entropy == 1 and f"entropy:0:{len(blob)}" in got[1].spans.split(",")
    assert got[2].spans == ""


def test_clean_rows_stay_whole(docs, empty):
    kept = secrets.without_secrets(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    want = Counter(map(tuple, (r for r in docs.collect() if not base_secrets(r.text or "") and not entropy_spans(r.text or ""))))
    assert Counter(map(tuple, kept.collect())) == want
    assert secrets.without_secrets(empty, "doc_id", "text").count() == licenses.scan(empty, "doc_id", "text").count() == 0
