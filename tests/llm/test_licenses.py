"""Licence scan against the same rules in plain Python."""

import random
import re

from thicket.llm import license_rules, licenses


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    norm = " " + " ".join(words) + " "
    starts, base = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    found = []
    for label, priority, keyword, regex in license_rules.rules():
        if keyword in norm:
            found += [(priority, m.start(), m.end(), label) for m in re.finditer(regex, norm)]
    left = [h for h in found if not any(g[1] <= h[1] and g[2] >= h[2] and (g[0] > h[0] or g[0] == h[0] and g[2] - g[1] > h[2] - h[1]) for g in found)]
    score = max([0.0, *(h[0] / 4 for h in left), *([0.5] if base else [])])
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {h[3] for h in left})), score)


def test_rules_are_gated_and_many():
    table = license_rules.rules()
    assert len(table) >= 250 and len({r[3] + r[0] for r in table}) == len(table)
    for label, priority, keyword, regex in table:
        assert re.search(license_rules.GATE, keyword), (label, keyword)
        re.compile(regex)


def test_scan_against_brute_force(spark):
    rng = random.Random(1)
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "SPDX-License-Identifier: Apache-2.0", "https://www.apache.org/licenses/LICENSE-2.0", "mit\nlicense mit LICENSE", "Lesser General Public License v2.1", "Copyright (c) 2001, 2002", "public domain dedication", "summit license", "MITé License", "the Unlicense"]
    texts = [None, "", " \x00\t", "License", "MIT License"] + lines
    for _ in range(150):
        parts = [rng.choice(lines) if rng.random() < 0.3 else "".join(rng.choice("abÉ ,.\nMIT") for _ in range(12)) for _ in range(rng.randint(0, 10))]
        texts.append(rng.choice([" ", "\n", "-"]).join(parts))
    texts += ["😀 😀 😀 😀 😀 mit license", "😀" * 9 + " 𝒜𝒷 mit license 𝒜 apache license", "mit license 😀 MIT LICENSE"]
    texts.append("word " * 50_000 + "mit license " + "word " * 10)
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, norm string, detections int")
    got = {r.doc_id: tuple(r)[1:8] for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_suppression_and_empty(spark):
    docs = spark.createDataFrame([(1, "Under the GNU Lesser General Public License version 2.1 only")], "doc_id long, text string")
    row = licenses.scan(docs).first()
    assert row.labels == "gpl,lgpl-2.1" and row.base_labels == "gpl"  # the base label stays
    assert licenses.scan(docs.limit(0)).count() == 0
