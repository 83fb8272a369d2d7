import random
import re

import llm_cases as C
from dhvani.llm import licenses as L
from pyspark.sql import functions as F


def brute(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        q = phrase.split()
        for i in range(len(w) - len(q) + 1):
            if w[i:i + len(q)] == q:
                places.append(i)
                labels.add(label)
    s, hits = " " + " ".join(w) + " ", []
    for k, (label, key, level, pattern) in enumerate(L.rules()):
        if key in s:
            hits += [(m.start(), -m.end(), -level, k, label) for m in re.finditer(pattern, s)]
    hits.sort()
    kept = [h for i, h in enumerate(hits) if not any(g[0] <= h[0] and g[1] <= h[1] and g[2] <= h[2] for g in hits[:i])]
    level = max([-h[2] for h in kept], default=0)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {h[4] for h in kept})), 0.25 + 0.25 * level if level else 0.5 if labels else 0.0)


def texts():
    r = random.Random(6)
    grants = ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MIT", "CC BY CC BY cc-by", "released under the MIT License",
              "GNU General Public License, version 3", "GNU Lesser General Public License v2.1", "Creative Commons Attribution-ShareAlike 4.0",
              "CC BY-NC-SA 4.0", "all rights reserved", "This software is under the BSD 3-Clause License", "0BSD", "the public domain", "into the public domain",
              "mit license mit license", "apache licence", "PERMISSION IS HEREBY GRANTED, free of charge, to any person obtaining a copy", "ccby", "Émit license"]
    out = [t for _, t in C.EDGE]
    for _ in range(120):
        out.append(" ".join(r.choice(grants + ["some", "the", "mit", "cc", "by", "license", "gnu", "…", "x1"]) for _ in range(r.randint(1, 9))))
    return out


def test_against_brute_force(spark, tmp_path):
    rows = list(enumerate(texts())) + [(None, "mit license")]
    d = C.write(str(tmp_path), documents=C.docs_of(rows))
    got = {r["doc_id"]: tuple(r)[1:] for r in L.op7_license_scan(spark, d).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == brute(t), t


def test_driver_table(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in L.op7_license_scan(spark, C.SF).collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in C.read("documents")}


def test_rules_and_gate():
    rules = L.rules()
    assert len(rules) >= 250 and all(re.compile(p) for *_, p in rules)
    for phrase in L.BASE:
        assert any(g in phrase for g in L.GATE)
    assert all(any(g in t.lower() for g in L.GATE) for t in texts() if t and brute(t)[6] > 0)


def test_native_plan_and_empty_table(spark, tmp_path):
    df = L.op7_license_scan(spark, C.write(str(tmp_path), documents=C.docs_of([])))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_cost_follows_the_hits(spark):
    """Ten times the hits of one text take at most twelve times as long, and none is lost."""
    import time

    def run(n):
        d = spark.createDataFrame([(1, "mit license and more " * n)], "doc_id long, text string")
        start = time.time()
        got = L.scan(d).select("n_base", F.size("detections").alias("n")).first()
        assert (got["n_base"], got["n"]) == (n, n)
        return time.time() - start
    run(100)
    assert run(20_000) <= 12 * run(2_000)
