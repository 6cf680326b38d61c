"""The training-data operators do the whole job: no label, copy or null id is lost."""

import itertools
import re

import numpy as np

from lacuna.llm import bpe, license_scan, packing

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_labels(text, idf):
    """Every beginning of every template, without an index."""
    number = {w: i for i, w in enumerate(license_scan.WORDS)}
    w = LICENCE_WORD.findall(text.translate(FOLD))
    labels = {label for p, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
    for (label, template, key), key_at in zip(license_scan.TEMPLATES, license_scan.KEY_AT, strict=True):
        t, k = template.split(), key.split()
        total = float(idf[[number[x] for x in t]].sum())
        for b in range(-len(t), len(w)):
            share = sum(idf[number[x]] / total for i, x in enumerate(t) if 0 <= b + i < len(w) and w[b + i] == x)
            near = range(max(0, b + key_at - license_scan.SLACK), b + key_at + license_scan.SLACK + 1)
            if share >= license_scan.MIN_SHARE and any(w[n : n + len(k)] == k for n in near):
                labels.add(label)
    return ",".join(sorted(labels))


def test_licenses_that_stand_together_are_all_found(spark):
    parts = [t for _, t, _ in license_scan.TEMPLATES]
    texts = [" and ".join(parts)] + [" and ".join(c) for c in itertools.combinations(parts, 3)][::7]
    # beginnings and ends cut off, words missing
    texts += [" ".join(parts[a].split()[3:] + parts[b].split()[:-2]) for a, b in itertools.combinations(range(len(parts)), 2)]
    texts += [" ".join(x for i, x in enumerate((" ".join(parts)).split()) if i % 9 != k) for k in range(9)]
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(100_000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    idf = license_scan.frequencies(own)
    got = {r.doc_id: r.labels for r in license_scan.scan(own).where("doc_id >= 100000").collect()}
    assert set(got[100_000].split(",")) == {label for label, _, _ in license_scan.TEMPLATES}
    assert got == {100_000 + k: brute_labels(t, idf) for k, t in enumerate(texts)}


def test_license_voters_leave_less_than_the_least_share():
    idf = np.random.default_rng(5).random(len(license_scan.WORDS)) + 0.01
    for codes in license_scan.TEMPLATE_CODES:
        rest = np.delete(idf[codes], license_scan._voters(codes, idf)).sum() / idf[codes].sum()
        assert rest < license_scan.MIN_SHARE


def test_null_ids_leave_other_ids_as_they_are(spark):
    big = 2**60 + 1
    own = spark.createDataFrame([(5, "five words of plain text"), (None, "no id"), (big, "a large id"), (None, None)], "doc_id long, text string").coalesce(1)
    clean = own.selectExpr("coalesce(doc_id, -1) AS doc_id", "text")
    for run in (bpe.round_trip, packing.pack):
        got, want = [sorted((-1 if r[0] is None else r[0], *map(str, r[1:])) for r in run(df).collect()) for df in (own, clean)]
        assert got == want and {r[0] for r in got} == {5, -1, big}
    assert {r.doc_id for r in bpe.round_trip(own).collect()} == {5, None, big}
