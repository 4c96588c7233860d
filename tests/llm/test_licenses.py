import random

import pytest

from kairos.llm import licenses as L
from kairos.llm.queries import op1_licenses


def test_templates_accept_exact_mandatory_wording(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
        "licensed under the apache license 2.0": {"apache-2.0"},
        "licensed under the old apache license 2.0": set(),
        "Copyright (c) 2020 A. Person. All rights reserved": {"copyright", "reserved"},
        "copyright all rights reserved": {"reserved"},
        "copyright a b c d e f g h i all rights reserved": {"reserved"},
        "Released under the MIT License": {"mit"}, "under the mit license": {"mit"}, "the MIT license": set(),
        "CC BY-NC 4.0 and cc-by": {"cc-by", "cc-by-nc"}, "GNU General Public License, version 3": {"gpl", "gpl-3.0"},
        "accord by law": set(), "cc": set(), "": set(),
    }
    for text, want in texts.items():
        assert {m[0] for m in L.find_matches(text)[1]} == want, text


def brute(words, items):
    """End positions that the items can reach from the first word."""
    ends = {0}
    for it in items:
        new = set()
        for e in ends:
            if it.kind == "word" and e < len(words) and words[e] == it.word:
                new.add(e + 1)
            elif it.kind == "optional":
                new |= {e} | {e + x for x in brute(words[e:], it.inside)}
            elif it.kind == "var":
                new |= {e + n for n in range(it.low, it.high + 1) if e + n <= len(words)}
        ends = new
    return ends


def test_scan_equals_brute_force_on_random_templates():
    r = random.Random(3)
    pieces = ["a", "b", "c", "<<beginOptional>>a b<<endOptional>>", "<<var;name=x;min=0;max=2>>",
              "<<beginOptional>>c <<beginOptional>>a<<endOptional>><<endOptional>>"]
    for _ in range(150):
        ts = [L.Template(str(i), L.parse(r.choice("abc") + " " + " ".join(r.choices(pieces, k=r.randint(0, 4)))), False)
              for i in range(3)]
        auto = L.Automaton()
        auto.compile(ts)
        words = [r.choice("abcd") for _ in range(14)]
        want = {(n, i, i + max(e)) for n, t in enumerate(ts) for i in range(14) if (e := brute(words[i:], t.items))}
        assert set(auto.scan([w.encode() for w in words])) == want


def test_markup_must_close():
    for bad in ("a <<beginOptional>> b", "a <<endOptional>>"):
        with pytest.raises(ValueError):
            L.parse(bad)


def test_defined_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "CC-BY cc by cc"), (3, "CC-BY cc by cc"), (None, "All rights reserved. " * 3), (5, "é" * 50_000),
            (6, "K cc by " + "x " * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Matches int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                 for r in op1_licenses(spark, str(tmp_path)).collect())
    assert got == [(0, 9, 3, 0, 6, "reserved"), (1, 0, 0, None, None, ""), (2, 0, 0, None, None, ""), (3, 5, 2, 0, 2, "cc-by"),
                   (3, 5, 2, 0, 2, "cc-by"), (5, 1, 0, None, None, ""), (6, 50_003, 1, 1, 1, "cc-by")]
    assert L.scan(df.limit(0)).count() == 0
