import hashlib
import random

import pytest

from kairos.llm import bpe
from kairos.llm.queries import word_bpe_spec

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def fuzz(n):
    r = random.Random(5)
    letters = "aaabbbcdeéèΣσİıſßÀñ'́ \n\x85\x1c\x1f ​!!..<|>12٣²中文😀"
    return (["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]
            + ["".join(r.choice("aeinrstlohd") for _ in range(r.randint(1, 40))) for _ in range(n)]
            + ["", " ", "a" * 20_000, "ab" * 5_000, "it's the dog's", "<|startoftext|>Hi <|endoftext|>x<|endoftext|>",
               "<|ENDOFTEXT|> <|", "word " * 20_000])


def test_ids_and_text_equal_the_library(spark, library):
    texts = fuzz(400)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = bpe.encode(df, word_bpe_spec())
    back = {r["doc_id"]: r["text"] for r in bpe.decode(got, word_bpe_spec()).collect()}
    want = library.encode_batch(texts, add_special_tokens=False)
    for r in got.collect():
        ids = want[r["doc_id"]].ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert back[r["doc_id"]] == text
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a dog")], "doc_id long, text string")
    rows = bpe.encode(df, word_bpe_spec(), with_ids=False).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 2), (1, 0), (1, 0)]
    assert bpe.encode(df.limit(0), word_bpe_spec()).count() == 0


def test_automaton_follows_merges_in_order_on_a_small_alphabet():
    r = random.Random(1)
    for _ in range(60):
        # a random list of merges; each only joins what earlier ones made
        known, merges = list("ab") + ["a/", "b/"], []
        for _ in range(r.randint(1, 8)):
            u, v = r.choice([k for k in known if not k.endswith("/")]), r.choice(known)
            if u + v not in known:
                merges.append((u, v))
                known.append(u + v)
        auto = bpe.TokenAutomaton({t: i for i, t in enumerate(known)}, merges, "/")
        for _ in range(60):
            word = "".join(r.choice("ab") for _ in range(r.randint(1, 12)))
            parts = [*word[:-1], word[-1] + "/"]
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (u, v):
                        parts[i:i + 2] = [u + v]
                    i += 1
            assert auto.encode_word(word) == parts, (merges, word)


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 10)
    monkeypatch.setattr(bpe, "MAX_ARCS", 5)
    tok = bpe.Tokenizer(__import__("json").loads(word_bpe_spec()))
    once = [tok.encode(w) for w in fuzz(50)]
    assert once == [tok.encode(w) for w in fuzz(50)] and len(tok.words) <= 10


def test_decoded_digest_is_formed_from_the_ids(spark):
    import json
    spec = json.loads(word_bpe_spec())
    end = spec["model"]["end_of_word_suffix"]
    # an id with two labels: what the ids name differs from what the encoding path spelled
    spec["added_tokens"][0]["id"] = spec["model"]["vocab"]["dog" + end]
    df = spark.createDataFrame([(1, "a dog")], "doc_id long, text string")
    row = bpe.encode(df, json.dumps(spec), with_ids=False).first()
    text = f"a{end} {spec['added_tokens'][0]['content']}"
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_every_code_point_splits_as_in_the_library(library):
    tok = bpe.tokenizer(word_bpe_spec())
    # every code point, of the long runs of one class (and the planes without any) one in 97
    runs = ((0x3500, 0x9F00), (0xAC10, 0xD790), (0xD800, 0xE000), (0xE100, 0xF800), (0x17100, 0x18700), (0x20100, 0x2A600), (0x30100, 0x31300),
            (0x34000, 0x3C000), (0x40000, 0x110000))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 97 == 0 or not any(lo <= c < hi for lo, hi in runs))]
    texts = [" ".join(f"a{chr(c)}b1{chr(c)}2!{chr(c)}" for c in points[lo:lo + 64]) for lo in range(0, len(points), 64)]
    wanted = library.encode_batch(texts, add_special_tokens=False)
    differ = [hex(points[64 * i]) for i, (text, want) in enumerate(zip(texts, wanted))
              if " ".join(g[1] for g in tok.encode(text)) != " ".join(map(str, want.ids))]
    assert differ == []
