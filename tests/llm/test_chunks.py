import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stackwise.llm import chunks as K


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def texts_of(corpus):
    r = random.Random(5)
    texts = [t for _, t in corpus] * 2
    long = " ".join(r.choice(["alpha", "beta", "gamma", "délta", "日本"]) for _ in range(60000))
    texts += [long, long.replace(" ", "\n\t"), long + "!", "x" * 50000, "x" * 50000, "x" * 50001, "a b", "a  b", " a b", "a b ", "a b", None, "", " ", "\n \n"]
    return texts


def want(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i is None, i or 0) for i in ids)
        keep = None if keep[0] else keep[1]
        kept = False
        for i in ids:
            mine = i == keep and not kept
            kept = kept or mine
            out.append((i, keep, len(ids), mine, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,parts", [(128, 3), (4, 4), (128, 1)])
def test_groups_equal_brute_force(make_docs, corpus, bits, parts):
    texts = texts_of(corpus) if bits == 128 else [t for t in texts_of(corpus) if len(t or "") < 60000]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, "a b"), (None, "only here"), (None, "only here"), (3, texts[ids.index(3)])]
    df = make_docs(rows, parts).selectExpr("*", "7 as recipe", "8 as digest", "9 as chunk", "1 as at")
    out = K.exact_duplicates(df, digest_bits=bits)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == want(rows)
    assert K.exact_duplicates(df.limit(0)).count() == 0


def test_large_and_small_groups(make_docs, monkeypatch):
    rows = [(i, "the same text") for i in range(150)] + [(i, f"pair {i // 2}") for i in range(200, 240)] + [(i, f"alone {i}") for i in range(300, 330)]
    for hot in (1, 10, 1024):  # no group is dealt by a salt, the large one, all
        monkeypatch.setattr(K, "HOT", hot)
        assert sorted(map(tuple, K.exact_duplicates(make_docs(rows)).collect()), key=str) == want(rows)


def test_weak_digests_clash_and_identifiers_are_verified(make_docs, corpus):
    df = make_docs([(i, t) for i, t in enumerate(texts_of(corpus)) if len(t or "") < 5000])
    rows = K.verified_recipes(df, digest_bits=2).collect()
    assert any(any(r.recipe[j + 16:j + 20] != b"\0\0\0\0" for j in range(0, len(r.recipe), 20)) for r in rows)
    by_recipe = {}
    for r in rows:
        by_recipe.setdefault(bytes(r.recipe), set()).add(r.text_sha256)
    assert all(len(v) == 1 for v in by_recipe.values()) and len(by_recipe) == len({r.text_sha256 for r in rows})


def test_store_and_recipes_give_the_texts_back(make_docs, corpus):
    rows = list(enumerate(texts_of(corpus)))
    df = make_docs(rows)
    store = {bytes(r.digest): bytes(r.chunk) for r in K.chunk_store(df).collect()}
    for r in K.chunk_recipes(df).collect():
        assert b"".join(store[bytes(r.recipe[j:j + 16])] for j in range(0, len(r.recipe), 20)).decode() == normal(rows[r.doc_id][1])
    lengths = [len(c) for c in store.values()]
    assert max(lengths) <= K.LARGEST


def test_cuts_follow_content():
    r = random.Random(8)
    body = "".join(r.choice("abcdefgh ,.") for _ in range(80000))
    cut = lambda t: [bytes(c) for _, data, offsets, ends in K._sliced(pa.array(["head", t])) for c in K._chunks(data, offsets[1], ends[1])]
    plain, shifted = cut(body), cut("some other beginning " * 30 + body)
    assert len(set(plain) & set(shifted)) >= 0.9 * len(plain) and 600 < len(body) / len(plain) < 2500
    old, K.PIECE = K.PIECE, 777
    try:
        assert cut(body) == plain
    finally:
        K.PIECE = old
    rolled = K._cuts(np.frombuffer(body.encode(), np.uint8))
    for at in rolled[rolled >= K.WINDOW][:50]:
        h = sum(int(K._GEAR[b]) << (K.WINDOW - 1 - j) for j, b in enumerate(body.encode()[at - K.WINDOW:at]))
        assert (h & 0xFFFFFFFF) >> 22 == 0
