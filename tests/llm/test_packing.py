import random
import struct
from itertools import combinations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stackwise.llm import packing as P
from stackwise.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_fill_window_is_the_best_multiset():
    r = random.Random(2)
    for _ in range(200):
        counts = {}
        for _ in range(r.randint(0, 8)):
            n = r.randint(1, 40)
            counts[n] = counts.get(n, 0) + r.randint(1, 2)
        cap = r.randint(1, 90)
        used, best = P.fill_window(counts, cap)
        items = [n for n, c in counts.items() for _ in range(c)]
        sums = {sum(c) for k in range(min(len(items), 12) + 1) for c in combinations(items, k)} if len(items) <= 12 else None
        assert sum(n * k for n, k in used.items()) == best <= cap and all(k <= counts[n] for n, k in used.items())
        if sums is not None:
            assert best == max(s for s in sums if s <= cap)


def test_encoder_equals_the_tokenizer(corpus):
    tok = Tokenizer.from_file(PATH)
    texts = [t or "" for _, t in corpus[:150]] + ["It's 3.5, ok... 'tis <|endoftext|> x<|startoftext|>y", "\x1cab\x85c d", "İstanbul ΣΑΣ. Σ,", "a.b. .c ..", "ﬁ é ́", "日本語 ab日", "tab\tnew\nline\r\x0b"]
    got = WordEncoder(PATH).encode(texts)
    for t, raw in zip(texts, got):
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == tok.encode(t, add_special_tokens=False).ids


def test_encoder_with_marks_and_two_generations(monkeypatch):
    """Runs of marks behind words, a letter whose lower case ends with a mark, and words that the older generation knows."""
    from stackwise.llm import tokens

    tok = Tokenizer.from_file(PATH)
    texts = ["İ. İ, Xİ!! İ", "Word!! word,*** wörd;:", "", "don't, it's 'S x's. #'s", "x<|endoftext|> a<|startoftext|>,b", "word new 1,2. wörd"] * 2
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    read = lambda raws: [list(struct.unpack(f"<{len(r) // 4}I", r)) for r in raws]
    assert read(WordEncoder(PATH).encode(texts)) == want
    monkeypatch.setattr(tokens, "CACHE_WORDS", 4)
    few = WordEncoder(PATH)
    learned = []
    monkeypatch.setattr(few, "_words", lambda w, f=few._words: (learned.extend(w), f(w)))
    assert [read(few.encode([t]))[0] for t in texts] == want
    few.encode(["house"])
    few.encode(["a b c d e f g h"])
    learned.clear()
    few.encode(["house"])
    assert "house" not in learned and len(few._before) > 0


@pytest.mark.parametrize("window,block", [(4096, 1 << 20), (64, 500)])
def test_round_trip_without_padding(make_docs, corpus, window, block):
    tok = Tokenizer.from_file(PATH)
    rows = P.pack(make_docs(corpus), PATH, window=window, block_tokens=block).collect()
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for i, t in corpus:
        pieces = sorted(docs[i], key=lambda r: r.start)
        raw = b"".join(bytes(p.ids) for p in pieces)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:j]) for j in range(len(pieces))]
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert {p.doc_tokens for p in pieces} == {len(raw) // 4}
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [p.offset for p in s] == [sum(q.length for q in s[:j]) for j in range(len(s))]
        n = sum(p.length for p in s)
        assert n <= window and n & (n - 1) == 0  # full, or a power of two


def test_equal_lengths_stay_bounded(make_docs):
    rows = P.pack(make_docs([(i, "word " * 40) for i in range(300)], 1), PATH, window=64, block_tokens=200).collect()
    assert sum(r.length for r in rows) == 300 * 41 and P.pack(make_docs([]), PATH).count() == 0


@pytest.mark.parametrize("parts", range(1, 9))
def test_null_and_repeated_ids(make_docs, parts):
    """The end of a task may cut a document, so the pieces depend on the partitions; what they cover does not."""
    rows = P.pack(make_docs([(None, "a b"), (1, None), (1, None), (1, "")], parts), PATH).collect()
    ids = Tokenizer.from_file(PATH).encode("a b", add_special_tokens=False).ids + [2]
    mine = sorted((r for r in rows if r.doc_id is None), key=lambda r: r.start)
    assert [r.start for r in mine] == [sum(p.length for p in mine[:j]) for j in range(len(mine))] and {r.doc_tokens for r in mine} == {3}
    assert b"".join(bytes(r.ids) for r in mine) == struct.pack("<3I", *ids)
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, bytes(r.ids)) for r in rows if r.doc_id is not None] == [(1, 0, 1, 1, struct.pack("<I", 2))] * 3
