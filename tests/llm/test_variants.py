import random
import re
import zlib
from collections import Counter

from stackwise.llm import variants as V

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def vocabulary(rows):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def want(rows):
    n = vocabulary(rows)
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def texts(seed, docs=120):
    r = random.Random(seed)
    letters = "abcdéÿÀ×z"
    base = ["".join(r.choice(letters) for _ in range(r.randint(7, 10))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "together", "Together", "ÀÀÀÀÀÀÀ"]

    def variant(w):
        p, c = r.randrange(len(w)), r.choice(letters)
        return r.choice([w[:p] + w[p + 1:], w[:p] + c + w[p:], w[:p] + c + w[p + 1:], w.upper()])

    words = base + [variant(w) for w in base * 6] + [variant(variant(w)) for w in base * 3]
    weights = [r.choice([1, 3, 40, 400]) for _ in words]
    return [(i, " ".join(r.choices(words, weights, k=r.randint(0, 120))) + r.choice(["", ".", "1", "日本"])) for i in range(docs)]


def test_equal_to_brute_force(make_docs):
    rows = texts(1) + [(None, "together togethre"), (7, None), (7, ""), (3, texts(1)[3][1]), (900, "q" * 3000 + " " + "q" * 2999 + " " + "Q" * 3000 + " " + "q" * 2999), (901, "q" * 3000)]
    df = make_docs(rows).selectExpr("*", "1 as word", "2 as code", "3 as m")
    out = V.spelling_variants(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = want(rows)
    assert sorted(map(tuple, out.collect())) == expected
    assert any(w[1] and w[2] != w[1] for w in expected) or any(w[1] for w in expected)
    assert V.spelling_variants(df.limit(0)).count() == 0


def test_chains_of_forms(make_docs):
    counts = {"abcdefgh": 2, "abcdefg": 25, "abcdefgi": 251, "abcdefgij": 2600}
    rows, i = [], 0
    for w, n in counts.items():
        left = n
        while left:  # ids whose checksum leaves the word whole
            if zlib.crc32(f"{i}:{w}".encode()) % 31:
                k = min(left, 200)
                rows.append((i, " ".join([w] * k)))
                left -= k
            i += 1
    got = sorted(map(tuple, V.spelling_variants(make_docs(rows)).collect()))
    assert got == want(rows) and {r[0]: r[2] for r in got}["abcdefgh"] == "abcdefgij"


def test_neighbourhood_is_full_and_has_no_repeats():
    r = random.Random(2)
    old, V.PIECE = V.PIECE, 97
    try:
        for _ in range(30):
            words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzàéÿ") for _ in range(r.choice([7, 8, 12]))) for _ in range(4)] + ["aaaaaaa"]
            code = {}
            for at, codes in V.neighbourhoods(words):
                for i, c in zip(at.tolist(), codes.tolist()):
                    assert c not in code.setdefault(i, set())
                    code[i].add(c)
            symbols = [tuple(int(x) for x in V._SYMBOL[list(w.encode("latin-1"))]) for w in words]
            letter = {}
            for c in "abcdefghijklmnopqrstuvwxyzàéÿ":
                letter.setdefault(int(V._SYMBOL[ord(c)]), c)
            for i, s in enumerate(symbols):
                near = {s} | {s[:p] + s[p + 1:] for p in range(len(s))}
                for c in letter:
                    near |= {s[:p] + (c,) + s[p:] for p in range(len(s) + 1)} | {s[:p] + (c,) + s[p + 1:] for p in range(len(s))}
                asked = set(V.reduced_codes(["".join(letter[x] for x in t) for t in near]).tolist())
                assert asked <= code[i] and (len(letter) < V.SYMBOLS or asked == code[i])
    finally:
        V.PIECE = old


def test_pieces_cut_between_runs(monkeypatch, make_docs):
    text = "abcdefghé " * 400 + "é" * 5000 + " done. " + "x" * 300
    whole = list(V._pieces(text.encode()))
    monkeypatch.setattr(V, "PIECE", 50)
    parts = list(V._pieces(text.encode()))
    assert whole == [text] and "".join(parts) == text and len(parts) > 20
    assert Counter(w for p in parts for w in V._RUN.findall(p)) == Counter(V._RUN.findall(text))
