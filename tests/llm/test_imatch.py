"""I-Match against a plain computation of terms, lexicon, subsets and likeness."""

import struct
from collections import Counter

import regex
import xxhash

from quern.llm import imatch as M


def _h(*values):
    """Spark's xxhash64: each value is hashed with the last one's hash as its seed."""
    seed = 42
    for raw in values:
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def _long(x):
    return struct.pack("<q", x)


def _terms(text):
    words = {w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w}
    return sorted({_h(w.encode()) % M.SLOTS for w in words})


def _fingerprint(text, lexicon):
    every = _terms(text)
    show = lambda x: format(_h(*map(_long, x)) % (1 << 32), "x")
    out = []
    for j in range(M.EACH * M.DENSITIES):
        level, i = divmod(j, M.EACH)
        own = [t for t in every if t in lexicon and not (_h(_long(t), struct.pack("<i", level)) >> i * (level + 1)) % (1 << level + 1)]
        out.append(show(own) if own else "")
    return [*out, show(every)]


def _likeness(a, b):
    some = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in some) / len(some)


def test_edits_equal_brute_force(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[(i * 7 + k * k) % 60] for k in range(i % 9 + 1)) + (" RARE%d!" % i if i % 3 else "") for i in range(60)] + [None, "", "Same again", "same AGAIN", "x " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts, n = Counter(t for text in texts for t in _terms(text)), len(texts)
    lexicon, mass = set(), 0
    inside = {t: k for t, k in counts.items() if k <= max(1, M.COMMON * n)}
    for k in sorted(set(inside.values()), reverse=True):
        some = {t for t, v in inside.items() if v == k}
        lexicon |= some
        mass += k * len(some)
        if mass >= M.TERMS * n:
            break
    got = {r.doc_id: r for r in M.edits(df).collect()}
    assert len(got) == n
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % n] or ""
        half = len(text) // 2
        own, edited, follows = (_fingerprint(x, lexicon) for x in (text, text[: len(text) - half] + after[:half], after))
        assert got[i].fingerprint == ":".join(own) and got[i].edited_fingerprint == ":".join(edited)
        assert abs(got[i].near_edited - _likeness(own, edited)) < 1e-12 and abs(got[i].near_next - _likeness(own, follows)) < 1e-12
    assert got[62].fingerprint == got[63].fingerprint
    assert M.edits(df.limit(0)).count() == 0
