"""The training-data operators against brute force on small fixtures, with nulls, empty texts and repeated rows."""

import base64
import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
PATH = P.path("byte_bpe_50k.tiktoken")


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], DOCS)


def test_decontamination(spark):
    from quern.llm.decontaminate import contamination, decontaminated

    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "Tiny Item"), (3, None), (4, "!!"), (None, "zz yy")], "item_id long, text string")
    d = docs(spark, ["a " + item.upper() + " b", "x tiny, item.", None, "", "one two three", "zz yy"]).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in contamination(d, bench).collect()}
    assert (list(got[0].hit_spans), list(got[0].hit_items), got[0].n_words, got[0].longest_match) == ([1, 12], ["1"], 13, 11)
    assert list(got[1].hit_items) == ["2"] and not got[2].hit_spans and got[3].n_words == 0 and not got[4].hit_spans
    assert list(got[5].hit_spans) == [0, 2] and not got[5].hit_items
    assert sorted(r.doc_id for r in decontaminated(d, bench).collect()) == [2, 3, 4]
    assert contamination(d.limit(0), bench).count() == 0


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    from quern.llm.bpe import Encoder, decoded, encoded

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["a" * 999, "abab" * 50, " " * 40 + "x", "\n\n \t x", "don't we'll", "日本語 é🎉", "", "==" * 30, "١٢ ²³", "\x1c a　b"]
    rows = {r.doc_id: r for r in decoded(encoded(docs(spark, texts + [None]), PATH), PATH).collect()}
    for i, t in enumerate(texts):
        assert list(rows[i].input_ids) == true.encode_ordinary(t) and bytes(rows[i].decoded).decode() == t
    assert list(rows[len(texts)].input_ids) == []
    enc = Encoder(PATH)
    for t in ("aaaaa", "abcabcabd", "xyzzyx"):
        assert np.frombuffer(enc.many([t.encode()])[0], "<u4").tolist() == enc.one(t.encode())


def test_token_counts(spark):
    from tokenizers import Tokenizer

    from quern.llm.token_counts import token_counts

    path = P.path("byte_bpe_50k.json")
    true = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>  b", "é" * 50, None, "", "same words", "same words"]
    got = {r.doc_id: r for r in token_counts(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(true.encode(t or "", add_special_tokens=False).ids), len((t or "").encode()))


def test_html():
    from quern.llm.html_text import default_model, labelled_pages, order, parse

    m = default_model()
    page = "<body><nav><a>Home</a></nav><article><h1>T &amp; x</h1><p>One<b>two</b> three.<p>Four\n five.</article><footer>Foot</footer>"
    assert m.text(page) == "T & x Onetwo three. Four five." and m.text(None) == m.text("") == ""
    right = total = 0
    for html, content in labelled_pages.__wrapped__(80, 99):
        nodes = order(parse(html))
        p = m.marginals(nodes)
        for x in nodes:
            if x.tag == "#":
                right += (p[id(x)] >= 0.5) == bool(content(x))
                total += 1
    assert right > 0.93 * total


def test_warc(spark):
    from quern.llm.common import scratch_path
    from quern.llm.warc import read_archives, write_archives

    rows = [(1, "u", "a\r\n\r\nWARC/1.1\r\nb" * 9), (2, None, None), (3, "x y", ""), (4, "u", "é" * 700), (5, "u", "é" * 700), (6, "u", "x\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for chunk in (64, 1 << 16):
        path = scratch_path(spark, "test")
        write_archives(pages, path, chunk=chunk)
        got = {r.page_id: r for r in read_archives(spark, path).collect()}
        for i, _, t in rows:
            raw = (t or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert {i: got[i].refers_to for i in got if got[i].record_type == "revisit"} == {2: 3, 4: 5}


def test_classifiers(spark):
    from quern.llm import quality, toxicity

    texts = [("plain words %d here and there" % i) + (" awful" if i % 3 == 0 else "") for i in range(150)]
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(150)], "doc_id long, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    d = docs(spark, texts)
    m = toxicity.train(d, labels)
    for r in toxicity.scored(d, m).collect():
        assert (r.toxicity >= 0.5) == (r.doc_id % 3 == 0)
    assert toxicity.scored(docs(spark, [None, ""]), m).where("toxicity < 0.5").count() == 2
    shout = docs(spark, ["FOO!!! BAR!!! " * (i % 7 + 3) if i % 4 == 0 else "some quiet words in a line. " * (i % 5 + 2) for i in range(200)])
    good = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)], "doc_id long, quality int")
    q = quality.train(shout, good)
    for r in quality.scored(shout, q).collect():
        assert (r.quality_score >= 0.3) == (r.doc_id % 4 != 0)


def test_imatch(spark):
    from quern.llm.imatch import edits

    texts = ["alpha beta gamma %d delta" % (i % 5) for i in range(30)] + [None, ""]
    got = {r.doc_id: r for r in edits(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        h = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()
    assert got[0].fingerprint == got[5].fingerprint and got[30].near_next == 1.0


@pytest.mark.parametrize("sets", [512, 4])
def test_jaccard_components(spark, monkeypatch, sets):
    from quern.llm import jaccard_join as J

    monkeypatch.setattr(J, "REGION_SETS", sets)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 60, 5)] + [" ".join(base), "a b", "A B", "", None, " ".join(base[:57])]
    own = [frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else []) for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs(spark, texts), 3, 90).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_line_dedup(spark):
    """Equal normalised lines always go; similar ones at least where their SimHashes differ in three bits at most."""
    from quern.llm.line_dedup import deduplicated, line_hashes

    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    line = " ".join(words)
    texts = [line + "\nshort", line.upper() + "!\nshort", None, "", "quite other words in this line"]
    texts += [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in range(0, 120, 8)]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in deduplicated(d).collect()}
    assert [(got[i].text, got[i].n_dropped) for i in range(5)] == [(texts[0], 0), ("short", 1), (None, 0), ("", 0), (texts[4], 0)]
    sim = {r.doc_id: r.sim for r in line_hashes(d).collect()}
    near = [i for i in range(5, len(texts)) if bin(sim[i] ^ sim[0]).count("1") <= 3]
    assert near and all(got[i].n_dropped == 1 for i in near)
    assert deduplicated(d.limit(0)).count() == 0


@pytest.mark.parametrize("share", [50, 80, 90])
def test_pigeonholes_miss_no_link(share):
    import numpy as np

    from quern.llm.jaccard_join import Pigeonholes

    rng, signs, linked = np.random.default_rng(5), Pigeonholes(share), 0
    for _ in range(2000):
        n = int(rng.integers(2, 400))
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        most = n * (100 - share) // 100 + 1
        b = np.concatenate([a[: n - int(rng.integers(0, most + 1))], rng.integers(0, 1 << 64, int(rng.integers(0, most + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        c = len(np.intersect1d(a, b))
        u = len(a) + len(b) - c
        if c < u and 100 * c >= share * u:
            linked += 1
            assert len(np.intersect1d(signs(a), signs(b)))
    assert linked > 300
    assert not len(signs(np.zeros(0, np.uint64)))


def test_simhash_counts_long_lines(spark):
    from quern.llm.line_dedup import line_hashes

    texts = [" ".join("word%d" % (i * i % 9001) for i in range(n)) for n in (5, 127, 128, 3000)]
    d = docs(spark, [*texts, None, ""])
    word = d.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("x"))
    x = {r.w: r.x for r in word.collect()}
    got = {r.doc_id: r.sim for r in line_hashes(d).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for i, t in enumerate(texts):
        w = t.split()
        assert got[i] == sum(1 << b for b in range(63) if 2 * sum(x[v] >> b & 1 for v in w) > len(w))


def _by_brute_force(lines, least=5):
    """For each line: whether an earlier one is linked with it, directly or through others, by word edits within a fifth."""
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x):
            last, row[0] = row[0], i + 1
            for j, b in enumerate(y):
                last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (a != b))
        return row[-1]

    w = [x.split() for x in lines]
    root = list(range(len(w)))
    for i in range(len(w)):
        for j in range(i):
            if w[i] == w[j] or min(len(w[i]), len(w[j])) >= least and 5 * distance(w[i], w[j]) <= max(len(w[i]), len(w[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return [r != i for i, r in enumerate(root)]


def test_line_dedup_equals_brute_force(spark):
    """Every two lines within the edit similarity are linked, whatever their words: one change of 5, 8 or 14 words, 20 of 100."""
    from quern.llm.line_dedup import deduplicated

    rng, lines = np.random.default_rng(3), []
    for n in (5, 6, 8, 9, 10, 14, 15, 20, 24, 40, 100):
        for _ in range(4):
            vocabulary = [f"w{i}" if n % 2 else f"longword{i}" for i in range(int(rng.choice([3, 40, 3000])))]
            base = rng.choice(vocabulary, n).tolist()
            lines.append(" ".join(base))
            for edits in (1, n // 5, n // 5 + 1):
                now = list(base)
                for _ in range(edits):
                    at, kind = int(rng.integers(0, len(now))), int(rng.integers(0, 3))
                    now[at : at + (kind < 2)] = [str(rng.choice(vocabulary))] if kind else []
                if len(now) >= 5:
                    lines.append(" ".join(now))
    got = {r.doc_id: r.n_dropped for r in deduplicated(docs(spark, lines)).collect()}
    assert [got[i] == 1 for i in range(len(lines))] == _by_brute_force(lines)


def test_short_lines_repeat_too(spark, tmp_path):
    """op10 drops equal lines of any length, also in scripts without spaces; blank lines stay."""
    from quern.llm.queries import QUERIES

    thai, texts = "\u0e01\u0e32\u0e23\u0e17\u0e14\u0e2a\u0e2d\u0e1a", ["all rights reserved\n\none", "All rights  reserved!\n\ntwo", None, "***\n* **\none two"]
    d = docs(spark, [*texts, f"\u4e2d\u6587\u6bb5\u843d\n{thai}", f"{thai}\n\u4e2d\u6587\u6bb5\u843d\u3002\nthree"])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.n_dropped) for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 5)] == [(texts[0], 0), ("\ntwo", 1), (None, 0), ("***\none two", 1), ("three", 2)]


def test_copies_with_short_and_blank_lines_go(spark):
    import corpus_pipeline

    text = "a line of some more words\n\nshort\n \u00a0\n---"
    d = docs(spark, [text, text, None, "", "\n", text + "\nown"])
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, d, "").collect()}
    assert got == {0: text, 2: None, 3: "", 4: "\n", 5: "\n \u00a0\nown"}


def test_lines_of_short_words_are_like_others(spark):
    from quern.llm.line_dedup import deduplicated, line_hashes

    d = docs(spark, ["we are all in the same old boat", "we are all in the same new boat", "it is not so far to go by foot"])
    assert {r.doc_id: r.n_dropped for r in deduplicated(d).collect()} == {0: 0, 1: 1, 2: 0}
    words = d.select("doc_id", F.explode(F.split("text", " ")).alias("w")).select("doc_id", F.xxhash64("w").alias("x")).collect()
    for r in line_hashes(d).collect():
        x = [w.x for w in words if w.doc_id == r.doc_id]
        assert r.sim == sum(1 << b for b in range(63) if 2 * sum(v >> b & 1 for v in x) > len(x))


def test_repeated_rows_are_one_document(spark):
    from quern.llm.line_dedup import deduplicated, line_hashes

    a, b = "one line of a few longer words", "one line of a few other words"
    once, often = (spark.createDataFrame([(1, a)] * n + [(2, f"{b}\n{a}")] * n, DOCS) for n in (1, 5))
    assert sorted(map(tuple, line_hashes(once).collect())) == sorted(map(tuple, line_hashes(often).collect()))
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in deduplicated(often).collect()} == {(1, 1, 0), (2, 2, 2)}
