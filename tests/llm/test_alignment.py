"""Cross-tokenizer alignment against a brute-force reading of every token pair."""

import hashlib
from collections import Counter

import pytest
from test_tokens import ODD, docs, some_texts

from gaugeweave.llm import alignment, bpe, pieces, queries


def brute(texts):
    """Rows of the contract, from the libraries' own tokens and all overlaps of their byte ranges."""
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.VOCABULARY)
    tk.encode_special_tokens = True
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    shown = bpe.Vocabulary.from_json().shown

    def of_piece(i):
        return bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()

    def ranges(tokens):
        at, out = 0, []
        for i, x in tokens:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    found, counts = [], Counter()
    for t in texts:
        want = b" " + (t or "").encode()
        a = [(i, shown[i]) for i in tk.encode(" " + (t or ""), add_special_tokens=False).ids]
        b = [(i, of_piece(i)) for i in sp.encode(t or "")]
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            found.append(None)
            continue
        a, b = ranges(a), ranges(b)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        pairs, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            m = j
            while m < len(b) and b[m][1] < e:
                pairs.append((i, b[m][0]))
                m += 1
        parts = [f"{','.join(str(i) for i, s, e in a if lo < e <= hi)}|{','.join(str(i) for i, s, e in b if lo < e <= hi)}" for lo, hi in zip([0, *cuts], cuts)] if len(want) < 4000 else None
        found.append((len(a), len(b), len(cuts), pairs, parts))
        counts.update(pairs)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, cuts, pairs, parts = f
            rows.append((n_a, n_b, cuts, len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), parts and hashlib.sha256(";".join(parts).encode()).hexdigest()))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(got, want):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got}
    for i, w in enumerate(want):
        assert got[i][: 6 if w[6] is None else 7] == w[: 6 if w[6] is None else 7], i
    assert len(got) == len(want)


@pytest.mark.parametrize("hot", [1 << 20, 50, 0])
def test_equals_brute_force(spark, hot):
    texts = ODD * 2 + some_texts(5, 150) + some_texts(6, 80, "the catsé ,.▁")
    same(alignment.alignments(docs(spark, texts).repartition(3), hot=hot).collect(), brute(texts))


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    ids = {r.doc_id: k for k, r in enumerate(rows)}
    got = queries.QUERIES["op11_alignment"](spark, sf).collect()
    assert len(got) == len(rows) == len(ids)
    same([type(r)(**(r.asDict() | {"doc_id": ids[r.doc_id]})) for r in got], brute([r.text for r in rows]))


def test_odd_tables(spark, monkeypatch):
    assert alignment.alignments(docs(spark, ["a"]).limit(0)).count() == 0
    monkeypatch.setattr(alignment, "KNOWN_RUNS", 2)
    texts = [None, "the cat sat", "the cat sat", "", "▁ no"]
    d = docs(spark, texts).selectExpr("cast(null as long) as doc_id", "text", "1 as row", "2 as pairs", "3 as _text", "4 as n_a")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in alignment.alignments(d).collect())
    assert got == sorted(brute(texts))
    assert all(r.doc_id is None for r in alignment.alignments(d).collect())


def test_labels_and_spans():
    import numpy as np

    label = alignment.labels(6, np.array([2, 4, 6]), np.array([1, 4, 6]))
    assert label.tolist() == [2, 1, 0, 3, 0, 3]
    ends, a, b = alignment.groups(label)
    assert (ends.tolist(), a.tolist(), b.tolist()) == ([4, 6], [2, 3], [2, 3])
    assert [x.tolist() for x in alignment.links(label)] == [[1, 2, 4, 6], [0, 0, 1, 2], [0, 1, 1, 2]]
