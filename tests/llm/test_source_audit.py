"""Source audit against brute force in Python's whole numbers."""

import collections
import re

import pytest

from lodestrata.llm import source_audit as A

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "lang string, source string, text string, tb int, who string"


def brute(rows, least=3, top=200):
    found = [(x or "", s or "", TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for x, s, t in rows]
    out = []
    for lang in {f[0] for f in found}:
        mine = [f for f in found if f[0] == lang]
        docs = collections.Counter(t for _, _, terms in mine for t in set(terms))
        kept = sorted(t for t, n in docs.items() if n >= least)
        group = {s: collections.Counter() for _, s, _ in mine}
        for _, s, terms in mine:
            group[s].update(t for t in terms if t in set(kept))
        whole = sum(group.values(), collections.Counter())
        v = len(kept)
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + v) for t in kept}
        shares, q = {s: p(c) for s, c in group.items()}, p(whole)
        f = lambda x, y: (x - y) * (x - y) // y
        for s in group:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in group if o != s]
            terms = [(t, f(shares[s][t], q[t])) for t in kept if group[s][t] and shares[s][t] > q[t]]
            for part, items, last in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda i: (-i[1], i[0].encode()))[:last], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


ODD = [
    ("en", "a", "The cat, the dog; THE end"), ("en", "a", "cat dog cat"), ("en", "b", "the cat sat"), ("en", "c", None), ("en", None, "dog the cat dog"), (None, "a", "x y z"),
    (None, None, ""), ("de", "a", "Äpfel äpfel 12äpfel_Äpfel"), ("de", "b", "äpfel Äpfel"), ("de", "b", "äpfel"), ("de", "b", "äpfel"), ("fr", "a", "seul"), ("fr", "b", None),
    *[("en", f"s{i}", f"cat {'dog ' * i}the t{i % 3} u{i % 2}") for i in range(12)],
]


@pytest.mark.parametrize("blocks", [(2, 2), (1, 100), (32, 4_096)])
def test_odd_rows(spark, blocks):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ODD], SCHEMA)
    assert rows_of(A.audit(docs, group_block=blocks[0], term_block=blocks[1], top=3)) == brute(ODD, top=3)


def test_empty_table(spark):
    assert A.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text_is_one_document(spark, monkeypatch):
    monkeypatch.setattr(A, "TEXT_BYTES", 500)
    rows = [("en", "a", "often seldom " * 500), ("en", "a", "often"), ("en", "b", "often seldom"), ("en", "b", "other " * 300)]
    assert rows_of(A.audit(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))) == brute(rows)


def test_large_counts_are_exact(spark):
    n, total = 8_999_999_999_999_998, 9_000_000_000_000_000
    got = spark.createDataFrame([(n, total), (0, 7)], "n long, total long").select(A.share("n", "total").alias("p")).collect()
    assert [r.p for r in got] == [1 + 1_000_000_000 * (n + 1) // total, 1 + 1_000_000_000 // 7]


def test_one_source_with_most_text(spark):
    rows = [("en", "big", f"w{i % 50} w{i % 7} common") for i in range(600)] + [("en", f"s{i}", f"w{i} common") for i in range(40)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert rows_of(A.audit(docs, group_block=8, term_block=16)) == brute(rows)
