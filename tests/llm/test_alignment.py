"""Token alignment against whole-text tokenisation, token by token."""

import collections
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import token_alignment as T

HARD = [
    None, "", " ", "  ", "a", "a b", " a  b ", "x\n y", "x \n y", "x\n \ny  z", "end \n", "tab\t a", "café été a", "no break   space a", "　wide 　 x",
    "it's we'll 's don 't", "12 345 6", "<|endoftext|> <s> </s> <0x41> <unk>", "low ▁ line", "\U0001f600 \U0001f600\U0001f600 ok", "中文 文字 end", "  a  b",
    "\x00 \x01 a", "a \x85 b\x85 c", "q " * 300, "word " * 50 + "Word", "a-b -c - d", "Δεν ξ", "é x́ y",
]


def brute(text, own):
    """Groups as text, and all links (a, b), from the whole text."""
    if not text:
        return "", []
    a = own.a.encode(" " + text, add_special_tokens=False).ids
    b = own.b.encode(text)
    want = (" " + text).encode()
    if b"".join(own.bytes_a[i] for i in a) != want or b"".join(own.bytes_b[i] for i in b) != want:
        return "", []

    def ranges(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of[i]), i))
            at += len(of[i])
        return out

    ra, rb = ranges(a, own.bytes_a), ranges(b, own.bytes_b)
    ends = sorted({e for _, e, _ in ra} & {e for _, e, _ in rb})
    groups, low = [], 0
    for e in ends:
        groups.append(",".join(str(i) for s, t, i in ra if s >= low and t <= e) + "|" + ",".join(str(i) for s, t, i in rb if s >= low and t <= e))
        low = e
    starts, links = 0, []
    for s, t, i in ra:
        while rb[starts][1] <= s:
            starts += 1
        k = starts
        while k < len(rb) and rb[k][0] < t:
            links.append((i, rb[k][2]))
            k += 1
    return ";".join(groups), links


def expected(rows):
    own = T.loaded(T.TOKENIZER_A, T.TOKENIZER_B)
    got = [(i, *brute(t, own)) for i, t in rows]
    count = collections.Counter(p for _, _, links in got for p in set(links))
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for i, groups, links in got:
        sides = [g.split("|") for g in groups.split(";")] if groups else []
        n_a, n_b = (sum(len(s[k].split(",")) for s in sides) for k in (0, 1))
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(sides), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=repr)


def rows_of(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def hard():
    return [*enumerate(HARD), (None, "a b"), (3, "a b"), (3, "a b")]


@pytest.mark.parametrize("head", [0, 3, T.HEAD])
def test_hard_texts(spark, hard, head):
    docs = spark.createDataFrame([(i, t, 1) for i, t in hard], "doc_id long, text string, pairs int")
    assert rows_of(T.alignment(docs, head=head)) == expected(hard)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(T.alignment(docs)) == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_long_text_in_spans(spark, monkeypatch):
    text = "The quick  brown fox\njumps over the läzy dog. " * 400
    rows = [(1, text), (2, "short one"), (3, text + "▁")]
    monkeypatch.setattr(T, "TEXT_BYTES", 3_000)
    own = T.loaded(T.TOKENIZER_A, T.TOKENIZER_B)
    spans = list(T.cut_spans(" " + text, 3_000))
    assert len(spans) > 3 and "".join(spans) == " " + text and all(s.startswith(" ") for s in spans)
    assert T.segments(pa.array([text]), own.cuts)[1][0] > 1_000
    # The limit goes to the workers with the function that uses it.
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(T.alignment(docs)) == expected(rows)


def test_empty_table(spark):
    assert T.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_alignment_of_the_registered_query_is_whole(spark, sf):
    from lodestrata.llm import queries

    got = queries.QUERIES["op11_token_alignment"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.where(F.col("n_links") < F.col("n_groups")).count() == 0
