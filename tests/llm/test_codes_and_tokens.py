"""SentencePiece ids, vector codes and token links against the library and brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of
from maskwright.llm import active_lloyd, piece_merges, token_links
from maskwright.llm.common import Recent
from tests.llm.test_llm import SF, frame, odd_rows

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = "abcdeth THE  \n\t.,;0123▁éß²ﬁ①😀\x00 　<>/s_-"


def test_recent_keeps_what_recurs():
    made = []

    def make(keys):
        made.extend(keys)
        return [k * 2 for k in keys]

    recent = Recent(make, room=1000)
    for i in range(200):
        known = recent.of({"often", f"word{i}"})
        assert known["often"] == "oftenoften" and known[f"word{i}"] == f"word{i}" * 2
    assert made.count("often") == 1 and len(recent.young) + len(recent.old) < 20


# --- SentencePiece -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def merges():
    return piece_merges.Merges(PIECES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(ODD), max_size=60), max_size=5), st.text(max_size=20))
def test_ids_are_those_of_the_library(merges, texts, other):
    texts = [*texts, other.encode("utf-8", "ignore").decode()]
    got = [np.frombuffer(r, "<u4").tolist() for r in merges.encode(texts)]
    assert got == merges.library.encode(texts, add_bos=True, add_eos=True)
    assert [merges.decode(x) for x in got] == merges.library.decode(got)


def test_a_wrong_agenda_is_noticed():
    wrong = piece_merges.Merges(PIECES)
    del wrong.key["▁the"]
    wrong.encode(["the cat"])
    assert wrong.differs == {"▁the"}


def test_any_ids_decode_as_in_the_library(merges):
    rnd, blank = random.Random(2), merges.library.piece_to_id("▁")
    for _ in range(4000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(3), blank]) for _ in range(rnd.randint(0, 8))]
        assert merges.decode(ids) == merges.library.decode(ids)


def test_one_long_stretch(merges):
    text = "ab" * 60000 + "é" * 1000
    assert np.frombuffer(merges.encode([text], False, False)[0], "<u4").tolist() == merges.library.encode(text)




def test_other_kinds_of_vocabulary_are_refused(monkeypatch, merges):
    import sentencepiece

    raw = merges.library.serialized_model_proto()
    # The kind of model is field 3 of the trainer's settings; without it the default, which is no merging, holds.
    fields = [(k, v) for k, v in piece_merges._fields(raw) if k != 2]

    class Other:
        def __init__(self, model_file):
            pass

        def serialized_model_proto(self):
            return b"".join(bytes([k << 3 | 2]) + size(len(v)) + v for k, v in fields)

    def size(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + size(n >> 7)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError):
        piece_merges.Merges(PIECES)


def test_encoding_of_odd_rows(spark, merges):
    rows = odd_rows()
    docs = frame(spark, rows)
    want = Counter()
    for i, t, _ in rows:
        want[(i, tuple(merges.library.encode(t or "", add_bos=True, add_eos=True)), merges.library.decode(merges.library.encode(t or "")))] += 1
    coded = piece_merges.encode(docs, PIECES, decoded=True)
    whole = piece_merges.encode(docs, PIECES, decoded=True, check="texts").collect()
    got = coded.collect()
    assert Counter(map(str, got)) == Counter(map(str, whole))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want and all(r["agrees"] for r in got)
    back = piece_merges.decode(coded, PIECES).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in back) == Counter((i, d) for (i, _, d), n in want.items() for _ in range(n))
    assert piece_merges.encode(frame(spark, []), PIECES).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None, 523]), (None, [])], "doc_id long, ids array<int>")
    assert {(r["doc_id"], r["decoded"]) for r in piece_merges.decode(odd, PIECES).collect()} == {(1, ""), (2, merges.library.decode([523])), (None, "")}


def test_sentencepiece_query(spark, merges):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op11_sentencepiece"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == docs.keys() and len(got) == len(docs)
    for r in got:
        ids = merges.library.encode(docs[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["agrees"]
        assert r["decoded_sha256"] == hashlib.sha256(merges.library.decode(ids).encode()).hexdigest()


# --- vector codes --------------------------------------------------------------------------------


def lloyd(rows, parts, entries, rounds):
    """(codes, errors, codebooks) by comparing every part with every entry, in Python integers."""
    width = len(rows[0]) // parts
    cut = [[r[p * width : (p + 1) * width] for p in range(parts)] for r in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assigned():
        near = [[min((sum((x - y) ** 2 for x, y in zip(c[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        return [[j for _, j in n] for n in near], [sum(d for d, _ in n) for n in near]

    for _ in range(rounds):
        codes, _ = assigned()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [c[p] for c, code in zip(cut, codes) if code[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    return *assigned(), books


VECTORS = "vec_id long, embedding array<double>, label int, kept string, vec int, code int, error int, apart int, _group int, _sum int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "k", 1, 2, 3, 4, 5, 6) for i, v, label in rows], VECTORS)


@pytest.mark.parametrize("size", [1.0, 1e5])
def test_vector_codes_match_brute_force(spark, size):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.choice([0.0, 0.25, 0.5, rnd.random()]) * size for _ in range(8)], rnd.choice([1, 2, None])) for i in range(80)]
    rows += [rows[3], rows[3], (None, [0.1] * 8, None), (90, rows[5][1], 1)]
    dropped = [(91, None, 1), (92, [None] + [0.5] * 7, 1), (93, [float("nan")] + [0.5] * 7, 2), (94, [float("inf")] * 8, 2)]
    unfit = [(-5, [], 1), (95, [0.5] * 4, 2), (96, [1e200] + [0.0] * 7, 3)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    codes, errors, books = lloyd([[int(np.floor(x * 256)) for x in v] for _, v, _ in order], 4, 6, 3)
    coded, got_books = active_lloyd.compress(vectors(spark, rows + dropped + unfit).repartition(5), parts=4, entries=6, rounds=3, carry=("label",))
    assert got_books.tolist() == books
    got = Counter((r["vec_id"], r["label"], bytes(r["code"]) if r["code"] is not None else None, r["error"]) for r in coded.collect())
    want = Counter((i, label, bytes(c), e) for (i, _, label), c, e in zip(order, codes, errors))
    want.update((i, label, None, None) for i, _, label in unfit)
    assert got == want
    sums = active_lloyd.with_group_error(coded, "label", "label_error").collect()
    total = {}
    for (_, label, _, e), n in want.items():
        if e is not None:
            total[label] = total.get(label, 0) + e * n
    assert all(r["label_error"] == total.get(r["label"]) for r in sums) and len(sums) == len(rows + unfit)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([3, 300, 1 << 27]))
def test_only_what_moved_is_compared(seed, entries, most):
    rnd = np.random.default_rng(seed)
    x = rnd.integers(-most, most + 1, (30, 3, 2))
    books = rnd.integers(-most, most + 1, (3, entries, 2))
    code, apart = active_lloyd.assign(x, books)
    later = np.where(rnd.random((3, entries, 1)) < 0.4, rnd.integers(-most, most + 1, books.shape), books)
    got = active_lloyd.assign(x, later, code, apart, (later != books).any(2))
    for a, b in zip(got, active_lloyd.assign(x, later)):
        assert (a == b).all()
    d = ((x[:, :, None, :] - later[None]) ** 2).sum(3)
    assert (got[0] == d.argmin(2)).all() and (got[1] == d.min(2)).all()


def test_vector_codes_of_few_rows(spark):
    coded, books = active_lloyd.compress(vectors(spark, []))
    assert coded.count() == 0 and books.size == 0
    coded, books = active_lloyd.compress(vectors(spark, [(7, [0.5] * 16, None)]))
    row = coded.first()
    assert bytes(row["code"]) == bytes(16) and row["error"] == 0 and books.ravel().tolist() == [128] * 16
    with pytest.raises(ValueError):
        active_lloyd.compress(vectors(spark, [(7, [0.5] * 15, None)]))


def test_vector_codes_match_their_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()["op12_vector_codes"](spark, SF)
    cur = con.execute(entry.oracle_sql()["op12_vector_codes"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


# --- token links ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return token_links.Pair(BYTES, PIECES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(ODD + "\x1c\x85\u200b'sÀ5"), max_size=60), max_size=5), st.text(max_size=20))
def test_stretches_have_the_ids_of_whole_texts(pair, texts, other):
    texts = [*texts, other.encode("utf-8", "ignore").decode()]
    a, b = pair.ids(texts)
    assert a.to_pylist() == [e.ids for e in pair.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert b.to_pylist() == pair.b.encode(texts)


def brute(pair, text):
    """(n_a, n_b, groups, links) from all pairs of token spans."""
    whole = (" " + (text or "")).encode()
    a, b = pair.a.encode(whole.decode(), add_special_tokens=False).ids, pair.b.encode(text or "")

    def spans(ids, table):
        at, out = 0, []
        for i in ids:
            raw = table[i].as_py()
            out.append((at, at + len(raw), i))
            at += len(raw)
        return out, b"".join(table[i].as_py() for i in ids)

    (sa, ra), (sb, rb) = spans(a, pair.a_bytes), spans(b, pair.b_bytes)
    if not text or ra != whole or rb != whole:
        return 0, 0, [], Counter()
    groups, low = [], 0
    for end in sorted({e for _, e, _ in sa} & {e for _, e, _ in sb}):
        groups.append("|".join(",".join(str(i) for _, e, i in s if low < e <= end) for s in (sa, sb)))
        low = end
    return len(a), len(b), groups, Counter((i, j) for s, e, i in sa for u, v, j in sb if s < v and u < e)


def short_rows():
    rnd = random.Random(6)
    rows = [r for r in odd_rows() if len(r[1] or "") < 1000] + [(60, "<|endoftext|> <s></s> <0x0A>", "s"), (61, "a▁b", "s"), (62, " ", "s"), (63, "<|endoftext|>", "s")]
    return rows + [(100 + i, "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))), "s") for i in range(120)]


@pytest.mark.parametrize("hot", [0, 40, 1 << 19])
def test_links_match_brute_force(spark, pair, hot):
    rows = short_rows()
    found = [brute(pair, t) for _, t, _ in rows]
    counts = sum((f[3] for f in found), Counter())
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    want = Counter()
    for (i, _, _), (n_a, n_b, groups, links) in zip(rows, found):
        text = ";".join(groups)
        best = sum(n for (a, b), n in links.items() if counts[a, b] == most[b])
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        want[(i, n_a, n_b, len(groups), sum(links.values()), best, sum(n * counts[k] for k, n in links.items()), digest, text)] += 1
    got, pairs = token_links.align(frame(spark, rows).repartition(3), BYTES, PIECES, with_groups=True, hot=hot)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {(r["a"], r["b"]): (r["count"], r["best"]) for r in pairs.collect()} == {k: (n, n == most[k[1]]) for k, n in counts.items()}


def test_counts_of_a_task_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_links, "PAIRS", 3)
    rnd = random.Random(1)
    batches, want = [], Counter()
    for _ in range(30):
        lists = [[(rnd.randrange(4), rnd.randrange(4), rnd.randint(1, 3)) for _ in range(rnd.randint(0, 5))] for _ in range(4)]
        for a, b, n in (x for y in lists for x in y):
            want[a, b] += n
        columns = [pa.array([[x[c] for x in y] for y in lists], pa.list_(t)) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
        batches.append(pa.RecordBatch.from_arrays(columns, ["a", "b", "n"]))
    got = Counter()
    for batch in token_links._counted(iter(batches)):
        for r in batch.to_pylist():
            got[r["a"], r["b"]] += r["n"]
    assert got == want


def test_no_documents_and_a_long_one(spark, pair):
    found, pairs = token_links.align(frame(spark, []), BYTES, PIECES)
    assert found.count() == 0 and pairs.count() == 0
    text = "the cat sat on the mat. " * 60000
    rows, links = token_links.aligned(pair, [text])
    got = rows.to_pylist()[0]
    assert got["n_a"] == len(pair.a.encode(" " + text, add_special_tokens=False).ids) and got["n_b"] == len(pair.b.encode(text))
    assert got["n_links"] == got["n_a"] + got["n_b"] - got["n_groups"] == sum(links["n"].to_pylist())
