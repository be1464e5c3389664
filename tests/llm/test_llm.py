"""The pipeline operators against brute force, on small tables with nulls, empties, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of
from maskwright.llm import bin_slack, chat_template, content_sort, noise_contrastive, private_spans, rotated_codes, simhash, source_schedule, subword_quality, url_rules
from maskwright.llm.common import components, running_sum

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Other columns with names that operators use inside.
DOCS = "doc_id long, text string, source string, fp long, row long, key string, n long, part int, _text string, doc string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    full = [(i, t, s, 1, 2, "k", 3, 4, "t", "d") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rnd.randint(0, 40)) for _ in range(60)) for _ in range(8)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20 + i, t.upper(), "s1") for i, t in enumerate(base[:3])]
    rows += [(30 + i, t.replace("alpha", "omega", 1) + " end", None) for i, t in enumerate(base)]
    rows += [(40, None, "s0"), (41, "", "s0"), (42, " \t\n", None), (43, "one", "s2"), (44, "One", "s2"), (44, "One", "s2"), (45, "É é", "é"), (None, base[0], "s0"), (46, None, None)]
    rows += [(50, "very long " * 20000, "s0"), (51, "straße ÄÖ\x0b\x1cx", "s1"), (52, "ÀB", "s1"), (53, "Àb", "s1")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op6_chat_format", "op7_url_rules", "op10_nearest"])
def test_query_matches_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


# --- helpers -------------------------------------------------------------------------------------


def test_components_of_random_graphs(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_running_sum_is_a_partition_of_the_key(spark):
    rows = spark.createDataFrame([("x" if i % 3 else "y", i, i % 5) for i in range(500)], "key string, id long, v long")
    got = running_sum(rows, "key", ["id"], F.col("v"), "before", bucket_rows=16).collect()
    for key in "xy":
        spans = sorted((r["before"], r["v"]) for r in got if r["key"] == key)
        at = 0
        for before, v in spans:
            assert before == at
            at += v


# --- 1 -------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps):
    """fps: list of (doc_id, fp); None is the largest id."""
    nodes = sorted({f for _, f in fps})
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for i, f in fps:
        if i is not None:
            low[find(f)].append(i)
    return {f: min(low[find(f)], default=None) for f in nodes}


def test_simhash_against_brute_force(spark, odd):
    got = simhash.near_groups(odd).collect()
    rows = odd_rows()
    fps = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    want = brute_components(fps)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter((i, f, want[f]) for i, f in fps)


def test_simhash_links_of_crowded_segments(spark):
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << rnd.randint(0, 63)) ^ (1 << rnd.randint(0, 63)) for _ in range(250)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert got == want


def brute_jaccard(a, b):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := WORD.findall(lowered(t))) else set() for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 0


def near_fixture():
    rnd = random.Random(21)
    word = lambda: "w" + str(rnd.randint(0, 5000))
    rows = []
    for g in range(30):
        base = [word() for _ in range(rnd.randint(60, 300))]
        rows.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(max(1, len(copy) // rnd.choice([40, 80, 100]))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    return [(i, t, "s") for i, t in enumerate(rows)]


def test_near_copies_against_all_pairs(spark):
    rows = near_fixture()
    pairs = [(a, b) for a, ta, _ in rows for b, tb, _ in rows if a < b and brute_jaccard(ta, tb) >= 0.8]
    docs = frame(spark, rows)
    _, found, groups = simhash.near_links(docs)
    key = {r["key"]: r["doc_id"] for r in docs.select(simhash.document_key().alias("key"), "doc_id").collect()}
    got = {tuple(sorted((key[r["a"]], key[r["b"]]))) for r in found.collect()}
    assert got <= set(pairs) and len(got) >= 0.95 * len(pairs) > 10
    assert {key[r["key"]] for r in groups.collect()} == {x for pair in got for x in pair}
    root = {i: i for i, _, _ in rows}
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    stay = {i for i in root if root[i] == i}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert stay <= left and len(left) <= len(stay) + 1


def test_a_large_group_of_near_copies_keeps_one(spark):
    rnd = random.Random(2)
    base = ["w" + str(rnd.randint(0, 5000)) for _ in range(400)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rnd.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(copy), "s"))
    assert [r["doc_id"] for r in simhash.drop_near_copies(frame(spark, rows)).collect()] == [0]


def mixed_families():
    """One large set that shares a passage: families of copies of copies, in steps that go on from any earlier copy."""
    rnd = random.Random(8)
    word = lambda: "w" + str(rnd.randint(0, 50000))
    passage = [word() for _ in range(80)]
    texts = []
    for _ in range(12):
        family = [[word() for _ in range(60)]]
        for _ in range(39):
            copy = list(rnd.choice(family))
            for _ in range(rnd.randint(1, 5)):
                copy[rnd.randrange(60)] = word()
            family.append(copy)
        texts += [" ".join(passage + f) for f in family]
    rnd.shuffle(texts)
    return [(i, t, "s") for i, t in enumerate(texts)]


def test_near_copies_of_a_large_mixed_set_against_all_pairs(spark, monkeypatch):
    rows = mixed_families()
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, _ in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    stay = {i for i in parent if find(i) == i}
    assert 20 < len(stay) < len(rows) - 20
    for block in (1024, 16):
        monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
        assert {r["doc_id"] for r in simhash.drop_near_copies(frame(spark, rows)).collect()} == stay

def test_the_near_stage_links_by_fingerprints_and_by_shingle_sets(spark):
    import corpus_pipeline

    draw = random.Random(11)
    words = lambda n: " ".join("".join(draw.choices("abcdefgh", k=7)) for _ in range(n))
    # Fingerprints count repeats: 1 has the one of 0, and less than half of its shingles in common with it.
    cycle = " ".join([words(5)] * 40)
    long, end = words(200), words(9)
    # 3 and 4 are alike by their sets of shingles only.
    texts = {0: cycle, 1: f"{cycle} {words(6)}", 2: words(80), 3: long, 4: f"{long} {end}", 6: "", 7: " "}
    rows = [(i, t, "s") for i, t in texts.items()]
    docs = frame(spark, rows)
    assert {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()} == {0, 1, 2, 3, 6, 7}
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, SF).collect()} == {0, 2, 3, 6, 7}
    assert "SimHash near-dedup" in dict(corpus_pipeline.STAGES)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs.where("doc_id < 6")).collect()}
    edges = {(r["a"], r["b"]) for r in simhash.near_edges(docs.where("doc_id < 6")).collect()}
    assert edges == {(i, root) for i, root in groups.items() if i != root} == {(1, 0)}


def test_near_copies_of_odd_rows(spark, odd, none):
    kept = simhash.drop_near_copies(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert {40, 41, 42, 43, 46, 51} <= set(ids)
    assert simhash.drop_near_copies(none).collect() == [] and simhash.near_groups(none).collect() == []


# --- 5 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups_against_brute_force(spark, odd, keep):
    rows = odd_rows() * 2
    by = defaultdict(list)
    for i, t, _ in rows:
        by[lowered(t)].append(i)
    pick = max if keep == "largest" else min
    best = {t: pick((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    got = content_sort.exact_groups(frame(spark, rows), keep=keep).collect()
    want = Counter((i, best[lowered(t)], len(by[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(by) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_a_run_over_many_partitions(spark):
    rows = [(i, "same text" if i % 3 else f"text {i % 7}", "s") for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = frame(spark, rows).repartition(5)
        got = content_sort.exact_groups(docs, keep="largest").collect()
        kept = content_sort.drop_exact_copies(docs)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(i for i, t, _ in rows if t == x) for x in {t for _, t, _ in rows})
        assert kept.columns == docs.columns
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] % 3} == {(2999, 2000)}
    assert sum(r["kept"] for r in got) == 8


def test_exact_groups_of_nothing(none):
    assert content_sort.exact_groups(none).collect() == [] and content_sort.drop_exact_copies(none).collect() == []


# --- 2 -------------------------------------------------------------------------------------------


def test_language_model_against_brute_force(spark, odd):
    rows = odd_rows()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, _ in rows:
        words = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want[(i, held(i), len(words), sum(w in counts for w in words), n, round(base, 6))] += 1
    got = noise_contrastive.score_texts(odd, subword_quality.held_out("doc_id", 7, 2)).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_language_model_is_a_distribution(spark, odd):
    texts = odd.select("text")
    counts, sent, model, mass, tokens, distinct = noise_contrastive.fit(texts, head=30)
    lexicon = sent.value
    table = 10.0 ** noise_contrastive.normalised(model).astype(float)
    assert np.allclose(table.sum(1), 1, atol=1e-4)
    known = {bytes(r["word"]): r["n"] for r in counts.collect()}
    assert len(lexicon.words) < len(known)
    own = dict(zip(lexicon.words[: lexicon.own], lexicon.classes[: lexicon.own]))
    for context in (0, 17, 160 * 9 + 12):
        total = sum(table[context, own[w]] if w in own else table[context, noise_contrastive.shape_of(w)] * (n + 1) / 10 ** mass[noise_contrastive.shape_of(w)] for w, n in known.items())
        total += sum(table[context, s] / 10 ** mass[s] for s in range(noise_contrastive.SHAPES))
        rest = table[context, noise_contrastive.SHAPES + lexicon.own :].sum()  # classes that no word has
        assert abs(total + rest - 1) < 1e-3


def test_language_model_beats_the_base_on_texts_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = noise_contrastive.score_texts(docs, subword_quality.held_out("doc_id", 7, 2)).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.1


@pytest.mark.parametrize("head, bucket", [(noise_contrastive.HEAD, noise_contrastive.BUCKET), (170, 64)])
def test_language_model_counts_word_triples(spark, odd, head, bucket):
    m, column = noise_contrastive, subword_quality.held_out("doc_id", 7, 2)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, sent, model, mass, _, _ = m.fit(odd.where(~column).select("text"), head)
    n, table, lexicon = {bytes(r["word"]): r["n"] for r in counts.collect()}, m.normalised(model), sent.value
    own = dict(zip(lexicon.words[: lexicon.own], lexicon.classes[: lexicon.own].tolist()))
    of = lambda w: own.get(w, m.shape_of(w))

    def walk(t):
        words = [m.END, m.END, *(t or "").encode().lower().split(), m.END]
        return zip(words, words[1:], words[2:])

    times, after = Counter(), Counter()
    for i, t, _ in odd_rows():
        for u, v, w in () if held(i) else walk(t):
            times[(u, v, w)] += 1
            after[(u, v, of(w))] += 1
    want = []
    for i, t, _ in odd_rows():
        total = 0.0
        for u, v, w in walk(t):
            total += table[of(u) * m.CLASSES + of(v), of(w)]
            if w not in own:
                share = (n.get(w, 0) + 1) / 10 ** mass[of(w)]
                total += math.log10((times[(u, v, w)] + m.STRENGTH * share) / (after[(u, v, of(w))] + m.STRENGTH))
        want.append((-1 if i is None else i, total))
    got = m.score_texts(odd, column, head=head, bucket=bucket).select("doc_id", "score", "base_score").collect()
    assert sum(len(lexicon.words) < len(n) for _ in got) == (len(got) if head == 170 else 0)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got)
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert np.allclose([x for _, x in got], [x for _, x in sorted(want)], rtol=1e-4, atol=1e-2)


def test_language_model_tells_texts_that_occur_twice(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(50)) for _ in range(300)]
    rows = [(i, texts[i % 300], "s") for i in range(330)]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in noise_contrastive.score_texts(frame(spark, rows), F.lit(False)).collect()}
    assert min(got[i] for i in range(30)) > max(got[i] for i in range(30, 300))


def test_language_model_learns_from_every_triple():
    size, own = noise_contrastive.CLASSES, noise_contrastive.SHAPES
    often = [(10, 10, t) for t in range(own, 60)]
    once = (100, 101, 59)  # three of some 10 ** 9: a sample would leave it out
    cells = np.array([(a * size + b) * size + t for a, b, t in [*often, once]])
    model = noise_contrastive.train(cells, np.array([2e7] * len(often) + [3.0]))
    table = 10.0 ** noise_contrastive.normalised(model).astype(float)
    assert table[100 * size + 101, 59] > 5 * table[10 * size + 10, 59]
    # Classes without a word have no share.
    assert np.allclose(table.sum(1), 1, atol=1e-4) and table[:, 60:].max() < 1e-30


def test_language_model_of_nothing(spark, none):
    assert noise_contrastive.score_texts(none, F.lit(False)).collect() == []
    unseen = noise_contrastive.score_texts(frame(spark, [(1, "a b", "s")]), F.lit(True)).collect()[0]
    assert (unseen["n_tokens"], unseen["n_known"], unseen["train_tokens"], unseen["base_score"], unseen["score"]) == (3, 0, 0, 0.0, 0.0)


# --- 3 -------------------------------------------------------------------------------------------

PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def accepted(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def brute_private(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN for m in p.finditer(text or "") if accepted(k, m.group())]


PRIVATE = [
    "a@b.c_x@d.e", "1.2.3.4.5.6.7.8 1.2.3.400 01.002.3.255", "4111 1111-1111 1111", "41111111111111112222 4111111111111111",
    "+1 (509) 555-6973) +49 3 ", "+1 509 555 6973 12 +12 34567 890", "é x@y.zz é 😀 q@w.e.r @a.b a@b", "", None, "--a@-.-",
    "4111 1111 1111 1111 1 1", "1-" * 3000, "a." * 3000 + "@x.y", "1.1.1.1.1", "+" * 50 + "1" * 9, "9" * 5000, "00000000000000000000001.2.3.4", "mail " * 3000 + "z@z.zz",
    "4111 1111 1111 1112 or 4111111111111111", "Tel. (415) 555-2671", "bob(at)example.com",
]


def test_private_spans_against_plain_patterns(spark):
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(PRIVATE)])
    for r in private_spans.digest(private_spans.find_private(docs)).collect():
        want = brute_private(PRIVATE[r["doc_id"]])
        assert hashlib.sha256(",".join(want).encode()).hexdigest() == r["base_sha256"], r
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k) for s in want) for k, _ in PLAIN]
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_private_spans_of_documents_are_the_base_and_some(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = private_spans.digest(private_spans.find_private(docs)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert hashlib.sha256(",".join(brute_private(texts[r["doc_id"]])).encode()).hexdigest() == r["base_sha256"]


def test_boosted_trees_learn_and_their_columns_agree(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(200):
        r = {f: rnd.randint(0, 4) for f in private_spans.FEATURES}
        r["n"] = 20
        r["yes"] = 18 if r["digits"] > 2 and r["named"] <= 1 else 1
        rows.append(r)
    model = private_spans.boost(rows)
    score = lambda r: model[0] + sum(private_spans._leaf(t, r) for t in model[1])
    assert min(score(r) for r in rows if r["yes"] > 1) > max(score(r) for r in rows if r["yes"] == 1)
    df = spark.createDataFrame([tuple(r[f] for f in private_spans.FEATURES) for r in rows], ", ".join(f"{f} int" for f in private_spans.FEATURES))
    total = sum((private_spans._tree_column(t, F.struct(*private_spans.FEATURES)) for t in model[1]), F.lit(model[0]))
    assert np.allclose([x[0] for x in df.select(total).collect()], [score(r) for r in rows])


def test_private_spans_use_no_python(spark, none):
    found = private_spans.digest(private_spans.find_private(none))
    assert found.collect() == []
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 4 -------------------------------------------------------------------------------------------


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing_is_whole_and_tight(spark, odd):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(tokenizer_path()), odd_rows()
    rows += [(100 + i, f"{'tok ' * (i * 37 % 900)}", "s") for i in range(300)]
    got = bin_slack.pack_documents(frame(spark, rows), tokenizer_path(), 4096, 1, with_ids=True).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for n, s in enumerate(range(0, len(ids), 4096)):
            want[(i, n, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    check_sequences(got, 4096)


def check_sequences(got, capacity):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // capacity) + 1


def test_fullest_against_all_combinations():
    rnd = random.Random(4)
    for _ in range(200):
        counts = {rnd.randint(1, 20): rnd.randint(1, 3) for _ in range(rnd.randint(0, 5))}
        room = rnd.randint(0, 40)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        got = bin_slack.fullest(counts, room)
        assert all(n <= counts[x] for x, n in got)
        assert sum(x * n for x, n in got) == max(s for s in sums if s <= room)


def test_packing_of_nothing(none):
    assert bin_slack.pack_documents(none, tokenizer_path()).collect() == []


# --- 6 -------------------------------------------------------------------------------------------


def test_templates():
    render = lambda template, **scope: [*chat_template.compile_template(template)(**scope)]
    text = lambda template, **scope: "".join(t for t, _ in render(template, **scope))
    assert text("a{{ 'b' + \"c\\n\" }}d") == "abc\nd"
    assert chat_template.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% elif true %}yes{% endif %}") == [("emit", ("const", "abcyes"))]
    xs = [{"v": 1}, {"v": 2}, {"v": 3}]
    assert text("{% for x in xs %}{{ loop.index }}{{ x.v }}{% if not loop.last %},{% endif %}{% endfor %}", xs=xs) == "11,22,33"
    assert render("{% generation %}{{ a }}{% endgeneration %}b", a="x") == [("x", True), ("b", False)]
    assert text("{% set y = a + '!' %}{{ (y | upper) }}", a="q") == "Q!"
    assert text("{% if a == 'x' and not b or c %}1{% else %}2{% endif %}", a="x", b=True, c="") == "2"
    assert text("{{ a.upper }}{{ b }}", a="x") == ""
    for wrong in ("{{ a.__class__ }}", "{{ a( }}", "{% for %}", "{% if a %}", "{% include 'x' %}", "{{ a | nofilter }}", "{{ a b }}", "{{ }}", "{% endfor %}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.parse(wrong)


def test_escape_is_reversible():
    rnd = random.Random(8)
    for _ in range(2000):
        t = "".join(rnd.choice("\\<|>\nim_endx") for _ in range(rnd.randint(0, 12)))
        for f in (chat_template.escape, chat_template.escape_line):
            assert chat_template.unescape(f(t)) == t and "<|" not in f(t)


def test_conversations_round_trip(spark):
    rnd = random.Random(6)
    said = ["<|im_end|><|im_start|>assistant ok", "", None, "a\nb", "\\", "<", "|im_end|>\n", "é😀", "x" * 300_000]
    rows = [(c, t, rnd.choice(["user", "assistant", "sys\ntem", None, "a\\<|b"]), rnd.choice(said), 1) for c in (1, 2, 3, None) for t in range(12)]
    rows += [(2, 3, "assistant", "same", 1)] * 2 + [(3, None, "user", "no turn", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment long")
    got = {r["conv_id"]: r for r in chat_template.read_back(chat_template.format_conversations(df)).collect()}
    assert len(got) == 4
    for c, r in got.items():
        turns = sorted(((t is not None, t or 0), role or "", text or "") for k, t, role, text, _ in rows if k == c)
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat_template.format_conversations(df.limit(0)).collect() == []


# --- 7 -------------------------------------------------------------------------------------------

URLS = [
    "http://a.com/en/x", "https://WWW.Example.COM/en/1?x=/fr/", "https://m.example.com/en/1", "https://m.www.example.com/en/", "http://x.net/es/q#f", "http://x.net/esx",
    "http://net/fr/", "http://com", "http://com?x", "ftp://u:p@b.com:80/", "no scheme/en/", None, "", "://", "http:///en/", "http://example.com/en", "http://a..example.com/en/",
    "http://" + "a." * 500 + "example.com/en/" + "b" * 5000, "http://notexample.com/en/", "x://y://example.com/en/",
]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("net", "/fr/", "allow"), (None, "/", "block")]


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lowered(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


def test_urls_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_rules.judge(pages, rules)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString().replace("Scan ExistingRDD", ""))
    got = {r["page_id"]: tuple(r)[1:] for r in got.collect()}
    assert got == {i: brute_verdict(u, RULES) for i, u in enumerate(URLS + URLS)}
    assert {r["verdict"] for r in url_rules.judge(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert url_rules.judge(pages.limit(0), rules).collect() == []


# --- 8 -------------------------------------------------------------------------------------------


def test_quality_on_texts_not_seen(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = entry.queries()["op8_quality"](spark, "/root/testdata/sf0.01")
    assert got.count() == docs.count()
    seen = got.where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert len(seen) > 50 and sum(r["predicted"] == r["quality"] for r in seen) >= 0.95 * len(seen)
    assert all(0 <= r["score"] <= 1 for r in seen)


def test_quality_hashes_do_not_depend_on_place():
    word = subword_quality._hashes(b"alpha")
    long = b"x" * 4090 + b" " + b"alpha"  # the word lies over the end of the table of powers
    for text in (b"  alpha\n", b"alpha alpha", long):
        assert set(word) <= set(subword_quality._hashes(text))
    assert [*subword_quality.features("")] == [] and [*subword_quality.features(" \n")] is not None


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(8)] + [(None, 1, 0), (5, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = subword_quality.train(odd, labels, F.lit(True))
    rows = subword_quality.score(odd, model, extra=[F.col("doc_id")]).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    empty = {round(r["score"], 12) for r in rows if r["doc_id"] in (40, 41, 42, 46)}
    assert len(empty) == 1
    assert subword_quality.score(none, model, extra=[F.col("doc_id")]).collect() == []
    flat = subword_quality.train(odd, labels.limit(0), F.lit(True))
    assert {r["score"] for r in subword_quality.score(odd, flat, extra=[F.col("doc_id")]).collect()} == {0.5}
    kept = subword_quality.keep_good(odd, labels, F.lit(True), 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()


# --- 9 -------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        share = {s: epochs * sizes[s] if s in full else rest * w[s] / free for s in names}
        over = {s for s in names if s not in full and share[s] > epochs * sizes[s]}
        if not over:
            return share
        full |= over


def check_mix(rows, got, weights=(5, 2, 1)):
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes, weights)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter(
        (i, len(WORD.findall(t or "")), sizes[s], round(float(want[s]), 6)) for i, t, s in rows
    )
    by_size = defaultdict(set)
    for s in sizes:
        by_size[(sizes[s], round(float(want[s]), 6))].add(s)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
    for k, names in by_size.items():
        assert abs(taken[k] - k[1] * len(names)) <= len(names)


def test_mix_against_brute_force(spark, odd):
    rnd = random.Random(12)
    rows = odd_rows() + [(200 + i, "w " * rnd.randint(0, 400), f"t{i % 9}" if i % 3 else "hot") for i in range(400)]
    docs = frame(spark, rows)
    got = source_schedule.mix_sources(docs, block_words=64).collect()
    check_mix(rows, got)
    again = source_schedule.mix_sources(docs.repartition(3), block_words=64).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_does_not_depend_on_how_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(source_schedule, "running_sum", lambda *args: running_sum(*args, bucket_rows=16))
    rnd = random.Random(13)
    rows = [(i, "w " * rnd.randint(1, 40), f"s{i % 3}") for i in range(300)] + [(None, f"v{i} " * 9, "s0") for i in range(20)] + [(7, "same words", "s0")] * 60
    docs = frame(spark, rows)
    first, second = (docs.repartition(n, *by) for n, by in ((2, ["text"]), (5, [F.xxhash64("doc_id")])))
    got = [source_schedule.mix_sources(d, block_words=64).collect() for d in (first, second)]
    check_mix(rows, got[0])
    assert Counter(map(tuple, got[0])) == Counter(map(tuple, got[1]))
    mixed = [source_schedule.mixed_documents(d, block_words=64).collect() for d in (first, second)]
    assert Counter(map(tuple, mixed[0])) == Counter(map(tuple, mixed[1]))


def test_mix_of_small_and_empty_sources(spark, none):
    rows = [(1, "a", "a"), (2, "b " * 5000, "b"), (3, "", "c"), (4, None, "d"), (5, "x y", None)]
    check_mix(rows, source_schedule.mix_sources(frame(spark, rows)).collect())
    assert source_schedule.mix_sources(none).collect() == []
    assert [r["taken"] for r in source_schedule.mix_sources(frame(spark, [(1, None, "a")])).collect()] == [0]


def test_schedule_interleaves_sources(spark):
    rows = [(i, "w " * 100, f"s{i % 3}") for i in range(300)]
    base = source_schedule.sized(frame(spark, rows), [F.monotonically_increasing_id().alias("row")])
    mix, _ = source_schedule.schedule(base, (5, 2, 1), 3, 50)
    slots = sorted({(r["slot"], r["key"]) for r in mix.where("slot is not null").collect()})
    for at in range(0, len(slots) - 80, 80):  # every stretch holds the sources in proportion
        share = Counter(k for _, k in slots[at : at + 80])
        assert abs(share["ss0"] - 50) <= 4 and abs(share["ss2"] - 10) <= 4


def test_mixed_documents_come_as_often_as_taken(spark):
    rows = [(i, f"w{i} " * 100, f"s{i % 3}") for i in range(60)]
    docs = frame(spark, rows)
    out = source_schedule.mixed_documents(docs)
    assert out.columns == docs.columns
    times = Counter(r["doc_id"] for r in out.collect())
    assert max(times.values()) <= 3 and abs(sum(times.values()) - 60) <= 3


def test_a_document_taken_in_part_comes_cut(spark):
    # One source is a single long document, one has a document twice, one ends in white space.
    long = "  " + "\t".join(f"l{i}" for i in range(5000)) + " \n"
    rows = [(1, long, "a"), (2, "x y z " * 400, "b"), (2, "x y z " * 400, "b"), (3, "q\u00a0r s" * 900, "c"), (4, None, "c"), (5, "", "d")]
    docs = frame(spark, rows)
    taken = {}
    for r in source_schedule.mix_sources(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    out = source_schedule.mixed_documents(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    words, texts = Counter(), {i: t for i, t, _ in rows}
    for r in out.collect():
        assert texts[r["doc_id"]].startswith(r["text"])
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert dict(words) == {i: n for i, n in taken.items() if n}
    assert any(n % 5000 for i, n in taken.items() if i == 1)


# --- 10 ------------------------------------------------------------------------------------------


def brute_nearest(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ok = list({(i, tuple(v)): (i, v) for i, v in ok}.values())
    out = set()
    for q, a in ok:
        if q % 50 == 0:
            best = sorted((-float(a @ b) / (math.sqrt(a @ a) * math.sqrt(b @ b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(best)}
    return out


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # one vector many times
    rows += [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [float("nan")] * 16), (2200, [1.0, None] * 8), (2250, [float("inf")] * 16), (None, rows[1][1]), (2300, [1.0, 2.0]), (2301, [2.0, 1.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, label int, cid string")
    got = rotated_codes.nearest(df, F.col("vec_id") % 50 == 0)
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()} == brute_nearest(rows)
    assert rotated_codes.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_nearest_of_vectors_whose_squares_leave_the_range(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e-200, 1e-200]), (2, [3e250, 0.0]), (3, [-1e300, 1e300]), (4, [5e-324, 5e-324]), (5, [1.0, 0.5]), (6, [0.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], round(r["score"], 12)) for r in rotated_codes.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    half = round(math.sqrt(0.5), 12)
    assert got == [(2, 1.0), (5, round(2 / math.sqrt(5), 12)), (1, half), (4, half), (3, -half)]


def test_nearest_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(rotated_codes, "BLOCK", 64)
    monkeypatch.setattr(rotated_codes, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rotated_codes.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got} == brute_nearest(rows)


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_keeps_clean_documents_and_drops_copies(spark, tmp_path):
    import corpus_pipeline

    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs, sizes = clean, []
    from maskwright.llm.common import hold

    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = hold(stage(spark, docs, "/root/testdata/sf0.01"), "stage")
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == clean.columns
        if name == "quality classifier":
            labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
            good = before.join(labels.where("quality = 1"), "doc_id").count()
            assert docs.join(labels.where("quality = 1"), "doc_id").count() >= 0.98 * good
            assert docs.join(labels.where("quality = 0"), "doc_id").count() <= 0.1 * labels.where("quality = 0").count()
        if name == "exact dedup":
            assert docs.count() == len({lowered(r["text"]) for r in before.select("text").collect()})
        if name == "SimHash near-dedup":
            texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
            shared = defaultdict(list)
            for i, t in texts:
                w = WORD.findall(lowered(t))
                for s in sorted({" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))}, key=lambda s: xxhash.xxh64_intdigest(s))[:12]:
                    shared[s].append((i, t))
            pairs = {(a[0], b[0]): (a[1], b[1]) for x in shared.values() for a in x for b in x if a[0] < b[0]}
            assert sum(brute_jaccard(*p) >= 0.8 for p in pairs.values()) == 0
    check_sequences(docs.collect(), 4096)
    packed = corpus_pipeline.run(spark, SF)
    assert {"sequence_id", "offset", "length"} <= set(packed.columns) and packed.count() > 0
