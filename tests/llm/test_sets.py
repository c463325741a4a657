"""Operators that compare rows with one another, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealyard.llm import components, embeddings, jaccard, scoring, sentences, shingles, suffixes
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LAST = 1 << 62


def grouped(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# Components


def test_components_of_a_path_a_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 60)] + [(900, 901), (901, 900), (3, 3)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.component for r in components.components(df).collect()}
    assert all(found[i] == 100 for i in range(100, 141)) and all(found[i] == 5 for i in range(5, 60))
    assert found[901] == found[900] == 900 and 3 not in found
    assert components.components(df.limit(0)).count() == 0


HUGE = 9_200_000_000_000_000_000


def test_components_of_ids_of_any_size(spark):
    edges = [(HUGE + i, HUGE + i + 1) for i in range(10)] + [(-HUGE, -HUGE + 1), (HUGE + 100, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {HUGE + i: HUGE for i in range(11)} | {-HUGE: -HUGE, -HUGE + 1: -HUGE, HUGE + 100: 5, 5: 5}
    assert found == want


def test_operators_on_ids_of_any_size(spark):
    ids = [HUGE + i for i in range(6)] + [-HUGE - i for i in range(6)] + [2**53 + i for i in range(4)] + [None]
    rng = np.random.default_rng(3)
    bases = rng.standard_normal((len(ids), 8))
    rows = [(v, bases[i // 2].tolist(), 1) for i, v in enumerate(ids)]
    root = grouped(len(rows), links(rows))
    least = [min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    for block in (2, 5000):
        found = sorted(((r.vec_id is None, r.vec_id or 0, r.component_id, r.kept) for r in embeddings.near_vectors(df, block=block).collect()), key=repr)
        assert found == sorted(((v is None, v or 0, least[i], v == least[i]) for i, (v, _, _) in enumerate(rows)), key=repr)
    texts = [(v, f"w{i // 2}a w{i // 2}b w{i // 2}c w{i // 2}d w{i // 2}e w{i // 2}f") for i, v in enumerate(ids)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = cases.by_id([(r.doc_id, r.n_links, r.class_id, r.kept) for r in jaccard.similar_documents(df).collect()])
    assert found == similar(texts)


# Jaccard


def sets_of(texts):
    out = []
    for t in texts:
        w = WORD.findall(t or "")
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def similar(rows, threshold=0.8):
    """doc_id, links, class and kept of each row by comparing all pairs."""
    rows = sorted(rows, key=lambda r: _LAST if r[0] is None else r[0])
    sets = sets_of([r[1] for r in rows])
    linked = [(i, j) for j in range(len(rows)) for i in range(j) if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    n = [sum(i in pair for pair in linked) for i in range(len(rows))]
    root = grouped(len(rows), linked)
    return cases.by_id([(r[0], n[i], rows[root[i]][0], rows[root[i]][0] == r[0]) for i, r in enumerate(rows)])


def test_shingles_are_sets_of_word_runs():
    texts = [cases.words(1, 30), "", "a b", "a b c d e", " a  b\tc\nd e f ", "a b c d e f g a b c d e f g", None]
    found = list(shingles.Shingler(5).sets([t or "" for t in texts]))
    assert [len(f) for f in found] == [len(s) for s in sets_of(texts)]
    again = list(shingles.Shingler(5).sets(["zz " + texts[0]]))[0]
    assert len(np.intersect1d(again, found[0])) == len(found[0])


def test_jaccard_of_odd_rows(spark):
    found = jaccard.similar_documents(cases.frame(spark)).collect()
    assert cases.by_id(map(tuple, found)) == similar(cases.documents())
    assert jaccard.similar_documents(cases.frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_jaccard_links_of_near_copies(spark, block):
    rnd = random.Random(2)
    rows = []
    for group in range(6):
        base = cases.words(50 + group, 80).split()
        for _ in range(rnd.choice([1, 2, 12])):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = "w%d" % rnd.randrange(50)
            rows.append((len(rows) * 7 % 101, " ".join(text), None, None, 1))
    rows += [(200, rows[0][1], None, None, 1), (201, rows[0][1], None, None, 1), (150, rows[3][1], None, None, 1), (150, "other " + cases.words(99, 40), None, None, 1)]
    found = jaccard.similar_documents(cases.frame(spark, rows, clashing=False), block=block).collect()
    got = {r.doc_id: (r.n_links, r.class_id) for r in found if r.doc_id != 150}
    expected = similar(rows)
    assert got == {e[0]: e[1:3] for e in expected if e[0] != 150}


def test_prefixes_are_as_long_as_recall_allows():
    length = jaccard.prefix_length()
    assert 1 - (1 - 0.8**length) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (length + 1)) ** jaccard.TREES


# Suffix arrays


def test_look_ups_and_bounds_of_segments_are_exact():
    rng = np.random.default_rng(2)
    numbers = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    asked = np.concatenate([numbers[::3], rng.integers(-(1 << 63), (1 << 63) - 1, 50_000), numbers[:50] ^ (1 << 40)])
    assert (suffixes._Among(numbers).of(asked) == np.isin(asked, numbers)).all()
    assert not suffixes._Among(numbers[:0]).of(asked).any()
    texts = [b"", b"a" * 49, b"a" * 50, b"", b"ab" * 40, b"x" * 49, bytes(range(120)), b""]
    offsets = np.cumsum([0, *map(len, texts)])
    found = suffixes.Minima().segments(np.frombuffer(b"".join(texts), np.uint8), offsets)
    strings = sorted((int(r), int(p) + i) for part in found for _, r, p, n in zip(*part, strict=True) for i in range(n))
    assert strings == [(r, i) for r, t in enumerate(texts) for i in range(len(t) - 49)]


def test_suffix_array_is_sorted():
    rnd = random.Random(1)
    for _ in range(200):
        n, top = rnd.randint(1, 150), rnd.choice([1, 2, 5, 256])
        s = np.array([rnd.randint(0, top) for _ in range(n)], np.uint16)
        if rnd.random() < 0.2:
            s[:] = s[0]
        order = suffixes.suffix_array(s, 160)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        shared = suffixes.common_prefixes(s, order, 200)
        for k in range(1, n):
            a, b = s[order[k - 1] :], s[order[k] :]
            m = min(len(a), len(b))
            different = np.flatnonzero(a[:m] != b[:m])
            assert shared[k] == (different[0] if len(different) else m)


def removed(rows, length=50):
    first = {}
    rows = [(_LAST if d is None else d, (t or "").encode()) for d, t, *_ in rows]
    for doc, data in rows:
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, data in rows:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((None if doc == _LAST else doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return cases.by_id(out)


def cleaned(df, **options):
    rows = suffixes.remove_copied(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return cases.by_id([(*r[:4], hashlib.sha256(bytes(r[4])).hexdigest()) for r in rows])


@pytest.mark.parametrize("hot", [suffixes.HOT, 0])
def test_suffix_dedup_of_odd_rows(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes._frequent, "__defaults__", (1, 1 << 16))
    assert cleaned(cases.frame(spark), hot=hot) == removed(cases.documents())
    assert cleaned(cases.frame(spark, [])) == []


@pytest.mark.parametrize("hot", [suffixes.HOT, 30_000])
def test_suffix_dedup_of_passages(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes._frequent, "__defaults__", (3, 1 << 16))
    rnd = random.Random(3)
    passages = ["".join(rnd.choice("abc dé") for _ in range(n)) for n in (49, 50, 51, 90, 300)]
    rows = []
    for i in range(40):
        parts = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 120))), rnd.choice(passages), "z" * rnd.choice([0, 60]), rnd.choice(passages)]
        rows.append((i * 13 % 41, "".join(parts), None, None, 1))
    rows += [rows[4], (99, rows[4][1], None, None, 1), (7, rows[5][1] + "!", None, None, 1)]
    assert cleaned(cases.frame(spark, rows, clashing=False), hot=hot) == removed(rows)


def test_hot_hashes_are_known_by_their_bytes(spark, monkeypatch):
    """Long texts of one character are a hash of few rows and many bytes, whether the sample has seen it or not."""
    taken = []
    one_by_one = suffixes._one_by_one

    def watched(segments, length):
        taken.append({r.doc for r in segments.select("doc").distinct().collect()})
        return one_by_one(segments, length)

    monkeypatch.setattr(suffixes, "_one_by_one", watched)
    rows = [(i, cases.words(i, 60), None, None, 1) for i in range(20)]
    rows += [(31, "x" * 30_000 + " end", None, None, 1), (30, "y" + "x" * 20_000, None, None, 1), (32, "ab" * 9000, None, None, 1)]
    rows += [(33, "ab" * 400, None, None, 1), (34, "q " + "x" * 70, None, None, 1)]
    df = cases.frame(spark, rows, clashing=False)
    for share in (1 << 30, 1):
        monkeypatch.setattr(suffixes._frequent, "__defaults__", (share, 1 << 16))
        assert cleaned(df, hot=100_000) == removed(rows)
    # A row is taken for 76 bytes: the 1,855 rows of one letter are too many for a task, the 694 of two are not.
    assert taken == [{30, 31, 34}] * 2


def test_segments_do_not_depend_on_chunks(monkeypatch):
    data = np.frombuffer((cases.words(8, 3000) + "q" * 9000).encode(), np.uint8)
    offsets = np.array([0, 100, 120, 7000, len(data)])

    def strings():
        return sorted((int(h), int(r), int(p) + i) for part in suffixes.Minima().segments(data, offsets) for h, r, p, n in zip(*part, strict=True) for i in range(n))

    whole = strings()
    monkeypatch.setattr(suffixes, "_CHUNK", 700)
    assert strings() == whole
    assert len(whole) == sum(max(0, b - a - 49) for a, b in zip(offsets, offsets[1:], strict=False))


# Sentences


def kept_sentences(rows, span=sentences.SPAN, least=sentences.LEAST_WORDS):
    split = [re.findall(r"(?s).+?(?:[.!?]+\s+|\n\s*|\Z)", t or "") for _, t, *_ in rows]
    first = {}
    keyed = []
    for (doc, *_), parts in zip(rows, split, strict=True):
        keyed.append([])
        for i in range(len(parts)):
            for j in range(i + span, len(parts) + 1):
                run = [p.strip() for p in parts[i:j]]
                if sum(len(p.split()) for p in run) >= least:
                    keyed[-1].append((i, j, tuple(run)))
                    place = (_LAST if doc is None else doc, i)
                    first[tuple(run)] = min(first.get(tuple(run), place), place)
                    break
    out = []
    for (doc, text, *_), parts, runs in zip(rows, split, keyed, strict=True):
        gone = {k for i, j, r in runs if first[r] < (_LAST if doc is None else doc, i) for k in range(i, j)}
        out.append((doc, text if not gone else "".join(p for i, p in enumerate(parts) if i not in gone), len(parts), len(gone)))
    return cases.by_id(out)


def test_sentence_spans_of_odd_rows(spark):
    rows = cases.documents() + [(20, cases.sentences(30, 6), None, None, 1), (21, cases.sentences(31, 2) + " " + cases.sentences(30, 6) + " End. " + cases.sentences(30, 4), None, None, 1)]
    shout = "!! ".join(cases.words(77, 40).split())
    rows += [(30, "Once. " + shout + "!! a.", None, None, 1), (31, shout + "!! b. Twice.", None, None, 1), (32, "A. B. C. D.", None, None, 1), (33, "A. B. C. D.", None, None, 1)]
    found = sentences.remove_repeated_spans(cases.frame(spark, rows)).select("doc_id", "text", "n_sentences", "n_removed").collect()
    assert cases.by_id(map(tuple, found)) == kept_sentences(rows)
    assert sum(r.n_removed > 0 for r in found) >= 2
    assert sentences.remove_repeated_spans(cases.frame(spark, [])).count() == 0


def test_long_passages_of_few_sentences(spark):
    one, two, free = cases.words(401, 60), cases.words(402, 30) + ". " + cases.words(403, 30) + ".", cases.words(404, 300)
    lost = free.split()
    rows = [
        (1, one + "."), (2, "Begins here. " + one + ". Ends."), (3, "Quite new. " + two), (4, "Other words. " + two + "\nEnd."),
        (5, free), (6, free), (7, cases.words(405, 20) + " " + " ".join(lost[100:170]) + " " + cases.words(406, 20)), (8, "round and " * 200), (9, None), (10, "x " * 24),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in sentences.remove_repeated_spans(df, passage=sentences.PASSAGE).collect()}
    expected = dict(rows) | {2: "Begins here. Ends.", 4: "Other words. End.", 6: ""}
    assert {i: r.text for i, r in found.items() if i not in (7, 8)} == {i: t for i, t in expected.items() if i not in (7, 8)}
    left = found[7].text.split()
    assert left[:20] == rows[6][1].split()[:20] and left[-20:] == rows[6][1].split()[-20:] and len(left) <= 110 - 22 and found[7].removed_words == 110 - len(left)
    assert 25 <= len(found[8].text.split()) < 100


def without_repeats(rows, passage):
    """The texts left, by a table of where each run is first, and a search through it."""
    chooser, runs_of, first = sentences.WordRuns(passage), [], {}
    for doc, text in rows:
        parts = sentences.sentences_of(text)
        words = sentences.lengths_of(parts)
        found = [*sentences.runs_of(parts, words=words), *sentences.short_runs_of(parts, words, passage), *chooser.of(text)]
        runs_of.append(found)
        for start, _, digest in found:
            place = (_LAST if doc is None else doc, start)
            first[digest] = min(first.get(digest, place), place)
    texts = []
    gone = {}
    for (doc, text), found in zip(rows, runs_of, strict=True):
        place = _LAST if doc is None else doc
        for start, size, digest in found:
            at = first[digest]
            if at[0] < place or (at[0] == place and at[1] < start and at[1] <= start + min(size, 0)):
                gone.setdefault((place, text), set()).add((start, size))
    for doc, text in rows:
        removed = gone.get((_LAST if doc is None else doc, text), ())
        texts.append((doc, sentences.without_runs(text, sorted(removed))[0]))
    return cases.by_id(texts)


@pytest.mark.parametrize("often", [None, 2, 5])
def test_passages_against_brute_force(spark, often, monkeypatch):
    if often:
        monkeypatch.setattr(sentences, "_ONE_IN", 1)
        monkeypatch.setattr(sentences, "_OFTEN", often)
    rnd = random.Random(8)
    shared = [cases.words(500 + i, 45) for i in range(4)] + [cases.sentences(520 + i, 5) for i in range(4)] + [cases.words(530, 9) + "."] * 2
    rows = [(d, t) for d, t, *_ in cases.documents()]
    for i in range(60):
        parts = [cases.words(600 + i, 20) + ". "] + [rnd.choice(shared) + rnd.choice([" ", ". ", "\n"]) for _ in range(rnd.randint(0, 4))]
        rnd.shuffle(parts)
        rows.append((rnd.choice([i + 100, i + 100, -i - 100, None, 120]), "".join(parts)))
    rows += [(HUGE, shared[0]), (-HUGE, shared[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    # With "often" everything that is repeated so often is dealt out.
    assert bool(sentences.common_runs(df, passage=25)) == bool(often)
    found = sentences.remove_repeated_spans(df, passage=25).select("doc_id", "text").collect()
    assert cases.by_id(map(tuple, found)) == without_repeats(rows, 25)


def test_word_runs_are_shared_and_leave_no_gaps(monkeypatch):
    rng = np.random.default_rng(12)
    chooser = sentences.WordRuns(25)
    for vocabulary in (2, 500):
        shared = [f"w{i}" for i in rng.integers(0, vocabulary, 49)]
        texts = [[f"{side}{i}" for i in range(40)] + shared + [f"{side}{i}" for i in range(33)] for side in "ab"]
        found = [{d for _, _, d in chooser.of(" ".join(t))} for t in texts]
        assert found[0] & found[1]
    words = [f"w{i}".encode() for i in rng.integers(0, 300, 3000)] + [b"again"] * 500
    starts = chooser.starts(words)
    assert starts[0] == 0 and starts[-1] == len(words) - 25 and max(np.diff(starts)) <= 25
    monkeypatch.setattr(sentences, "_CHUNK", 700)
    assert chooser.starts(words) == starts
    assert chooser.starts(words[:24]) == [] and chooser.starts(words[:25]) == [0]


# Embeddings


def links(rows, threshold=0.93):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        x = np.array(v, float) if ok else None
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if ok else None)
    pairs = [
        (i, j) for j in range(len(rows)) for i in range(j)
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold
    ]
    return pairs


@pytest.mark.parametrize("block", [3, 40, 5000])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(6)
    rows = []
    for group in range(30):
        centre = rng.standard_normal(8)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (centre + rng.standard_normal(8) * rng.choice([0.0, 0.05, 0.25])).tolist(), group % 3))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [1.0, None] + [0.0] * 6, 1), (n + 3, [float("nan")] * 8, 1), (n + 4, rows[0][1], None)]
    rows += [(n + 5, [float("inf")] + [1.0] * 7, 0), (n + 6, [], 0), (n + 7, [1e300] * 8, 2), (n + 8, [1e-300] * 8, 2), (n + 9, [1.0, 2.0], 0), (n + 10, [2.0, 4.0], 0)]
    pairs = links(rows)
    root = grouped(len(rows), pairs)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("n_links", F.lit("given"))
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, block=block).collect()}
    assert found == {i: (sum(i in p for p in pairs), root[i], root[i] == i) for i in range(len(rows))}
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_cover_tree_bounds_hold():
    x = np.random.default_rng(7).standard_normal((400, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = embeddings.CoverTree(x)
    for node, children in enumerate(tree.children):
        gap = np.linalg.norm(x[tree.members[node]] - x[tree.centre[node]], axis=1)
        assert gap.max() <= tree.reach[node] + 1e-7
        if children is not None:
            assert sorted(np.concatenate([tree.members[c] for c in children])) == sorted(tree.members[node])
            assert all(tree.reach[c] <= tree.reach[node] / 2 + 1e-7 for c in children)


# Language model


def test_base_scores_and_counts(spark):
    import math
    import zlib
    from collections import Counter

    import public_tokenizers

    rows = [(i, cases.words(i % 9, 40 + i), None, None, 1) for i in range(60)] + cases.documents()
    found = scoring.score_documents(cases.frame(spark, rows), public_tokenizers.path(scoring.VOCABULARY)).collect()
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [[*WORD.findall((t or "").translate(table)), ""] for _, t, *_ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows]
    c = Counter(w for ts, h in zip(tokens, held, strict=True) if not h for w in ts)
    n, v = sum(c.values()), len(c)
    expected = [(r[0], h, len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)) for r, h, ts in zip(rows, held, tokens, strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for got, want in zip(sorted(map(tuple, found), key=key), sorted(expected, key=key), strict=True):
        assert got[:5] == want[:5] and got[5] == pytest.approx(want[5], rel=1e-9) and got[6] < 0
    same = [r.score for r in found if r.doc_id in (5, 6) and r.n_tokens == 121]
    assert len(same) == 3 and same == pytest.approx([same[0]] * 3, rel=1e-6)
    assert scoring.score_documents(cases.frame(spark, []), public_tokenizers.path(scoring.VOCABULARY)).count() == 0


def test_scores_do_not_depend_on_the_listed_words(spark, monkeypatch):
    import public_tokenizers

    rows = [(i, cases.words(i % 5, 30 + i) + " café" + " unseen" * (i % 10), None, None, 1) for i in range(40)]
    found = []
    for hot in (scoring.HOT, 3):
        monkeypatch.setattr(scoring, "HOT", hot)
        got = scoring.score_documents(cases.frame(spark, rows, clashing=False), public_tokenizers.path(scoring.VOCABULARY)).collect()
        found.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in got})
    for doc, row in found[0].items():
        assert found[1][doc] == pytest.approx(row, rel=1e-5)


def test_attention_is_trained_on_all_windows(spark):
    import public_tokenizers

    path = public_tokenizers.path(scoring.VOCABULARY)
    words, names = scoring.Subwords(path), [b"%d" % i for i in range(50257)]
    rows = [(i if i % 7 else None, cases.words(i % 11, 3 + i % 60), None, None, 1) for i in range(2500)]
    vocabulary = scoring.Vocabulary(np.ones(len(names), np.int64), names)
    df = cases.frame(spark, rows, clashing=False)
    expected = len(scoring.windows(np.array([len(words.of(scoring.words_of(r[1]))[0]) + 1 for r in rows]))[0])
    for tasks in (3, 40):
        model, seen = scoring.train_attention(df.repartition(tasks), path, vocabulary)
        assert seen == expected and all(np.isfinite(v).all() for v in model.p.values())


def _model():
    return scoring.Attention(300, -(-300 // scoring.CLASSES), seed=2)


def test_attention_is_a_distribution_and_causal():
    model = _model()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 300, (1, scoring.WINDOW)).astype(np.int32)
    state = model.states(x)[-1][0]
    total = sum(np.exp(model.log_parts(state, np.full(len(state), t, np.int32))[0]) for t in range(300))
    assert total == pytest.approx(np.ones(scoring.HALF), rel=1e-4)
    changed = x.copy()
    changed[0, scoring.HALF + 5 :] = 7
    assert model.states(changed)[-1][0, :5] == pytest.approx(state[:5], abs=1e-6)


def test_gradients_by_differences():
    model = _model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.masked = model.masked.astype(np.float64)
    rng = np.random.default_rng(2)
    flat = rng.integers(1, 300, 90).astype(np.int32)
    text, first = scoring.windows(np.array([89]))
    batch = scoring.batch_of(flat, np.zeros(len(text), int), np.full(len(text), 89), first)[:3]
    g = model.gradients(*batch)
    for name, value in model.p.items():
        at = np.unravel_index(np.argmax(np.abs(g[name])), value.shape)
        losses = []
        for step in (1e-4, -2e-4):
            value[at] += step
            losses.append(-model.log10(*batch).mean() * np.log(10))
        value[at] += 1e-4
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=2e-2), name


def test_scores_and_gradients_of_any_size_of_logits():
    """Softmax does not change if all logits are larger or smaller by the same, however much that is."""
    rng = np.random.default_rng(6)
    flat = rng.integers(1, 300, 500).astype(np.int32)
    at, first = scoring.windows(np.array([499]))
    batch = scoring.batch_of(flat, np.zeros(len(at), int), np.full(len(at), 499), first)[:3]
    plain = _model()
    logs, g = plain.log10(*batch), plain.gradients(*batch)
    for shift in (-300.0, 300.0):
        model = _model()
        model.p["class_bias"] += np.float32(shift)
        model.p["within_bias"][::2] += np.float32(shift)
        assert model.log10(*batch) == pytest.approx(logs, abs=1e-3)
        for k, v in model.gradients(*batch).items():
            assert np.allclose(v, g[k], atol=1e-4), k
    sharp = _model()
    sharp.p["query"] *= 1e4
    assert np.isfinite(sharp.log10(*batch)).all() and all(np.isfinite(v).all() for v in sharp.gradients(*batch).values())


def test_training_is_plain_adam_on_each_parameter():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 300, scoring.HALF * scoring._STEP * 2 + 1).astype(np.int32)
    model, plain = _model(), _model()
    assert model.train([text], rate=0.02, seed=9) == 2 * scoring._STEP
    at, first = scoring.windows(np.array([len(text) - 1]))
    order = np.random.default_rng(9).permutation(len(at))
    m, s = ({k: 0.0 for k in plain.p} for _ in range(2))
    for step, rows in enumerate(np.split(order, 2), 1):
        lengths = np.full(len(rows), len(text) - 1)
        g = plain.gradients(*scoring.batch_of(text, np.zeros(len(rows), int), lengths, first[rows])[:3])
        for k, v in plain.p.items():
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * s[k] + 0.01 * g[k] ** 2
            now = 0.02 * step / 20 * (1 - 0.9 * step / 2)
            v -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    for k, v in plain.p.items():
        assert model.p[k].shape == v.shape and np.allclose(model.p[k], v, atol=2e-5), k


def test_a_step_has_few_calls_for_each_class(monkeypatch):
    """Class by class there are only products: one forward and two back, and no other work on a few rows at a time."""
    seen = Counter()

    class Counting:
        def __getattr__(self, name):
            found = getattr(np, name)
            if isinstance(found, type) or not callable(found):
                return found

            def call(*args, **kwargs):
                seen[name] += 1
                return found(*args, **kwargs)

            call.reduceat = getattr(found, "reduceat", None)
            return call

    model = _model()
    rng = np.random.default_rng(3)
    flat = rng.integers(1, 300, 2000).astype(np.int32)
    at, first = scoring.windows(np.array([1999]))
    batch = scoring.batch_of(flat, np.zeros(len(at), int), np.full(len(at), 1999), first)[:3]
    monkeypatch.setattr(scoring, "np", Counting())
    model.gradients(*batch)
    assert seen.pop("dot", 0) <= 3 * scoring.CLASSES and sum(seen.values()) < 2 * scoring.CLASSES


def test_sums_of_rows_by_their_numbers():
    rng = np.random.default_rng(7)
    for kind in (np.float32, np.float64):
        rows, at = rng.standard_normal((5, 8, 6)).astype(kind), rng.integers(0, 9, (5, 8))
        at[at == 4] = 3
        found = scoring.sums(rows, at, 9)
        assert found.dtype == kind and found.shape == (9, 6) and not found[4].any()
        assert np.allclose(found, [rows[at == i].sum(0) for i in range(9)], atol=1e-5)


def test_no_product_goes_over_all_places_of_the_windows():
    """What is linear in the row of an id is multiplied once for each different id of a step."""
    sizes = []

    class Seen(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, out=None, **kwargs):
            if ufunc is np.matmul and max(np.ndim(i) for i in inputs) == 2:
                sizes.append(max(n for i in inputs for n in np.shape(i)))
            plain = [np.asarray(i) if isinstance(i, Seen) else i for i in inputs]
            if out:
                kwargs["out"] = tuple(np.asarray(o) if isinstance(o, Seen) else o for o in out)
            found = getattr(ufunc, method)(*plain, **kwargs)
            return out[0] if out else found.view(Seen) if isinstance(found, np.ndarray) else found

    model = _model()
    flat = np.random.default_rng(5).integers(1, 300, 2000).astype(np.int32)
    at, first = scoring.windows(np.array([1999]))
    batch = scoring.batch_of(flat, np.zeros(len(at), int), np.full(len(at), 1999), first)[:3]
    expected = model.gradients(*batch)
    model.p = {k: v.view(Seen) for k, v in model.p.items()}
    for k, v in model.gradients(*batch).items():
        assert np.allclose(np.asarray(v), expected[k], atol=1e-6), k
    assert len(sizes) > 5 and max(sizes) < batch[0].size


def test_every_id_is_scored_once():
    for n in (1, 2, 15, 16, 17, 32, 33, 100):
        text, first = scoring.windows(np.array([n, 3]))
        lengths = np.array([n, 3])
        x, scored, target, place = scoring.batch_of(np.arange(1, n + 8), np.array([0, n + 1])[text], lengths[text], first)
        seen = sorted(zip(np.repeat(text, scored.sum(1)).tolist(), place[scored].tolist(), strict=True))
        assert seen == [(0, i) for i in range(n)] + [(1, i) for i in range(3)]
        assert sorted(target.tolist()) == sorted([*range(2, n + 2), *range(n + 3, n + 6)])


def _small_model():
    """A model that has learned some words, among them ones that other words begin with; and how often each is there."""
    from collections import Counter

    import public_tokenizers
    from sealyard.llm.bytepairs import load_ranks

    path = public_tokenizers.path(scoring.VOCABULARY)
    subwords, ranks = scoring.Subwords(path), load_ranks(path)
    names = [token for token, _ in sorted(ranks.items(), key=lambda r: r[1])]
    rnd = random.Random(4)
    known = [b"a", b"an", b"anker", b"ankers", b"the", b"then", b"thenxyzzy", b"qqq", b"qqqq", "caf\u00e9s".encode(), "\u732b\u732b".encode(), b"sun", b"sunlit"]
    texts = [[rnd.choice(known) for _ in range(rnd.randint(0, 60))] for _ in range(150)]
    counts = np.zeros(len(names), np.int64)
    for words in texts:
        np.add.at(counts, subwords.of(words)[0], 1)
    vocabulary = scoring.Vocabulary(counts, names)
    model = scoring.Attention(vocabulary.total, vocabulary.per_class, unused=vocabulary.unused)
    model.train(40 * [scoring.sequence(subwords.of(words)[0], vocabulary) for words in texts])
    tokens = Counter(w for words in texts for w in [*words, b""])
    return model, vocabulary, subwords, texts, tokens


def test_words_and_the_end_share_at_most_one():
    """After any words, the probabilities of all known words and of the end, mixed and not, do not exceed one."""
    model, vocabulary, subwords, texts, tokens = _small_model()
    words = [w for w in tokens if w]
    near = []
    for before in [[], *(t[:n] for t in texts[:6] for n in (1, 2, 9, 30))]:
        found = [*([*before, w] for w in words), before]
        ids = [subwords.of(t) for t in found]
        unknown = [np.full(len(t) + 1, np.nan) for t in found]
        logs = scoring.score_texts(model, vocabulary, ids, unknown)[1]
        # Of the last text, the end; of the others, the word after those before.
        alone = 10 ** np.array([log[len(before)] for log in logs])
        assert alone.sum() < 1 + 1e-4
        shares = np.array([tokens[w] for w in [*words, b""]]) / tokens.total()
        assert (alone * (1 - scoring.MIX) + shares * scoring.MIX).sum() < 1 + 1e-4
        near.append(alone.sum())
    assert np.mean(near) > 0.9  # most of it, as the model has seen nothing else


def test_scores_are_those_of_a_plain_forward_pass():
    """The score of a text, place by place in plain loops."""
    model, vocabulary, subwords, texts, tokens = _small_model()
    p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    def at_place(numbers, place):
        """Probabilities of all numbers after ``numbers[: place + 1]``."""
        begin = place // scoring.HALF * scoring.HALF - scoring.HALF
        h = [p["embed"][numbers[i] if i >= 0 else 0] + p["place"][i - begin] for i in range(begin, place + 1)]
        query = h[-1] @ p["query"] / scoring.WIDTH**0.5
        weights = softmax(np.array([query @ (x @ p["key"]) for x in h]))
        state = h[-1] + sum(w * (x @ p["value"]) for w, x in zip(weights, h, strict=True)) @ p["out"]
        classes = softmax(state @ p["classes"] + p["class_bias"])
        inside = [softmax(state @ p["within"][c] + p["within_bias"][c]) for c in range(scoring.CLASSES)]
        return np.concatenate([c * i for c, i in zip(classes, inside, strict=True)]), classes[: vocabulary.heads].sum()

    for words in [[], [b"the"], texts[3], [b"unheard", "\u00fcber".encode(), *texts[5], *texts[6]], [b"x" * 70, b"a"]]:
        public, sizes = subwords.of(words)
        numbers = scoring.sequence(public, vocabulary)
        places = [at_place(numbers, i) for i in range(len(numbers) - 1)]
        total, at = 0.0, 0
        for word, size in [*zip(words, sizes.tolist(), strict=True), (b"", 1)]:
            share = 1 / places[at][1]
            for i in range(at, at + size):
                share *= places[i][0][numbers[i + 1]] * (10.0 ** vocabulary.rest_log[public[i]] if word else 1.0)
            at += size
            if word:
                share *= places[at][1]
            total += np.log10((1 - scoring.MIX) * share + scoring.MIX * tokens[word] / tokens.total())
        with np.errstate(divide="ignore"):
            own = np.log10(np.array([tokens[w] for w in [*words, b""]]) / tokens.total())
        got, waiting = scoring.score_texts(model, vocabulary, [(public, sizes)], [own])
        assert got[0] == pytest.approx(total, rel=1e-4, abs=1e-4) and not len(waiting[0])


def test_model_beats_word_frequencies_on_held_out(spark):
    rows = scoring.op3_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(rows) > 50 and sum(r.score for r in rows) > 0.98 * sum(r.base_score for r in rows)
