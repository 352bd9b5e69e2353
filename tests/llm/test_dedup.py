"""Exact, near, substring and suffix deduplication against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from check import compare, duck
from conftest_llm import FOLDER, WORD

from veilspark.llm import exact, jaccard, queries, repeats, suffixes
from veilspark.llm.components import components


def repeats_by_hand(texts, window=13):
    first = {}
    for i in sorted(texts):
        w = WORD.findall(texts[i])
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in texts.items():
        w = WORD.findall(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)
    return out


def test_substring_query(spark, texts):
    got = {r["doc_id"]: r for r in queries.op6_substring_dedup(spark, FOLDER).collect()}
    want = repeats_by_hand(texts)
    assert set(got) == set(want)
    assert sum(n for _, n, _ in want.values()) > 100
    for i, (words, removed, kept) in want.items():
        r = got[i]
        assert (r["n_words"], r["n_removed"]) == (words, removed)
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_substring_odd(odd, none):
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[1][0]["n_removed"] == 0 and by[1][0]["n_words"] == 4000
    # both rows of id 2 lose all to id 1 and nothing to each other
    assert [r["n_removed"] for r in by[2]] == [4000, 4000] and by[2][0]["text"] == ""
    assert {r["n_removed"] for r in by[None]} == {0, 4000}  # null ids come last
    assert by[7][0]["text"] == "one two three" and by[3][0]["text"] == ""
    assert repeats.remove_repeats(none).count() == 0
    kept = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(odd, layout=True).collect()}
    assert kept[7] == "one  two\tthree"


def test_anchor_cover():
    """Any two residues share a cover position within the period."""
    for d in range(repeats.PERIOD):
        assert any((c + d) % repeats.PERIOD in repeats.COVER for c in repeats.COVER)


@pytest.mark.parametrize("offset", range(9))
def test_shifted_passage(spark, offset):
    passage = " ".join(f"p{i}" for i in range(13))
    pad = " ".join(f"q{offset}x{i}" for i in range(offset))
    df = spark.createDataFrame([(1, "a b c " + passage), (2, f"{pad} {passage} z")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(df).collect()}
    assert got == {1: 0, 2: 13}


def spans_by_hand(texts, length=50):
    have = defaultdict(set)
    for i, t in texts.items():
        w = WORD.findall(t)
        for k in range(len(w) - length + 1):
            have[tuple(w[k : k + length])].add(i)
    out = set()
    for i, t in texts.items():
        w = WORD.findall(t)
        start = end = None
        for k in range(len(w) - length + 1):
            if len(have[tuple(w[k : k + length])]) < 2:
                continue
            if end is None or k > end:
                if end is not None:
                    out.add((i, start, end - start))
                start = k
            end = k + length
        if end is not None:
            out.add((i, start, end - start))
    return out


def test_suffix_query(spark, texts):
    rows = suffixes.repeated_passages(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()
    want = spans_by_hand(texts)
    assert want and {(r["doc_id"], r["start"], r["n_words"]) for r in rows} == want
    for r in rows:
        words = WORD.findall(texts[r["doc_id"]])[r["start"] : r["start"] + r["n_words"]]
        assert WORD.findall(r["text"]) == words and r["other_id"] != r["doc_id"]


def test_suffix_odd(odd, none):
    rows = suffixes.repeated_passages(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["start"], r["n_words"]) for r in rows if r["doc_id"]) == [
        (False, 1, 0, 4000), (False, 2, 0, 4000), (False, 2, 0, 4000)
    ]
    assert [r["other_id"] for r in rows if r["doc_id"] == 2] == [1, 1]
    assert suffixes.repeated_passages(none).count() == 0


def near_by_hand(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(set(first.values()))
    root, links = {i: i for i in reps}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in reps:
        for b in reps:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    size = Counter(first[s] for s in sets.values())
    return {i: (first[s], size[first[s]], links[first[s]], find(first[s])) for i, s in sets.items()}


def columns(rows):
    return {r["doc_id"]: (r["class_id"], r["class_size"], r["n_links"], r["group_id"]) for r in rows}


def test_jaccard_query(spark, texts):
    assert columns(queries.op8_ngram_jaccard_join(spark, FOLDER).collect()) == near_by_hand(texts)


def test_jaccard_family(spark):
    """Near copies beyond one block: every link is counted, no row is a pair."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(300):
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(120))] = f"new{i}x{int(rng.integers(1000))}"
        rows[i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = near_by_hand(rows)
    got = columns(jaccard.near_groups(df).collect())
    assert max(n for _, _, n, _ in want.values()) > 128
    assert got == want
    assert jaccard.one_of_each(df).count() == len({g for *_, g in want.values()})


def test_jaccard_odd(odd, none):
    rows = jaccard.near_groups(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["class_id"] == 1 and by[2]["class_size"] == 4
    assert by[7]["class_id"] == 6 and by[7]["n_links"] == 0
    assert by[4]["class_id"] == 3 and by[5]["class_id"] == 3
    stay = jaccard.one_of_each(odd)
    assert stay.columns == odd.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == [1, 3, 6, 8, 9]
    assert jaccard.near_groups(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_pruning_never_hurts_certain_links():
    need = jaccard.fewest(0.8, 1e-8)
    assert need == sorted(need) and 60 < need[-1] < 90
    assert all(m < n for m, n in zip(need, range(16, 129, 16)))


def test_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200, 150), (170, 200)] + [(1000 + i, 999) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {150: 150, 170: 150, 200: 150} | {i: 999 for i in range(999, 1050)}


def test_exact_odd(odd, none):
    rows = exact.equal_groups(odd, digests=True).collect()
    assert len(rows) == odd.count()
    groups = defaultdict(list)
    for r in rows:
        groups[r["text_sha256"]].append(r)
    assert all(len(g) == g[0]["group_size"] and sum(r["kept"] for r in g) == 1 for g in groups.values())
    keep = {r["doc_id"]: r["keep_id"] for r in rows}
    assert keep[2] == 1 and keep[7] == 6 and keep[4] == 3 and keep[5] == 5
    plain = exact.equal_groups(odd)
    assert sorted(map(str, ((r["doc_id"], r["kept"]) for r in plain.collect()))) == sorted(map(str, ((r["doc_id"], r["kept"]) for r in rows)))
    stay = exact.drop_copies(odd)
    assert stay.columns == odd.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == [1, 3, 5, 6, 8, 9]
    assert exact.equal_groups(none).count() == 0 and exact.drop_copies(none).count() == 0


def test_exact_same_head(spark):
    """Equal in length and first characters, not in full."""
    head = "h" * exact.HEAD
    df = spark.createDataFrame([(1, head + "a"), (2, head + "b"), (3, head + "a")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.equal_groups(df).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False)}




@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, FOLDER), duck(FOLDER), queries.ORACLE[name])
    assert ok, note
