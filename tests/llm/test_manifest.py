"""The Merkle manifest against a tree built by hand."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import FOLDER

from veilspark.llm import manifest, queries


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes):
    """(root, proof of each node): levels of runs of eight."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            proofs[i].append([nodes[k] for k in range(run, min(run + 8, len(nodes))) if k != p])
        nodes = [h("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0] if nodes else None, proofs


def by_hand(leaves):
    """``leaves``: (grp, id, leaf). Rows (grp, id, leaf, subroot, root, proof)."""
    groups = defaultdict(list)
    for g, i, x in leaves:
        groups[g].append((i is not None, i or 0, x, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = []
    for g in names:
        groups[g].sort(key=lambda r: r[:3])
        subs.append(tree([r[2] for r in groups[g]]))
    root, over = tree([s for s, _ in subs])
    return [
        (g, r[3], r[2], sub, root, h("".join(map("".join, proof + top))))
        for g, (sub, proofs), top in zip(names, subs, over)
        for r, proof in zip(groups[g], proofs)
    ]


def proved(spark, leaves):
    df = spark.createDataFrame([(*r, None) for r in leaves], "grp string, id long, leaf string, altered string")
    rows = manifest.prove(df.repartition(5)).collect()
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in rows)
    return Counter(tuple(r[c] for c in ("grp", "id", "leaf", "subroot", "root", "proof_sha256")) for r in rows)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (8, 9, 64, 65), (513, 4200)])
def test_sizes(spark, sizes):
    """Lone leaves, full and broken runs, and trees of one, two and three shuffles."""
    leaves = [(f"g{k}", i * 3 - 50, h(f"{k}.{i}")) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(leaves)
    assert proved(spark, leaves) == Counter(by_hand(leaves))


def test_nulls_copies_and_far_ids(spark):
    rng = random.Random(2)
    leaves = [(rng.choice([None, "", ".", "en", "Zé", "a"]), rng.choice([None, 0, -1, 7, 65535, 65536, -(1 << 63), (1 << 63) - 1, rng.randrange(1 << 40)]), h(str(rng.randrange(40)))) for _ in range(700)]
    assert proved(spark, leaves) == Counter(by_hand(leaves))


def test_more_groups_than_a_block(spark):
    leaves = [(f"g{i:04d}", 1, h(str(i))) for i in range(600)]
    assert proved(spark, leaves) == Counter(by_hand(leaves))


def test_bitmaps():
    rng = np.random.default_rng(3)
    for n in (1, 50, 5000, 60_000):
        ids = rng.integers(0, 1 << 16, n)
        parts = [manifest.pack_bitmap(*np.unique(p, return_counts=True)) for p in np.array_split(ids, 3) if len(p)]
        merged, rows = manifest.merge_bitmaps(parts)
        assert rows == n
        rank, same = manifest.Ranks(merged).of(ids)
        ordered = np.sort(ids)
        assert (rank == np.searchsorted(ordered, ids)).all()
        assert (same == np.searchsorted(ordered, ids, "right") - rank).all()
    assert len(manifest.pack_bitmap(np.arange(1 << 16), np.ones(1 << 16, np.int64))) < 8300
    assert len(manifest.pack_bitmap(np.array([7]), np.array([1]))) < 10


def test_query(spark):
    def value(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = {r["doc_id"]: h("".join(value(r[c]) for c in columns)) for r in docs}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = {r[1]: r for r in by_hand([(r["lang"], r["doc_id"], leaf[r["doc_id"]]) for r in docs])}
    rows = queries.op13_merkle_manifest(spark, FOLDER).collect()
    assert len(rows) == len(docs) == len(want)
    text = {r["doc_id"]: r["text"] for r in docs}
    changed = 0
    for r in rows:
        _, i, x, sub, root, proof = want[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (x, sub, root, proof)
        touched = zlib.crc32(str(i).encode()) % 3 == 0 and text[i] is not None and text[i].translate(lower) != text[i]
        assert r["verified"] == (not touched) == (r["folded_root"] == root)
        changed += touched
    assert changed > 10


def test_folded_root_of_an_altered_leaf(spark):
    leaves = [("a", i, h(str(i)), h("x") if i == 700 else None) for i in range(1000)]
    rows = manifest.prove(spark.createDataFrame(leaves, "grp string, id long, leaf string, altered string")).collect()
    other = by_hand([(g, i, a or x) for g, i, x, a in leaves])[0][4]
    for r in rows:
        assert r["verified"] == (r["id"] != 700) and r["folded_root"] == (other if r["id"] == 700 else r["root"])


def test_empty(spark):
    none = spark.createDataFrame([], "grp string, id long, leaf string, altered string")
    assert manifest.prove(none).collect() == []
