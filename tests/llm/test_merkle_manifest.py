import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sightline.llm import merkle_manifest as m

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes, fan):
    """The root of a list, and for each member the pairs (before, after) on its way."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run, slot = nodes[i // fan * fan :][:fan], i % fan
            ways[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        nodes, at = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)], [i // fan for i in at]
    return nodes[0], ways


def brute(rows, fan):
    sources = {}
    for doc_id, source, lang, n, text in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % m.TAMPER == 0 and text is not None
        changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if hit else text
        sources.setdefault(source, []).append((doc_id, leaf(doc_id, source, lang, n, text), leaf(doc_id, source, lang, n, changed)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(climb([r[1] for r in sources[s]], fan))
    root, over = climb([t[0] for t in trees], fan)
    found = []
    for s, (subroot, ways), top in zip(order, trees, over, strict=True):
        for (doc_id, own, claimed), way in zip(sources[s], ways, strict=True):
            folded = claimed
            for a, b in way + top:
                folded = sha(a + folded + b)
            found.append((doc_id, own, subroot, root, sha("".join(a + b for a, b in way + top)), folded, folded == root))
    return found


def result(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=str)


def rows_of(n_sources, seed=1):
    rng = random.Random(seed)
    rows = [(i, "hot", "en", 3, rng.choice(["Abc", "lower", "", None, "ÄÖ Straße X"])) for i in range(300)]
    rows += [(1000 + i, f"s{rng.randrange(n_sources)}", rng.choice(["en", None]), None, f"Text {i}") for i in range(200)]
    rows += [(None, "hot", None, None, "No id"), (None, None, None, None, None), (5, None, "en", 1, "A"), (7, "", "en", 1, "B"), (7, "", "en", 1, "B"), (7, "", "en", 1, "C")]
    rows += [(2**60 + 1, "hot", "en", 200_000, "Long " * 200_000), (2**60 + 2, "é", "en", 1, "ZZ"), (-4, "hot", "en", 1, "Neg")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("fan", "levels", "sources"), [(16, 3, 30), (2, 2, 7), (4, 1, 90), (3, 2, 12)])
def test_equals_brute_force(spark, fan, levels, sources):
    rows = rows_of(sources)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5).withColumns({"leaf": F.lit("x"), "claimed": F.lit(1), "seq": F.lit(2), "tree": F.lit(3)})
    got = result(m.manifest(m.leaves(docs, m.tampered_text()), fan, levels))
    assert got == sorted(brute(rows, fan), key=str)


def test_proofs_fold_to_the_root_and_single_rows(spark):
    docs = spark.createDataFrame(rows_of(9, 3), COLUMNS)
    for r in m.manifest(m.leaves(docs), 4, 2, proofs=True).collect():
        assert r.verified and r.folded_root == r.root and sha("".join(x for level in r.proof for x in level)) == r.proof_sha256
    one = m.manifest(m.leaves(docs.limit(1))).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].proof_sha256 == sha("")


def test_no_rows(spark):
    assert m.manifest(m.leaves(spark.createDataFrame([], COLUMNS), m.tampered_text())).collect() == []
