"""A Merkle manifest of a dataset: one hash tree per source, a tree over their roots, and for every row its proof, checked
against a claimed leaf.

Method. Rows are numbered in their source's order and cut into superblocks of ``FAN ** levels`` leaves. One pass reduces each
superblock to its top node; the few nodes above are reduced by plain aggregations of runs of ``FAN``. Then the leaves and the outer nodes that
they need (the runs on the way from the superblock's top to the root) are cogrouped by superblock: one call builds the levels
inside, joins the proof and folds the claimed leaf up to the root.

Scale. Numbering is a range partition of narrow rows (ids and hashes, no text) plus offsets of its partitions. A source that holds a third of
all rows is many superblocks; small sources share one. A group has at most twice ``FAN ** levels`` leaves and ``FAN`` hashes for
each outer level, whatever the input's size. Runs meet in lists of at most ``FAN``.

A leaf is the SHA-256 of the fields, each ``-`` if null, else its UTF-8 bytes, a colon and its text. Leaves of a source ascend by doc_id (null first),
equal ids by leaf; equal rows are leaves of their own. Null sources form a source, before all others; an empty source name is another. While a
level has several nodes, each run of ``FAN`` (the last may be shorter, even one) becomes the hash of its hex digests. Empty tables have no rows and no root.
"""

from __future__ import annotations

import hashlib
import string
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import written

FAN, LEVELS = 16, 3
#: one in so many ids is tampered with in the registered query
TAMPER = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf(*fields: Column) -> Column:
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def tampered_text() -> Column:
    """The text, for one id in ``TAMPER`` with A-Z in lower case."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER)) == 0
    text = F.col("text").cast("string")
    return F.when(hit, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)


def _ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place ``g`` in the order, from 0: ranges, sorted, and shifted by the sizes of the ranges before."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    rows = written(sorted_rows, name).withColumns({"piece": F.shiftright("seq", 33), "at": F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("piece").agg(F.count(F.lit(1)).alias("size"))  # one row for each partition
    before = sizes.select("piece", (F.sum("size").over(Window.orderBy("piece")) - F.col("size")).alias("before"))
    return rows.join(before, "piece").withColumn("g", F.col("before") + F.col("at")).drop("piece", "seq", "at", "before")


def _div(c: Column, by: int) -> Column:
    return F.floor(c / F.lit(by)).cast("long") if by & (by - 1) else F.shiftright(c, by.bit_length() - 1)


def _placed(leaves: DataFrame, block: int) -> DataFrame:
    """(tree, n, pos, top, big, bundle, doc_id, leaf, claimed): the place of each leaf in its source's tree and its superblock."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    ranked = _ranked(leaves, order, "leaves")
    sources = ranked.groupBy("source").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("n"))
    sources = _ranked(sources, [F.col("start").asc()], "sources").select(F.col("source").alias("s"), "start", "n", F.col("g").alias("tree"))
    own = ranked.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("pos", F.col("g") - F.col("start"))
    big = F.col("n") > block
    own = own.withColumns({"top": _div(F.col("pos"), block), "big": F.when(big, F.col("tree")).otherwise(-1)})
    bundle = F.when(big, F.col("top")).otherwise(_div(F.col("start"), block))
    return written(own.select("tree", "n", "pos", "top", "big", bundle.alias("bundle"), "doc_id", "leaf", "claimed"), "placed")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _runs(nodes: list[str], fan: int) -> list[str]:
    """The digests of each run in one text."""
    return ["".join(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]


def _inside(nodes: list[str], fan: int, levels: int | None) -> tuple[list[list[str]], str]:
    """The runs of each level within a superblock, and its top. ``levels``: None for a tree that ends in the superblock."""
    found: list[list[str]] = []
    while len(nodes) > 1 if levels is None else len(found) < levels:
        found.append(_runs(nodes, fan))
        nodes = [_sha(run) for run in found[-1]]
    return found, nodes[0]


def _trees(leaves: pd.DataFrame, block: int, levels: int):
    for (tree, top), own in leaves.sort_values(["tree", "pos"]).groupby(["tree", "top"], sort=False):
        yield tree, top, own, levels if own["n"].iloc[0] > block else None


def _climb(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (tree, pos, hash, n; n: nodes of the tree) to the runs of each level, (tree, run, hashes), and the last nodes, (tree, hash)."""
    most, levels, last = nodes.agg(F.max("n")).first()[0] or 0, [], [nodes.filter("n = 1")]
    while most > 1:
        members = F.array_sort(F.collect_list(F.struct("pos", "hash")))  # a run has at most FAN
        runs = nodes.filter("n > 1").groupBy("tree", "n", _div(F.col("pos"), fan).alias("run")).agg(F.transform(members, lambda x: x["hash"]).alias("hashes"))
        runs = written(runs, "runs")
        levels.append(runs.select("tree", "run", "hashes"))
        nodes = runs.select("tree", F.col("run").alias("pos"), F.sha2(F.array_join("hashes", "").cast("binary"), 256).alias("hash"), F.ceil(F.col("n") / fan).alias("n"))
        last.append(nodes.filter("n = 1"))
        most = -(-most // fan)
    return levels, reduce(DataFrame.union, [x.select("tree", "hash") for x in last])


def manifest(leaves: DataFrame, fan: int = FAN, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """``RESULT`` for rows (doc_id, source, leaf, claimed): the proof of each ``leaf`` and what ``claimed`` folds to with it.
    ``proofs`` adds ``proof``: the siblings of each level, left to right."""
    block = fan**levels
    rows = _placed(leaves.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "leaf", "claimed"), block)
    group = ["big", "bundle"]

    def tops(own: pd.DataFrame) -> pd.DataFrame:
        found = []
        for tree, top, part, depth in _trees(own, block, levels):
            big, bundle, n = (int(part[c].iloc[0]) for c in ("big", "bundle", "n"))
            found.append((big, bundle, tree, top, -(-n // block), _inside(list(part["leaf"]), fan, depth)[1]))
        return pd.DataFrame(found, columns=["big", "bundle", "tree", "pos", "n", "hash"])

    narrow = rows.select("big", "bundle", "tree", "top", "pos", "n", "leaf")
    blocks = written(narrow.groupBy(*group).applyInPandas(tops, "big long, bundle long, tree long, pos long, n long, hash string"), "tops")
    own_levels, subroots = _climb(blocks, fan)
    subroots = written(subroots, "subroots")
    over = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash").withColumn("n", F.lit(subroots.count()).cast("long"))
    over_levels, _ = _climb(over, fan)

    # the outer runs that each superblock needs: of its own tree (part 0), then of the tree over the sources (part 1)
    def needed(part: int, place: str, runs: list[DataFrame]) -> list[DataFrame]:
        found = []
        for k, level in enumerate(runs):
            by = ["run"] if part else ["tree", "run"]
            level = level.select(*by, "hashes")
            own = blocks.select(*group, "tree", F.col("pos").alias("top"), _div(F.col(place), fan ** (k + 1)).alias("run"), (_div(F.col(place), fan**k) % fan).alias("at"))
            found.append(own.join(level, by).select(*group, "tree", "top", F.lit(part).alias("part"), F.lit(k).alias("level"), F.col("at").cast("int").alias("at"), "hashes"))
        return found

    empty = rows.sparkSession.createDataFrame([], "big long, bundle long, tree long, top long, part int, level int, at int, hashes array<string>")
    outer = reduce(DataFrame.unionByName, [*needed(0, "pos", own_levels), *needed(1, "tree", over_levels)], empty)

    def finish(own: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        beyond: dict[tuple, list] = {}
        for tree, top, part, at, hashes in outside.sort_values(["part", "level"])[["tree", "top", "part", "at", "hashes"]].itertuples(index=False):
            beyond.setdefault((tree, top), []).append((part, "".join(hashes[:at]), "".join(hashes[at + 1 :])))
        found = []
        for tree, top, part, depth in _trees(own, block, levels):
            inside, node = _inside(list(part["leaf"]), fan, depth)
            way = beyond.get((tree, top), [])
            subroot = reduce(lambda x, step: _sha(step[1] + x + step[2]), [s for s in way if s[0] == 0], node)
            root = reduce(lambda x, step: _sha(step[1] + x + step[2]), [s for s in way if s[0] == 1], subroot)
            for i, (doc_id, leaf, claimed) in enumerate(zip(part["doc_id"], part["leaf"], part["claimed"], strict=True)):
                steps, at = [], i
                for runs in inside:
                    at, slot = divmod(at, fan)
                    steps.append((runs[at][: 64 * slot], runs[at][64 * (slot + 1) :]))
                steps += [s[1:] for s in way]
                folded = reduce(lambda x, step: _sha(step[0] + x + step[1]), steps, claimed)
                row = (doc_id, leaf, subroot, root, _sha("".join(a + b for a, b in steps)), folded, folded == root)
                if proofs:
                    row += ([[t[k : k + 64] for t in step for k in range(0, len(t), 64)] for step in steps],)
                found.append(row)
        names = [c.split(" ")[0] for c in schema.split(", ")]
        return pd.DataFrame(found, columns=names)

    # ids as text on the way, as pandas has no null among integers
    schema = RESULT.replace("doc_id long", "doc_id string") + (", proof array<array<string>>" if proofs else "")
    mine = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    done = mine.groupBy(*group).cogroup(outer.groupBy(*group)).applyInPandas(finish, schema)
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def leaves(docs: DataFrame, claimed_text: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, claimed) of documents; ``claimed`` has ``claimed_text`` in place of the text."""
    own = [F.col(c) for c in FIELDS]
    claimed = F.col("leaf")
    if claimed_text is not None:
        claimed = F.when(claimed_text.eqNullSafe(F.col("text")), claimed).otherwise(leaf(*own[:-1], claimed_text))
    return docs.select(*FIELDS).withColumn("leaf", leaf(*own)).select("doc_id", "source", "leaf", claimed.alias("claimed"))


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def sql_crc32(text: str) -> str:
    """The unsigned CRC-32 of a short ASCII text in DuckDB's SQL."""
    bit = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295)"


_HEAD = " || ".join(_sql_field(c) for c in FIELDS[:-1])
_LOWER = f"CASE WHEN {sql_crc32('doc_id::VARCHAR')} % {TAMPER} = 0 THEN translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') ELSE text END"
ORACLE = f"""
WITH RECURSIVE t AS (SELECT *, {_LOWER} AS changed FROM documents),
l AS (SELECT doc_id, source, sha256({_HEAD} || {_sql_field('text')}) AS leaf, sha256({_HEAD} || {_sql_field('changed')}) AS claimed FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER () AS id FROM l),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS hash, n FROM p
  UNION ALL SELECT tree, level + 1, pos // {FAN}, sha256(string_agg(hash, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN} FROM nodes WHERE n > 1 GROUP BY tree, level, pos // {FAN}, n
),
sub AS (SELECT tree, hash AS subroot FROM nodes WHERE n = 1),
over_nodes AS (
  SELECT 0 AS level, tree AS pos, subroot AS hash, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL SELECT level + 1, pos // {FAN}, sha256(string_agg(hash, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN} FROM over_nodes WHERE n > 1 GROUP BY level, pos // {FAN}, n
),
every AS (SELECT tree, level, pos, hash, n FROM nodes UNION ALL SELECT -1, 100 + level, pos, hash, n FROM over_nodes),
lists AS (SELECT tree, level, pos // {FAN} AS run, list(hash ORDER BY pos) AS hashes FROM every WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT id, lists.level, array_to_string(hashes[: k], '') AS before, array_to_string(hashes[k + 2 :], '') AS after
  FROM (SELECT id, x.tree, x.level, x.place // power({FAN}, x.level % 100)::BIGINT % {FAN} AS k, x.place // power({FAN}, x.level % 100 + 1)::BIGINT AS run
    FROM p, LATERAL (SELECT unnest([{{'tree': p.tree, 'place': p.pos, 'level': s}} FOR s IN range(12)] || [{{'tree': -1, 'place': p.tree, 'level': 100 + s}} FOR s IN range(12)], recursive := true)) x) w
  JOIN lists ON lists.tree = w.tree AND lists.level = w.level AND lists.run = w.run
),
ways AS (SELECT id, list({{'b': before, 'a': after}} ORDER BY level) AS way, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM steps GROUP BY id),
folds AS (
  SELECT id, claimed AS node, coalesce(way, []) AS way, 0 AS k FROM p LEFT JOIN ways USING (id)
  UNION ALL SELECT id, sha256(way[k + 1].b || node || way[k + 1].a), way, k + 1 FROM folds WHERE k < len(way)
),
root AS (SELECT hash AS root FROM over_nodes WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM p JOIN sub USING (tree) CROSS JOIN root LEFT JOIN ways USING (id) JOIN folds USING (id) WHERE folds.k = len(folds.way)
"""
