import re

from sightline.llm import line_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least=10, chars=1):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(FOLD)
    seen = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            seen.setdefault(key(line), set()).add(i)
    gone = {k for k, v in seen.items() if len(k) >= chars and len(v) >= least}
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        stay = [x for x in all_lines if key(x) not in gone]
        out.append((i, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, bitmap int, kept_text string, k int")
    return line_dedup.apply_bitmaps(docs, line_dedup.dropped_lines(docs, **options))


def test_equals_brute_force(spark):
    rows = [(i, f"own {i}\n Common LINE \n\ncommon line\n" + "pad\n" * (i % 3) + "é" * i) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "common line"), (103, "\n" * 200 + "Common line\n" * 150 + "end"), (104, "\t\ncommon line\r")]
    rows += [(100 + k % 2, "few\nonce") for k in range(12)]  # twelve rows, two documents
    rows += [(None, "common line\nz"), (None, "z"), (7, rows[7][1])]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in run(spark, rows).collect()), key=repr)
    assert got == brute_force(rows)


def test_first_occurrence_can_stay(spark):
    rows = [(i, "a\nb\na") for i in range(12)] + [(50, "b")]
    got = {r.doc_id: r.kept_text for r in run(spark, rows, keep_first=True).collect()}
    assert got == {0: "a\nb", **{i: "" for i in range(1, 12)}, 50: ""}


def test_bounds_and_empty_table(spark):
    rows = [(i, "ab\nabc") for i in range(10)]
    assert {r.kept_text for r in run(spark, rows, min_chars=3).collect()} == {"ab"}
    assert {r.kept_text for r in run(spark, rows, min_docs=11).collect()} == {"ab\nabc"}
    assert run(spark, []).collect() == []


def test_texts_are_split_once_for_the_hashes(spark):
    docs = spark.createDataFrame([(i, f"a\nb\nown {i}") for i in range(12)], "doc_id long, text string")
    found = line_dedup.dropped_lines(docs)
    assert "posexplode" not in found._jdf.queryExecution().toString()
    assert {r.doc_id: [tuple(w) for w in r.bitmap] for r in found.collect()} == {i: [(0, ~3)] for i in range(12)}
