"""Near matches of many names in many texts through a deletion-neighbourhood index.

Two strings within k edits have the same string left after at most k characters of each are deleted, and that holds for
their first characters as well. So short names (two edits at most) and the distinct word groups of the texts meet on hashes of
their first eight characters with up to two of them deleted. A longer name admits three edits, of which its first or its last
characters, four or five of each, have one at most; there it is enough to delete one character of one end. Only pairs that
meet are measured. The work follows hits, not names x words, and a key has 77 hashes at most whatever its length. Pairs are
then led back to the places of their words: frequent words that are near no name never leave the join's hash test, and the
places of those that are near one spread by project and word.

``operators/mentions.py`` has the form for a handful of names per project, which stays inside the row of an answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.arrays import explode_items
from sightline.functions.similarity import jaro_winkler
from sightline.operators.mentions import edit_cap, token_spans

C = F.col
HEAD, MOST_EDITS = 8, 3
#: names up to this length admit two edits
SHORT = 7
#: least and largest length of names, and how many characters of each end they meet on (two ends fit into a name)
ENDS = ((8, 9, 4), (10, (1 << 31) - 8, 5))


def _kept(text: Column, mask: int, size: int) -> Column:
    """The first ``size`` characters of a text without the places that are bits of ``mask``."""
    stay = [i for i in range(size) if not mask >> i & 1]
    starts = [i for i in stay if i - 1 not in stay]
    ends = [i for i in stay if i + 1 not in stay]
    return F.concat(*[F.substring(text, a + 1, b - a + 1) for a, b in zip(starts, ends, strict=True)])


def neighbourhood(text: Column, edits: Column, most: int = MOST_EDITS) -> Column:
    """Hashes of the first characters of a text that is not empty, with up to ``edits`` of them deleted, and no more than ``most``."""
    masks = [m for m in range(1 << HEAD) if m.bit_count() <= most]
    hashes = [F.when((edits >= m.bit_count()) & (F.length(text) >= m.bit_length()), F.xxhash64(_kept(text, m, HEAD))) for m in masks]
    return F.array_compact(F.array_distinct(F.array(*hashes)))


def _ends(text: Column, size: int, longer: bool) -> list[Column]:
    """Hashes of both ends of a text, of ``size`` characters, with one deleted; and of the ends as they are or, if ``longer``, of those of one
    character more with one deleted. Ends within one edit, one of them in the longer form, share a hash."""
    out = []
    for side, own in enumerate((text, F.reverse(text))):
        left = [_kept(own, 1 << i, size) for i in range(size)]
        left += [_kept(own, 1 << i, size + 1) for i in range(size + 1)] if longer else [_kept(own, 0, size)]
        out += [F.xxhash64(F.lit(size), F.lit(side), x) for x in left]
    return out


def _hashes(text: Column, edits: Column, wider: int) -> Column:
    """Hashes of the head of a text, if it can be short, and of its ends by the classes of ENDS, each ``wider`` at both sides."""
    n, none = F.length(text), F.array().cast("array<bigint>")
    short = F.when(n <= SHORT + min(wider, 2), neighbourhood(text, edits, 2)).otherwise(none)
    long = [F.when(n.between(least - wider, most + wider), F.array(*_ends(text, size, wider > 0))).otherwise(none) for least, most, size in ENDS]
    return F.array_distinct(F.concat(short, *long))


def name_hashes(name: Column) -> Column:
    """Hashes on which a name meets all word groups within its edits."""
    return _hashes(name, edit_cap(name), 0)


def group_hashes(low: Column) -> Column:
    """Hashes on which a word group meets all names that it can be near to, of whatever length they are."""
    return _hashes(low, F.lit(2), MOST_EDITS)


def word_groups(answers: DataFrame, sizes: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """(key, project_id, words, text, position, len): each word outside URLs, and each run of as many words as a name of the
    project has. ``sizes``: (project_id, words)."""
    wanted = sizes.groupBy("project_id").agg(F.sort_array(F.collect_set("words")).alias("sizes"))
    spans = answers.join(wanted, "project_id").select(
        key, "project_id", "sizes", F.filter(token_spans("text"), lambda t: ~t["is_url"]).alias("spans"))
    per_size = explode_items(spans, [key, "project_id", "spans"], "sizes", "words")
    last = F.size("spans") - C("words") + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last))
    runs = explode_items(per_size, [key, "project_id", "words"], F.transform(starts, lambda s: F.slice("spans", s, C("words"))), "run")
    first, end = F.element_at("run", 1), F.element_at("run", -1)
    return runs.select(
        key, "project_id", "words", F.array_join(F.transform("run", lambda t: t["token"]), " ").alias("text"),
        first["at"].alias("position"), (end["at"] + F.length(end["token"]) - first["at"]).alias("len"))


def near_pairs(groups: DataFrame, names: DataFrame, floor: float = K.FUZZY_FLOOR) -> DataFrame:
    """(project_id, words, low, name, confidence): lower-cased word groups near a lower-cased name of their project, each
    pair once. ``groups`` (project_id, words, low) and ``names`` (project_id, words, name) hold each row once.

    A name of up to four characters admits one edit, up to seven two, longer ones three. A single word may differ by two
    characters in length. Names over four characters need a similarity as well. Equal strings are exact matches, not near.
    """
    cap = edit_cap(C("name"))
    left = groups.withColumn("h", F.explode(group_hashes(C("low"))))
    right = names.withColumn("h", F.explode(name_hashes(C("name"))))
    distance = F.levenshtein("low", "name", MOST_EDITS)
    longest = F.when(C("words") == 1, 2).otherwise(MOST_EDITS)
    met = left.join(right, ["project_id", "words", "h"]).filter(
        (C("low") != C("name")) & (F.abs(F.length("low") - F.length("name")) <= longest) & distance.between(0, cap))
    pairs = met.select("project_id", "words", "low", "name").distinct()
    n = F.length("name")
    least = F.when(n <= 7, max(K.FUZZY_FLOOR_MEDIUM, floor)).otherwise(floor)
    share = F.when(n <= 4, 1 - distance / F.greatest(F.length("low"), n)).otherwise(jaro_winkler(C("low"), C("name")))
    # as the only member of an array it is computed once, and not again by the filter
    scored = explode_items(pairs, ["project_id", "words", "low", "name"], F.array(share), "share")
    return scored.filter((n <= 4) | (C("share") >= least)).select("project_id", "words", "low", "name", (C("share") * 0.9).alias("confidence"))


def near_names(answers: DataFrame, names: DataFrame, floor: float = K.FUZZY_FLOOR, key: str = "snapshot_id") -> DataFrame:
    """(key, project_id, name, position, matched_text, len, confidence): places of words, or groups of words, near a name.

    ``answers`` (key, project_id, text); ``names`` (project_id, name), any number of them. Names of up to two characters,
    null names and null texts have no near matches; repeated names count once; a name of several words is met by
    groups of as many words, if it has more than four characters, and by single words.
    """
    own = names.select("project_id", C("name").cast("string").alias("written")).distinct().withColumn("name", F.lower("written"))
    own = own.filter(F.length("name") > 2).withColumn("n", F.size(F.split("written", r"\s+")))
    several = (C("n") > 1) & (F.length("name") > 4)
    own = own.withColumn("words", F.explode(F.when(several, F.array(F.lit(1), C("n"))).otherwise(F.array(F.lit(1))))).drop("n")
    groups = word_groups(answers, own.select("project_id", "words"), key).withColumn("low", F.lower("text"))
    index = own.select("project_id", "words", "name").distinct()
    pairs = near_pairs(groups.select("project_id", "words", "low").distinct(), index, floor)
    hits = groups.join(pairs, ["project_id", "words", "low"]).join(own, ["project_id", "words", "name"])
    return hits.select(key, "project_id", C("written").alias("name"), "position", C("text").alias("matched_text"), "len", "confidence")
