"""Variant spellings of personal names (problem 1).

Names are brought to a plain form and cut into parts; a part that opens or closes a name
is an anchor. Anchors form a metric space under the edit distance. Each anchor is assigned
to its nearest pivot and replicated to every pivot that is at most two radii farther: by the
triangle inequality two anchors within the radius then meet in the home cell of either. The
radius join inside a cell is exact and pairs only records that agree on a key (date of birth
or a document number). Candidate pairs are then compared part by part in both scripts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarraf.session import cut

#: Titles and words between given names and father's names, in both scripts.
TITLES = frozenset("mr mrs ms miss dr eng engr prof sheikh haj hajj السيد السيدة الدكتور المهندس الأستاذ د م أ".split())
SON_OF = frozenset("bin ibn ben bint بن ابن بنت".split())

#: Spellings of one sound in Latin transliteration, applied in this order.
SOUNDS = (("ph", "f"), ("ch", "sh"), ("dh", "th"), ("kh", "k"), ("gh", "g"), ("q", "k"), ("c", "k"), ("v", "w"), ("x", "sh"))
#: Arabic letters written for one another.
LETTERS = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ئ": "ي", "ؤ": "و", "ة": "ه", "ء": "", "ـ": ""})

_MARKS = re.compile(r"[ً-ٰٟ‎‏]")
_COMMA = re.compile(r"[,،]")
_BREAKS = re.compile(r"[^\w]+")
_VOWELS = re.compile(r"[aeiouy]+")
_TWICE = re.compile(r"(.)\1+")


def _sound(word: str) -> str:
    for written, plain in SOUNDS:
        word = word.replace(written, plain)
    return _TWICE.sub(r"\1", _VOWELS.sub("a", word))


def name_parts(name: str | None) -> list[str]:
    """The parts of a name, given name first: no titles, articles, case, marks or spelling habits.

    `Family, Given` and a leading family name with an article are turned round. A part of one
    letter is an initial. None and blank names have no parts.
    """
    if not name:
        return []
    text = unicodedata.normalize("NFKD" if name.isascii() else "NFKC", name).lower()
    text = "".join(c for c in _MARKS.sub("", text) if not unicodedata.combining(c)).translate(LETTERS)
    halves = [h for h in _COMMA.split(text) if h.strip()]
    if len(halves) == 2:
        text = f"{halves[1]} {halves[0]}"
    words = [w for w in _BREAKS.split(text) if w and w not in TITLES and w not in SON_OF]
    parts, family = [], []
    arabic = any("؀" <= c <= "ۿ" for w in words for c in w)
    glue, front = "", bool(words) and (words[0] == "al" or (arabic and words[0].startswith("ال") and len(words[0]) > 4))
    for at, word in enumerate(words):
        if word in ("al", "el", "ال"):
            glue = "al"
            continue
        if word in ("abu", "ابو"):
            glue = word
            continue
        if arabic:
            plain = word[2:] if word.startswith("ال") and len(word) > 4 and (at == 0 or at == len(words) - 1) else word
            plain = _TWICE.sub(r"\1", plain)
        else:
            plain = word if len(word) == 1 else _sound(word)
        if glue in ("abu", "ابو"):
            plain = glue + plain
        (family if front and not parts and not family else parts).append(plain)
        glue = ""
    return parts + family


@lru_cache(maxsize=200_000)
def edit_distance(a: str, b: str) -> int:
    """Levenshtein's distance, a metric."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        last, row[0] = row[0], j
        for i, x in enumerate(a, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != y))
    return row[-1]


@lru_cache(maxsize=200_000)
def _swapped(a: str, b: str) -> bool:
    """Whether two parts differ by one exchange of neighbouring letters alone."""
    if len(a) != len(b):
        return False
    at = [i for i in range(len(a)) if a[i] != b[i]]
    return len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]


def _close(a: str, b: str) -> bool:
    longest = max(len(a), len(b))
    return edit_distance(a, b) <= (0 if longest < 3 else 1 if longest < 8 else 2) or (longest > 2 and _swapped(a, b))


def compare_part(a: str, b: str, aliases: dict[str, frozenset[str]], last: bool = False) -> int:
    """2: one name, 1: compatible (an initial, or a cut-off end), 0: different."""
    if _close(a, b):
        return 2
    for x, y in ((a, b), (b, a)):
        formal = aliases.get(x)
        if formal and any(_close(f, y) for f in formal):
            return 2
        if len(x) == 1 and y.startswith(x):
            return 1
        if last and len(x) >= 2 and y.startswith(x):
            return 1
    return 0


def compare_names(a: list[str], b: list[str], aliases: dict[str, frozenset[str]]) -> tuple[int, int, int]:
    """(given, agreeing other parts, clashing other parts); given as of `compare_part`, -1 if a name is missing.

    The parts behind the given name are laid side by side in order; parts of the longer name
    may be left out, those of the shorter must find their like to agree.
    """
    if not a or not b:
        return -1, 0, 0
    if len(a) > len(b):
        a, b = b, a
    given = compare_part(a[0], b[0], aliases, last=len(a) == 1)
    agree = clash = 0
    at = 1
    for i in range(1, len(a)):
        for j in range(at, len(b)):
            like = compare_part(a[i], b[j], aliases, last=i == len(a) - 1)
            if like:
                agree += 1 + (like == 2)
                at = j + 1
                break
        else:
            clash += 1
    return given, agree, clash


def _turned(a: list[str], b: list[str], aliases: dict[str, frozenset[str]]) -> tuple[int, int, int]:
    """The best comparison of a name with another or with its last part in front."""
    best = compare_names(a, b, aliases)
    for x, y in ((a, b), (b, a)):
        if len(x) > 1 and len(y) > 1 and (best[0] < 2 or best[2]):
            other = compare_names([x[-1], *x[:-1]], y, aliases)
            if other[0] == 2 and not other[2] and other[1] >= 2:
                best = max(best, other, key=lambda r: (r[0] == 2 and not r[2], r[0], r[1] - 3 * r[2]))
    return best


def one_name(a_en: list[str], a_ar: list[str], b_en: list[str], b_ar: list[str], aliases: dict[str, frozenset[str]], keys: int) -> bool:
    """Whether two names are forms of one, given the number of kinds of keys (1 or 2) they agree on."""
    found = [r for r in (_turned(a_en, b_en, aliases), _turned(a_ar, b_ar, aliases)) if r[0] >= 0]
    if not found:
        return False
    full = [r for r in found if r[0] == 2 and r[2] == 0]
    if any(r[0] == 0 for r in found):  # another given name in one script needs a full agreement in the other
        strong = any(r[1] >= 4 for r in full) or (bool(full) and any(r[1] >= 2 for r in found if r[0] == 0))
        return bool(full) and strong or (keys > 1 and any(r[1] >= 2 and r[2] == 0 for r in found))
    if full and all(r[2] == 0 or r[1] for r in found):
        return True
    # No script agrees fully: initials or cut-off parts, or one damaged part.
    return any((r[1] >= 2 and r[2] == 0) or (r[0] == 2 and r[1] >= 2 and r[2] == 1) or (keys > 1 and r[2] == 0) for r in found)


def _anchors(parts: list[str], aliases: dict[str, frozenset[str]]) -> set[str]:
    ends = {parts[0], parts[-1]} if parts else set()
    for p in list(ends):
        ends |= aliases.get(p, frozenset())
    return {p for p in ends if len(p) > 1}


def read_aliases(table: DataFrame, most: int = 100_000) -> dict[str, frozenset[str]]:
    """Short form to formal forms, from a small dictionary table; refuses more than `most` rows."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} aliases")
    found: dict[str, set[str]] = {}
    for r in rows:
        for short, formal in ((r["short_en"], r["formal_en"]), (r["short_ar"], r["formal_ar"])):
            s, f = name_parts(short), name_parts(formal)
            if s and f:
                found.setdefault(s[0], set()).add(f[0])
    return {s: frozenset(f) for s, f in found.items()}


def pick_pivots(tokens: DataFrame, count: int = 16, sample: int = 4096) -> list[str]:
    """Pivots far from each other, out of a sample of at most `sample` different anchors (those of least hash)."""
    some = [r[0] for r in tokens.orderBy(F.xxhash64("token"), "token").limit(sample).collect()]
    if not some:
        return []
    pivots = [some[0]]
    near = [edit_distance(t, some[0]) for t in some]
    while len(pivots) < min(count, len(some)):
        best = max(range(len(some)), key=near.__getitem__)
        if near[best] == 0:
            break
        pivots.append(some[best])
        near = [min(d, edit_distance(t, some[best])) for t, d in zip(some, near)]
    return pivots


def radius_join(objects: DataFrame, radius: int = 2, pivots: int = 4, sample: int = 4096, equal: bool = True) -> DataFrame:
    """`key`, `a`, `b`: all pairs a < b of tokens of one key within `radius` edits, with `equal` also a = b.

    `objects` has `key` and `token`. Cells are made of different tokens, so copies cost nothing.
    A pair may differ by at most one third of the length of its longer token where that is less
    than `radius`; a token's own radius is what it may differ by from any other. Each pair meets
    once, in the home cell of its smaller token.
    """
    objects = cut(objects.select("key", "token").where("key is not null and token is not null").distinct())
    tokens = cut(objects.select("token").distinct())
    chosen = pick_pivots(tokens, pivots, sample)
    same = objects.select("key", F.col("token").alias("a"), F.col("token").alias("b"))
    if not chosen:
        return same if equal else same.limit(0)
    spread = F.array(*[F.levenshtein(F.col("token"), F.lit(p)) for p in chosen])
    own = F.least(F.lit(radius), F.floor((F.length("token") + radius) / 3).cast("int"))  # the longer token of a pair is at most `radius` longer
    placed = tokens.withColumns({"_d": spread, "_own": own}).withColumn("_least", F.array_min("_d"))
    placed = cut(placed.select("token", (F.array_position("_d", F.col("_least")) - 1).cast("int").alias("home"), F.filter(
        F.sequence(F.lit(0), F.lit(len(chosen) - 1)), lambda i: F.get("_d", i) <= F.col("_least") + 2 * F.col("_own")).alias("cells")))
    located = cut(objects.join(placed, "token"))
    homes = located.select("key", F.col("token").alias("a"), F.col("home").alias("cell"))
    guests = located.select("key", F.col("token").alias("b"), F.explode("cells").alias("cell"))
    reach = F.least(F.lit(radius), F.floor(F.greatest(F.length("a"), F.length("b")) / 3).cast("int"))
    edits = F.levenshtein("a", "b", radius)  # -1 beyond the radius
    met = homes.join(guests, ["key", "cell"]).where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= radius) & (edits >= 0) & (edits <= reach)).select("key", "a", "b")
    return met.unionByName(same) if equal else met


_FORMS = "id string, en array<string>, ar array<string>, anchors array<string>"


def link_names(people: DataFrame, aliases: dict[str, frozenset[str]], radius: int = 2, pivots: int = 4) -> DataFrame:
    """`a`, `b`: ids of records whose names are forms of one and that agree on a key.

    `people` has `id`, `name_en`, `name_ar` and `keys`, an array of strings of which the first
    letter names the kind of key. Null or blank names and keys link nobody. Records with equal
    names and an equal key are linked to the smallest of them, so copies are never paired with
    each other; those smallest records are compared. An empty table gives no rows.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            en = [name_parts(n) for n in batch.column(1).to_pylist()]
            ar = [name_parts(n) for n in batch.column(2).to_pylist()]
            ends = [sorted(_anchors(e, aliases) | _anchors(a, aliases)) for e, a in zip(en, ar)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.list_(pa.string())) for x in (en, ar, ends)]], names=["id", "en", "ar", "anchors"])

    rows = people.select(F.col("id").cast("string").alias("id"), "name_en", "name_ar", "keys").where("id is not null")
    # A record's name is a number until names are compared; numbers are only ever equated under one key.
    named = rows.select("id", "name_en", "name_ar").distinct().mapInArrow(forms, _FORMS).where("size(en) > 0 or size(ar) > 0").withColumn("form", F.xxhash64("en", "ar"))
    named = cut(named.dropDuplicates(["id", "form"]))
    keyed = cut(rows.select("id", F.explode("keys").alias("key")).where("key is not null").distinct())
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")  # a key of one id links nobody
    records = cut(keyed.join(shared, "key", "left_semi").join(named.select("id", "form"), "id"))
    # One class per key and name; its smallest record stands for it.
    classes = cut(records.groupBy("key", "form").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n")))
    copies = records.join(classes.where("n > 1").select("key", "form", "rep"), ["key", "form"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    several = classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    heads = classes.join(several, "key", "left_semi").join(named.select(F.col("id").alias("rep"), "form", "anchors"), ["rep", "form"])
    objects = cut(heads.select("key", "rep", "form", F.explode("anchors").alias("token")))
    # A token of one key held by one class alone has no equal to meet.
    met_equal = objects.groupBy("key", "token").agg(F.count("*").alias("n")).where("n > 1").select("key", F.col("token").alias("a"), F.col("token").alias("b"))
    near = cut(radius_join(objects, radius, pivots, equal=False).unionByName(met_equal))
    left = objects.select("key", F.col("token").alias("a"), F.col("rep").alias("rep_a"), F.col("form").alias("form_a"))
    right = objects.select("key", F.col("token").alias("b"), F.col("rep").alias("rep_b"), F.col("form").alias("form_b"))
    met = near.join(left, ["key", "a"]).join(right, ["key", "b"]).where("rep_a <> rep_b")
    swap = F.col("rep_a") > F.col("rep_b")
    side = lambda c, d: F.when(swap, F.col(d)).otherwise(F.col(c))
    columns = [side(f"{c}_{x}", f"{c}_{y}").alias(f"{c}_{x}") for c in ("rep", "form") for x, y in (("a", "b"), ("b", "a"))]
    born = F.col("kind") == "d"
    pairs = met.select(F.substring("key", 1, 1).alias("kind"), *columns).groupBy("rep_a", "form_a", "rep_b", "form_b").agg(
        F.max(born.cast("int")).alias("born"), F.max((~born).cast("int")).alias("paper"))
    name = lambda x: named.select(F.col("id").alias(f"rep_{x}"), F.col("form").alias(f"form_{x}"), F.col("en").alias(f"en_{x}"), F.col("ar").alias(f"ar_{x}"))
    full = pairs.join(name("a"), ["rep_a", "form_a"]).join(name("b"), ["rep_b", "form_b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            keep = [one_name(c["en_a"][i], c["ar_a"][i], c["en_b"][i], c["ar_b"][i], aliases, c["born"][i] + c["paper"][i]) for i in range(batch.num_rows)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("rep_a").filter(mask), batch.column("rep_b").filter(mask)], names=["a", "b"])

    # Comparing costs far more than its bytes suggest, so it is spread over all cores.
    spread = full.repartition(3 * people.sparkSession.sparkContext.defaultParallelism, "rep_a", "rep_b")
    return spread.mapInArrow(compare, "a string, b string").unionByName(copies).distinct()


def group_pairs(groups: DataFrame, node: str, group: str) -> DataFrame:
    """All pairs `a` < `b` within groups that are small by nature (the records of one person)."""
    left, right = groups.select(F.col(node).alias("a"), F.col(group).alias("_g")), groups.select(F.col(node).alias("b"), F.col(group).alias("_g"))
    return left.join(right, "_g").where("a < b").select("a", "b")


def usable_number(bare: Column, digits: Column) -> Column:
    """A document number that is no placeholder: not one digit throughout, no counting up or down. `digits` are those of `bare`."""
    one = lambda c: F.length(F.replace(c, F.left(c, F.lit(1)), F.lit(""))) == 0
    placeholder = (F.length(digits) < 5) | one(digits) | one(F.substring(digits, 2, 99)) | digits.isin("1234567890", "0123456789", "9876543210", "123456789")
    return F.when(~placeholder, bare)
