"""Subject areas of documents by label propagation (problem 10).

Documents that share verified terms are similar; the graph keeps documents and terms as its
two kinds of nodes, so documents are linked through a term at the cost of one edge each and
never as pairs, however many share a subject. Hand labels are the seeds. Each round joins the
subjects of documents to their terms, averages them per term, joins the terms back and
averages them per document; seeds are clamped towards their labels, a document keeps a share
of every subject it shows, and the rounds end when the shares of the terms have settled. A
term is verified if it is common enough to be trusted and points mostly to one subject.

A document is about a subject that propagation has given it if an exact check of its
paragraphs agrees: one of them holds at least two sentences whose verified terms speak for
the subject, and they are a good part of all its sentences with any subject.

Documents, terms and subjects are tables throughout and meet in joins. What a task holds
besides are filters of a fixed size, which only spare rows that would find no partner.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarraf.session import cut, drop

#: Marks of Arabic writing that carry no letter, and letters written for one another.
_MARKS = re.compile("[ً-ٰٟـ­​‌‍]")
_LETTERS = tuple(zip("أإآىة", "ااايه"))
_BLOCK = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"[.!؟]+(?:\s+|$)|\n")
_WORD = re.compile(r"[^\W\d_]{3,}")
_PLAIN_WORD = re.compile("[a-z]{3,}")  # the same where all characters are ASCII, in half the time
_INNER = re.compile(r"[.!?؟]\s")


def term_number(word: str) -> int:
    """A stable number of 63 bits for a word; an article or a preposition glued to an Arabic word is taken off."""
    if "\u0600" < word[0] < "\u06ff":
        for glued in ("وال", "بال", "لل", "ال"):
            if word.startswith(glued) and len(word) > len(glued) + 2:
                word = word[len(glued) :]
                break
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big") >> 1


class _Numbers(dict):
    """The numbers of the words met last."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        number = self[word] = term_number(word)
        return number


_number = _Numbers().__getitem__


def _read(text: str, terms: list[int], sizes: list[int], places: list[int]) -> None:
    """Adds the terms of all sentences, and the size and the number of the paragraph of each."""
    text = text.lower()
    words = _PLAIN_WORD.findall
    if not text.isascii():
        words = _WORD.findall
        for letter, plain in _LETTERS:
            text = text.replace(letter, plain)
        text = _MARKS.sub("", text)
    paragraph = 0
    for block in _BLOCK.split(text):
        single = False
        for line in block.split("\n"):
            many = _INNER.search(line) is not None
            if many or not single:
                paragraph += 1
            single = not many
            for s in _SENTENCE.split(line):
                found = words(s)
                if found:
                    terms += map(_number, found)
                    sizes.append(len(found))
                    places.append(paragraph)


def sentences(text: str) -> tuple[list[list[int]], list[int]]:
    """The terms of each sentence, and the number of the paragraph it stands in.

    Blank lines end a paragraph, and so does a line of several sentences; lines of one
    sentence each are one paragraph together.
    """
    flat, sizes, places = [], [], []
    _read(text, flat, sizes, places)
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [flat[end - n : end] for end, n in zip(ends, sizes)], places


_ODD, _ALL, _PLUS = 0x9E3779B97F4A7C15, 2**64 - 1, 2**63 - 1


def _pairs(s: list[int]) -> list[int]:
    return [(a ^ (b * _ODD & _ALL)) & _PLUS for a, b in zip(s, s[1:])]


def _pairs_of(terms: np.ndarray) -> np.ndarray:
    """`_pairs` of a whole array; the last pair is none."""
    t = terms.astype(np.uint64)
    after = np.r_[t[1:], np.zeros(1, np.uint64)] if len(t) else t
    return ((t ^ (after * np.uint64(_ODD))) & np.uint64(_PLUS)).astype(np.int64)


def wordings(items: DataFrame, text: str, most: int = 2_000_000) -> Iterator[frozenset[int]]:
    """The word pairs of the evaluation items, in as many parts as it takes for none to come from more than about `most` characters."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {p for t in batch.column(0).to_pylist() for s in sentences(t)[0] for p in _pairs(s)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["pair"])

    given = items.select(F.col(text).cast("string").alias("t")).where("t is not null")
    parts = -(-(given.agg(F.sum(F.length("t"))).first()[0] or 0) // most)
    rows = given.mapInArrow(pairs, "pair long").distinct()
    for part in range(parts):
        yield frozenset(rows.where(F.pmod("pair", F.lit(parts)) == part).toArrow().column(0).to_pylist())


_CODED = "doc long, terms array<long>, sizes array<int>, places array<int>, hits array<int>"


def code_documents(documents: DataFrame, doc: str, text: str, worded: Iterator[frozenset[int]], alike: float = 0.4) -> DataFrame:
    """`doc`, `terms` (all sentences), `sizes` (words of each sentence), `places` (paragraph of each).

    Sentences of which at least `alike` of the word pairs are in `worded` are left out; its
    parts are gone through one after another, counting the pairs found so far in `hits`.
    """
    parts = iter(worded)
    first, following = next(parts, frozenset()), next(parts, None)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _sorted(first)
        for batch in batches:
            terms, sizes, places, n_words, n_sentences = [], [], [], [0], [0]
            for t in batch.column(1).to_pylist():
                _read(t, terms, sizes, places)
                n_words.append(len(terms))
                n_sentences.append(len(sizes))
            flat, n = np.array(terms, np.int64), np.array(sizes, np.int32)
            ends = pa.array(n_sentences, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (n, np.array(places, np.int32), _hits(flat, n, known))]
            yield _batch(batch.column(0), pa.ListArray.from_arrays(pa.array(n_words, pa.int32()), pa.array(flat)), *lists)

    rows = documents.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null and text is not null")
    coded = rows.mapInArrow(code, _CODED)
    while following is not None:
        coded, following = cut(coded.mapInArrow(_more_hits(following), _CODED)), next(parts, None)
    return coded.mapInArrow(_own_words(alike), _CODED).select("doc", "terms", "sizes", "places")


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["doc", "terms", "sizes", "places", "hits"])


def _sentence_of(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _sorted(worded: frozenset[int]) -> np.ndarray:
    return np.sort(np.fromiter(worded, np.int64, len(worded)))


def _hits(flat: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many word pairs of each sentence are in `known`; sentences of one or two words have none."""
    pairs, low = _pairs_of(flat), np.zeros(1 << 20, bool)
    low[known & (len(low) - 1)] = True
    at = np.flatnonzero(low[pairs & (len(low) - 1)])  # most pairs end here
    at = at[np.isin(pairs[at], known)]
    of = _sentence_of(sizes)
    at = at[at + 1 < len(of)]
    at = at[(of[at] == of[at + 1]) & (sizes[of[at]] > 2)]
    return np.bincount(of[at], minlength=len(sizes)).astype(np.int32)


def _more_hits(worded: frozenset[int]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _sorted(worded)
        for batch in batches:
            sizes, flat, hits = (batch.column(c).flatten().to_numpy() for c in ("sizes", "terms", "hits"))
            lists = pa.ListArray.from_arrays(_offsets(batch.column("hits")), pa.array(hits + _hits(flat, sizes, known)))
            yield _batch(*[batch.column(c) for c in ("doc", "terms", "sizes", "places")], lists)

    return add


def _offsets(lists: pa.ListArray) -> pa.Array:
    at = lists.offsets.to_numpy()
    return pa.array(at - at[0], pa.int32())


def _own_words(alike: float):
    """Leaves out sentences worded like the items."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hits = batch.column("sizes").flatten().to_numpy(), batch.column("hits").flatten().to_numpy()
            keep = (hits == 0) | (hits < alike * (sizes - 1))
            if keep.all():
                yield batch
                continue
            of_doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("sizes").offsets.to_numpy()))
            words = keep[_sentence_of(sizes)]
            n_sentences = np.bincount(of_doc[keep], minlength=batch.num_rows)
            n_words = np.bincount(of_doc[keep], sizes[keep], minlength=batch.num_rows).astype(np.int64)
            ends = lambda n: pa.array(np.r_[0, np.cumsum(n)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends(n_words), pa.array(batch.column("terms").flatten().to_numpy()[words]))]
            lists += [pa.ListArray.from_arrays(ends(n_sentences), pa.array(batch.column(c).flatten().to_numpy()[keep])) for c in ("sizes", "places", "hits")]
            yield _batch(batch.column("doc"), *lists)

    return strip


#: Words of a filter: 2**17 words of 64 bits are one MB.
_FILTER_WORDS = 1 << 17


def _spot(c: Column) -> Column:
    return c.bitwiseXOR(F.shiftrightunsigned(c, 29)).bitwiseXOR(F.shiftrightunsigned(c, 47))


def key_filter(rows: DataFrame, column: str) -> np.ndarray:
    """A bit array of fixed size in which the bit of every value of `column` (long) is set; others may share it."""
    at = _spot(F.col(column))
    word = F.shiftrightunsigned(at, 6).bitwiseAND(F.lit(_FILTER_WORDS - 1))
    bits = rows.select(word.alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    found = bits.toArrow()  # at most one row a word of the filter
    out = np.zeros(_FILTER_WORDS, np.int64)
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def maybe_in(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """False only for values that are not in the column the filter was made of."""
    v = values.astype(np.int64).view(np.uint64)
    at = v ^ (v >> np.uint64(29)) ^ (v >> np.uint64(47))
    return (filter_[((at >> np.uint64(6)) & np.uint64(_FILTER_WORDS - 1)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _terms_of(coded: DataFrame, docs: np.ndarray | None, terms: np.ndarray | None) -> DataFrame:
    """`doc`, `terms`: the different terms of the documents that pass the filters (None passes all)."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if docs is not None:
                batch = batch.filter(pa.array(maybe_in(docs, batch.column("doc").to_numpy())))
            lists = batch.column("terms")
            flat, of = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            if terms is not None:
                hit = maybe_in(terms, flat)
                flat, of = flat[hit], of[hit]
            order = np.lexsort((flat, of))
            flat, of = flat[order], of[order]
            new = np.r_[True, (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])] if len(flat) else np.zeros(0, bool)
            flat, of = flat[new], of[new]
            kept, first = np.unique(of, return_index=True)
            ends = pa.array(np.r_[first, len(flat)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(kept)), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["doc", "terms"])

    return coded.select("doc", "terms").mapInArrow(pick, "doc long, terms array<long>")


def _normal(shares: str) -> Column:
    """An array of (s, w) with its weights made to add up to one."""
    whole = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x["w"])
    return F.transform(shares, lambda x: F.struct(x["s"].alias("s"), (x["w"] / whole).alias("w")))


def _gathered(rows: DataFrame, key: str) -> DataFrame:
    """`key`, `shares`: the weights of each key as an array with one entry a subject, adding up to one."""
    sums = rows.groupBy(key, "s").agg(F.sum("w").alias("w")).where("w > 0")
    return sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("s", "w"))).alias("shares")).select(key, _normal("shares").alias("shares"))


def _weighed(shares: str, factor: Column) -> Column:
    return F.transform(F.coalesce(shares, F.array().cast("array<struct<s:int,w:double>>")), lambda x: F.struct(x["s"].alias("s"), (x["w"] * factor).alias("w")))


def _mixed(means: DataFrame, held: DataFrame, clamp: float) -> DataFrame:
    """`doc`, `shares` of `means`, those of the seeds `held` drawn by `clamp` towards their labels.

    Both have one row a document and one entry a subject, so a document is mixed within its row.
    """
    both = means.join(held.withColumnRenamed("shares", "_held"), "doc", "full")
    all_ = F.concat(_weighed("shares", F.when(F.col("_held").isNull(), 1.0).otherwise(1 - clamp)), _weighed("_held", F.lit(clamp)))
    # Only rows that have both can have a subject twice.
    once = F.transform(F.array_sort(F.array_distinct(F.transform("_all", lambda x: x["s"]))), lambda s: F.struct(s.alias("s"), F.aggregate(F.filter("_all", lambda x: x["s"] == s), F.lit(0.0), lambda a, x: a + x["w"]).alias("w")))
    summed = F.when(F.col("shares").isNull() | F.col("_held").isNull(), F.col("_all")).otherwise(once)
    rows = both.withColumn("_all", all_).select("doc", F.filter(summed, lambda x: x["w"] > 0).alias("shares"))
    return rows.where("size(shares) > 0").select("doc", _normal("shares").alias("shares"))


def _term_shares(nodes: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """`term`, `n`, `shares`: the mean subjects of the documents with a term, subjects evened out by their size.

    `n` is the number of documents that have subjects; terms in fewer than `least` have no row.
    """
    told = nodes.join(docs, "doc").select(F.explode("terms").alias("term"), "shares")
    sums = told.select("term", F.inline("shares")).groupBy("term", "s").agg(F.sum("w").alias("w"))
    size = docs.select(F.inline("shares")).groupBy("s").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("_size"))
    # The shares of a document add up to one, so those of a term add up to its documents.
    even = sums.join(size, "s").groupBy("term").agg(F.sum("w").alias("n"), F.sort_array(F.collect_list(F.struct("s", (F.col("w") / F.col("_size")).alias("w")))).alias("shares"))
    return even.where(F.col("n") >= least - 1e-6).select("term", "n", _normal("shares").alias("shares"))


def _strength(shares: str = "shares") -> tuple[Column, Column]:
    """The first and the second share of an array of (s, w)."""
    ranked = F.sort_array(F.transform(shares, lambda x: x["w"]), asc=False)
    return ranked[0], F.coalesce(F.get(ranked, 1), F.lit(0.0))


def propagate(coded: DataFrame, seeds: DataFrame, rounds: int = 12, tolerance: float = 0.01, clamp: float = 0.8, least_docs: int = 5, most_share: float = 0.6, sure: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """(`doc`, `shares`) of every document that shares terms with others, (`term`, `shares`) of the verified terms.

    `seeds` has `doc` and the number of a subject `s`, several rows a document where it has
    several. A term stands in at least `least_docs` and at most the share `most_share` of all
    documents, in three with subjects; it passes on subjects if its first share is at least half of `sure`, and is verified if that is
    at least `sure` and twice the second. Rounds end when the shares of the terms move by no
    more than `tolerance` on average, at the latest after `rounds`.
    """
    total = coded.count()
    held = cut(seeds.groupBy("doc").agg(F.collect_set("s").alias("_all")).select("doc", F.transform("_all", lambda s: F.struct(s.alias("s"), (F.lit(1.0) / F.size("_all")).alias("w"))).alias("shares")))
    # The terms that labelled documents make candidates; only these are edges.
    first = _term_shares(_terms_of(coded, key_filter(held, "doc"), None), held, 3).where(_strength()[0] >= 0.5 * sure)
    first = cut(first)
    found = _terms_of(coded, None, key_filter(first, "term"))
    found = cut(found)
    counts = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("_docs"))
    trusted = counts.where((F.col("_docs") >= least_docs) & (F.col("_docs") <= F.greatest(F.lit(10 * least_docs), F.lit(most_share * total)))).select("term")
    trusted = cut(first.select("term").join(trusted, "term", "left_semi"))
    terms = cut(first.join(trusted, "term", "left_semi"))
    docs = None
    for _ in range(rounds):
        # A term counts the more, the surer it is.
        sharp = terms.where(_strength()[0] >= 0.5 * sure).select("term", F.transform("shares", lambda x: F.struct(x["s"].alias("s"), (x["w"] * x["w"]).alias("w"))).alias("shares"))
        # A document's terms are one row until here, so all that follows can stay with it.
        reached = found.repartition("doc").select("doc", F.explode("terms").alias("term")).join(sharp, "term").select("doc", F.inline("shares"))
        drop(docs)
        docs = cut(_mixed(_gathered(reached, "doc"), held, clamp))
        # Small shares are noise of common terms; what is left keeps its several subjects.
        clear = docs.select("doc", F.filter("shares", lambda x: x["w"] >= 0.15).alias("shares")).where("size(shares) > 0").select("doc", _normal("shares").alias("shares"))
        now = cut(_term_shares(found, clear, 3).join(trusted, "term", "left_semi"))
        was = terms.select("term", F.inline("shares")).withColumnRenamed("w", "_w")
        moved = now.select("term", F.inline("shares")).join(was, ["term", "s"], "full").agg((F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("_w", F.lit(0.0)))) / 2).alias("d"), F.count_distinct("term").alias("n")).first()
        drop(terms)
        terms = now
        if (moved["d"] or 0.0) <= tolerance * max(moved["n"], 1):
            break
    drop(found, trusted, first)
    best, second = _strength()
    return docs, terms.where((best >= sure) & (best >= 2 * second)).select("term", "shares")


def _occurrences(coded: DataFrame, terms: np.ndarray) -> DataFrame:
    """`doc`, `spot` (number of the sentence, and of its paragraph in the last 32 bits), `term`: where the terms that pass the filter stand."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes, places = (batch.column(c).flatten().to_numpy() for c in ("terms", "sizes", "places"))
            if not len(flat):
                continue
            at = np.flatnonzero(maybe_in(terms, flat))
            sentence = _sentence_of(sizes)[at]
            of_doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("sizes").offsets.to_numpy()))[sentence]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(of_doc)), pa.array(sentence.astype(np.int64) << 32 | places[sentence]), pa.array(flat[at])], names=["doc", "spot", "term"])

    return coded.mapInArrow(find, "doc long, spot long, term long")


def paragraphs_about(coded: DataFrame, terms: DataFrame, least: int, part: float) -> DataFrame:
    """`doc`, `s`: the subjects of which a paragraph has enough sentences.

    Every sentence takes the subject its verified terms speak for, if that holds at least half of
    what they say; a subject needs `least` sentences of a paragraph and the share `part` of its
    sentences with any subject.
    """
    top = _strength()[0]
    votes = terms.select("term", F.filter(F.transform("shares", lambda x: F.struct(x["s"].alias("s"), ((x["w"] / top) * (x["w"] / top)).alias("v"))), lambda x: x["v"] >= 0.02).alias("votes"))
    said = _occurrences(coded, key_filter(terms, "term")).join(votes, "term").select("doc", "spot", F.inline("votes"))
    said = said.repartition("doc")  # all that follows stays with the document
    scores = said.groupBy("doc", "spot", "s").agg(F.sum("v").alias("v"))
    # No votes are nil, so of several best subjects only two alone can hold half each: then the first. Plain
    # values are gathered in hash tables, a greatest struct would have the rows sorted.
    told = scores.groupBy("doc", "spot").agg(F.max("v").alias("v"), F.min("v").alias("_least"), F.sum("v").alias("all"), F.max_by("s", "v").alias("_best"), F.min("s").alias("_first"))
    clear = told.where(F.col("v") >= F.greatest(F.lit(0.9), 0.5 * F.col("all"))).select("doc", F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)).alias("place"), F.when(F.col("v") == F.col("_least"), F.col("_first")).otherwise(F.col("_best")).alias("s"))
    cells = clear.groupBy("doc", "place", "s").agg(F.count("*").alias("n"))
    whole = cells.withColumn("all", F.sum("n").over(Window.partitionBy("doc", "place")))
    return whole.where((F.col("n") >= least) & (F.col("n") >= part * F.col("all"))).select("doc", "s").distinct()


def subject_areas(documents: DataFrame, doc: str, text: str, labels: DataFrame, label_doc: str, label: str, items: DataFrame, item_text: str, rounds: int = 12, tolerance: float = 0.01, least: int = 2, part: float = 0.35, shown: float = 0.02) -> DataFrame:
    """`doc_id`, `subject`: every subject that a document has been given and one of its paragraphs is about.

    Labels without document or subject are passed over, repeated ones count once; subjects
    are compared without case and surrounding blanks. Subjects come from the propagated shares
    (at least `shown`), and are kept where a paragraph agrees (`least`, `part`: see
    `paragraphs_about`). Null and empty texts have no subject, nor have sentences worded like
    the evaluation items. Without labels, or over an empty table, there are no rows.
    """
    seeds = labels.select(F.col(label_doc).cast("long").alias("doc"), F.lower(F.trim(F.col(label))).alias("subject")).where("doc is not null and subject <> ''").distinct()
    seeds = cut(seeds)
    names = cut(seeds.select("subject").distinct().withColumn("s", F.row_number().over(Window.orderBy("subject"))))  # one row a subject
    coded = cut(code_documents(documents, doc, text, wordings(items, item_text)))
    docs, terms = propagate(coded, seeds.join(names, "subject").select("doc", "s"), rounds, tolerance)
    terms = cut(terms)
    given = docs.select("doc", F.inline("shares")).where(F.col("w") >= shown).select("doc", "s")
    about = paragraphs_about(coded, terms, least, part)
    return given.join(about, ["doc", "s"]).join(names, "s").select(F.col("doc").alias("doc_id"), "subject")
