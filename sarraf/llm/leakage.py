"""Documents that hold passages of held-out evaluation items (problem 8).

Documents are cut into overlapping passages of words. Over the words of the evaluation
items the passages form a TF-IDF matrix; words foreign to the items count towards a
passage's length only. A single-pass randomised SVD (a Gaussian sketch of the Gram matrix,
summed over all partitions and decomposed by Nystroem's method) gives the latent space in
which passages are compared with passages of the items. Candidates are verified by the
longest common subsequence of document and item, by the words that lie in common runs, and
by whether the facts of those runs (numbers, codes, names) are the item's own.

Everything that is broadcast or gathered on the driver is as large as the vocabulary of
one part of the items, which `fit_items` bounds; nothing grows with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarraf.session import cut

#: Digits of other scripts, and letters of Arabic written for one another.
_PLAIN = tuple(zip("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹أإآىة", "01234567890123456789ااايه"))
_MARKS = re.compile("[ً-ٰٟـ­​‌‍]")
_WORD = re.compile(r"\d[\d,٬]*|[^\W_]+")
_PLAIN_WORD = re.compile("[a-z][a-z0-9]*|[0-9][0-9,]*")  # the same where all characters are ASCII

WIDTH, STEP = 24, 12  # words of a passage; passages overlap by half


def words(text: str) -> list[str]:
    """The words of a text without case, marks and punctuation; long numbers without separators."""
    text = text.lower()
    pattern = _PLAIN_WORD
    if not text.isascii():
        pattern = _WORD
        for odd, plain in _PLAIN:
            text = text.replace(odd, plain)
        text = _MARKS.sub("", text).replace("٬", ",")
    if "-\n" in text:
        text = text.replace("-\n", "")
    found = pattern.findall(text)
    return [w.replace(",", "") for w in found] if "," in text else found


@dataclass
class Items:
    """The items in word numbers; `vocabulary` maps each of their words to its number."""

    ids: list[int]
    texts: list[np.ndarray]
    vocabulary: dict[str, int]


def fit_items(items: DataFrame, item: str, text: str, most_words: int = 200_000) -> Iterator[Items]:
    """Read the evaluation items, in as many parts as it takes for none to have more than about `most_words` words.

    The words of one part are held in memory everywhere; items are dealt to parts by hash.
    """
    given = items.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    parts = -(-(given.agg(F.sum(F.length("t"))).first()[0] or 0) // (12 * most_words))
    for part in range(parts):
        mine = given.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        rows = [(r["i"], words(r["t"])) for r in mine.orderBy("i", "t").collect()]
        rows = [(i, w) for i, w in rows if w]
        vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in rows for w in ws}))}
        if vocabulary:
            yield Items([i for i, _ in rows], [np.array([vocabulary[w] for w in ws], np.int32) for _, ws in rows], vocabulary)


def word_numbers(documents: DataFrame, doc: str, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """`doc`, `words`: the whole text as numbers of the vocabulary, -1 for other words."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            lists = [[number(w, -1) for w in words(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["doc", "words"])

    rows = documents.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null and text is not null")
    return rows.mapInArrow(code, "doc long, words array<int>")


def _passages(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(passage, word) of every word in every passage it lies in, document of each passage, passages."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy()
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    blocks = -(-sizes // STEP)
    base = np.cumsum(blocks) - blocks
    own = base[doc] + at // STEP
    back = at >= STEP
    return np.concatenate([own, own[back] - 1]), np.concatenate([flat, flat[back]]), np.repeat(np.arange(len(sizes)), blocks), int(blocks.sum())


def _chunks(batch: pa.RecordBatch, column: str, docs: int = 256) -> Iterator[tuple[int, pa.ListArray]]:
    """The lists of a batch, a few documents at a time: their tables then fit the caches."""
    lists = batch.column(column)
    for start in range(0, batch.num_rows, docs):
        yield start, lists.slice(start, docs)


def _entries(lists: pa.ListArray, size: int, weighing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Different (passage, word) pairs in order, foreign words per passage, documents, passages.

    With `weighing`, a flag for each word of the vocabulary, only the words flagged.
    """
    passage, word, doc, n = _passages(lists)
    foreign = np.bincount(passage[word < 0], minlength=n)
    known = word >= 0 if weighing is None else np.r_[weighing, False][word]  # -1 is the last
    cells = passage[known] * size + word[known]
    cells.sort()
    pairs = cells[np.diff(cells, prepend=-1) > 0]
    return pairs // size, pairs % size, foreign, doc, n


def passage_frequencies(coded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """How many passages of the corpus hold each word of the vocabulary, and the number of passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, lists in _chunks(batch, "words"):
                _, word, _, _, more = _entries(lists, size)
                total += np.bincount(word, minlength=size)
                n += more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, total[at]])], names=["word", "n"])

    found = dict(coded.select("words").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n")).collect())
    passages = found.pop(-1, 0)
    frequencies = np.zeros(size, np.int64)
    frequencies[list(found)] = list(found.values())
    return frequencies, passages


def weights(frequencies: np.ndarray, passages: int, common: float = 0.05) -> np.ndarray:
    """Inverse passage frequencies; words in more than `common` of all passages weigh nothing."""
    idf = np.log((passages + 1) / (frequencies + 1)) + 1
    return np.where(frequencies > common * max(passages, 20), 0.0, idf)


def _weigh(row: np.ndarray, word: np.ndarray, foreign: np.ndarray, idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the entries over the length of their passage, and the known share of its square."""
    w = idf[word]
    known = np.bincount(row, w * w, minlength=n)
    strange = idf.max(initial=1.0) / 2
    length = np.sqrt(known + foreign * strange * strange)
    length[length == 0] = 1
    return (w / length[row]).astype(np.float32), known / (length * length)


def _add_lines(out: np.ndarray, index: np.ndarray, lines: np.ndarray) -> None:
    """out[index] += lines for ascending `index`: all first lines of an index, all second ones, and so on."""
    if not len(index):
        return
    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    counts = np.diff(np.r_[first, len(index)])
    by_count = np.argsort(-counts, kind="stable")
    first, counts = first[by_count], counts[by_count]
    for k in range(counts[0]):
        upto = np.searchsorted(-counts, -k, side="left")
        at = first[:upto] + k
        out[index[at]] += lines[at]


def latent_basis(coded: DataFrame, idf: np.ndarray, rank: int = 128, extra: int = 32, seed: int = 7) -> np.ndarray:
    """An orthonormal basis (words by rank) of the leading latent dimensions of all passages.

    One pass: each partition adds its share of G @ omega, G being the Gram matrix of the
    passages and omega a Gaussian sketch; the shares are summed word by word.
    """
    size = len(idf)
    width = min(rank + extra, size)
    omega = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width), np.float32)
        for batch in batches:
            for _, lists in _chunks(batch, "words"):
                row, word, foreign, _, n = _entries(lists, size, idf > 0)
                w, _ = _weigh(row, word, foreign, idf, n)
                mixed = np.zeros((n, width), np.float32)
                _add_lines(mixed, row, w[:, None] * omega[word])
                order = np.argsort(word, kind="stable")
                _add_lines(total, word[order], w[order, None] * mixed[row[order]])
        at = np.flatnonzero(np.abs(total).sum(axis=1))
        yield _lines(at, total[at])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width), np.float32)
        seen = np.zeros(size, bool)
        for batch in batches:
            at = batch.column(0).to_numpy()
            np.add.at(total, at, batch.column(1).flatten().to_numpy().reshape(len(at), width))
            seen[at] = True
        yield _lines(np.flatnonzero(seen), total[seen])

    kind = "word int, line array<float>"
    parts = coded.select("words").mapInArrow(sketch, kind).repartition("word").mapInArrow(add, kind).collect()
    y = np.zeros((size, width))
    for r in parts:
        y[r["word"]] = r["line"]
    core = omega.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-6 * max(values.max(initial=0), 1e-12)
    basis, strengths, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return basis[:, strengths > 1e-9][:, :rank].astype(np.float32)


def _lines(at: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(lines.astype(np.float32).ravel())
    offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * lines.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.ListArray.from_arrays(offsets, flat)], names=["word", "line"])


def common_subsequence(masks: dict[int, int], length: int, sequence: list[int]) -> int:
    """The length of the longest common subsequence with an item of `length` words.

    `masks` has for each word of the item the bits of its places; the rows of the usual
    table are kept as bits of one number.
    """
    full = (1 << length) - 1
    row = full
    for word in sequence:
        match = masks.get(word)
        if match:
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def coverable_words(masks: dict[int, int], doc: list[int]) -> int:
    """At least as many words of an item as `covered_words` finds in common runs with a document.

    `masks` has for each word of the item the bits of its places. A run has three equal words
    or more, each one or two places after the one before in both texts, so whatever it holds
    are places of such chains and single places between two of them.
    """
    seen = m1 = m2 = m3 = m4 = t1 = t2 = 0  # equal places, and those that end a chain of two, some words before
    place = masks.get
    for word in doc:
        m = place(word, 0)
        two = 0
        if m:
            before = m1 | m2
            two = m & (before << 1 | before << 2)
            if two:
                before = t1 | t2
                three = two & (before << 1 | before << 2)
                if three:
                    back = three >> 1 | three >> 2
                    b1, b2 = t1 & back, t2 & back
                    c1, c2 = b1 >> 1 | b1 >> 2, b2 >> 1 | b2 >> 2
                    seen |= three | b1 | b2 | (m2 | m3) & c1 | (m3 | m4) & c2
        m1, m2, m3, m4, t1, t2 = m, m1, m2, m3, two, t1
    return (seen | seen << 1 & seen >> 1).bit_count()


def covered_words(item: np.ndarray, doc: list[int], fact: np.ndarray, least: int = 3) -> tuple[int, int, int]:
    """(words of the item in common runs, facts in them, those facts agreed on).

    A run is a stretch along one diagonal of at least `least` equal words in which single
    words may differ (slight damage) or be left out. Facts of a run that differ count
    against it. A word of the item counts once.
    """
    places: dict[int, list[int]] = {}
    for i, w in enumerate(item.tolist()):
        places.setdefault(w, []).append(i)
    ends: dict[tuple[int, int], tuple[int, int, int]] = {}  # (item, doc) place -> start, equal words, last start in doc
    runs: dict[tuple[int, int], tuple[int, int, int]] = {}
    for j, w in enumerate(doc):
        for i in places.get(w, ()):
            best = None
            for di, dj in ((1, 1), (2, 2), (2, 1), (1, 2)):
                before = ends.get((i - di, j - dj))
                if before and (best is None or before[1] > best[1]):
                    best = before
            start, equal, from_doc = best if best else (i, 0, j)
            ends[i, j] = (start, equal + 1, from_doc)
            kept = runs.get((start, from_doc))
            if kept is None or kept[1] <= equal:
                runs[start, from_doc] = (i, equal + 1, j)
    inside, agreed = np.zeros(len(item), bool), np.zeros(len(item), bool)
    for (start, from_doc), (end, equal, to_doc) in runs.items():
        if equal < least or equal < 0.7 * (end - start + 1):
            continue
        inside[start : end + 1] = True
        here = np.isin(item[start : end + 1], doc[from_doc : to_doc + 1])
        agreed[start : end + 1] |= here
    return int(inside.sum()), int((inside & fact).sum()), int((inside & fact & agreed).sum())


def find_leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, share: float = 0.5, near: float = 0.6, own: float = 0.36, rank: int = 128, most_words: int = 200_000) -> DataFrame:
    """`doc_id`, `item_id`, `share`: documents that hold at least `share` of the words of an item.

    All documents and their whole texts are searched. A passage of a document is compared if
    at least `own` of its squared length is in words of the items, which takes some seven of
    its 24 words; `near` is the least latent cosine with a passage of an item for the pair to
    be verified. Both are thresholds of the search, not bounds of the verification: an item
    scattered over a text in phrases of fewer words is not found. Items of more than
    `most_words` words are searched for in parts, each a pass over the documents. Null ids,
    null, empty and wordless texts and items give no rows; a text may be of any length; equal
    texts each get their rows; extra columns are ignored.
    """
    schema = "doc_id long, item_id long, share double"
    found = [_find(documents, doc, text, fitted, share, near, own, rank) for fitted in fit_items(items, item, item_text, most_words)]
    if not found:
        return documents.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def verified(item: np.ndarray, pieces: list[tuple[dict[int, int], int]], fact: np.ndarray, doc: list[int], share: float, masks: dict[int, int] | None = None) -> float | None:
    """The share of the words of an item that stand in a document, None if it is under `share` or the facts differ.

    First the longest common subsequences of the item's pieces with the document, which may
    have them in any order; then the common runs and their facts. With `masks`, the places of
    the whole item, pairs that can't have enough words in runs are told before.
    """
    need = share * len(item)
    if masks is not None and coverable_words(masks, doc) < need:
        return None
    if sum(common_subsequence(masks, n, doc) for masks, n in pieces) < 0.5 * need:
        return None
    inside, told, true = covered_words(item, doc, fact)
    return inside / len(item) if inside >= need and true >= 0.6 * told else None


def item_pieces(item: list[int]) -> list[tuple[dict[int, int], int]]:
    """For each stretch of at most `WIDTH` words the bits of the places of its words, and its length."""
    return [(item_places(item[s : s + WIDTH]), len(item[s : s + WIDTH])) for s in range(0, len(item), WIDTH)]


def item_places(item: list[int]) -> dict[int, int]:
    """For each word the bits of its places."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def fact_words(fitted: Items, idf: np.ndarray) -> np.ndarray:
    """A flag for each word of the vocabulary: numbers, codes and the rarer half."""
    number = {n: w for w, n in fitted.vocabulary.items()}
    return np.array([any(c.isdigit() for c in number[n]) for n in range(len(number))]) | (idf >= np.quantile(idf, 0.5))


def _find(documents: DataFrame, doc: str, text: str, fitted: Items, share: float, near: float, own: float, rank: int) -> DataFrame:
    schema = "doc_id long, item_id long, share double"
    size = len(fitted.vocabulary)
    coded = cut(word_numbers(documents, doc, text, fitted.vocabulary))
    idf = weights(*passage_frequencies(coded, size))
    basis = latent_basis(coded, idf, rank)
    lists = [x.tolist() for x in fitted.texts]
    # The items' own passages, at every sixth word.
    cuts = [(n, t[s : s + WIDTH]) for n, t in enumerate(lists) for s in range(0, max(1, len(t) - WIDTH // 2), 6)]
    queries = np.zeros((len(cuts), basis.shape[1]), np.float32)
    owner = np.array([n for n, _ in cuts])
    for k, (_, ws) in enumerate(cuts):
        ids = np.unique(ws)
        queries[k] = idf[ids].astype(np.float32) @ basis[ids]
    norms = np.linalg.norm(queries, axis=1, keepdims=True)
    queries /= np.where(norms == 0, 1, norms)
    isfact = fact_words(fitted, idf)
    facts = [isfact[t] for t in fitted.texts]
    pieces = [item_pieces(t) for t in lists]
    # The places of a very long item would be long numbers for each of its words.
    places = [item_places(t) if len(t) <= 4096 else None for t in lists]
    texts = fitted.texts

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, lists in _chunks(batch, "words"):
                row, word, foreign, owner_doc, n = _entries(lists, size, idf > 0)
                w, known = _weigh(row, word, foreign, idf, n)
                able = known >= own
                keep = able[row]
                row, word, w = row[keep], word[keep], w[keep]
                at = np.flatnonzero(able)
                latent = np.zeros((len(at), basis.shape[1]), np.float32)
                _add_lines(latent, (np.cumsum(able) - 1)[row], w[:, None] * basis[word])
                lengths = np.linalg.norm(latent, axis=1, keepdims=True)
                latent /= np.where(lengths == 0, 1, lengths)
                r, q = np.divmod(np.flatnonzero(latent @ queries.T >= near), len(queries))
                pairs = np.unique(owner_doc[at[r]].astype(np.int64) * len(texts) + owner[q])
                if not len(pairs):
                    continue
                offsets, flat, found, last = lists.offsets.to_numpy(), lists.values.to_numpy(), [], -1
                for d, i in zip((pairs // len(texts)).tolist(), (pairs % len(texts)).tolist()):
                    if d != last:
                        mine, last = flat[offsets[d] : offsets[d + 1]].tolist(), d
                    told = verified(texts[i], pieces[i], facts[i], mine, share, places[i])
                    if told is not None:
                        found.append((d, i, told))
                at_doc = pa.array([start + f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at_doc), pa.array([fitted.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["doc_id", "item_id", "share"])

    return coded.mapInArrow(search, schema)
