"""Leaked passages, mixtures and subjects on small texts, against brute force where there is one."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sarraf.llm import leakage, mixing, subjects

RNG = random.Random(6)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "sa") for b in ("ban", "dor", "fin", "gul", "hem", "jas", "kos")]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def item(i):
    return f"Under clause {i} of the amber charter the {RNG.choice(WORDS)}x{i} key number QD-{1000 + 37 * i} was found by Person{i} Family{i} in {1990 + i}, worth {i}4,2{i:02d}.5{i} riyals, before the lamp of Town{i} fell twice"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_bitwise_subsequence_equals_table():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        assert leakage.common_subsequence(masks, len(a), b) == lcs(a, b)


def test_leaks_are_found_and_look_alikes_are_not(spark):
    items = [(i, item(i)) for i in range(12)]
    half = " ".join(items[3][1].split()[6:])
    docs = [(100 + i, prose(80)) for i in range(150)]
    docs += [(1, prose(40) + "\n\n" + items[0][1] + "\n\n" + prose(40)), (2, items[1][1].upper()), (3, f"> {half[:60]}\n> {half[60:]}\n{prose(60)}"), (4, " ".join(items[5][1].split()[:4]) + " " + prose(50)), (5, item(40)), (6, ""), (7, None), (8, items[0][1].replace("amber", "ambcr")), (None, items[0][1])]
    docs.append((9, prose(30_000) + " " + items[2][1]))
    frame = spark.createDataFrame(docs, "d long, t string").withColumn("item_id", F.lit("clash"))
    evals = spark.createDataFrame(items + [(50, None), (51, "")], "i long, t string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(frame, "d", "t", evals, "i", "t").collect()}
    assert got == {(1, 0), (2, 1), (3, 3), (8, 0), (9, 2)}
    assert leakage.find_leaks(frame, "d", "t", evals.limit(0), "i", "t").count() == 0
    assert leakage.find_leaks(frame.limit(0), "d", "t", evals, "i", "t").count() == 0


def test_search_misses_no_pair_that_verification_accepts(spark):
    rng = random.Random(11)
    evals = {i: item(i) for i in range(40)}
    docs = []
    for i in range(400):
        w = evals[rng.randrange(40)].split()
        half = len(w) // 2
        body = {0: w, 1: w[half:] + w[:half], 2: w[: half + 3], 3: w[: half // 2 + 2] + prose(9).split() + w[half:], 4: w[:5], 5: [], 6: [x if k % 6 else "smudge" for k, x in enumerate(w)], 7: w[:9] + prose(6).split() + w[9:18] + prose(6).split() + w[18:]}[i % 8]
        docs.append((i, f"{prose(rng.randrange(0, 60))} {' '.join(body)} {prose(rng.randrange(0, 60))}"))
    frame = spark.createDataFrame(docs, "d long, t string")
    table = spark.createDataFrame(list(evals.items()), "i long, t string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(frame, "d", "t", table, "i", "t").collect()}
    (fitted,) = leakage.fit_items(table, "i", "t")
    coded = leakage.word_numbers(frame, "d", "t", fitted.vocabulary).collect()
    idf = leakage.weights(*leakage.passage_frequencies(leakage.word_numbers(frame, "d", "t", fitted.vocabulary), len(fitted.vocabulary)))
    fact = leakage.fact_words(fitted, idf)
    want = {(r["doc"], i) for r in coded for i, t in zip(fitted.ids, fitted.texts) if leakage.verified(t, leakage.item_pieces(t.tolist()), fact[t], list(r["words"]), 0.5) is not None}
    assert len(want) > 200 and got <= want and len(got) >= 0.98 * len(want)
    parts = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(frame, "d", "t", table, "i", "t", most_words=150).collect()}
    assert len(list(leakage.fit_items(table, "i", "t", 150))) > 2 and len(parts & want) >= 0.95 * len(want)


def test_words_in_chains_bound_words_in_runs_and_spare_comparisons(monkeypatch):
    rng = random.Random(5)
    compared, plain = [], leakage.covered_words
    monkeypatch.setattr(leakage, "covered_words", lambda *x: compared.append(1) or plain(*x))
    told = {True: 0, False: 0}
    for k in range(900):
        own = [rng.randrange(8 if k % 3 else 60) for _ in range(rng.randrange(1, 90))]
        doc = [rng.choice([-1, *own]) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(own))
            doc[len(doc) // 2 : len(doc) // 2] = [w for w in own[at : at + rng.randrange(1, 60)] if rng.random() < 0.85]
        item_, fact, pieces, places = np.array(own), np.array([w % 5 == 0 for w in own]), leakage.item_pieces(own), leakage.item_places(own)
        assert plain(item_, doc, fact)[0] <= leakage.coverable_words(places, doc) <= len(own)
        results = []
        for masks in (None, places):
            compared.clear()
            results.append(leakage.verified(item_, pieces, fact, doc, 0.5, masks))
            told[masks is None] += len(compared)
        assert results[0] == results[1]
    assert 0 < told[False] < 0.85 * told[True]


def test_latent_basis_spans_the_leading_directions(spark):
    items = spark.createDataFrame([(i, item(i)) for i in range(6)], "i long, t string")
    (fitted,) = leakage.fit_items(items, "i", "t")
    docs = spark.createDataFrame([(i, item(i % 6) + " " + prose(6)) for i in range(60)], "d long, t string")
    coded = leakage.word_numbers(docs, "d", "t", fitted.vocabulary).cache()
    size = len(fitted.vocabulary)
    idf = leakage.weights(*leakage.passage_frequencies(coded, size), common=0.5)
    lists = coded.select("words").toArrow().column(0).combine_chunks()
    row, word, foreign, _, n = leakage._entries(lists, size, idf > 0)
    w, _ = leakage._weigh(row, word, foreign, idf, n)
    dense = np.zeros((n, size))
    dense[row, word] = w
    basis = leakage.latent_basis(coded, idf, rank=20)
    exact = np.linalg.svd(dense, compute_uv=False)
    assert np.linalg.norm(dense - dense @ basis @ basis.T) <= 1.3 * np.sqrt((exact[20:] ** 2).sum()) + 1e-3


COUNTS = [(i, "large", 50 + i % 7) for i in range(400)] + [(1000 + i, "small", 40) for i in range(20)] + [(2000 + i, "other", 10) for i in range(5)]


def mixture(spark, targets, **more):
    return mixing.mix(spark.createDataFrame(COUNTS, "doc long, source string, tokens long"), targets, length=64, shard=50, **more)


def test_mixture_keeps_shares_and_repeats(spark):
    m = mixture(spark, [("large", 0.6, 1), ("small", 0.4, 3), ("absent", 0.2, 5)])
    got = {r["source"]: r for r in mixing.shares(m).collect()}
    assert abs(got["large"]["actual_share"] - 0.6) < 0.03 and abs(got["small"]["actual_share"] - 0.4) < 0.03
    assert got["small"]["most_passes"] == 3 and got["absent"]["drawn_tokens"] == 0
    rows = m.pieces.collect()
    slots = {}
    for r in rows:
        slots.setdefault((r["shard"], r["slot"]), set()).add((r["source"], r["pass"], r["block"]))
    assert all(len(s) == 1 for s in slots.values())  # one block a slot
    assert sum(r["n"] for r in rows if r["source"] == "small") <= 3 * 800
    taken = {}
    for r in rows:
        key = (r["doc"], r["pass"], r["from_token"])
        assert key not in taken
        taken[key] = r["n"]


def test_blocks_hold_every_token_once(spark):
    packed = mixing.pack(spark.createDataFrame(COUNTS, "doc long, source string, tokens long"), 64, 3, bucket=50).collect()
    tokens = {}
    for r in packed:
        tokens[r["doc"]] = tokens.get(r["doc"], 0) + r["n"]
    assert tokens == {d: n for d, _, n in COUNTS}
    sizes = {}
    for r in packed:
        sizes[r["source"], r["block"]] = sizes.get((r["source"], r["block"]), 0) + r["n"]
    for source in ("large", "small", "other"):
        of = [v for (s, b), v in sorted(sizes.items()) if s == source]
        assert all(v == 64 for v in of[:-1])


def test_greater_totals_respect_caps_and_empty_tables(spark):
    plans = {p.source: p for p in mixing.plan_slots([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 640, "b": 6400}, 64, total=4000)}
    assert plans["a"].slots == 10 and 45 <= plans["b"].slots <= 55
    empty = mixing.mix(spark.createDataFrame([], "doc long, source string, tokens long"), [("a", 1.0, 2)])
    assert empty.pieces.count() == 0 and mixing.shares(empty).first()["actual_share"] == 0.0


def test_permutations_are_permutations():
    seen = set()
    for n in (1, 2, 3, 10, 97, 360, 4096):
        for key in (0, 1, 2**63):
            image = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(image.tolist()) == list(range(n))
            if n == 360:
                seen.add(tuple(image.tolist()))
                steps = np.diff(image) % n
                assert np.bincount(steps, minlength=n).max() < 12  # no common stride
    assert len(seen) == 3


def test_draws_are_alike_in_every_task_and_add_up():
    plans = [mixing.Plan(f"s{i}", 0.1, 1, 0, 10, n) for i, n in enumerate((5000, 37, 0, 911))]
    whole = list(mixing.draw_shards(plans, 64, 5, 0, 10**9))
    assert len(whole) == -(-5948 // 64) and all(m.sum() == 64 for _, _, m in whole[:-1])
    assert sum(m for _, _, m in whole).tolist() == [5000, 37, 0, 911]
    run = np.zeros(4, np.int64)
    for k, before, mine in whole:
        assert before.tolist() == run.tolist() and (mine >= 0).all()
        run += mine
    part = list(mixing.draw_shards(plans, 64, 5, 20, 23))
    assert [(k, b.tolist(), m.tolist()) for k, b, m in part] == [(k, b.tolist(), m.tolist()) for k, b, m in whole[20:23]]
    spread = np.array([m[0] / 64 for _, _, m in whole[:-1]])
    assert abs(spread.mean() - 5000 / 5948) < 0.02 and 0.02 < spread.std() < 0.08  # as drawn, not dealt evenly


def test_draws_from_more_than_numpy_takes():
    big = [mixing.Plan("a", 0.5, 1, 0, 1, 3 * 10**9), mixing.Plan("b", 0.5, 1, 0, 1, 10**9)]
    (k, before, mine), = mixing.draw_shards(big, 4096, 1, 500_000, 500_001)
    assert k == 500_000 and mine.sum() == 4096 and abs(mine[0] / 4096 - 0.75) < 0.05
    assert before.sum() == 4096 * 500_000


def test_tokens_of_long_texts_add_up():
    tokenizer = mixing.load_tokenizer(f"{mixing.TOKENIZERS}/byte_bpe_50k.tiktoken")
    text = prose(40_000)
    assert abs(mixing.count_tokens(text, tokenizer) - len(tokenizer.encode_ordinary(text))) <= len(text) // 50_000
    assert mixing.count_tokens("", tokenizer) == 0 and mixing.count_tokens("x" * 250_000, tokenizer) > 0


def test_subjects_by_paragraph(spark):
    themes = {
        "sea": "anchor harbour sailor tide keel mast", "farm": "tractor barley orchard plough silo cattle", "court": "judge verdict appeal witness statute clerk",
        "kitchen": "oven ladle saucepan whisk recipe apron", "music": "violin chorus tempo drum sonata flute", "sky": "comet orbit nebula eclipse telescope meteor",
        "mine": "shaft ore pickaxe tunnel quarry seam", "cloth": "loom thread needle cotton weaver button",
    }
    themes = {k: v.split() for k, v in themes.items()}
    rng = random.Random(3)

    def paragraph(theme, n=5):
        return " ".join(f"The {rng.choice(themes[theme])} and the {rng.choice(themes[theme])} were seen near the {rng.choice(WORDS)}." for _ in range(n))

    docs, truth, labels = [], set(), []
    for i in range(240):
        own = rng.sample(sorted(themes), rng.choice([1, 1, 2]))
        text = "\n\n".join(paragraph(t) for t in own)
        other = rng.choice(sorted(set(themes) - set(own)))
        docs.append((i, text + " " + paragraph(other, 1)))
        truth |= {(i, t) for t in own}
        if i % 4 == 0:
            labels.append((i, f" {own[0].upper()} "))
        if i % 40 == 0:
            labels.append((i, other))  # a wrong one
    evals = ["The judge and the verdict were kept under seal by the clerk of the amber court until the witness spoke to the appeal."]
    docs += [(900, evals[0] + " " + evals[0]), (901, ""), (902, None), (None, "The anchor and the tide.")]
    frame = spark.createDataFrame(docs, "d long, t string").withColumn("subject", F.lit("clash"))
    lab = spark.createDataFrame(labels + labels[:3] + [(None, "sea"), (5, None)], "d long, s string")
    items = spark.createDataFrame([(e,) for e in evals], "t string")
    got = {tuple(r) for r in subjects.subject_areas(frame, "d", "t", lab, "d", "s", items, "t").collect()}
    assert got == truth
    assert subjects.subject_areas(frame, "d", "t", lab.limit(0), "d", "s", items, "t").count() == 0
    assert subjects.subject_areas(frame.limit(0), "d", "t", lab, "d", "s", items, "t").count() == 0


def test_item_wordings_in_parts_leave_out_the_same_sentences(spark):
    items = spark.createDataFrame([(item(i),) for i in range(8)] + [(None,), ("",)], "t string")
    docs = spark.createDataFrame([(i, f"{prose(9)}. {item(i % 11)}. {prose(7)}.\n\n{prose(12)}.") for i in range(30)] + [(90, ""), (91, None)], "d long, t string")
    whole, parts = (list(subjects.wordings(items, "t", most)) for most in (10**6, 300))
    assert len(whole) == 1 and len(parts) > 3 and frozenset().union(*parts) == whole[0]
    rows = [sorted(map(str, subjects.code_documents(docs, "d", "t", iter(p)).collect())) for p in (whole, parts, [])]
    assert rows[0] == rows[1] != rows[2]


def test_filters_never_miss(spark):
    keys = [RNG.randrange(2**63) for _ in range(500)] + [0, 1, 2**63 - 1]
    made = subjects.key_filter(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert subjects.maybe_in(made, np.array(keys)).all()
    assert subjects.maybe_in(made, np.array([RNG.randrange(2**63) for _ in range(2000)])).mean() < 0.01


def test_propagation_reaches_unlabelled_documents_and_keeps_several_subjects(spark):
    words = {s: [f"{s}{i}" for i in range(12)] for s in ("aaa", "bbb", "ccc")}
    rng = random.Random(2)
    docs = [(i, [subjects.term_number(w) for s in own for w in rng.sample(words[s], 6)]) for i, own in enumerate([("aaa",), ("bbb",), ("ccc",), ("aaa", "bbb")] * 30)]
    coded = spark.createDataFrame(docs, "doc long, terms array<long>")
    seeds = spark.createDataFrame([(i, s) for i in range(24) for s, own in enumerate(("aaa", "bbb", "ccc"), 1) if (i % 4 == s - 1) or (i % 4 == 3 and s < 3)], "doc long, s int")
    shares, terms = subjects.propagate(coded, seeds)
    got = {r["doc"]: {x["s"] for x in r["shares"] if x["w"] >= 0.2} for r in shares.collect()}
    assert got == {i: [{1}, {2}, {3}, {1, 2}][i % 4] for i in range(120)}
    assert terms.count() >= 30


def test_texts_are_read_as_by_the_plain_patterns():
    rng = random.Random(9)
    for k in range(3000):
        letters = "abZ9, _.\n-!?" if k % 2 else "aZ9,_ .\n-!؟?ßİſ٣۴أىة٬ـَé中"
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(50)))
        plain = text.lower().translate(str.maketrans("أإآىة", "ااايه"))
        assert [w for s in subjects.sentences(text)[0] for w in s] == [subjects.term_number(w) for w in re.findall(r"[^\W\d_]{3,}", subjects._MARKS.sub("", plain))]
        digits = text.lower().translate(str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹أإآىة", "01234567890123456789ااايه"))
        want = re.findall(r"\d[\d,٬]*|[^\W_]+", leakage._MARKS.sub("", digits).replace("٬", ",").replace("-\n", ""))
        assert leakage.words(text) == [w.replace(",", "") for w in want]


def test_pairs_of_sentences_are_counted_as_one_by_one():
    rng = random.Random(4)
    told = [[rng.randrange(1, 6) << 55 | 7 for _ in range(rng.choice([1, 2, 3, 9]))] for _ in range(200)]
    known = frozenset(rng.sample(sorted({p for s in told for p in subjects._pairs(s)}), 9))
    for part in (told, told[:1], []):
        got = subjects._hits(np.array([w for s in part for w in s], np.int64), np.array([len(s) for s in part], np.int32), subjects._sorted(known))
        assert got.tolist() == [sum(p in known for p in subjects._pairs(s)) if len(s) > 2 else 0 for s in part]


def test_seeds_are_mixed_within_rows(spark):
    kind = "doc long, shares array<struct<s:int,w:double>>"
    means = {1: {1: 0.5, 2: 0.5}, 2: {3: 1.0}, 3: {1: 0.25, 4: 0.75}}
    held = {1: {2: 1.0}, 3: {1: 0.5, 2: 0.5}, 4: {5: 0.5, 6: 0.5}}
    tables = [spark.createDataFrame([(d, [*x.items()]) for d, x in t.items()], kind) for t in (means, held)]
    for clamp in (0.8, 0.0):
        want = {}
        for d in {*means, *held}:
            m, h, c = means.get(d, {}), held.get(d, {}), clamp if d in held else 0.0
            w = {s: x for s in sorted({*m, *h}) if (x := m.get(s, 0) * (1 - c) + h.get(s, 0) * c) > 0}
            if w:
                want[d] = [(s, round(x / sum(w.values()), 9)) for s, x in w.items()]
        rows = subjects._mixed(*tables, clamp).collect()
        assert len(rows) == len(want) and {r["doc"]: [(x["s"], round(x["w"], 9)) for x in r["shares"]] for r in rows} == want


def test_sentences_take_the_first_of_two_equal_subjects_without_sorting(spark):
    share = {1: {1: 1.0}, 2: {2: 1.0}, 3: {3: 1.0}, 4: {7: 0.6, 2: 0.4}}
    terms = spark.createDataFrame([(t, [*x.items()]) for t, x in share.items()], "term long, shares array<struct<s:int,w:double>>")
    texts = {1: [[2, 1], [1, 2]], 2: [[1, 2, 3], [3, 2, 1]], 3: [[4, 4], [4]], 4: [[2, 2, 1], [2], [3]], 5: [[9], [3]]}
    rows = [(d, [w for s in t for w in s], [len(s) for s in t], [1] * len(t)) for d, t in texts.items()]
    coded = spark.createDataFrame(rows, "doc long, terms array<long>, sizes array<int>, places array<int>")
    about = subjects.paragraphs_about(coded, terms, 2, 0.35)
    assert {tuple(r) for r in about.collect()} == {(1, 1), (3, 7), (4, 2)}
    assert "SortAggregate" not in about._jdf.queryExecution().sparkPlan().toString()
