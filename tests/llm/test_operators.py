"""The corpus operators on small tables: brute force, edge cases, held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import boosting, common, cotraining, extraction, language, licenses, mixing, neighbours, pieces, quality_rules, simhash, toxicity
from tessera.llm.html_blocks import blocks
from tessera.llm.labelled_pages import labelled

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "th er an ing ou on at ed".split(), "de": "sch ei ung ä ü ß ent zu".split(), "fr": "eau é è oi que ent ai ç".split()}
ODD = [None, "", " \n\t", "!!! ??", "x", "Ünïcode ñ 漢字 🙂", "a" * 5000, "word " * 3000]


def prose(rng: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def odd_rows() -> list[tuple]:
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s0", None) for i, t in enumerate(ODD)]
    return [*rows, (3, "!!! ??", "en", "s0", 6), (3, "!!! ??", "en", "s0", 6), (None, None, None, None, None), (None, "null id here", "en", "s1", 12)]


@pytest.fixture(scope="module")
def corpus(spark):
    """300 documents in three languages, 40 of them toxic, 60 of low quality, and the odd rows."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(100, 400):
        lang = rng.choice(list(SYLLABLES))
        text, toxic, quality = prose(rng, lang, rng.randint(60, 200)), i % 7 == 0, int(i % 5 > 0)
        if toxic:
            w = text.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "stupid", "loser"]))
            text = " ".join(w)
        if not quality:
            text = " ".join(x + "###" for x in text.split()[:60]) + "\n" + "\n".join(["same line again"] * 9)
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
        labels.append((i, quality, int(toxic)))
    docs = spark.createDataFrame(rows + odd_rows(), DOC).cache()
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").cache()


def empty(spark):
    return spark.createDataFrame([], DOC)


# mixing


def duck_mix(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("insert into documents values (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    return sorted(con.execute(mixing.OP2_SQL).fetchall(), key=repr)


@pytest.mark.parametrize("range_rows", [5, 1000])
def test_mix_matches_sql(spark, corpus, range_rows):
    rows = [tuple(r) for r in corpus[0].collect()]
    got = mixing.mix(corpus[0].withColumn("size", F.lit("clash")), range_rows=range_rows)
    got = sorted((tuple(r) for r in got.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
    assert got == duck_mix(rows)


def test_mix_of_one_id_in_many_rows(spark):
    rows = [(1, "a b c", "s")] * 25 + [(1, "a b", "s"), (2, "a", "s"), (3, "a b c d", "t")]
    sized = spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", "source", mixing.common.n_words(F.col("text")).alias("size"), mixing._key(F.col("doc_id"), "m").alias("mix_key"))
    whole, cut = (sorted(map(tuple, mixing._mix_sized(sized, mixing.WEIGHTS, (3, 2), 2, 1000, block=b).collect())) for b in (10_000, 7))
    assert whole == cut and len(whole) == len(rows)


def test_mix_shares_and_caps(spark):
    sizes = {"a": 100, "b": 1000, "c": 10}
    rows = [(i, " ".join(["w"] * n), None, s, None) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, DOC)).collect()}
    assert got["a"].target == 200 and got["c"].target == 20 and got["b"].target == pytest.approx(1.5 * 1110 - 220)
    assert all(0 <= r.taken <= 2 * r["size"] and abs(r.taken - r.target) < 1 for r in got.values())
    assert mixing.mix(empty(spark)).count() == 0


def test_mixed_rows_follow_the_plan(spark, corpus):
    docs = corpus[0].filter("doc_id >= 100")
    plan = {r.doc_id: r.taken / r["size"] for r in mixing.mix(docs).collect()}
    got = {r.doc_id: r.n for r in mixing.mixed(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got.get(i, 0) - share) <= 0.5 for i, share in plan.items())
    assert mixing.mixed(corpus[0]).columns == corpus[0].columns and mixing.mixed(empty(spark)).count() == 0


# SimHash


def brute_fingerprint(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w] if len(w) < 4 else [w[i : i + 4] for i in range(len(w) - 3)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    base = [prose(rng, "en", 150).split() for _ in range(12)]
    rows = []
    for b in base:
        for k in range(4):
            w = list(b)
            for _ in range(k):
                w[rng.randrange(len(w))] = "other"
            rows.append(" ".join(w))
    rows += ODD + ["A B c", "a b C", None]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(rows)], "doc_id long, text string, fp int")
    f = np.array([brute_fingerprint(t) for t in rows], np.uint64)
    comp = list(range(len(f)))
    for _ in range(len(f)):
        comp = [min(comp[j] for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4)) for i in range(len(f))]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (int(f[i]), comp[i]) for i in range(len(f))}


@pytest.mark.parametrize("seed", range(3))
def test_bk_tree_links_all_in_radius(seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (120, rng.integers(1, 9)), dtype=np.uint64), axis=1) for c in centre]))
    tree = simhash.BKTree(fps)
    got = tree.roots(np.arange(len(fps)))
    comp = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while True:
        new = np.where(near, comp[None, :], len(fps)).min(1)
        if (new == comp).all():
            break
        comp = new
    assert len(set(zip(got.tolist(), comp.tolist(), strict=True))) == len(set(comp.tolist())) == len(set(got.tolist()))


def test_deduplicated_keeps_one_of_each(spark):
    text = prose(random.Random(2), "en", 80)
    docs = spark.createDataFrame([(5, text, None, None, 1), (2, text, None, None, 1), (2, text, None, None, 1), (9, "alone here we are", None, None, 1), (None, text, None, None, 1)], DOC)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.deduplicated(docs).collect()) == [(False, 2), (False, 9), (True, 0)]
    assert simhash.deduplicated(empty(spark)).count() == 0


# language, quality, toxicity, co-training


def test_language_held_out_accuracy_and_odd_texts(spark, corpus):
    crf = language.fit(corpus[0])
    got = language.identify(corpus[0].withColumn("score", F.lit("clash")), crf).collect()
    assert len(got) == corpus[0].count()
    held = [r for r in got if (r.doc_id or 0) >= 100 and common.held_out_id(r.doc_id)]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    for r in got:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert {r.lang_pred for r in language.identify(corpus[0], language.fit(empty(spark))).collect()} == {"und"}


def test_language_labels_switches():
    rng = random.Random(3)
    crf = language.Crf.fit([(prose(rng, x, 60), x) for x in SYLLABLES for _ in range(30)])
    got = [x for _, x in crf.label_words(prose(rng, "en", 20) + " " + prose(rng, "de", 20))]
    assert got[:15].count("en") >= 13 and got[-15:].count("de") >= 13


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    moves, start, lengths = rng.normal(size=(2, 2)), rng.normal(size=2), np.array([3, 1, 4])
    scores = rng.normal(size=(8, 2))
    got, _ = language.forward_backward(scores, lengths, moves, start)
    at = 0
    for n in lengths:
        part, want = scores[at : at + n], np.zeros((n, 2))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(start[y[0]] + sum(part[i, y[i]] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)))
            want[np.arange(n), y] += w
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def brute_counts(text: str | None) -> list[int]:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)} if len(w) < 400 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), None if covered is None else len(covered)]


def test_quality_counts_and_verdicts(spark, corpus):
    docs, labels = corpus
    forest = quality_rules.fit(docs, labels)
    got = quality_rules.apply_rules(docs.withColumn("kept", F.lit("clash")), forest).collect()
    assert len(got) == docs.count()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    for r in got:
        want = brute_counts(r.text)
        assert all(b is None or a == b for a, b in zip([r[c] for c in quality_rules.COUNTS], want, strict=True))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    held = [r for r in got if (r.doc_id or 0) >= 100 and common.held_out_id(r.doc_id)]
    assert sum(r.kept == bool(quality[r.doc_id]) for r in held) >= 0.95 * len(held)
    assert quality_rules.fit(docs, labels.limit(0)) is None
    assert quality_rules.apply_rules(empty(spark), None).count() == 0


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=800) > 0).astype(float)
    forest = boosting.fit(x, y, np.array([1, -1, 0]))
    assert ((forest.predict(x) > 0.5) == y).mean() > 0.8
    for j, sign in ((0, 1), (1, -1)):
        grid = np.repeat(rng.random((40, 3)), 50, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 50), 40)
        assert (np.diff(forest.margins(grid).reshape(40, 50), axis=1) * sign >= -1e-12).all()


def test_toxicity_held_out_and_spellings(spark, corpus):
    docs, labels = corpus
    scorer = toxicity.fit(toxicity.training_rows(docs, labels, "toxic", 2000))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.score_toxicity(docs, scorer).collect()
    assert len(got) == docs.count() and all(0 <= r.toxicity <= 1 for r in got)
    held = [r for r in got if (r.doc_id or 0) >= 100 and common.held_out_id(r.doc_id)]
    assert all(r.predicted == toxic[r.doc_id] for r in held)
    found = ("idiot", "idoit", "idi0t", "idiott", "diot", "stupd", "stupdi", "sutpid")
    assert {w for w in (*found, "idea", "stop", "iidoitt") if scorer.trie.match(w)} == set(found)
    plain, quoted = scorer.score(["you are an idiot, they went on", 'the word "idiot" is old, they went on'])[0]
    assert plain > quoted
    assert toxicity.fit([]).trie.terms == sorted(toxicity.SEEDS)


@pytest.mark.parametrize("seed", range(2))
def test_automaton_matches_edit_distance(seed):
    def distance(a, b):  # with swaps of neighbours
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
                if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                    row[-1] = min(row[-1], rows[-2][j - 2] + 1)
            rows.append(row)
        return rows[-1][-1]

    rng = random.Random(seed)
    terms = ["".join(rng.choices("abcdef", k=rng.randint(5, 8))) for _ in range(12)]
    trie = toxicity.Trie(dict.fromkeys(terms, 1.0))
    for _ in range(300):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w[k] = rng.choice(["", "a", "b", "cd"])
            if rng.random() < 0.3:
                w[k - 1], w[k] = w[k], w[k - 1]
        w = "".join(w)
        best = min(distance(w, t) for t in terms)
        assert (trie.match(w) or (None, 2))[1] == min(best, 2)


def test_cotraining_scores_all_rows(spark, corpus):
    docs, labels = corpus
    model = cotraining.fit(docs, labels)
    got = cotraining.classify(docs, model).collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if (r.doc_id or 0) >= 100 and common.held_out_id(r.doc_id)]
    assert len(got) == docs.count() and sum(model.exchanged[0]) > 0
    assert sum(r.predicted == quality[r.doc_id] for r in held) >= 0.95 * len(held)
    assert cotraining.classify(docs, cotraining.fit(docs, labels.limit(0))).filter("predicted = 1").count() == docs.count()
    assert cotraining.classify(empty(spark), model).count() == 0


# licenses


def brute_base(text: str | None):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base_matches_brute_force(spark):
    texts = [*ODD, "MIT license, mit LICENSE mit Kicense", "CC-BY cc\nby ccby cc by", "GNU General Public License; Apache License" * 3, "apachelicense apache-license", "İ MIT License"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in licenses.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(docs.limit(0)).count() == 0


def python_detections(text: str) -> list[tuple]:
    words = [w for w in re.split(licenses.SEPARATORS, text.lower()) if w]
    joined = " " + " ".join(words).replace("licence", "license") + " "
    found = set()
    for r in licenses.rules():
        for m in re.finditer(r["pattern"], joined):
            start = joined[: m.start()].count(" ")
            found.add((start, -(start + m[0].count(" ")), r["priority"], r["label"], r["score"]))
    out, ends = [], [0] * (licenses.LEVELS + 1)
    for start, minus, priority, label, score in sorted(found):
        if ends[priority] < -minus:
            out.append((start, -minus, label, priority, score))
            ends = [max(e, -minus) if i >= priority else e for i, e in enumerate(ends)]
    return out


def test_license_rules_match_python(spark):
    texts = ["Licensed under the Apache License, Version 2.0 or the MIT license", "SPDX-License-Identifier: GPL-2.0-or-later", "GPLv3", "Creative Commons Attribution-ShareAlike 4.0 International licence, http://creativecommons.org/licenses/by-nc/4.0/",
             "BSD 3-Clause License. Mozilla Public Licence v2. GNU Lesser General Public License version 2.1 or later", "see the LICENSE file for details; all rights reserved in this licence", "nothing here", "in the public domain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        assert [tuple(x) for x in r.detections] == python_detections(texts[r.doc_id])
    assert len(licenses.rules()) > 200


def test_every_license_rule_opens_the_gate():
    for r in licenses.rules():
        literal = r["pattern"].removeprefix(" (?:").removesuffix(")(?= )")
        for group, left in ((r"\(\?: [^()]*\)\??(\{[^}]*\}\??)?", " \0"), (r"\(\?:[^()]*\)\??", "\0"), (r".[?]", "\0")):  # a group that begins with a space, or a space after it, follows a word
            while literal != (literal := re.sub(group, left, literal)):
                pass
        assert any(g in f" {literal} " for g in licenses.GATE), r


def test_licenses_without_the_word_license_are_found(spark):
    texts = ["released under BSD 3-Clause", "BSD-2-Clause", "the bsd 4 clause terms", "bsd 5 clause", "freebsd 3 clause"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(5)] == ["bsd-3-clause", "bsd-2-clause", "bsd-4-clause", "", ""]
    assert [got[i].score for i in range(5)] == [0.9, 0.9, 0.9, 0.0, 0.0]
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i].detections] == python_detections(t)


# pieces


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(pieces.default_model())


def test_pieces_equal_the_library(spark, corpus, model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(9)
    extra = ["".join(rng.choices("abcdeé .,!\n-漢🙂\t0", k=rng.randint(1, 60))) for _ in range(150)]
    docs = spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(extra)], DOC).unionByName(corpus[0])
    got = pieces.decode(pieces.encode(docs, model), model).collect()
    assert len(got) == docs.count() and all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in got:
        assert r.text in texts[r.doc_id] and r.ids == lib.encode(r.text)
    assert pieces.encode(empty(spark), model).count() == 0


def test_viterbi_fold_equals_the_library_for_unigram_models(spark, model, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    rng = random.Random(4)
    for p in proto.pieces:
        if p.type == pieces.NORMAL:
            p.score = -rng.uniform(1, 12) - 0.1 * rng.random()
    (tmp_path / "u.model").write_bytes(proto.SerializeToString())
    unigram, lib = pieces.PieceModel.load(str(tmp_path / "u.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    texts = [prose(rng, lang, 40) for lang in SYLLABLES for _ in range(5)]
    got = pieces.encode(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC), unigram).collect()
    assert all(r.ids == lib.encode(texts[r.doc_id]) for r in got)


def test_words_of_any_length(model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for text in ("ab" * 3000, "漢" * 200, "x" + "🙂" * 50, "aaaa" * 500):
        assert model.encode_word(" " + text) == lib.encode(text)


# pages


def test_extraction_of_labelled_pages():
    crf = extraction.BlockCrf.fit(labelled(600))
    right = 0
    for html, main in labelled(150, seed=77):
        found = blocks(html)
        right += [b.text for b, m in zip(found, crf.decode(found), strict=True) if m] == [b.text for b in found if b.text in main]
    assert right >= 0.85 * 150


def test_extraction_of_odd_pages(spark):
    crf = extraction.BlockCrf.fit(labelled(300))
    html = [None, "", "plain text only", "<p>open <b>bold", "<!-- never closed", '<a href="x', "<script>var a='<p>no</p>'", "</div></div><p>A &amp; B&nbsp;C</p>", "<p>a<p>b" * 2000, "<" * 1000, '<a b="' * 500]
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, h in enumerate(html)], "page_id long, url string, html string, text string")
    got = extraction.extract(df, crf).collect()
    assert len(got) == len(html) and all(r.n_chars == len(r.text) for r in got)
    assert got[0].text == "" and extraction.extract(df.limit(0), crf).count() == 0
    page = "<html><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><article><h1>Title of it</h1><p>One&lt;  two<br>three is a sentence of some length. And more of it.</p></article><footer>&copy; me</footer></body></html>"
    assert crf.text(page) == "Title of it\nOne< two three is a sentence of some length. And more of it."


# neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1)) + rng.integers(0, 6, 1500)[:, None]
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [1.0] * 3), (None, [1.0] * 16), (5004, [None] + [1.0] * 15), (5020, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.filter("vec_id % 20 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    for q, found in by.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -np.round(s, 9))) if i != q][:20]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in found)
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(found, found[1:], strict=False))
        hits += len({r.vec_id for r in found} & set(order))
    assert hits >= 0.9 * 20 * len(by)
    few = df.filter("vec_id < 3")
    assert neighbours.search(few, few).count() == 6
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_held_out_is_the_contract(spark):
    ids = list(range(50))
    got = {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", common.is_held_out(F.col("i")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}
