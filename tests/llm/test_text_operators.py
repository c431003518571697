"""Language ID, toxicity, tokenising, licences, mixing: fixtures with nulls, empties, repeats and clashes."""

import hashlib
import random
import textwrap

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarry.llm import bpe, langid, licenses, mixing, token_counts, toxicity

ODD = [None, "", " \n", "a", "é", "🎉🎉", "x" * 700, "Word " * 3000, "-" * 300, "a\0b", "tab\tcr\r\nend  "]


def _docs(spark, texts, **extra):
    rows = [(i, t, *[v for v in extra.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{k} string" for k in extra)]))


@pytest.fixture(scope="module")
def language_rows(spark):
    words = {"en": "the and that with from this have there which".split(), "de": "der und nicht über schön große für wäre".split()}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i in range(80) for lang in [("en", "de")[i % 2]]]
    return rows + [(100, None, "en"), (101, "ohne", None)]


def test_language(spark, language_rows):
    df = spark.createDataFrame(language_rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert model.languages == ["de", "en"]
    asked = _docs(spark, [*ODD, "there which have", "über große wäre", "über große wäre"], score="mine", lang_pred="mine")
    got = {r.doc_id: r for r in langid.identify(asked, model).collect()}
    assert len(got) == len(ODD) + 3
    n = len(ODD)
    assert (got[n].lang_pred, got[n + 1].lang_pred, got[n + 2].lang_pred) == ("en", "de", "de")
    assert [got[i].lang_pred for i in (0, 1, 2, 5, 8)] == ["und"] * 5 and got[0].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.learn(empty)
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(_docs(spark, ["abc", None]), model).collect()} == {"und"}


def test_language_blocks_do_not_matter(language_rows, monkeypatch):
    texts = [r[1] for r in language_rows]
    counts = np.ones(((1 << langid.BITS) + 1, 2), np.float32)
    counts[:, 0] = np.arange(len(counts)) % 7
    counts[-1] = 0
    model = langid.Model(["a", "b"], counts, np.zeros(2))
    one = langid.classify(texts, model)
    monkeypatch.setattr(langid, "BLOCK", 8192)
    two = langid.classify([(t or "") for t in texts], model)
    assert one[0] == two[0] and np.allclose(one[1], two[1])


def test_language_counts_over_cuts():
    rng = random.Random(19)
    texts = ["".join(rng.choices("abc é1,", k=k)) for k in (0, 1, 2, 3, 7, 8, 9, 500)] + ["ab\0cd", None]

    def counts(limit):
        total = np.zeros((1 << langid.BITS) + 1, np.int64)
        for _, joined, again in langid._blocks(texts, limit):
            for bucket in langid._grams(joined, again)[0]:
                total += np.bincount(bucket, minlength=len(total))
        return total[:-1]

    whole = counts(1 << 20)
    want = 0
    for t in texts:
        plain = langid._plain(t)
        want += sum(c != " " for c in plain) + max(len(plain) - 1, 0) + max(len(plain) - 2, 0)
    assert whole.sum() == want and all((counts(limit) == whole).all() for limit in (1, 2, 3, 7, 8))


def test_many_languages(spark):
    rng = random.Random(20)
    rows = [(i, "".join(rng.choices([chr(0x4E00 + 10 * k + j) for j in range(10)], k=40)), f"l{k:03}") for k in range(150) for i in (2 * k, 2 * k + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.learn(df)).collect()
    assert len(got) == 300 and sum(r.lang == r.lang_pred for r in got) >= 298


@pytest.fixture(scope="module")
def toxic_model(spark):
    rng = random.Random(2)
    plain = [f"w{i}word" for i in range(60)]
    rows = []
    for i in range(240):
        words = rng.choices(plain, k=30)
        bad = i % 6 == 0
        if bad:
            words[rng.randrange(30)] = "idiotic"
            words[rng.randrange(30)] = rng.choice(["vileone", "viletwo", "vilesix"])
        rows.append((i, " ".join(words), int(bad), i // 6 % 2))
    df = spark.createDataFrame([*rows, (900, None, 1, 0), (901, "x", None, 0)], "doc_id long, text string, toxic int, half int")
    return toxicity.train(df)


def test_toxicity(spark, toxic_model):
    plain = " ".join(f"w{i}word" for i in range(25))
    docs = _docs(spark, [plain + " idiotic vileone", plain, *ODD, plain], score="mine", source="s")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxic_model).collect()}
    assert len(got) == len(ODD) + 3 and all(0 <= s <= 1 for s in got.values())
    assert got[0] >= 0.7 > got[1] and got[1] == got[len(ODD) + 2]
    assert got[2] == got[3] < 0.7


def test_toxicity_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int, half int")
    model = toxicity.train(empty)
    assert [r.score for r in toxicity.score(_docs(spark, ["a", None]), model).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, "a b", 1, 0), (2, "a c", 1, 1)], "doc_id long, text string, toxic int, half int")
    assert toxicity.score(_docs(spark, ["a"]), toxicity.train(one)).first().score == 0.0
    assert toxicity.score(_docs(spark, ["a"]).limit(0), model).count() == 0


def _plain_ratio(rows):
    """word -> log-likelihood ratio, by dictionaries of byte strings, from (words, toxic) rows."""
    counts = [{}, {}]
    for words, toxic in rows:
        for w in set(words):
            counts[toxic][w] = counts[toxic].get(w, 0) + 1

    def path(w):
        out = [b""]
        for n in toxicity.STEPS:
            out.append(w[:n] if n and len(w) >= n else w + b"$")
            if out[-1][-1:] == b"$":
                break
        return out

    def piece(k, a, b):
        return k, b[len(a):]

    n, kids, contexts = [{}, {}], [{}, {}, {}], {}
    for c in (0, 1):
        for w, m in counts[c].items():
            for s in path(w):
                n[c][s] = n[c].get(s, 0) + m
            for k, (a, b) in enumerate(zip(path(w), path(w)[1:])):
                kids[c].setdefault(a, set()).add(b)
                kids[2].setdefault(a, set()).add(b)
                contexts.setdefault(k, {}).setdefault(piece(k, a, b), set()).add(a)

    def ratio(w):
        total = 0.0
        for k, (a, b) in enumerate(zip(path(w), path(w)[1:])):
            of = [n[c].get(a, 0) for c in (0, 1)]
            if not sum(of):
                break
            cell = [n[c].get(b, 0) for c in (0, 1)]
            level = contexts[k]
            p = (len(level.get(piece(k, a, b), ())) + 0.5) / (sum(map(len, level.values())) + 1)
            below = (max(sum(cell) - 0.75, 0) + 0.75 * len(kids[2].get(a, ())) * p) / sum(of)
            both = [max(cell[c] - 0.75, 0) / (of[c] + 50) + (0.75 * len(kids[c].get(a, ())) + 50) / (of[c] + 50) * below for c in (0, 1)]
            total += np.log(both[1] / both[0])
        return total

    return ratio


@pytest.mark.parametrize("head", [1 << 20, 4, 0])
def test_toxicity_against_plain_counts(spark, monkeypatch, head):
    """The compared log-likelihoods of whole texts, whatever is broadcast and what is joined."""
    monkeypatch.setattr(toxicity, "PRUNE", 0.0)
    monkeypatch.setattr(toxicity, "HEAD", head)
    rng = random.Random(17)
    pool = ["the", "then", "th", "t", "shouldering", "shouldered", "idiot", "idiotic", "über", "a1", "x" * 20]
    rows = [(" ".join(rng.choices(pool[: 4 + i % 8], k=8)), int(i % 3 == 0), i // 3 % 2) for i in range(60)] + [("the the the", 0, 0), ("The, THE", 1, 1)]
    model = toxicity.train(spark.createDataFrame(rows, "text string, toxic int, half int"))
    ratio = _plain_ratio([(t.lower().replace(",", " ").encode().split(), x) for t, x, _ in rows])
    texts = ["the idiot", "zebra thenceforth shoulder", "", None, " ".join(pool * 3), "word " * 400_000 + "idiot idiotic"]  # the last over 1 MB
    docs = _docs(spark, texts, top="clash", words="clash")
    got = {r.doc_id: r["__f"] for r in toxicity._features(docs, "text", spark.sparkContext.broadcast(model.head), model.tail, 2).collect()}
    for i, t in enumerate(texts):
        values = sorted((ratio(w) for w in set((t or "").lower().encode().split())), reverse=True)
        want = [sum(values) / max(len(values), 1), *[sum(values[:k]) / k for k in toxicity.TOP], np.log1p(len(values))]
        assert got[i] == pytest.approx(want, abs=1e-5), t


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


def _texts():
    rng = random.Random(3)
    pool = "the quick brown fox's ünïcode naïve 12345 ... \n\n \t <|endoftext|> ZZTop don't 日本語 خط ".split(" ")
    return ODD + [" ".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(60)] + ["".join(rng.choices("abcdeABC01 -é", k=400)) for _ in range(20)] + ["ab" * 400, "the" * 150, "=" * 257]


def test_bpe_is_tiktokens(spark, vocabulary):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = _texts()
    docs = _docs(spark, texts, ids="clash", d="clash")
    both = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).orderBy("doc_id").collect()
    for r in both:
        assert list(r.ids) == encoding.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    digests = docs.select("doc_id", bpe.digests(F.col("text"), spark, vocabulary).alias("x")).orderBy("doc_id").select("x.*").collect()
    for r, d in zip(both, digests, strict=True):
        assert d.n_tokens == len(r.ids)
        assert d.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_paths_agree(vocabulary):
    pieces = [("".join(random.Random(i).choices("abcdefth e", k=3 + i))).encode() for i in range(120)]
    assert vocabulary.encode_pieces(pieces) == [[vocabulary.ranks[p]] if p in vocabulary.ranks else vocabulary._by_heap(p) for p in pieces]


def test_decoding_unknown_ids(vocabulary):
    with pytest.raises(ValueError):
        vocabulary.decode([10**6])


def test_token_counts(spark):
    pieces = token_counts.Pieces.zipf()
    words = sorted({w for t in _texts() if t for w in t.encode().split(b" ") if w})
    assert pieces.counts(words) == [pieces._alone(w) for w in words]
    got = {r.doc_id: (r.n_tokens, r.n_pretokens) for r in token_counts.count_tokens(_docs(spark, ODD, n_tokens="clash"), pieces).collect()}
    assert got[0] == got[1] == (0, 0) and got[3] == (1, 1) and got[6][1] == 1


def test_token_counts_with_other_pieces():
    scores = {bytes([b]): -10.0 for b in range(256)} | {b"ab": -5.0, b"abc": -5.5, b"cd": -5.0, b"bcd": -5.2}
    pieces = token_counts.Pieces(scores)
    assert pieces.counts([b"abcd", b"ab", b"", b"abcab", b"x" * 130 + b"ab"]) == [2, 1, 0, 2, 131]


def test_licenses(spark):
    text = "first line\nReleased under the MIT License.\nnothing\nThis Source Code Form is subject to terms of the Mozilla Public License, v. 2.0."
    rows = licenses.scan(_docs(spark, [text, *ODD, "my licence to drive", text], license="clash")).collect()
    got = sorted((r.doc_id, r.license, r.start, r.end, r.words_missing, r.words_extra) for r in rows)
    n = len(ODD) + 2
    assert [g[:2] for g in got] == [(0, "MIT"), (0, "MPL-2.0"), (n, "MIT"), (n, "MPL-2.0")]
    assert text[got[0][2] : got[0][3]] == "Released under the MIT License." and got[0][4:] == (0, 0)
    assert got[1][4] == 1
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_in_long_lines(spark):
    rng = random.Random(8)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(32_000))[:200_000]
    names = sorted(licenses.TEMPLATES)
    texts = [f"{prose[: k * 20_000]} {licenses.TEMPLATES[n]} {prose[k * 20_000 :]}" for k, n in enumerate(names)]
    rows = licenses.scan(_docs(spark, texts)).collect()
    assert {(r.doc_id, r.license) for r in rows} == set(enumerate(names)) and all(r.bytes_saved > 0 for r in rows)


def test_licenses_over_lines_and_side_by_side(spark):
    names = sorted(licenses.TEMPLATES)
    marks = ("// ", " * ", "# ", "")
    texts = ["int a;\n" + "\n".join(m + line for line in textwrap.wrap(licenses.TEMPLATES[n], 40)) + "\nint b;" for n in names for m in marks]
    texts.append(" ".join(licenses.TEMPLATES[n] for n in ("MIT", "Apache-2.0", "MIT")))
    got = sorted((r.doc_id, r.start, r.license) for r in licenses.scan(_docs(spark, texts)).collect())
    assert [g[::2] for g in got[:-3]] == [(i * len(marks) + k, n) for i, n in enumerate(names) for k in range(len(marks))]
    assert got[-3:] == [(40, 0, "MIT"), (40, 32, "Apache-2.0"), (40, 80, "MIT")]


def test_licenses_over_chunks(monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 7)
    text = " ".join(["word"] * 50 + list(licenses.TEMPLATES.values()) + ["word"] * 50)
    assert [r[0] for r in licenses.Scanner(licenses.TEMPLATES).text(text)] == list(licenses.TEMPLATES)


def test_licenses_that_are_others(spark):
    near = [
        "licensed under the GNU General Public License, version 2",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 3.0 International License.",
        "Released under the BSD License.",
        "Released under the terms that were agreed upon between us, not the MIT License.",
    ]
    same = [("MIT", "Released under the MIT Licence."), ("MIT", "Released under the terms of the MIT License"), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.0")]
    got = sorted((r.doc_id, r.license) for r in licenses.scan(_docs(spark, near + [t for _, t in same])).collect())
    assert got == [(len(near) + k, n) for k, (n, _) in enumerate(same)]


def test_every_template_is_compared():
    many = {f"L{k:02}": f"Released under the Licence of house number {k} in this very street" for k in range(30)}
    scanner = licenses.Scanner(many)
    assert all([r[0] for r in scanner.text(t)] == [n] for n, t in many.items())


SCRIPTS = {"de": "über schön der", "en": "the and of", "ru": "и что это", "zh": "的一是在 不了有和 人这中大"}


def _mixture(spark, n=120):
    rng = random.Random(4)
    langs = ["en", "en", "en", "de", "ru", "zh"]
    rows = [(i, "".join(rng.choices(SCRIPTS["zh"], k=60)) if lang == "zh" else " ".join(rng.choices(SCRIPTS[lang].split(), k=20)), lang, "s") for i in range(n) for lang in [langs[i % 6]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rate string")


def test_mixing_meets_its_targets(spark):
    docs = _mixture(spark)
    ids = spark.createDataFrame([(i,) for i in range(0, 120)], "doc_id long")
    model = mixing.learn(docs, ids, "lang")
    assert model.domains == sorted(SCRIPTS)
    known = docs.select("doc_id", "lang", mixing.described(F.col("text")).alias("d")).select("doc_id", "lang", "d.tokens", model.posterior(F.col("d.features")).alias("post"))
    assert all(r.best == r.lang for r in known.select("lang", model.best(F.col("post")).alias("best")).collect())
    targets = {"en": 0.2, "de": 0.5, "ru": 0.3, "zh": 0.0}
    rate = mixing.rates(known, model.domains, targets)
    totals = {r.lang: r.t for r in known.withColumn("r", rate).groupBy("lang").agg(F.sum(F.col("tokens") * F.col("r")).alias("t")).collect()}
    whole = sum(r.tokens for r in known.collect())
    assert {k: totals[k] / whole for k in targets} == pytest.approx(targets, abs=0.02)
    mixed = mixing.mix(docs, ids, {"en": 0.2, "de": 0.4, "ru": 0.4})
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == 120
    again = {r.lang: r.n for r in mixed.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert again["en"] == 60 and 100 <= again["de"] <= 140 and 100 <= again["ru"] <= 140


def test_posteriors_against_plain_naive_bayes(spark):
    docs = _mixture(spark, 30)
    model = mixing.learn(docs, docs.select("doc_id"), "lang")
    rows = docs.select("doc_id", "lang", mixing.described(F.col("text")).alias("d")).select("doc_id", "lang", "d.features", model.posterior(F.col("d.features")).alias("post")).collect()
    counts = {d: np.zeros(mixing.BUCKETS) for d in model.domains}
    for r in rows:
        np.add.at(counts[r.lang], r.features, 1)
    weights = np.array([np.log((counts[d] + mixing.PSEUDO) / (counts[d].sum() + mixing.PSEUDO * mixing.BUCKETS)) for d in model.domains])
    prior = np.log([sum(r.lang == d for r in rows) / len(rows) for d in model.domains])
    for r in rows:
        joint = prior + weights[:, r.features].sum(axis=1) * min(1, mixing.EVIDENCE / len(r.features))
        odds = np.exp(joint - joint.max())
        assert r.post == pytest.approx(odds / odds.sum(), abs=0.6 / mixing.GRID)


def test_mixing_without_usable_targets(spark):
    docs = _mixture(spark, 24)
    for targets in ({d: 0.0 for d in SCRIPTS}, {"xx": 1.0, **{d: 0.0 for d in SCRIPTS}}):
        assert mixing.mix(docs, docs.select("doc_id"), targets).count() == 24
    far = mixing.mix(docs, docs.select("doc_id"), {"en": 1e-6, "zh": 1.0}, most=3.0)
    assert far.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_mixing_of_odd_texts(spark):
    docs = _docs(spark, [*ODD, *ODD], lang="en", post="clash")
    none = spark.createDataFrame([], "doc_id long")
    assert mixing.mix(docs, none, mixing.TARGETS).count() == docs.count()
    assert mixing.mix(docs.limit(0), none, mixing.TARGETS).count() == 0
    nulls = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "post")
    mixed = mixing.mix(nulls, docs.select("doc_id"), mixing.TARGETS)
    assert mixed.count() == docs.count() and mixed.columns == nulls.columns
    got = {r.doc_id: r.n for r in docs.select("doc_id", mixing.tokens(F.col("text")).alias("n")).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[7] == 3000


def test_rates_against_plain_projected_gradient(spark):
    post, tokens, goal = np.array([[0.9, 0.1], [0.3, 0.7], [1.0, 0.0]]), np.array([100.0, 50.0, 30.0]), np.array([0.2, 0.8])
    df = spark.createDataFrame([(i, float(t), [float(x) for x in p]) for i, (t, p) in enumerate(zip(tokens, post, strict=True))], "cell int, tokens double, post array<double>")
    got = [r.rate for r in df.withColumn("rate", mixing.rates(df, ["a", "b"], {"a": 0.2, "b": 0.8})).orderBy("cell").collect()]
    rate, present = np.ones(3), tokens @ post
    for _ in range(mixing.STEPS):
        rate = np.maximum(0, rate - post @ (((tokens * rate) @ post - goal * tokens.sum()) / present))
    assert got == pytest.approx(rate, rel=1e-6)
