"""The ten operators against brute force on small tables with nulls, empties, long texts, ties and repeats."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.llm import _common as C
from terrasift.llm import curriculum, decontaminate, language_id, license_scan, line_dedup, near_dedup, pii, token_ids, topk, viterbi_count
from terrasift.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, label string, node string"


def vocabulary(lang):
    r = random.Random(lang)
    syllables = {"en": "th er on an ing ed", "de": "sch ein ung der ich tz"}[lang].split()
    return ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(150)]


def made(seed=0, n=60):
    r = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        lang = r.choice(("en", "de"))
        words = [r.choice(vocabulary(lang)) for _ in range(r.randint(1, 120))]
        if texts and r.random() < 0.4:
            text, lang = r.choice(texts)
            words = text.split(" ")
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(("x", "Mail a.b@c.de", "+1 (454) 555-9913", "MIT License\n", "1.2.3.4"))
        text = " ".join(words)
        texts.append((text, lang))
        rows.append((i, text, lang, r.choice(("a", "a", "a", "b", None))))
    rows += [(n, None, "en", "b"), (n + 1, "", "en", "c"), (n + 2, " \n\t ", None, None), (n + 3, "one", "en", "a"), (n + 4, "One", "en", "a")]
    rows += [(n + 5, "a shared line of text\n" * 3 + "the end", "en", "b"), (n + 6, " A Shared line of text \nmore", "en", "b"), (None, "a shared line of text", "de", "b")]
    rows += [(n + 7, ("wort " * 30_000) + "licensed under cc by nc 4.0", "de", "long"), rows[3], rows[3]]
    return [(d, t, lang, s, len(t or ""), "x", "y", "z") for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def key(r):
    return tuple((x is not None, x) for x in r)


def same(found, expected):
    assert sorted(map(key, found)) == sorted(map(key, expected))


def test_token_ids(spark, docs, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out = token_ids.token_output(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    ids = {t: tk.encode(t or "", add_special_tokens=False).ids + [0] for t in {r[1] for r in rows}}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, expected = 0, []
    for r in ordered:
        x = ids[r[1]]
        expected.append((r[0], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    same([tuple(r) for r in out], expected)


def test_token_ids_added_tokens_and_positions(spark):
    """As the library does by default, its added token in a text is one id; positions come back with their documents."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ["start <|endoftext|> end", "<|endoftext|>", "a<|endoftext|>b  c", "plain  text " + "x" * 500 + " end", "x" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sorted(token_ids.token_output(docs, tokenizer_path("byte_bpe_50k.json"), position=10 - F.col("doc_id")).collect())
    for (d, t), got in zip(enumerate(texts), out, strict=True):
        x = [*tk.encode(t, add_special_tokens=False).ids, 0]
        assert got[0] == d and got[2:] == (len(x), zlib.crc32(np.array(x, "<u4").tobytes()), 10 - d)
    assert out[0].n_tokens == 5


def test_long_words_are_not_remembered():
    encoder = token_ids.Encoder(tokenizer_path("byte_bpe_50k.json"))
    encoder.encode([f"{'y' * 200}{i} a {'z' * 300}{i}, b" for i in range(50)], 0)
    assert max(map(len, [*encoder.after, *encoder.known])) <= token_ids.LONGEST + 1


def test_row_order_is_the_order_written(spark, tmp_path):
    spark.range(1000).withColumn("k", F.xxhash64("id")).orderBy("k").write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    got = [r.k for r in read.withColumn("at", token_ids.row_order(read)).orderBy("at").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert spark.range(1).select(token_ids.row_order(spark.range(1)).alias("at")).first().at is None


def test_token_ids_empty(empty):
    assert token_ids.token_output(empty, tokenizer_path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("sizes", [[], [0], [1], [0, 0, 5, 0], [3] * 1000, [1, 10_000, 0, 7] * 50, [100_000]])
def test_elias_fano(sizes):
    ends = np.cumsum(sizes, dtype=np.int64)
    documents = [np.arange(n, dtype="<u2").tobytes() for n in sizes]
    ef, ids = token_ids.read_block(token_ids.write_block(documents, 2))
    assert ef.decode().tolist() == ends.tolist()
    assert [ef.select(i) for i in range(len(sizes))] == ends.tolist()
    assert len(ids) == sum(sizes)
    if sizes:
        assert (len(ef.low) + len(ef.high)) * 8 <= len(sizes) * (2 + np.log2(max(2, ends[-1] / len(sizes)))) + 32


def test_language_id(docs, rows, empty):
    train = F.coalesce(F.col("doc_id") % 4 != 2, F.lit(False))
    model = language_id.fit(docs, train)
    out = {r.doc_id: r for r in language_id.predict(docs, model, F.col("doc_id") % 4 == 2).collect()}
    held = [(out[r[0]].lang_pred, r[2]) for r in rows if r[0] is not None and r[0] % 4 == 2 and r[1] and len(r[1]) > 100]
    assert len(held) > 5
    assert np.mean([a == b for a, b in held]) > 0.9
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (60, 61, 62))
    assert all(0 <= r.score <= 1 for r in out.values())
    p = np.exp2(-model.bits.astype(float))
    seen = model.n_symbols - 1
    assert np.allclose(p[:, :seen].sum(axis=1) + p[:, seen] * (256 - seen), 1)
    kept = {r.doc_id for r in language_id.identified(docs, model).select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {60, 61, 62}
    none = language_id.fit(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.predict(docs, none, F.lit(False)).collect()} == {"und"}
    assert language_id.predict(empty, model, F.lit(False)).collect() == []


def test_language_id_sample_counts_copies_once(spark):
    """Copies of the text whose hash comes first take one place of the sample."""
    texts = [f"text {'abcdefghijklmnopqrstuvwxyz'[k]} of the sample" for k in range(12)]
    ordered = [r.text for r in spark.createDataFrame([(t,) for t in texts], "text string").orderBy(F.xxhash64("text")).collect()]
    docs = spark.createDataFrame([("en", t) for t in texts + [ordered[0]] * 30], "lang string, text string")
    assert language_id.training_rows(docs, F.lit(True), per_language=5) == sorted(("en", t) for t in ordered[:5])


def test_language_id_learns_a_language_of_long_texts_only(spark):
    """No length and no number of languages keeps one out; a long text is learnt whole."""
    rows = [(f"l{i:03d}", f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 9) for i in range(300)] + [("long", "lang text " * 5000), ("long", "lang text " * 4000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    sample = language_id.training_rows(docs, F.lit(True), per_language=2, max_bytes=1000)
    assert {x for x, _ in sample} == {x for x, _ in rows}
    assert [len(t) for x, t in sample if x == "long"] == [40_000]


def test_code_length_is_exact(rows):
    """The automaton against a walk through the counts, context by context."""
    model = language_id.Model([(r[2], r[1]) for r in rows if r[2] and r[1] and len(r[1]) < 2000])
    counts = [model._counts([r[1].encode() for r in rows if r[2] == name and r[1] and len(r[1]) < 2000]) for name in model.languages]

    def probability(c, context, byte, banned):
        at = c.get(context)
        if at is None:
            return probability(c, context[1:], byte, banned)
        free = {b: k for b, k in at.items() if b not in banned}
        total, kinds = sum(at.values()), len(at)
        if context == b"":
            base = {b: (at[b] / (total + kinds) if b in at else kinds / (total + kinds) / max(1, 256 - kinds)) for b in range(256)}
            return base[byte] / sum(v for b, v in base.items() if b not in banned)
        full = {b: k / (total + kinds) for b, k in free.items()}
        escape = kinds / (total + kinds)
        scale = sum(full.values()) + escape
        if byte in full:
            return full[byte] / scale
        return escape / scale * probability(c, context[1:], byte, banned | set(at))

    text = "therings unx sch"
    for k, c in enumerate(counts):
        raw = text.encode()
        bits = -sum(np.log2(probability(c, raw[max(0, i - model.order) : i], raw[i], set())) for i in range(len(raw)))
        data = np.frombuffer(raw, np.uint8)
        assert model.code_lengths(data, np.array([0, len(raw)]))[0, k] == pytest.approx(bits, rel=1e-3)


def test_stretches_add_up(rows):
    model = language_id.Model([(r[2], r[1]) for r in rows if r[2] and r[1] and len(r[1]) < 2000])
    text = " ".join(r[1] for r in rows[:40] if r[1]).encode()
    data = np.frombuffer(text, np.uint8)
    whole = model.code_lengths(data, np.array([0, len(text)]))[0]
    state, bits = 0, np.zeros(len(whole))
    for b in text:
        bits += model.bits[state, model.symbol[b]]
        state = model.next[state, model.symbol[b]]
    assert whole == pytest.approx(bits, rel=1e-6)


def fill(sizes, weights, share, most):
    """Targets by repeated sharing."""
    total, capped = share * sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        target = [most * s if i in capped else rest * weights[i] / weight for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(target) if i not in capped and t > most * sizes[i]}
        if not over:
            return target
        capped |= over
        if len(capped) == len(sizes):
            return [most * s for s in sizes]


def test_curriculum(docs, rows, empty):
    out = curriculum.curriculum_mix(docs).collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in curriculum.curriculum_mix(docs.repartition(3)).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in names]
    target = dict(zip(names, fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2), strict=True))
    same([(r.doc_id, r.size) for r in out], [(r[0], size(r[1])) for r in rows])
    for s in names:
        mine = [r for r in out if r.source == s]
        assert all(r.target == pytest.approx(target[s]) and r.source_size == sum(x.size for x in mine) for r in mine)
        assert sum(r.taken for r in mine) == round(target[s])
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    at = [r.position for r in out if r.position is not None]
    assert at == sorted(at)
    assert all(0 <= p.position < 1 for r in out for p in r.placements)
    assert curriculum.curriculum_mix(empty).collect() == []
    mixed = curriculum.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() > 0


def test_curriculum_follows_its_schedule(spark):
    """Words due by time t follow the integral of the schedule."""
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w w w").alias("text"), F.lit("s").alias("source"))
    out = curriculum.curriculum_mix(many, ramps=(0.5,), share=1.0).collect()
    for t in (0.25, 0.5, 0.75):
        due = sum(r.taken for r in out if r.position <= t) / (5 * 4000)
        assert due == pytest.approx(t + 0.5 * (t - t * t), abs=0.01)


def test_curriculum_places_each_document_as_often_as_it_is_taken(spark, docs, rows):
    mix = curriculum.curriculum_mix(docs).collect()
    wanted = Counter()
    for r in mix:
        wanted[r.doc_id] += sum(2 * p.words >= r.size for p in r.placements)
    mixed = curriculum.mixed_documents(docs).collect()
    assert Counter(r.doc_id for r in mixed) == +wanted
    at = sorted((p.position, r.doc_id) for r in mix for p in r.placements if 2 * p.words >= r.size)
    assert [r.doc_id for r in mixed] == [d for _, d in at]


CLASH = "row d s t h d2 s2 t2 p q a b x y node label letter mark lines gone kept pos key line text_hash doc n size rows position positions placements taken target bucket shard ids rid low comp group h1 h2 holder".split()


def test_columns_of_any_name_travel_along(spark, rows):
    """Each operator that returns its input's columns, with a column of each name used inside."""
    docs = spark.createDataFrame(rows, SCHEMA).drop("label", "node")
    wide = docs.select("*", *[F.lit(f"c-{c}").alias(c) for c in CLASH])
    train = F.coalesce(F.col("doc_id") % 4 != 2, F.lit(False))
    item = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    for f in (
        lambda x: language_id.identified(x, language_id.fit(x, train)),
        near_dedup.keep_one,
        lambda x: decontaminate.decontaminated(x, item),
        curriculum.mixed_documents,
        line_dedup.drop_repeated_lines,
    ):
        got = f(wide)
        assert got.columns == wide.columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r.doc_id, r.text) for r in f(docs).collect())
        assert all(r[c] == f"c-{c}" for r in got.limit(3).collect() for c in CLASH)


def test_viterbi(docs, rows, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokenizer_path("piece_bpe_32k.model")
    tk = Tokenizer(models.Unigram(viterbi_count.unigram_vocabulary(path), unk_id=0))
    tk.pre_tokenizer = pre_tokenizers.Metaspace()
    out = viterbi_count.piece_counts(docs, path).collect()
    text = {r[0]: r[1] for r in rows}
    assert all(r.n_pieces == len(tk.encode(text[r.doc_id] or "", add_special_tokens=False).ids) for r in out)
    assert viterbi_count.piece_counts(empty, path).collect() == []
    r, counter = random.Random(4), viterbi_count.counter_of(path)
    for n in (3, 20, 300):
        for _ in range(40):
            t = "".join(r.choice("aeit hnr\n😀日é▁") for _ in range(n))
            words = viterbi_count.words_of(t)
            assert sum(map(counter.count_words(words).get, words)) == len(tk.encode(t, add_special_tokens=False).ids)
    tied = viterbi_count.Counter([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("▁a", -2.0)])
    small = Tokenizer(models.Unigram([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("▁a", -2.0)], unk_id=0))
    for t in ("ab", "aabb", "abxyab", "ba"):
        assert tied.count([("▁" + t).encode()])[0] == len(small.encode("▁" + t).ids) == tied.count_long(("▁" + t).encode())


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def base_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            g = m.group()
            d = re.sub("[^0-9]", "", g)
            ok = (True, k == 1 and all(int(x) <= 255 for x in g.split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(docs, rows, empty):
    out = pii.personal_data(docs).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in out:
        spans = base_spans(text[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        n = Counter(k for _, k, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n[0], n[1], n[2], n[3])
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert pii.personal_data(empty).collect() == []


def test_personal_data_rules_on_noise():
    r = random.Random(8)
    for _ in range(4000):
        t = "".join(r.choice("a1.@ -+(0)9_é\n25") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == base_spans(t)


def test_semi_markov_decoding_is_the_best_segmentation():
    crf = pii.model()

    def every(lattice, at=0):
        if at == lattice.n:
            yield 0.0
        for (i, j, *_), s in ((x, crf._score(x)) for x in lattice):
            if i == at:
                yield from (s + rest for rest in every(lattice, j))

    lattice = pii.Lattice("(454) 555-9913", 0, 14)
    got = crf.decode(lattice)
    assert got == [(0, 3, 14)]
    scores = {x[:3]: crf._score(x) for x in lattice}
    assert scores[0, lattice.n, 3] == pytest.approx(max(every(lattice)))


def test_semi_markov_held_out():
    crf, right, found, there = pii.model(), 0, 0, 0
    for t, spans in pii.training_set(200, seed=77):
        got = {s for a, b in pii.stretches(t) for s in crf.decode(pii.Lattice(t, a, b))}
        right, found, there = right + len(got & set(spans)), found + len(got), there + len(spans)
    assert right / found > 0.95
    assert right / there > 0.9


def test_personal_data_spelt_out_at_sign_without_digits():
    crf = pii.model()
    found = lambda t: [t[a:b] for a, k, b in pii.all_spans(t, crf) if k == 0]
    assert found("write to john (at) example.org") == ["john (at) example.org"]
    assert found("a.b[at]mail.de") == ["a.b[at]mail.de"]
    assert found("write to joe at example.org now") == ["joe at example.org"]
    assert found("joe[at]example[dot]org, and anna (at) mail.de") == ["joe[at]example[dot]org", "anna (at) mail.de"]
    assert [pii.stretches(t) for t in ("look at the page.", "at home. Then at", "flat) [a t] (a)")] == [[], [], []]
    seen = [(t[x:y], any(a <= x and y <= b for a, b in pii.stretches(t))) for t, spans in pii.training_set() for x, _, y in spans]
    assert [s for s, inside in seen if not inside] == []


def leaked(docs, items):
    def sets(t, n=None):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        n = n or min(5, len(w))
        return n, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    out = []
    for d, t in docs:
        for i, x in items:
            n, own = sets(x)
            if own:
                both = len(own & sets(t, n)[1])
                if both >= 0.75 * len(own):
                    out.append((d, i, both, len(own), both / len(own)))
    return out


def test_leaks(spark, docs, rows, empty):
    r = random.Random(6)
    long = [t for _, t, *_ in rows if t and len(t.split()) > 60]
    items = [(i, " ".join(r.choice(long).split()[3 : 3 + n])) for i, n in enumerate((5, 6, 9, 14, 20, 33, 50, 14, 14))]
    items += [(90, "one"), (91, "two words"), (92, None), (93, ""), (94, "nothing like it is anywhere in these documents"), (0, items[0][1])]
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    expected = leaked([(x[0], x[1]) for x in rows], items)
    assert len(expected) > 10
    for mb in (32, 1e-4):
        same([tuple(x) for x in decontaminate.leaks(docs, benchmark, block_mb=mb).collect()], expected)
    clean = decontaminate.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns
    gone = {d for d, *_ in expected}
    assert Counter(x.doc_id for x in clean.collect()) == Counter(x[0] for x in rows if x[0] not in gone)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).collect() == []
    assert decontaminate.decontaminated(docs, none).count() == len(rows)
    assert decontaminate.leaks(empty, benchmark).collect() == []


def test_license_base(docs, rows, empty):
    out = license_scan.license_scan(docs).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows)
    for r in out:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text[r.doc_id]))
        places, labels = [], set()
        for p, label in license_scan.BASE.items():
            p = p.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels))
        assert labels <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert license_scan.license_scan(empty).collect() == []


def test_license_labels(spark):
    texts = {
        0: "x y Released under the MIT License. z",
        1: "Licensed under CC BY-NC 4.0.",
        2: "Redistribution and use in source and binary forms, with or without\n modification, are permitted provided",
        3: "permission is hereby granted",
        4: "the mozilla public license",
        5: "This work is licensed under the GNU General Public License, version 3.",
        6: "mit mit license license apache license version 2",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert [out[i].labels for i in range(7)] == ["mit", "cc-by-nc", "bsd", "", "mpl", "gpl", "apache,mit"]
    assert out[1].score == pytest.approx(1.0)
    assert 0 < out[2].score < 1
    assert out[6].n_base == 2


def test_license_labels_of_a_file_with_every_template(spark):
    """No licence of a file takes another's place, whatever the words' document frequencies are."""
    parts = [t for _, t, _ in license_scan.TEMPLATES]
    keys = [k for _, _, k in license_scan.TEMPLATES]
    apart = [(100 + i, t) for i, t in enumerate(parts)] + [(200 + i, k) for i, k in enumerate(keys)]
    common = [(1000 + i, "a and any are the this of license software") for i in range(300)]
    expected = {100 + i: label for i, (label, _, _) in enumerate(license_scan.TEMPLATES)}
    every = ",".join(sorted(set(expected.values())))
    notice = [(0, ". x ".join(parts)), (1, ". x ".join(keys)), (2, parts[0] + ". x " + parts[8] + ". x " + parts[9])]
    for more in ([], common):
        out = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(notice + apart + more, "doc_id long, text string")).collect()}
        assert out[0].labels == out[1].labels == every
        assert out[2].labels == "bsd,mit,mpl"
        assert all(label in out[i].labels.split(",") and label in out[i + 100].labels.split(",") for i, label in expected.items())
    assert {r.labels for r in license_scan.license_scan(spark.createDataFrame([(0, "a b c d")], "doc_id long, text string"), [("x", "a b c", "b")]).collect()} == {"x"}


def test_topk(spark):
    r = np.random.default_rng(3)
    v = [(i, [float(x) for x in np.round(r.normal(size=8), 1)]) for i in range(400)]
    v += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0] * 3), (420, [2.0] * 3), (None, [1.0] * 8), (405, []), (20, v[20][1])]
    frame = spark.createDataFrame([(a, b, 7) for a, b in v], "vec_id long, embedding array<float>, rank int").repartition(4)
    whole = [(a, np.floor(64 * np.array(b, np.float32).astype(float)).astype(int)) for a, b in v if a is not None and b is not None and None not in b and np.isfinite(b).all()]
    expected = []
    for q in {a for a, _ in whole if a % 20 == 0}:
        own = next(b for a, b in whole if a == q)
        scores = sorted((-int(own @ b), a) for a, b in whole if a != q and len(b) == len(own))
        expected += [(q, k + 1, a, -s) for k, (s, a) in enumerate(scores[:20])]
    for shard, block in ((10_000, 10_000), (70, 6)):
        got = topk.exact_topk(frame, F.col("vec_id") % 20 == 0, shard=shard, block=block).collect()
        same([tuple(x) for x in got], expected)
    assert topk.exact_topk(frame.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_threshold_stops_early():
    """On lists where few vectors matter most candidates are never scored."""
    r = np.random.default_rng(1)
    values = r.integers(-3, 3, size=(5000, 6)).astype(float)
    values[:30] += 50
    queries = np.ones((4, 6))
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, k):
            out = super().__getitem__(k)
            if isinstance(k, np.ndarray) and k.dtype != bool:
                seen.append(len(k))
            return out

    names = np.arange(5000)
    row, name, score = topk.threshold_topk(names, values.view(Watched), np.full(4, -1), queries, 20)
    assert sum(seen) < 5000
    best = sorted(zip(-values.sum(axis=1), names, strict=True))[:20]
    assert [(s, n) for s, n in zip(-score[row == 0], name[row == 0], strict=True)] == [(float(s), n) for s, n in best]


def test_line_dedup(docs, rows, empty):
    holders = {}
    space = " \t\n\x0b\x0c\r"
    last = 1 << 62
    key_of = lambda x: lowered(x.strip(space))
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key_of(x), set()).add(last if d is None else d)
    expected, texts = [], []
    for d, t, *_ in rows:
        every = (t or "").split("\n")
        stay = [x for x in every if len(key_of(x)) < 10 or len(h := holders[key_of(x)]) < 2 or min(h) == (last if d is None else d)]
        expected.append((d, len(every), len(every) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
        texts.append((d, None if t is None else "\n".join(stay)))
    assert sum(e[2] for e in expected) > 2
    same([tuple(r) for r in line_dedup.line_report(docs).collect()], expected)
    done = line_dedup.drop_repeated_lines(docs)
    assert done.columns == docs.columns
    same([(r.doc_id, r.text) for r in done.collect()], texts)
    assert line_dedup.line_report(empty).collect() == []


def components(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, r in zip(label, rows, strict=True):
        if r[0] is not None:
            least[x] = min(r[0], least.get(x, 1 << 62))
    return [(r[0], len(s), least.get(x), r[0] == least.get(x)) for r, s, x in zip(rows, sets, label, strict=True)]


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 3])
def test_near_dedup(docs, rows, block):
    expected = components(rows)
    assert sum(not e[3] for e in expected) > 5
    same([tuple(r) for r in near_dedup.near_duplicates(docs, block=block).collect()], expected)


def test_near_dedup_chain_in_blocks(spark):
    """A chain of small edits is one component, though its ends have little in common, also when dealt to many blocks."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = words[2:] + [f"n{i}a", f"n{i}b"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (7, 4000):
        assert {r.component_id for r in near_dedup.near_duplicates(docs, block=block).collect()} == {0}


def test_near_dedup_links_beyond_the_distance_that_sharing_a_key_needs(spark):
    """Six of eight shingles in common, 25 to 27 of 48 positions apart, and a key in common."""
    rows = []
    for k, text in enumerate((
        "128479 427141 454307 455006 633122 330944 98697 725741 490918 233414 597268 410868",
        "133731 543462 613370 819000 412040 510574 539809 343891 150816 916920 357617 271682",
        "641929 33817 441867 984027 80689 605524 130225 161128 141443 48588 895448 758385",
    )):
        words = text.split()
        rows += [(10 * k, " ".join(words[:-1])), (10 * k + 1, " ".join(words[1:]))]
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {d: d // 10 * 10 for d, _ in rows}
    assert sum(math.comb(48, k) * 0.25**k * 0.75 ** (48 - k) for k in range(near_dedup.ADMITTED + 1, 49)) < 1e-8


def test_near_dedup_keeps_one(docs, rows, empty):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    expected = {e[0] for e in components(rows) if e[3]}
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x)) == sorted(expected, key=lambda x: (x is not None, x))
    assert near_dedup.near_duplicates(empty).collect() == []


def test_near_dedup_keeps_rows_that_link_with_nothing(spark):
    text = "one two three four five six seven"
    rows = [(None, None), (None, None), (None, ""), (None, " "), (5, text), (5, text), (5, "other words stand here in this row"), (6, text), (None, text), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = [(None, None), (None, None), (None, ""), (None, " "), (5, text), (5, "other words stand here in this row"), (7, None)]
    same([tuple(r) for r in near_dedup.keep_one(docs).collect()], expected)


def test_near_dedup_deals_whole_rows_once(spark):
    """Where no row repeats another, the texts that stay pass one shuffle."""
    text = "one two three four five six seven"
    rows = [(None, None), (1, text), (2, text), (2, "other words stand here in this row"), (None, text), (3, " ")]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count(" AS row#") == 1
    same([tuple(r) for r in kept.collect()], [(None, None), (1, text), (2, "other words stand here in this row"), (3, " ")])


def test_materialize_leaves_no_shuffle_files(spark):
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def left():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size())}

    before, as_set = left(), spark.conf.get(cleanup)
    made = C.materialize(spark.range(5000).repartition(3, "id").groupBy(F.col("id") % 7).count())
    for _ in range(40):
        if not (new := [x for x in left() - before if x.startswith("shuffle_")]):
            break
        time.sleep(0.1)
    assert not new
    assert spark.conf.get(cleanup) == as_set
    assert made.agg(F.sum("count")).first()[0] == 5000


def test_near_dedup_hot_group_of_near_copies(spark):
    """One group of many near copies beside documents that share a third of their words with it, in small blocks."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(words)
        copy[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(words[:20] + [f"y{i}-{k}" for k in range(30)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same([tuple(x) for x in near_dedup.near_duplicates(docs, block=20).collect()], components(rows))


def test_folded():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 400, 300), r.integers(0, 400, 300)
    nodes, label = C.folded(a, b)
    of = {int(n): int(n) for n in nodes}
    for _ in range(400):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            of[x] = of[y] = min(of[x], of[y])
    assert dict(zip(nodes.tolist(), label.tolist(), strict=True)) == of


def test_words_do_not_depend_on_segments(monkeypatch):
    text = ("Wort wort,x " * 300 + "y" * 900 + " ende").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 100, 100, 2500, len(text)])
    whole = C.words(data, offsets, C.NOT_SPACE)
    monkeypatch.setattr(C, "SEGMENT", 64)
    cut = C.words(data, offsets, C.NOT_SPACE)
    assert all(np.array_equal(x, y) for x, y in zip(whole, cut, strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 205)]
    out = {r.node: r.label for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 205: 200}
