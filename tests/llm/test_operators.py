"""Each operator against a plain version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import components, embedding_dedup, exact_dedup, language_id, mixing, pii, sentencepiece_nbest, simhash, suffix_dedup, token_counts, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, h string, id string, _t string"
BPE, SPM = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(5)
    words = ["the", "of", "Thing", "and", "Über", "naïve", "x1", "12", "…", "日本語", "don't"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    shared = " ".join(rng.choice(words) for _ in range(70))
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [
        None, "", "", " ", "\n\n", "a", "a", "12 34", *prose, prose[0], prose[0], prose[1] + " tail", shared, "pre " + shared,
        shared + " post", long, "  two  spaces \n and\tlines \r\n", "<|endoftext|> in text", "\x00nul\x00", "To To To " * 100,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "h", "i", "t") for i, t in enumerate(texts)]
    rows += [rows[10], (None, "null id", None, None, None, None, None, None), (10, "other text, same id", "de", None, 1, None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def multiset(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_token_counts(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    want = Counter((i, len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 512) for i, t in pairs(docs))
    cache = f"file://{tmp_path}/cache"
    got = token_counts.token_counts(docs, BPE, cache_path=cache)
    assert multiset(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t for _, t in pairs(docs)})
    again = token_counts.token_counts(docs, BPE, cache_path=cache)  # nothing is encoded twice
    assert multiset(again, "doc_id", "n_bytes", "n_tokens", "over_limit") == want and spark.read.parquet(cache).count() == stored
    assert token_counts.token_counts(empty, BPE).count() == 0


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        yield len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("most,shard", [(1024, 1 << 17), (3, 600)])
def test_suffix_dedup(docs, empty, most, shard):
    rows = [(i, t.encode()) for i, t in pairs(docs) if len(t) < 20_000]
    small = docs.where("text IS NULL OR length(text) < 20000")
    want = Counter((i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows], 100), strict=True))
    got = suffix_dedup.suffix_dedup(small, length=100, gram=32, most_fragments=most, shard_bytes=shard, with_kept=most == 3)
    assert multiset(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    if most == 3:
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())
        assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        d = rng.integers(97, 100, rng.integers(1, 300)).astype(np.uint8)
        order, _ = suffix_dedup.suffix_array(d, 40)
        b = bytes(d)
        assert [b[i : i + 40] for i in order] == sorted(b[i : i + 40] for i in range(len(b)))
        shared = suffix_dedup.common_prefixes(d, order, 40)
        for k in range(1, len(order)):
            x, y = b[order[k - 1] :][:40], b[order[k] :][:40]
            assert shared[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905


def test_language_id(spark, empty):
    rng = random.Random(2)
    words = {"en": "the and thing with from".split(), "de": "der und nicht für schön".split(), "fr": "le que été pour dans".split(), "es": "el que niño para año".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k, None, 1, None, None, None) for i in range(400) for k in [list(words)[i % 4]]]
    rows += [(1000, None, "en", *[None] * 5), (1001, "123 !!", None, *[None] * 5), (None, "the thing", None, *[None] * 5)]
    df = spark.createDataFrame(rows, DOC)
    got = language_id.language_id(df).collect()
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(got) == len(rows) and held and all(r.lang_pred == rows[r.doc_id][2] and 0.5 < r.score <= 1 for r in held)
    assert by[1000].lang_pred == by[1001].lang_pred == "und" and by[1001].score == 0 and by[None].lang_pred == "en" and not by[None].held_out
    kept = language_id.known_language_documents(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 2
    assert language_id.language_id(empty).count() == 0
    assert language_id.language_id(df.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(n, linked):
    label = list(range(n))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, empty):
    rows = pairs(docs)
    fp = [plain_fingerprint(t) for _, t in rows]
    part = plain_components(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    least = {}
    for p, (i, _) in zip(part, rows, strict=True):
        least[p] = min((x for x in (least.get(p), i) if x is not None), default=None)
    want = Counter((i, f"{f:016x}", least[p]) for (i, _), f, p in zip(rows, fp, part, strict=True))
    assert multiset(simhash.simhash(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(part))
    assert simhash.simhash(empty).count() == 0 and simhash.distinct_documents(empty).count() == 0


@pytest.mark.parametrize("blocks,most", [(4, 512), (4, 4), (6, 512)])
def test_near_pairs_join_all_links(spark, blocks, most):
    rng = random.Random(blocks + most)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (1 << 64) - 1 for b in base for _ in range(6)} | {0, (1 << 64) - 1})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), blocks=blocks, most=most).collect()
    at = {v: i for i, v in enumerate(signed)}
    links = {(max(at[r.u], at[r.v]), min(at[r.u], at[r.v])) for r in got}
    assert all((values[i] ^ values[j]).bit_count() <= 3 for i, j in links)
    assert plain_components(len(values), lambda i, j: (i, j) in links) == plain_components(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (-5, 40)]
    got, _ = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {-5: -5, **dict.fromkeys(range(41), -5), 100: 100, 200: 100}


def test_segmentations(docs, empty):
    lattice = sentencepiece_nbest.Lattice(open(SPM, "rb").read())
    rng = random.Random(1)

    def every(s, i=0, score=0):
        if i == len(s):
            yield score
        for j in range(i + 1, len(s) + 1):
            p = lattice.piece.get(s[i:j])
            if p or j == i + 1:
                yield from every(s, j, score + (p[1] if p else lattice.unknown))

    for _ in range(40):
        t = "".join(rng.choice("the aon\nß▁") for _ in range(rng.randint(1, 10)))
        ids, scores = lattice.encode(t, 4)
        assert scores == sorted(every("▁" + t.replace(" ", "▁")), reverse=True)[:4]
        assert lattice.decode(ids) == t.replace("▁", " ")
        best = lattice.n_best("▁" + t.replace(" ", "▁"), 4)
        assert [s for s, _ in best] == scores and len({i for _, i in best}) == len(best)
    got = sentencepiece_nbest.segmentations(docs, SPM, n=3)
    assert got.count() == docs.count() and got.where("NOT round_trip").count() == 0
    assert got.where("best_score <> nbest_scores[0]").count() == 0
    assert sentencepiece_nbest.segmentations(empty, SPM).count() == 0


def labelled(spark, n=600):
    rng = random.Random(3)
    clean, rude = "plain words about garden weather music travel".split(), ["idiot", "worthless"]
    rows, labels = [], []
    for i in range(n):
        toxic, low = i % 5 == 0, i % 3 == 0
        w = [rng.choice(clean) for _ in range(40)]
        if toxic:
            for k in (3, 9, 17):
                w[k] = rng.choice(rude)
        rows.append((i, " ".join(w).upper() + "!!" * 30 if low else " ".join(w), None, None, 1, None, None, None))
        labels.append((i, int(not low), int(toxic)))
    rows += [(9000, None, *[None] * 6), (9001, "", *[None] * 6), (None, "you idoit and wortless person, an idiiot, idiott", *[None] * 6)]
    labels += [(None, 1, 1), (1, None, None)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    df, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 600]
    assert len(got) == 603 and held and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert got[9000].score == got[9001].score < 0.7 and got[None].score > got[9001].score
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(df, labels.limit(0)).where("score <> 0").count() == 0


def distance(a, b):
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y)))
        old = new
    return old[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = ["moron", "idiot", "pathetic", "disgusting", "bad", "stem*"]
    automaton = toxicity.Automaton(terms)
    words = terms[:5] + ["".join(rng.sample("idotmrnpahecsgu", rng.randint(2, 10))) for _ in range(100)]
    for t in terms[:5]:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(w)) if w else 0
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "o", "ti"])
            words.append("".join(w))
    for w in words:
        want = {(k, d) for k, t in enumerate(terms[:5]) if w and (d := distance(w, t)) <= toxicity.errors_allowed(t)}
        assert {x for x in automaton.match(w) if x[0] < 5} == want, w
    assert automaton.match("stemming") == [(5, 0)] and automaton.match("ste") == []


def test_quotation_is_told_from_abuse():
    text = 'she said "you idiot" and left'
    words = toxicity.WORD.findall(text)
    assert toxicity.quotation(text, words, [3]) == [True] and toxicity.quotation(text.replace('"', ""), words, [3]) == [False]


def test_mixing(spark, empty):
    df, labels = labelled(spark)
    targets = {"quality1_toxic0": 0.6, "quality0_toxic0": 0.2, "quality1_toxic1": 0.1, "quality0_toxic1": 0.1}
    got = mixing.mixing_rates(df, labels, targets).collect()
    p = np.array([r.posteriors for r in got])
    n, rate = np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    names = sorted(targets)
    assert len(got) == 603 and (rate >= 0).all()
    assert np.abs((n * rate) @ p / n.sum() - [targets[k] for k in names]).max() < 0.01
    assert all(abs(r.copies - r.rate) <= 1 for r in got)
    mixed = mixing.mixed_documents(df, labels, targets)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mixing_rates(empty, labels, targets).count() == 0 and mixing.mixed_documents(empty, labels, targets).count() == 0
    assert mixing.mixing_rates(df, labels.limit(0), targets).where("rate <> 1 OR domain IS NOT NULL").count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, empty, keep):
    rows = pairs(docs)
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    pick = {t: (max if keep == "largest" else min)((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = Counter((i, pick[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = exact_dedup.exact_dedup(docs, keep=keep)
    assert multiset(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = got.where("kept")
    assert kept.count() == len(groups) == kept.select("text_sha256").distinct().count()
    whole = exact_dedup.kept_documents(docs, keep=keep)
    assert whole.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in whole.collect()) == Counter((i, t) for t, i in pick.items())
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.kept_documents(empty).count() == 0


def test_exact_dedup_of_a_frequent_text(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    got = exact_dedup.exact_dedup(df, keep="largest")
    assert [tuple(r)[:3] for r in got.where("kept AND group_size > 1").collect()] == [(398, 398, 200)]
    assert got.where("kept").count() == 201 == exact_dedup.kept_documents(df).count()


@pytest.mark.parametrize("most", [2048, 16])
def test_embedding_dedup(spark, most):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 24))
    x = [c + rng.standard_normal(24) * 0.08 for c in centres for _ in range(rng.integers(1, 5))]
    x += [centres[0] + rng.standard_normal(24) * 0.05 for _ in range(40)] + [x[0], x[0] * 2]
    rows = [(i, v.astype(np.float32).tolist(), i % 2 if i < 60 else 0) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, rows[0][1], None), (904, rows[0][1][:8], 0), (905, [1.0, None], 0), (906, [], 0), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("w", F.lit("clash"))
    ok = [r[1] is not None and len(r[1]) > 2 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) and r[2] is not None for r in rows]

    def linked(i, j):
        if not (ok[i] and ok[j]) or rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98

    n = len(rows)
    part = plain_components(n, linked)
    least = {p: min(rows[i][0] for i in range(n) if part[i] == p) for p in set(part)}
    links = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
    got = embedding_dedup.embedding_dedup(df, most_in_cell=most, tables=12, probes=4)
    want = Counter((rows[i][0], links[i], least[part[i]], rows[i][0] == least[part[i]]) for i in range(n))
    assert multiset(got, "vec_id", "n_links", "component_id", "kept") == want
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_e8_is_nearest():
    x = np.random.default_rng(1).standard_normal((200, 8)) * 2
    near = embedding_dedup.e8(x)
    around = near[:, None] + embedding_dedup._roots()[None]
    assert (((x - near) ** 2).sum(1)[:, None] <= ((x[:, None] - around) ** 2).sum(2) + 1e-9).all()


def test_pii(spark, docs, empty):
    texts = [
        "mail a.b@c.example.com, ip 1.2.3.4 or 1.2.3.999 x@y", "card 4111 1111 1111 1111 and 4111111111111112", "call +1 (988) 555-2485 now +12 34",
        "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "+1 (269) 555-3296 4524132264652876", "12-3", None, "٣٤@x.y ü@ö.de q@r.s",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    model = pii.fit([t for t in texts if t], 2)
    for r in pii.pii(df, model=model).join(df.select(F.col("doc_id").alias("d"), "text"), F.expr("doc_id <=> d")).where("doc_id < 9 AND text IS NOT NULL").collect():
        text = r.text or ""
        if text not in texts:
            continue
        row = [x for x in pii.pii(df.where(F.col("text") == text), model=model).collect()][0]
        found = []
        for k, p in zip(pii.KINDS, (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE), strict=True):
            for m in p.finditer(text):
                d = re.sub("[^0-9]", "", m.group())
                if (k == "email") or (k == "ip" and all(int(x) < 256 for x in m.group().split("."))) or (k == "card" and 13 <= len(d) <= 19 and pii.luhn(d)) or (k == "phone" and 9 <= len(d) <= 15):
                    found.append(f"{k}:{m.start()}:{m.end()}")
        assert row.base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest(), text
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(f.startswith(k) for f in found) for k in pii.KINDS]
        assert set(found) <= set(row.spans.split(",")) | {""}
    assert pii.pii(empty).count() == 0


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(6)
    for letters in ("ab@.-_ 1", "1234.+ -()", "0123456789 -", "a@.1 +\n(ü"):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            want = []
            for k, p in zip(pii.KINDS, (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE), strict=True):
                for m in p.finditer(text):
                    d = re.sub("[^0-9]", "", m.group())
                    if k == "email" or (k == "ip" and all(int(x) < 256 for x in m.group().split("."))) or (k == "card" and 13 <= len(d) <= 19 and pii.luhn(d)) or (k == "phone" and 9 <= len(d) <= 15):
                        want.append((k, m.start(), m.end()))
            assert pii.base_spans(text) == want, text
    for text in ("a" * 300_000 + " @", "1" * 300_000, "+" * 300_000, "a@" * 100_000):  # linear time
        assert pii.base_spans(text) == []


def test_pii_adds_what_patterns_miss():
    seen = [f"text {i} call +1 (98{i % 10}) 555-24{i:02d} or mail ab{i}.x@mail{i}.example.com, host 10.{i}.3.4 end" for i in range(40)]
    model = pii.fit(seen, 3)
    text = "please call 1-981-555-2417 today"
    assert ("phone", 12, 26) in pii.added_spans(model, text, pii.base_spans(text))
    assert pii.added_spans(model, "in 1999 we had 12 of 2.0", []) == []
