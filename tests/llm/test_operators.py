"""The corpus operators against SQL, brute force, libraries and held-out labels, and the cases that their docstrings define."""

import fractions
import hashlib
import inspect
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from voxquarry.llm import bagminhash, exact, oracle, packing, pii, queries, secrets, sentencepieces, sharding, substring, topk, toxicity  # noqa: E402

SF = f"{compare.TESTDATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `h` string, kept string"
MODEL = queries.model("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, ""), (5, "   "), (6, long), (7, long), (8, "password = hunter22"), (None, None), (9, "x"), (9, "y")]
    return spark.createDataFrame([(i, t, None, None, None, "k", "h", "kept") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert compare.difference(spark, queries.QUERIES[name], oracle.ORACLE[name], SF) == ""


def test_all_operators_are_registered():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(i) for i in range(1, 11)]


# 1


def test_substring_odd(odd, empty):
    rows = substring.remove_repeats(odd, window=4).collect()
    assert len(rows) == odd.count() and all(r.n_words == 0 and r.kept_text == "" for r in rows if r.doc_id in (3, 4, 5))
    assert substring.remove_repeats(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[7].n_removed == 30_000 and by[2].n_removed == 6


def test_substring_names_only_what_exists():
    names = re.findall(r"`(\w+)`", substring.__doc__)
    assert names and all(hasattr(substring, n) or n in inspect.signature(substring.remove_repeats).parameters for n in names)


def kept_by_force(rows, window):
    """Kept text of each row, rows alike in doc_id and text being one document; doc_ids of different texts differ."""
    seen, kept = set(), {}
    for i, t in sorted(set(rows)):
        w = t.split()
        gone = set()
        for a in range(len(w) - window + 1):
            x = tuple(w[a : a + window])
            if x in seen:
                gone |= set(range(a, a + window))
            seen.add(x)
        kept[i, t] = " ".join(x for a, x in enumerate(w) if a not in gone)
    return sorted((i, kept[i, t]) for i, t in rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_rows_keep_their_first_passage(spark, parts):
    rng = random.Random(9)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = [own(40) for _ in range(6)]
    # passages alone, in other surroundings (runs that differ) and in part
    texts = [" ".join(own(rng.randrange(12)) + rng.choice(passage)[rng.randrange(8) :] + own(rng.randrange(12))) for _ in range(40)] + [" ".join(own(25)) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(1 + (i % 3 > 0) * 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    for window in (20, 5):
        got = sorted((r.doc_id, r.kept_text) for r in substring.remove_repeats(df, window=window).collect())
        assert got == kept_by_force(rows, window)


# 2


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_formats_and_links(spark):
    t = ["4111-1111-1111-1111 DE89 3704 0044 0532 0130 00 123-45-6789 +1 (521) 555-6210 190. 1.2.3.4. 1999-12-31 31.12.1999 12/31/1999 a.b@c.org", "again 4111-1111-1111-1111 4111-1111-1111-1112 300.1.2.3 666-12-3456 2001-02-30"]
    out = pii.pseudonymised(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    kinds = [s.kind for s in out[0].pii_spans]
    assert kinds == ["card", "iban", "ssn", "phone", "ip", "date", "date", "date", "email"]
    for s in out[0].pii_spans:
        assert t[0][s.start : s.end] == s.value and s.pseudonym != s.value
        if s.kind != "email":
            assert re.sub(r"\d+" if s.kind == "ip" else r"\d", "0", s.pseudonym) == re.sub(r"\d+" if s.kind == "ip" else r"\d", "0", s.value)
    card = out[0].pii_spans[0].pseudonym
    assert luhn(re.sub(r"\D", "", card)) and card in out[1].text and "4111-1111-1111-1112 300.1.2.3 666-12-3456 2001-02-30" in out[1].text
    iban = out[0].pii_spans[1].pseudonym.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    d = [s.pseudonym for s in out[0].pii_spans if s.kind == "date"]
    assert d[0].split("-") == d[1].split(".")[::-1] and d[2].split("/") == [d[0][5:7], d[0][8:], d[0][:4]]


def test_pii_scans_texts_with_one_short_match(spark):
    """No match depends on other numbers in its text; each pattern's short forms pass the test of a text."""
    own = ["+34 612 345 678", "+33 (6) 12 34 56 78", "+49 30 123 456", "+1 (521) 555-6210", "(521) 555-6210", "521-555-6210", "a@b.co", "ab 12"]
    own += ["1999-12-31", "31.12.1999", "12/31/1999", "123-45-6789", "1.2.3.4", "4222222222222", "4111 1111 1111 1111", "3782 822463 10005"]
    for body in ("AB1C 2D3E 4F5", "AB1C2D3E4F5"):
        digits = "".join(str(int(c, 36)) for c in body.replace(" ", "") + "MT00")
        own.append(f"MT{98 - int(digits) % 97:02d}{' ' if ' ' in body else ''}{body}")
    texts = [t for o in own for t in (f"at {o} now", f"at {o} now 2024")]
    out = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    for o, alone, more in zip(own, out[::2], out[1::2]):
        assert len(alone.pii_spans) == (o != "ab 12"), o
        if not o.startswith("+"):  # a phone may take up the digits that follow
            assert alone.pii_spans == more.pii_spans, o


def test_pii_compact_phones(spark):
    """A phone has one pseudonym however it is grouped."""
    forms = [["+15551234567", "+1 (555) 123-4567", "+1-555-123-4567"], ["+4915112345678", "+49 151 1234 5678", "+49 (151) 12345678"], ["+351912345678", "+351 912 345 678"], ["+34612345678", "+34 612 345 678"], ["+12345678"], ["+123456789012345"]]
    texts = [f"call {x}." for group in forms for x in group] + ["+1234567", "+1234567890123456", "1+15551234567"]
    out = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [len(r.pii_spans) for r in out] == [1] * (len(texts) - 3) + [0] * 3
    at = 0
    for group, code in zip(forms, ("1", "49", "351", "34", "1", "1")):
        found = [r.pii_spans[0] for r in out[at : at + len(group)]]
        at += len(group)
        assert [s.value for s in found] == group and all(s.kind == "phone" for s in found)
        new = {re.sub(r"\D", "", s.pseudonym) for s in found}
        assert len(new) == 1 and new.pop().startswith(code) and all(s.pseudonym != s.value for s in found)


def test_pii_is_a_permutation(spark):
    df = spark.range(6 * 7).select(pii.feistel(F.col("id"), F.lit(6), F.lit(7), "key", "x").alias("v"))
    assert sorted(r.v for r in df.collect()) == list(range(42))


def test_pii_odd(odd, empty):
    rows = pii.digest(odd, "k").collect()
    assert len(rows) == odd.count() and {r.text for r in rows if r.doc_id == 3} == {None}
    assert pii.pseudonymised(odd, "k").columns == [*odd.columns, "pii_spans"] and pii.digest(empty, "k").count() == 0


def test_pii_of_documents(docs):
    """Planted numbers by brute force."""
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        want[r.doc_id] += sum(luhn(m) for m in re.findall(r"(?<![^\W_])(?<!\.)\d{13,19}(?![^\W_])", t)) + len(re.findall(r"[\w.]+@mail\d+\.example\.com", t)) + len(re.findall(r"\+1 \(\d{3}\) 555-\d{4}", t))
    got = {r.doc_id: r.n_card + r.n_email + r.n_phone for r in pii.digest(docs, "k").collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


# 3


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes_by_force(rows):
    """Class id (smallest doc_id) of each (doc_id, text), by comparing all that share a shingle or a text."""
    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    held, same = defaultdict(list), defaultdict(list)
    for i, (_, t) in enumerate(rows):
        same[t or ""].append(i)
        for s in bags[i]:
            held[s].append(i)
    pairs = {(v[0], b) for v in same.values() for b in v} | {(a, b) for v in held.values() for k, a in enumerate(v) for b in v[k + 1 :] if len(v) < 60}
    for a, b in pairs:
        if (rows[a][1] or "") == (rows[b][1] or "") or sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[root(i)].append(d)
    return sorted((d, min((x for x in low[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows) if d is not None)


def test_near_classes_by_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.class_id) for r in bagminhash.classes(docs).collect())
    assert got == classes_by_force(rows)


def test_near_group_with_hub_and_strays(spark):
    """Copies with edits: some link only through others, some to none."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(120)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in bagminhash.classes(df).collect())
    bags = [bag(t) for _, t in rows]
    up = list(range(90))
    for _ in range(90):
        up = [min([up[i]] + [up[j] for j in range(90) if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())]) for i in range(90)]
    assert got == list(enumerate(up))


def test_near_group_of_many_strays(spark):
    """3000 copies with edits, few of them linked: classes by brute force, and few pairs pass the bounds."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(f"e{rng.randrange(10**6)}" if rng.random() < 0.04 else x for x in base) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in bagminhash.classes(df).collect()}
    ids: dict[str, int] = {}
    dense = np.zeros((3000, 146), bool)
    own = [bag(t) for t in texts]
    rare: dict[str, list[int]] = defaultdict(list)
    for i, b in enumerate(own):
        for x in b:
            if "e" in x:
                rare[x].append(i)
            else:
                dense[i, ids.setdefault(x, len(ids))] = True
    common = dense.astype("i4") @ dense.T.astype("i4")
    for v in rare.values():
        for i in v:
            for j in v:
                common[i, j] += 1  # every shingle is at most once in a text
    linked = common >= 0.8 * (2 * 146 - common)
    up = np.arange(3000)
    while True:
        new = np.where(linked, up[None, :], 3000).min(axis=1)
        if (new == up).all():
            break
        up = new
    assert sum(linked[i].sum() > 1 for i in range(3000)) > 100
    # bands find links near the threshold with high probability: none is made up, and few are missed
    assert all(up[i] == up[got[i]] for i in range(3000))
    assert sum(got[i] != up[i] for i in range(3000)) <= 0.02 * 3000


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(100):
        h = np.sort(rng.integers(0, 2**44, 60).astype("u8"))
        a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
        b = np.where(rng.random(60) < 0.6, a, b)
        d = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = bagminhash.signatures(d, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 125)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015


def test_near_odd(odd, empty):
    rows = bagminhash.classes(odd).collect()
    assert len(rows) == odd.count() and {r.class_id for r in rows if r.doc_id in (1, 2)} == {1} and {r.class_size for r in rows if r.doc_id == 1} == {4}
    kept = bagminhash.dedup(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:3]) for r in kept.collect()) == [(1, "a b"), (3, ""), (5, "   "), (6, "w0 "), (8, "pas"), (9, "x"), (9, "y")]
    assert bagminhash.classes(empty).count() == 0 and bagminhash.dedup(empty).count() == 0


# 4


def test_exact_odd(odd, empty):
    rows = exact.duplicates(odd).collect()
    assert len(rows) == odd.count() and {r.keep_id for r in rows if r.doc_id == 1} == {2} and sum(r.kept for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()) == 1
    assert exact.dedup(odd).columns == odd.columns and exact.dedup(odd).count() == sum(r.kept for r in rows)
    assert exact.duplicates(empty).count() == 0 and exact.dedup(empty).count() == 0


def test_exact_with_a_crowded_filter(docs):
    """A filter that is far too small changes nothing."""
    key = lambda r: (r.doc_id, r.keep_id, r.group_size, r.kept)
    assert sorted(map(key, exact.duplicates(docs, max_bits=4).collect())) == sorted(map(key, exact.duplicates(docs).collect()))


# 5


def test_shards_match_the_mixture(docs, odd, empty):
    rows = sharding.shard(docs, 24).collect()
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and len(rows) == docs.count()
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    four = sharding.shard(docs, 4).collect()
    sources = Counter(r.stratum for r in four)
    for (_, source), k in Counter((r.shard, r.stratum) for r in four).items():
        assert abs(k - sources[source] / 4) <= 2
    assert sharding.shard(odd, 3).count() == odd.count() and sharding.shard(empty, 3).count() == 0


# 6


def test_pieces_like_the_library(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    extra = ["".join(rng.choice("abcdehilnorst THE  .,\n\té一日😀▁'01<>#") for _ in range(rng.randint(0, 60))) for _ in range(2000)] + [" " * 40, "a" * 500, "x  y "]
    codec = sentencepieces.Codec(MODEL)
    texts = [r.text or "" for r in docs.collect()] + extra
    coded = codec.encode_all(texts)
    for t, c in zip(texts, coded):
        ids = np.frombuffer(c, "<u4").tolist()
        assert ids == library.encode(t)
        assert codec.decode(ids) == library.decode(ids) == t.replace("▁", " ")
    for _ in range(500):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000)]) for _ in range(8)]
        assert codec.decode(ids) == library.decode(ids)


def test_unigram_like_the_library(tmp_path):
    """A hand-made unigram model: Viterbi by the sum of scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(p, s, 1) for p, s in (("▁", -3.0173), ("a", -2.5091), ("b", -2.7367), ("ab", -3.1549), ("▁a", -2.9713), ("ba", -4.0119), ("▁ab", -6.5237), ("aba", -5.3411))]:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.remove_extra_whitespaces = False
    path = tmp_path / "m.model"
    path.write_bytes(m.SerializeToString())
    library, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepieces.Codec(str(path))
    rng = random.Random(4)
    texts = ["".join(rng.choice("aaabb zz") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    assert [np.frombuffer(c, "<u4").tolist() for c in codec.encode_all(texts)] == [library.encode(t) for t in texts]


def test_best_scores_by_force(docs):
    """The same pieces and scores as a unigram model: the sums of whole documents are the best ones."""
    codec = sentencepieces.Codec(MODEL, sentencepieces.UNIGRAM)
    texts = docs.collect()

    longest = max(map(len, codec.ids))

    def best(text):
        """The best sum by brute force, piece by piece; a character without one stands alone and adds the scores of its bytes."""
        score = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for at in range(max(0, end - longest), end):
                if (i := codec.ids.get(text[at:end])) is not None:
                    score[end] = max(score[end], score[at] + codec.scores[i])
            if text[end - 1] not in codec.ids:
                score[end] = max(score[end], score[end - 1] + sum(codec.scores[codec.of_byte[b]] for b in text[end - 1].encode()))
        return score[-1]

    got = {r.doc_id: r for r in sentencepieces.encode(docs, MODEL, scored=True).collect()}
    sums: dict = {}
    for r in texts:
        text = (r.text or "").replace(" ", "▁")
        parts = re.findall("▁+[^▁]*", "▁" + text) if text else []
        sums |= {w: best(w) for w in parts if w not in sums}
        assert got[r.doc_id].best_score == sum(sums[w] for w in parts)
        ids = np.frombuffer(codec.encode_all([r.text or ""])[0], "<i4")
        assert len(ids) == got[r.doc_id].best_n_ids and codec.decode(ids) == (r.text or "").replace("▁", " ")


def test_pieces_odd(odd, empty):
    out = sentencepieces.encode(odd, MODEL)
    rows = out.collect()
    assert len(rows) == odd.count() and {r.n_ids for r in rows if r.doc_id in (3, 4)} == {0}
    assert {r.back for r in sentencepieces.decode(out, MODEL, text_col="back").collect() if r.doc_id == 8} == {"password = hunter22"}
    assert sentencepieces.encode(empty, MODEL).count() == 0


# 7

BASE = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))


def test_secrets_by_force(docs):
    for r, got in zip(docs.orderBy("doc_id").collect(), secrets.digest(docs).orderBy("doc_id").collect()):
        spans = [(m.start(), i, kind, m.end()) for i, (kind, p, g, n) in enumerate(BASE) for m in p.finditer(r.text or "") if len(m[g]) >= n]
        named = ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(spans))
        assert got.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert set(filter(None, named.split(","))) <= set(got.spans.split(","))
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(s[1] == i for s in spans) for i in range(3))


def entropy(s):
    return -sum(c / len(s) * np.log2(c / len(s)) for c in Counter(s).values())


def test_entropy_windows_and_allow_list(spark, odd, empty):
    run = "q7Zp2XcV9bLm4KtR8wYs3HdF6g"
    texts = [f"key {run} end", "see example-q7Zp2XcV9bLm4KtR8wYs", "averylongwordwithoutanydigitsinside", "g" * 40 + "1"]
    rows = secrets.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    dense = [i for i in range(len(run) - 19) if entropy(run[i : i + 20]) >= 3.75]
    assert rows[0].spans == f"entropy:{4 + dense[0]}:{4 + dense[-1] + 20}" and [r.spans for r in rows[1:]] == ["", "", ""]
    out = secrets.redact(odd)
    assert out.columns == odd.columns and {r.text for r in out.collect() if r.doc_id == 8} == {"[SECRET]"} and {r.text for r in out.collect() if r.doc_id == 3} == {None}
    assert secrets.digest(odd).count() == odd.count() and secrets.digest(empty).count() == 0


def test_entropy_of_runs_with_slashes_and_base_spans(spark):
    rng = random.Random(11)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secret, commit = "q7Zp2XcV9bLm4KtR8wYs3HdF", "0f1e2d3c4b5a69788796a5b4c3d2e1f00f1e2d3c"
    held = [f"/services/T01AB2CD3/B04EF5GH6/{secret}", f"{commit}/{secret}Jn6Q", f"{secret}Jn6Q/{commit}", f"/example/{secret}", f"{secret[:14]}/{secret[14:]}a1Xk", "/files/" + "0123ABCD4567EF89" * 2 + "A1B2C3D4"]
    free = ["/usr/local/lib/python3/dist-packages/numpy", "data/year=2024/month=05/day=12/part-00001", "services/v2Beta1/things/list", f"/repo/commit/{commit}", "src/main/java/Foo2Bar/HelloWorld", "a/" * 20]
    drawn = [r for r in ("".join(rng.choice(chars) for _ in range(40)) for _ in range(4000)) if re.fullmatch("/?[A-Za-z0-9]+(/[A-Za-z0-9]+)+/?", r)]
    texts = [f"see {x} end" for x in held + free + drawn]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = [r.spans for r in secrets.digest(df).orderBy("doc_id").collect()]
    assert all("entropy" in s for s in spans[: len(held)]), spans[: len(held)]
    assert not any("entropy" in s for s in spans[len(held) : len(held) + len(free)]), spans[len(held) : len(held) + len(free)]
    assert len(drawn) > 500 and sum("entropy" in s for s in spans[-len(drawn) :]) > 0.9 * len(drawn)
    safe = [r.text for r in secrets.redact(df).orderBy("doc_id").collect()]
    assert not any(secret[:14] in t or secret[-10:] in t for t in safe[: len(held)])


# 8


def test_toxicity_on_held_out_rows(spark):
    sf = f"{compare.TESTDATA}/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scores(d, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    pos, neg = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9, auc
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (None, 0, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scores(empty, labels).count() == 0 and toxicity.scores(odd, labels.limit(0)).filter("score > 0").isEmpty()
    assert toxicity.folded("Ｆ00l ѕ1lly t​ext") == ["fool", "silly", "text"]


# 9


def test_packing_round_trip(docs, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.model("byte_bpe_50k.json"))
    files = queries.model("byte_bpe_50k.json"), queries.model("byte_bpe_50k.tiktoken")
    by = defaultdict(list)
    rows = packing.pack(docs, *files).collect()
    for r in rows:
        by[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d in docs.collect():
        pieces = sorted(by[d.doc_id], key=lambda r: r.start)
        assert sum((list(p.ids) for p in pieces), []) == [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert [p.start for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces[:-1]]]))
    assert packing.pack(odd, *files).filter("doc_id = 4").count() == 1 and packing.pack(empty, *files).count() == 0


# 10


def test_topk_odd(spark):
    nan, none = float("nan"), None
    rows = [(0, [1.0, 0.5]), (50, [0.5, -0.5]), (1, [1.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [none, 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, q int")
    got = topk.search(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got][:3] == [(0, 1, 1, 98304), (0, 2, 6, 98304), (0, 3, 50, 16384)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def best_by_force(rows, k=5):
    """(query_id, rank, vec_id, score) in Python integers."""
    whole = lambda x: math.floor(fractions.Fraction(x) * 256)
    q = [(i, [whole(x) for x in v]) for i, v in rows]
    out = []
    for i, v in q:
        if i % 50 == 0:
            own = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i and len(v) == len(w))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(own[:k])]
    return out


def test_topk_beyond_small_components(spark):
    """Large finite vectors are queries and candidates like all others."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 0, 0, 3, 5, 6]) for _ in range(8)]) for i in range(300)]
    rows += [(300, [600000.0] + [0.5] * 7), (301, [-700000.0, 800000.25] + [0.0] * 6), (302, [2.0**24] + [0.0] * 7), (303, [-(2.0**25)] + [0.0] * 7)]
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    search = lambda rows: [tuple(r) for r in topk.search(df(rows), F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    assert max(256 * abs(x) for _, v in rows for x in v) > topk.LIMIT and search(rows) == best_by_force(rows)
    # many dimensions: the sum leaves 64 bits although no component is large
    wide = [(0, [-5e5] * 600), (1, [5e5] * 600), *[(i, [-1.0] * 600) for i in range(2, 8)]]
    assert search(wide) == best_by_force(wide)
    # scores without a 64-bit integer: no matter below the k best, an error among them
    far = [(0, [-1.0]), (1, [-(2.0**45) - 0.5]), (2, [2.0**45 + 0.5])]
    assert search(far) == best_by_force(far)
    few = [(0, [1e30, 1.0]), (1, [0.0, 3.0]), (2, [-1e30, 0.0])]
    assert [r[:3] for r in search([*few, *[(i, [0.0, float(i)]) for i in range(3, 9)]])] == [(0, i, 9 - i) for i in range(1, 6)]
    for bad in (few, [(0, [1e30, 1.0]), (1, [1e30, 1.0])]):
        with pytest.raises(Exception, match="no 64-bit integer"):
            search(bad)


# pipeline


def test_pipeline_by_force(spark, docs):
    """Each stage on what the one before kept."""
    kept, columns = docs, docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "secrets", "packing"]
    clean = stages["toxicity"](spark, kept, SF)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out("doc_id")))
    automaton = model.automaton()
    found = {r.doc_id: toxicity.weight_of(automaton, r.text or "") for r in docs.collect()}
    score = lambda f: 1 / (1 + np.exp(-np.dot(toxicity.inputs(np.array([f[0]]), np.array([f[1]]))[0], model.weights)))
    assert {r.doc_id for r in clean.collect()} == {i for i, f in found.items() if model.weights is None or score(f) < 0.5} and clean.columns == columns
    clean = clean.cache()
    own = stages["exact_dedup"](spark, clean, SF).cache()
    last = {}
    for r in clean.collect():
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    assert {r.doc_id for r in own.collect()} == set(last.values()) and own.columns == columns
    near = stages["near_dedup"](spark, own, SF).cache()
    assert {r.doc_id for r in near.collect()} == {c for _, c in classes_by_force([(r.doc_id, r.text) for r in own.collect()])} and near.columns == columns
    safe = stages["secrets"](spark, near, SF).cache()
    assert safe.count() == near.count() and secrets.digest(safe).filter("n_assign + n_access + n_hex > 0").isEmpty() and safe.columns == columns
    assert {r.doc_id for r in stages["packing"](spark, safe, SF).collect()} == {r.doc_id for r in safe.collect()}


def test_pipeline_odd(spark, odd, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for df in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, str(tmp_path))
            if name != "packing":
                assert df.columns == odd.columns
        df.count()
