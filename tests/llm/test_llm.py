"""The corpus operators on small fixtures, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kintrace.llm import bpe, chat, hnsw, langid, minhash, mixing, passages, quality, queries, shingles, suffix, tokenfiles
from kintrace.sources.shared import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["the", "of", "on", "tion", "re", "é", "Σ", "İ", "'s", "9", "\n", "<|endoftext|>", "\x1c", " ", "한", "é", "!!", "\x00"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ID string, token_ids string, _tid string, kept string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def documents(spark, texts, **cols):
    """Documents with clashing extra columns; ids from 0 unless given."""
    rows = [(cols.get("ids", range(len(texts)))[i], t, cols.get("langs", ["en"] * len(texts))[i], cols.get("sources", ["s"] * len(texts))[i], len(t or ""), "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA.replace("ID string", "extra string"))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(11)
    base = words(rng, 120)
    near = base.split()
    near[40] = "changed"
    return [None, "", "   \n\t", "a", "b c d", base, base, " ".join(near), words(rng, 30_000, 50_000), "é" * 500, "x" * 4_000, "<|endoftext|> À Σ", words(rng, 80) + "\n" + base]


def check_bpe(texts):
    library, enc = Tokenizer.from_file(PATH), bpe.encoder(PATH)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        packed = enc.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids, t[:80]
        assert enc.decode(packed) == library.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(tokenfiles.LibraryWords(enc, "<u4").encode(t), "<u4").tolist() == ids, t[:80]


def test_bpe_random():
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET + [chr(rng.randrange(1, 0x500))]) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    check_bpe(texts + ["a" * 300, "ab" * 200] + [f"x{chr(i)}y" for i in range(0x300)])


def test_bpe_columns(spark, odd_texts):
    df = documents(spark, odd_texts)
    out = bpe.bpe_roundtrip(df, PATH)
    assert out.columns[-2:] == ["token_ids_", "decoded"] and out.count() == len(odd_texts)
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.a for r in bpe.with_id_array(out.select("doc_id", "token_ids_"), "token_ids_", "a").collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(odd_texts)}
    assert bpe.bpe_roundtrip(df.limit(0), PATH).count() == 0


def test_token_files(spark, odd_texts, tmp_path):
    ids = [5, None, 3, 3, 9, -1, 7, 8, 10, 11, 12, 13, 14]
    df = documents(spark, odd_texts, ids=ids)
    folder = f"file://{tmp_path}/t"
    parts = tokenfiles.write_tokens(df, folder, PATH)
    got = sorted(tokenfiles.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    want = {i: [] for i in ids}
    for i, t in zip(ids, odd_texts, strict=True):
        want[i].append(zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()))
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert all(r.ids_crc32 in want[r.doc_id] for r in got)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist() and sum(p["tokens"] for p in parts) == sum(r.n_tokens for r in got)
    tokenfiles.write_tokens(df.limit(0), folder + "0", PATH)
    assert tokenfiles.read_tokens(spark, folder + "0").count() == 0


def test_chat(spark):
    rng = random.Random(2)
    odd = ["", None, "</s>[INST] ok [/INST]", "\\l\\b\\s <|turn|>x\n<|end|>\n", "a" * 5000, words(rng, 700), "[[<<\\\\", "é\n"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, "a<|b\n[c"]), rng.choice(odd + [words(rng, rng.randrange(90))])) for c in (1, 2, 3, None, 5) for t in range(rng.randrange(1, 14))]
    rows += [(8, 0, "assistant", "twice")] * 2 + [(9, None, "assistant", "x"), (9, 0, "system", "s")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df, budget=200, history=40)
    assert windows.count() > 8
    got = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_text == "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        assert got[c].loss_text == "".join(x for _, _, r, x in turns if r == "assistant")
    for w in windows.filter("context_turns > 0").collect():
        assert w.formatted.count(chat.TURN) > w.context_turns
    assert chat.read_windows(chat.format_windows(df.limit(0))).count() == 0


def test_mixing(spark, duck, odd_texts):
    df = documents(spark, odd_texts, sources=[None, "a", "b", "b", "c", "c", "c", "d", "d", "é", None, "a", "e"], ids=[1, 1, None, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13])
    out = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in out) == sorted(map(size, odd_texts)) and sum(r.target for r in {r._source: r for r in out}.values()) == pytest.approx(sum(map(size, odd_texts)))
    by = defaultdict(list)
    for r in out:
        by[r._source].append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for rs in by.values():
        assert sum(r.taken for r in rs) == int(rs[0].target) and rs[0].target <= 3 * rs[0].source_size
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=repr)
    taken = mixing.mixed_rows(df)
    assert taken.columns == df.columns
    assert taken.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r.taken for r in out)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0


def _brute_components(sets, percent):
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_minhash(spark, odd_texts):
    rng = random.Random(4)
    texts = list(odd_texts)
    for n in (8, 60, 150):
        base = words(rng, n).split()
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(n)] = "new"
            texts.append(" ".join(t))
    hub = words(rng, 160).split()  # copies of a hub that are mostly too far from each other
    for i in range(60):
        t = list(hub)
        for at in ((2 * i + 7) % 160, (5 * i + 80) % 160):
            t[at] = f"n{i}"
        texts.append(" ".join(t))
    out = minhash.near_duplicates(documents(spark, texts)).collect()
    sets = {i: _shingles(t) for i, t in enumerate(texts)}
    assert {r.id: r.n_shingles for r in out} == {i: len(s) for i, s in sets.items()}
    assert {r.id: r.component_id for r in out} == _brute_components(sets, 85)
    assert all(r.kept == (r.id == r.component_id) for r in out)
    again = minhash.near_duplicates(documents(spark, ["a b c d e f", "a b c d e f", "x", None], ids=[3, 3, None, 7])).collect()
    assert sorted((r.id is None, r.id or 0, r.component_id or 0, r.kept) for r in again) == [(False, 3, 3, True), (False, 3, 3, True), (False, 7, 7, True), (True, 0, 0, True)]
    twice = {(r.id, r.n_shingles): r.component_id for r in minhash.near_duplicates(documents(spark, ["a b c d e f", "g h i j k l m", "g h i j k l m"], ids=[5, 5, 2])).collect()}
    assert twice == {(5, 2): 5, (5, 3): 2, (2, 3): 2}
    assert minhash.near_duplicates(documents(spark, texts).limit(0)).count() == 0


def test_minhash_blocks():
    """The last step alone finds every link between minor and other members."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**63, 100).astype("u8")
    sets = [np.unique(np.r_[base[k:], rng.integers(1, 2**63, k).astype("u8")]) for k in range(30)]
    t = pa.table({"id": range(30), "label": range(30), "minor": [k < 10 for k in range(30)], "items": [s.tobytes() for s in sets]})
    out = minhash._block_links(85)(t)
    got = {frozenset(p) for p in zip(out["p"].to_pylist(), out["q"].to_pylist(), strict=True)}
    want = {frozenset((a, b)) for a in range(10) for b in range(30) if a != b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert got == want


def test_langid(spark):
    rng = random.Random(6)
    vocab = {"en": ["the", "thing", "wheth", "ation"], "fr": ["que", "été", "ment", "eaux"], "ru": ["привет", "мир", "это"]}
    texts, langs = [], []
    for i in range(240):
        lang = ["en", "fr", "ru"][i % 3]
        texts.append(" ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(1, 40))))
        langs.append(lang)
    extra = [None, "", "12 !!", "the thing " * 40 + "que été eaux " * 60, "привет the", "a" * 20_000, "漢字"]
    df = documents(spark, texts + extra, langs=langs + [None] * len(extra))
    model = langid.learn(df)
    out = langid.detect(df, model, spans_col="spans").orderBy("doc_id").collect()
    assert all(r.lang_pred == l for r, l in zip(out, langs, strict=False))
    odd = out[len(texts) :]
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in out)
    assert odd[3].lang_pred == "fr" and [s.lang for s in odd[3].spans] == ["en", "fr"] and odd[3].spans[1].first_word == 80
    assert odd[6].lang_pred in model.langs
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() == len(texts) + 4
    empty = langid.learn(df.limit(0))
    assert {r.lang_pred for r in langid.detect(df.limit(5), empty).collect()} == {"und"} and langid.detect(df.limit(0), model).count() == 0


def test_viterbi_by_hand():
    rng = np.random.default_rng(8)
    sizes = np.array([0, 7, 1, 30, 0, 12])
    scores = rng.normal(size=(sizes.sum(), 3)).astype("f4") * 3
    got, base = langid.viterbi(scores, sizes, 2.0), 0
    for n in sizes:
        s, total = scores[base : base + n].astype("f8"), lambda p, s: sum(s[i, p[i]] for i in range(len(p))) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        if n:
            value = s[0]
            for x in s[1:]:
                value = np.maximum(value, value.max() - 2.0) + x
            assert total(got[base : base + n], s) == pytest.approx(value.max())
        base += n


def test_viterbi_of_long_texts(monkeypatch):
    rng = np.random.default_rng(61)
    sizes = np.array([5, 1_300, 0, 900, 2_111])
    scores = rng.normal(size=(int(sizes.sum()), 4)).astype("f4")
    whole = langid.viterbi(scores, sizes, 3.0)
    monkeypatch.setattr(langid, "LONG_TEXT", 10**9)
    assert (whole == langid.viterbi(scores, sizes, 3.0)).all() and len(np.unique(whole)) == 4


def test_letters():
    assert langid.words_of("½ ² Ⅷ ① 12_3 \u0301") == []
    assert langid.words_of("हिन्दी, ÀB's x1y") == ["हिन्दी", "àb", "s", "x", "y"]


def test_langid_scores(spark):
    """Scores against a plain count of n-grams, and every held-out row right."""
    rng = random.Random(67)
    made = {"a": "abcde", "b": "defgh", "c": "абвгд"}
    rows = [(lang, " ".join("".join(rng.choice(made[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(30))) for lang in "abc" for _ in range(30)]
    rows += [("a", "½ ²"), (None, "abc abd"), ("b", None), ("c", "")]
    df = documents(spark, [t for _, t in rows], langs=[lang for lang, _ in rows])
    model = langid.learn(df)
    learned = [(lang, t) for i, (lang, t) in enumerate(rows) if lang and t and zlib.crc32(str(i).encode()) % 4 != 2]
    count = defaultdict(Counter)
    for lang, t in learned:
        for w in langid.words_of(t):
            count[lang].update(langid.grams(w))
    known = set().union(*count.values())
    assert set(model.index) == known
    total = {lang: sum(count[lang][g] + 0.5 for g in known) for lang in "abc"}
    scorer = langid.Scorer(model)
    for w in ("abc", "defgg", "ea"):
        plain = [sum(np.log(count[lang][g] + 0.5 if g in known else 0.5) - np.log(total[lang]) for g in langid.grams(w)) for lang in "ab"]
        got = scorer.score([w])[0]
        assert got[0] - got[1] == pytest.approx(plain[0] - plain[1], abs=1e-3)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.detect(df.select("doc_id", "text"), model).collect()}
    assert all(found[i][0] == rows[i][0] for i in range(90))
    assert [found[i] for i in (90, 92, 93)] == [("und", 0.0)] * 3


def _brute_repeats(texts, length=200):
    bodies = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(b), int(gone.sum()), runs, bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)))
    return out


@pytest.mark.parametrize("group", [suffix.GROUP, 2])
def test_suffix(spark, odd_texts, group, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", group)
    rng = random.Random(9)
    passage = words(rng, 70)
    texts = [t for t in odd_texts if len(t or "") < 10_000] + [words(rng, 30) + " " + passage[rng.randrange(60) : rng.randrange(230, 290)] + words(rng, 20) for _ in range(12)] + ["ab" * 300, passage * 3, "é" * 101, "é" * 101]
    out = suffix.repeated_passages(documents(spark, texts))
    by = {bytes(r.tid): (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()}
    for t, want in zip(texts, _brute_repeats(texts), strict=True):
        assert by[hashlib.sha256((t or "").encode()).digest()[:16]] == want, (t or "")[:50]
    cut = suffix.without_repeats(documents(spark, texts))
    assert cut.columns == documents(spark, texts).columns
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())
    assert suffix.repeated_passages(documents(spark, texts).limit(0)).count() == 0


def test_intervals():
    assert sorted(suffix.intervals([0, 3, 5, 2])) == [(2, 0, 3), (3, 0, 2), (5, 1, 2)]
    assert suffix.common_prefix(b"abcx", b"abcyz") == 3 and suffix.common_prefix(b"", b"a") == 0 and suffix.common_prefix(b"ab", b"abc") == 2


def test_quality(spark, odd_texts):
    rng = random.Random(12)
    texts = list(odd_texts) + ["a b c a b c a b c", "one\ntwo\none\n \n \none", "x y", "a a a a", words(rng, 60, 6)]

    def base(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n, mark = Counter(windows), set()
        for i, x in enumerate(windows):
            if n[x] > 1:
                mark |= {i, i + 1, i + 2}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(mark)

    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: tuple(r[c] for c in cols) for r in quality.statistics(documents(spark, texts)).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    w = F.split(F.lit("a b c a b c d"), " ")
    packed = quality.PACKED_WORDS
    try:
        quality.PACKED_WORDS = 4  # then the wide form is taken
        assert spark.range(1).select(quality.repeat_words(w)).first()[0] == 6
    finally:
        quality.PACKED_WORDS = packed


def test_decision_list():
    rng = random.Random(1)
    rows = []
    for i in range(600):
        a, b = rng.random(), rng.random()
        rows.append({"a": a, "b": b, "bad": int(a > 0.7 or (b < 0.2 and a > 0.3)), "grow": i % 3 > 0})
    rules = quality.learn_rules(rows, ["a", "b"])
    wrong = sum(any(quality._covers(r, x) for r in rules) != bool(x["bad"]) for x in rows)
    assert len(rules) >= 2 and wrong < 30
    assert quality.learn_rules([], ["a"]) == [] and quality.learn_rules(rows[:0], ["a"]) == []


def test_passages(spark):
    rng = random.Random(13)
    shared, loose = words(rng, 60, 5000), words(rng, 90, 5000).split()
    texts = [words(rng, rng.randrange(40, 300), 5000) for _ in range(20)]
    planted = {}
    for i in range(20, 32):
        t = list(loose)
        if i % 2:
            t[30 + i] = "other"
        texts.append(f"{words(rng, 50, 5000)} {shared if i < 26 else ' '.join(t)} {words(rng, 40, 5000)}")
        planted[i] = True
    texts += [None, "", "a", words(rng, 20, 5), "same " * 300]
    out = passages.near_passages(documents(spark, texts)).collect()
    assert {x for r in out for x in (r.p, r.q)} == set(planted)
    for r in out:
        a, b = texts[r.p].split()[r.p_first : r.p_first + r.p_words], texts[r.q].split()[r.q_first : r.q_first + r.q_words]
        x, y = _shingles(" ".join(a)), _shingles(" ".join(b))
        assert len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.8 and min(len(a), len(b)) >= 50
    assert passages.near_passages(documents(spark, texts).limit(0)).count() == 0


def _brute_passage(a, b, width, least):
    """Whether any two ranges of ``width`` or more reach the Jaccard value."""
    for x in range(len(a) - width + 1):
        for y in range(x + width, len(a) + 1):
            one = set(a[x:y])
            for u in range(len(b) - width + 1):
                two = set(b[u : u + width])
                for v in range(u + width, len(b) + 1):
                    two.add(b[v - 1])
                    both = len(one & two)
                    if both >= least * (len(one) + len(two) - both) - 1e-12:
                        return True
    return False


def test_passages_inserted_and_deleted():
    rng = np.random.default_rng(17)
    word_shingles = lambda w: shingles.shingles(w.astype("u8"), 5)
    for n, more in ((64, 4), (64, 6), (80, 8)):
        base, new = rng.integers(1, 2**60, n), rng.integers(1, 2**60, more)
        a, b = word_shingles(base), word_shingles(np.r_[base[: n // 2], new, base[n // 2 :]])
        for p, q in ((a, b), (b, a)):
            got = list(passages.common_passages(p, q, 46, 0.8))
            assert got and all(min(y - x, v - u) >= 46 and value >= 0.8 for x, y, u, v, value in got)
    width, seen = 12, Counter()
    for _ in range(150):
        base = rng.integers(1, 2**60, 24)
        other = list(base)
        for _ in range(rng.integers(2, 7)):
            at = int(rng.integers(len(other)))
            other[at : at + int(rng.integers(3))] = rng.integers(1, 2**60, int(rng.integers(3))).tolist()
        a = np.r_[rng.integers(1, 2**60, 4), base].astype("u8")
        b = np.r_[np.array(other, "u8"), rng.integers(1, 2**60, 3).astype("u8")]
        want = _brute_passage(a.tolist(), b.tolist(), width, 0.8)
        got = list(passages.common_passages(a, b, width, 0.8))
        assert bool(got) == want and all(value >= 0.8 for *_, value in got)
        seen[want] += 1
    assert min(seen[True], seen[False]) > 5


def _pairs_without_a_range(hashes):
    """Of 3,000 pairs of 50 words with one word changed, 41 of 51 shingles shared, those that windows do not bring together."""
    rng, lost = np.random.default_rng(29), 0
    for _ in range(3_000):
        x, y = (rng.integers(1, 2**60, 130).astype("u8") for _ in range(2))
        x[40:90] = y[40:90]
        x[65] += np.uint64(1)
        sides = [defaultdict(list), defaultdict(list)]
        for d, k, rows in passages.compact_windows([shingles.shingles(x), shingles.shingles(y)], hashes, 46):
            for side, r in zip(d.tolist(), rows.tolist(), strict=True):
                sides[side][r[0], k].append((r[2], r[1], r[3]))
        over = [{key for key, found in side.items() if any(first <= 40 and last >= 85 for _, first, last in found)} for side in sides]
        lost += len({k for _, k in over[0] & over[1]}) < passages.AGREE
    return lost


def test_hashes_that_agree():
    assert _pairs_without_a_range(range(passages.HASHES)) <= 3


@pytest.mark.parametrize("block", [512, 5])
def test_passages_of_a_template(spark, block, monkeypatch):
    """Pairs of letters that share most of their words with all others, too far from any pivot."""
    monkeypatch.setattr(passages, "BLOCK", block, raising=False)
    monkeypatch.setattr(passages, "OPEN_BLOCK", max(2, block // 4), raising=False)
    rng = random.Random(23)
    form = words(rng, 38, 5000)
    letters = [f"{form} {words(rng, 12, 5000)}" for _ in range(24)]
    texts = [f"{words(rng, 50, 5000)} {letters[i // 2]} {words(rng, 50, 5000)}" for i in range(48)]
    pairs = {(r.p, r.q) for r in passages.near_passages(documents(spark, texts)).collect()}
    assert pairs == {(i, i + 1) for i in range(0, 48, 2)}


def test_ranges(spark):
    rng = random.Random(19)
    seeds = []
    for _ in range(400):
        p, q = rng.randrange(3), rng.randrange(3, 6)
        a, b, n, m = rng.randrange(2000), rng.randrange(300), rng.randrange(46, 120), rng.randrange(46, 120)
        seeds.append(((p, a + 9, a, a + n), (q, b + 9, b, b + m), 1 << rng.randrange(4)))
    window = "struct<id:long,centre:int,first:int,last:int>"
    df = spark.createDataFrame([(b, a, k) if i % 2 else (a, b, k) for i, (a, b, k) in enumerate(seeds)], f"a {window}, b {window}, met int")
    got = [tuple(r) for r in passages._ranges(df, 46).collect()]
    for a, b, k in seeds:
        for c, d, m in seeds:
            if (a[0], b[0]) == (c[0], d[0]) and k != m:
                r = (max(a[2], c[2]), min(a[3], c[3]), max(b[2], d[2]), min(b[3], d[3]))
                if r[1] - r[0] >= 45 and r[3] - r[2] >= 45:
                    assert any((p, q) == (a[0], b[0]) and x <= r[0] and r[1] <= y and u <= r[2] and r[3] <= v for p, q, x, y, u, v in got)


def test_passages_that_drift(spark):
    """Families in which each document changes one word of the passage of the one before: all pairs are of one component, each end is found."""
    rng = random.Random(37)
    texts, family, parts = [], [], []
    for f in range(6):
        passage = words(rng, 80, 5000).split()
        for _ in range(20):
            passage[rng.randrange(80)] = f"w{rng.randrange(5000)}"
            family.append(f)
            parts.append(_shingles(" ".join(passage)))
            texts.append(f"{words(rng, 60, 5000)} {' '.join(passage)} {words(rng, 60, 5000)}")
    near = passages.near_passages(documents(spark, texts))
    label = {r.node: r.component for r in passages.components(near).collect()}
    want = _brute_components(dict(enumerate(parts)), 80)
    pairs = [(i, j) for i in want for j in want if i < j and 5 * len(parts[i] & parts[j]) >= 4 * len(parts[i] | parts[j])]
    assert len(pairs) > 100 and all(label.get(i) == label.get(j) is not None for i, j in pairs)
    assert all(family[i] == family[label[i]] for i in label)


def test_passages_met_often(spark):
    """One passage in 300 documents, one word changed in a third of them, and lines that all share without being near-duplicates."""
    rng = random.Random(41)
    line, passage = words(rng, 25, 5000), words(rng, 60, 5000).split()
    texts = []
    for i in range(300):
        t = list(passage)
        if i % 3 == 0:
            t[rng.randrange(60)] = f"new{i}"
        texts.append(f"{words(rng, 40, 5000)} {line} {words(rng, 40, 5000)} {' '.join(t) if i < 200 else ''} {words(rng, 30, 5000)}")
    label = {r.node: r.component for r in passages.components(passages.near_passages(documents(spark, texts))).collect()}
    assert set(label) == set(range(200)) and set(label.values()) == {0}


def test_passages_of_one_id(spark):
    a, b = words(random.Random(43), 70, 5000), words(random.Random(44), 70, 5000)
    near = passages.near_passages(documents(spark, [a, b, a, b, "x y", None], ids=[1, 1, 2, 3, None, 4])).collect()
    assert len(near) == 1 and near[0].p == 1 and near[0].q in (2, 3)


def test_passages_of_texts_apart(spark):
    """Each text of an id is looked at: documents that meet different texts of it are one component."""
    rng = random.Random(44)
    a, b, c = (words(rng, 70, 5000) for _ in range(3))
    df = documents(spark, [a, b, a, b, a, c, c + " more", c, c], ids=[1, 1, 2, 3, 1, 5, 5, 7, 7])
    near = passages.near_passages(df, texts_apart=True).collect()
    assert {(r.p, r.q) for r in near} >= {(1, 2), (1, 3), (5, 7)} and all(r.p <= r.q and r.similarity >= 0.8 for r in near)
    label = {r.node: r.component for r in passages.components(passages.near_passages(df, texts_apart=True)).collect()}
    assert label == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5}


def test_windows_compared_whole(spark):
    """A passage of 80 shingles with its centre at the start, cut short it is below 0.8: both windows are compared over all of it."""
    rng = random.Random(45)
    passage = words(rng, 84, 50_000).split()
    other = list(passage)
    other[28] = other[31] = "changed"  # 8 of 80 shingles differ: 72 / 88, and less over the first 62 or any 46 of them
    texts = [" ".join(words(rng, 30, 50_000).split() + t + words(rng, 30, 50_000).split()) for t in (passage, other)]
    a, b = (_shingles(" ".join(t)) for t in (passage, other))
    assert 5 * len(a & b) >= 4 * len(a | b)
    window = lambda i, label: (1, 2, i, 34, 30, 109, label, i == 1)
    open_ = spark.createDataFrame([window(0, 0), window(1, 1)], "x long, y long, id long, centre int, first int, last int, label long, open boolean")
    src = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = passages._in_blocks(src, open_, 46, 0.8).collect()
    assert [(r.p, r.q) for r in got] == [(0, 1)]


def test_windows_of_shared_stretches(spark, monkeypatch):
    """A line that all share gives no windows, and a text that repeats itself few: those written are of the near-duplicates alone."""
    rng = random.Random(49)
    line, passage = words(rng, 12, 50_000), words(rng, 60, 50_000).split()
    texts = [f"{words(rng, 150, 50_000)} {line} {words(rng, 150, 50_000)}" for _ in range(30)]
    other = passage[:30] + ["changed"] + passage[31:]
    texts += [f"{words(rng, 200, 50_000)} {' '.join(t)} {words(rng, 200, 50_000)}" for t in (passage, other)]
    texts += [" ".join(words(random.Random(50), 20, 50_000) for _ in range(60)) + end for end in ("", " end")]
    written = {}
    cut = passages.cut

    def told(df, name="t"):
        written[name] = cut(df, name)
        return written[name]

    monkeypatch.setattr(passages, "cut", told)
    monkeypatch.setattr(passages, "discard", lambda *_: None)
    pairs = {(r.p, r.q) for r in passages.near_passages(documents(spark, texts)).collect()}
    rows = written["all-windows"].collect()
    assert pairs == {(30, 31), (32, 33)} and {r.id for r in rows} == {30, 31, 32, 33}
    assert max(Counter((r.id, r.value) for r in rows).values()) == 1 and len(rows) <= 100


def test_stretches():
    rng = np.random.default_rng(51)
    for _ in range(20):
        docs = [rng.integers(0, rng.integers(5, 3000), rng.integers(1, 400)).astype("u8") for _ in range(30)]
        hits = [rng.random(len(d)) < rng.choice([0.3, 0.8, 0.95]) for d in docs]
        again = [~passages._first_places(d.astype("i8")) for d in docs]
        want = [(i, s, e) for i, (d, h) in enumerate(zip(docs, hits)) for s, e in passages._feasible(d.astype("i8"), h, 0.8, 46)]
        assert passages._stretches(docs, np.concatenate(hits), np.concatenate(again), 46, 0.8) == want


def test_block_gives_a_forest():
    """Near copies of one range under labels of their own, and others that share half of it: a block gives one pair less than there are near copies, not all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(57)
    base, sketch = rng.integers(1, 2**63, 90).astype("u8"), passages._sketch(46)
    ranges = []
    for i in range(60):
        near = base.copy()
        near[rng.integers(0, 90, 3 if i < 40 else 60)] = rng.integers(1, 2**63)
        ranges.append(near)
    digests = [sketch(x)[:16] for x in ranges]
    run = passages._likely(46, 0.8)
    for labels in (list(range(60)), [i % 40 // 2 for i in range(60)]):
        table = pa.table({"digest": digests, "label": labels, "open": [i % 3 > 0 for i in range(60)], "sketch": [sketch(x) for x in ranges]})
        out = [(digests.index(r["p"]), digests.index(r["q"])) for r in run(table).to_pylist()]
        want = [(i, j) for i in range(60) for j in range(i) if labels[i] != labels[j] and (i % 3 or j % 3) and list(passages.common_passages(ranges[i], ranges[j], 46, 0.8))]
        roots = passages._Ties()
        for i, j in out:
            assert (i, j) in want or (j, i) in want
            assert roots.root(labels[i]) != roots.root(labels[j])
            roots.tie(labels[i], labels[j])
        assert len(want) > 400 > 60 > len(out) and all(roots.root(labels[i]) == roots.root(labels[j]) for i, j in want)


def test_ranges_that_share_scattered_words():
    """Ranges of 90 shingles that share 60, in one stretch or in runs too short for any passage: only the first are compared in full."""
    import pyarrow as pa

    rng = np.random.default_rng(53)
    base, new = rng.integers(1, 2**63, 90).astype("u8"), rng.integers(1, 2**63, 90).astype("u8")
    sketch = passages._sketch(46)
    for other, found in ((np.r_[base[:60], new[60:]], 1), (np.where(np.arange(90) % 6 < 4, base, new), 0)):
        table = pa.table({"digest": [b"a", b"b"], "label": [1, 2], "open": [True, False], "sketch": [sketch(base), sketch(other)]})
        assert passages._likely(46, 0.8)(table).num_rows == found
        assert bool(list(passages.common_passages(base, other, 46, 0.8))) == bool(found)


def test_repeating_shingles():
    rng = np.random.default_rng(47)
    base = rng.integers(1, 2**60, 70).astype("u8")
    period, other = np.tile(base[:12], 12), np.tile(np.r_[base[:11], base[40:41]], 9)
    for a, b in ((np.full(90, 5, "u8"), np.full(60, 5, "u8")), (period, period[5:90]), (period, other), (np.r_[base, base], np.r_[base[35:], base[:35]]), (np.r_[base[40:], period], np.r_[base[:30], other])):
        assert all(value >= 0.8 for *_, value in passages.common_passages(a, b, 46, 0.8))
        assert bool(list(passages.common_passages(a, b, 46, 0.8))) == _brute_passage(a.tolist()[:120], b.tolist()[:110], 46, 0.8)
    assert not list(passages.common_passages(np.tile(base[:8], 9), np.tile(np.r_[base[:5], base[50:53]], 9), 46, 0.8))


def test_cartesian():
    rng = random.Random(3)
    v = np.array([0] + [rng.randrange(1, 12) for _ in range(60)] + [0] + [rng.randrange(1, 5) for _ in range(9)] + [0], "u8")
    before, after = passages.cartesian(v)
    for i, x in enumerate(v):
        if x:
            assert before[i] == max(j for j in range(i) if v[j] <= x) and after[i] == min(j for j in range(i + 1, len(v)) if v[j] < x)


def test_vectors_in_cells(spark, monkeypatch):
    """Cells, of which some have several shards and parts, give the links and components of brute force."""
    for name, value in (("CELLS_FROM", 100), ("SHARD_ROWS", 60), ("VISIT", 1), ("ROUTE_AUDIT", 2_000), ("ROUTE_RECALL", 1.0)):
        monkeypatch.setattr(hnsw, name, value, raising=False)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 16))
    v = np.concatenate([base[rng.integers(30, size=500)] + rng.normal(size=(500, 16)) * 0.15, base[0] + rng.normal(size=(200, 16)) * 0.1]).astype("f4")
    v[690:] = v[0]
    rows = [(i + 5, x.tolist()) for i, x in enumerate(v)] + [(1, [1.0, 2.0]), (2, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {r.id: r for r in hnsw.similar_vectors(df).collect()}
    unit = v.astype("f8") / np.linalg.norm(v.astype("f8"), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    for _ in range(len(v)):
        label = np.minimum(label, np.where(near, label[None], len(v)).min(1))
    assert [out[i + 5].n_links for i in range(len(v))] == near.sum(1).tolist() and [out[i].n_links for i in (1, 2)] == [1, 1]
    assert [out[i + 5].component_id for i in range(len(v))] == (label + 5).tolist()


def test_vectors_in_bounded_memory():
    """A shard in which all vectors are links holds a bounded number of pairs."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(7)
    v = rng.normal(size=8) + rng.normal(size=(4_000, 8)) * 0.01
    n = len(v)
    table = pa.table({"dim": pa.array(np.full(n, 8, "i4")), "shard": pa.array(np.zeros(n, "i4")), "rep": np.arange(n), "n": np.ones(n, "i8"), "v": pa.array(v.tolist())})
    graphs = hnsw._build_shard(table)
    tracemalloc.start()
    got = hnsw._query_shard(0.9)(graphs, table.select(["dim", "rep", "v"])).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[got.n > 0].n == n - 1).all() and len(got[got.rep != got.to]) == n - 1
    assert peak < 150 << 20


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    v = [(base[i % 40] + rng.normal(size=16) * 0.12).tolist() for i in range(600)] + [[0.0] * 16, None, [], [1.0, float("nan")] + [0.0] * 14, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], base[0].tolist(), base[0].tolist(), (base[0] * 1e200).tolist()]
    df = spark.createDataFrame([(i if i != 606 else None, x, i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<double>, n long")
    out = {r.id: r for r in hnsw.similar_vectors(df).collect()}
    unit = {i: np.array(x) / np.abs(np.array(x)).max() for i, x in enumerate(v) if x and None not in x and np.isfinite(x).all() and np.any(x) and i != 606}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    links = {i: [j for j, y in unit.items() if j != i and len(x) == len(y) and x @ y >= 0.9] for i, x in unit.items()}
    parent = {i: i for i in out}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, js in links.items():
        for j in js:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    assert {i: r.n_links for i, r in out.items() if i is not None} == {i: len(links.get(i, [])) for i in out if i is not None}
    assert {i: r.component_id for i, r in out.items() if i is not None} == {i: find(i) for i in out if i is not None}
    assert out[None].kept and out[None].component_id is None
    assert hnsw.similar_vectors(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    base = words(rng, 80)
    texts = [words(rng, rng.randrange(20, 200), 3000) for _ in range(120)] + [base, base, base.replace("w1 ", "v1 ", 1), "123 456", None, ""]
    passage = words(rng, 60, 3000)
    texts += [words(rng, 40, 3000) + " " + passage + " " + words(rng, 40, 3000) for _ in range(3)]
    df = documents(spark, texts, sources=[["a", "b", None][i % 3] for i in range(len(texts))])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = df
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == df.columns
    ids = [Counter(r.doc_id for r in s.select("doc_id").collect()) for s in seen]
    gone = {123, 124, 125}
    assert set(ids[0]) == set(range(len(texts))) - gone
    groups = _brute_components({i: _shingles(texts[i]) for i in ids[0]}, 85)
    assert set(ids[1]) == {i for i, c in groups.items() if i == c}
    cut = {r.doc_id: r.text for r in seen[2].collect()}
    kept = sorted(ids[1])
    for i, want in zip(kept, _brute_repeats([texts[i] for i in kept]), strict=True):
        assert cut.get(i, "") == want[3].decode("utf-8", "ignore")
    plan = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(seen[2]).collect()}
    assert ids[3] == Counter({i: -(-t // s) for i, (s, t) in plan.items() if t})
    library = Tokenizer.from_file(PATH)
    want = Counter((r.doc_id, np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()) for r in seen[3].collect())
    assert Counter((r.doc_id, bytes(r.token_ids)) for r in seen[4].collect()) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


def test_pipeline_near_dedup_at_80(spark, tmp_path):
    rng = random.Random(31)
    texts = []
    for n in (60, 90, 120):
        for _ in range(8):
            base = words(rng, n, 3000).split()
            texts.append(" ".join(base))
            for changed in range(1, 5):  # far enough apart to spoil five shingles each
                t = list(base)
                for k in range(changed):
                    t[7 + k * (n // 5)] = f"new{k}"
                texts.append(" ".join(t))
    sets = {i: _shingles(t) for i, t in enumerate(texts)}
    want = {i for i, c in _brute_components(sets, 80).items() if i == c}
    assert want < {i for i, c in _brute_components(sets, 85).items() if i == c}
    got = corpus_pipeline.near_dedup(spark, documents(spark, texts), str(tmp_path))
    assert {r.doc_id for r in got.collect()} == want


def test_pipeline_near_dedup_leaves_no_texts(spark, tmp_path):
    """What the stage leaves in the shared folder while later ones run has no column of texts."""
    from pathlib import Path

    rng = random.Random(55)
    base = words(rng, 80, 3000)
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    got = corpus_pipeline.near_dedup(spark, documents(spark, [base, base + " more", words(rng, 80, 3000), None]), str(tmp_path))
    left = [p for p in folder.iterdir() if p not in before and p.is_dir()]
    assert left and not any("text" in spark.read.parquet(str(p)).columns for p in left)
    assert {r.doc_id for r in got.collect()} == {0, 2, 3}


def test_pipeline_repeated_rows(spark, tmp_path):
    """Equal rows leave one; an id under two texts keeps the one that is no copy."""
    rng = random.Random(53)
    one, two, three = (words(rng, 90, 3000) for _ in range(3))
    df = documents(spark, [one, one, two, three, two, None, None, "", one], ids=[7, 7, 40, 41, 41, 8, 8, 9, None])
    near = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    assert near.columns == df.columns
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    want = [(7, one), (8, None), (8, None), (9, ""), (40, two), (41, three)]
    assert [(r.doc_id, r.text) for r in sorted(near.collect(), key=key)] == want
    assert [(r.doc_id, r.text) for r in sorted(corpus_pipeline.passage_dedup(spark, near, str(tmp_path)).collect(), key=key)] == want


def test_targets_by_resharing(spark):
    """Targets against the rule as it is worded: share by weight, cut at three times the source, share the excess again."""
    rng = random.Random(71)
    for n in (1, 2, 5, 9):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(n)}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        target, free, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
        while free:
            rate = left / sum(weight[s] for s in free)
            full = {s for s in free if rate * weight[s] > 3 * sizes[s]}
            for s in full or free:
                target[s] = float(3 * sizes[s]) if full else rate * weight[s]
            left -= sum(target[s] for s in full)
            free = free - full if full else set()
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(target)


def test_mixed_rows_of_two_sources(spark):
    docs = documents(spark, ["a b c d", "a b c d", "a b c d", "e f"], ids=[1, 1, 1, 2], sources=["x", "y", None, "x"])
    got = Counter((r.doc_id, r.source) for r in mixing.mixed_rows(docs).collect())
    plan = {(r.doc_id, r._source): -(-r.taken // r["size"]) for r in mixing.mix(docs).collect() if r.taken}
    assert got == Counter(plan) and {s for _, s in got} == {"x", "y", None}


def test_pipeline_empty(spark, tmp_path):
    docs = documents(spark, ["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_queries_registered(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert shared_dir(spark)
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()


def test_rows_of_words_are_those_of_their_grams():
    from kintrace.llm import langid

    rng = random.Random(5)
    words = ["a", "ab", "ß", "हिन्दी", "𝔘𝔫", *["".join(rng.choice("abcäб𝔘") for _ in range(rng.randint(1, 9))) for _ in range(400)]]
    index = {g: i for i, g in enumerate(sorted({g for w in words[::2] for g in langid.grams(w)}))}
    scorer = langid.Scorer(langid.Model(["x"], index, np.zeros((len(index) + 1, 1), "f4"), {}))
    assert scorer.rows_of(words).tolist() == [index.get(g, len(index)) for w in words for g in langid.grams(w)]


def test_words_of_one_byte_texts_are_those_of_the_general_pattern():
    from kintrace.llm import langid

    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(chr(rng.choice([rng.randrange(256), 97, 32, 0x300 if rng.random() < 0.1 else 65])) for _ in range(25))
        assert langid.words_of(text) == langid._letters().findall(text.lower())
