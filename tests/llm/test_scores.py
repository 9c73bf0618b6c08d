"""Learned scores by held-out rows, and what they are made of by brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memloom.llm import language, perplexity, quality, queries, toxicity
from memloom.llm.common import documents

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_quality_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    found = queries.op1_quality(spark, MEDIUM).where("held_out").join(labels, "doc_id").toPandas()
    assert len(found) > 50
    assert ((found["score"] >= 0.5) == (found["quality"] == 1)).mean() > 0.95


def test_language_of_held_out_rows(spark):
    found = queries.op2_language(spark, MEDIUM).where("held_out").join(
        documents(spark, MEDIUM).select("doc_id", "lang"), "doc_id").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.98
    assert found["score"].between(0, 1).all()


def test_unseen_words_fall_back_to_shorter_units():
    model = language.Model(["aa", "bb"], [], [])
    import pyarrow as pa

    rows = []
    for lang, text in (("aa", "wolo wolo tolo"), ("bb", "kiri tiri")):
        codes, starts, ends, _ = language._words([text])
        for n in range(language.ORDER + 1):
            if n:
                padded, b, e = language._padded(codes, starts, ends)
                gram, _ = language._grams(b, e, n)
                hashes = language.span_hash(padded, gram, gram + n)
            else:
                hashes = language.span_hash(codes, starts, ends)
            rows += [(lang, n, h, c) for h, c in Counter(hashes.view(np.int64).tolist()).items()]
    model = language.build(pa.table({k: list(v) for k, v in zip(("lang", "n", "hash", "count"), zip(*rows))}))
    names, scores = model.predict(["wolo", "molo", "KIRI", "firi", "...", None, "zzz"])
    assert names[:4] == ["aa", "aa", "bb", "bb"] and names[4:6] == ["und", "und"]
    assert scores[4] == scores[5] == 0 and 0 < scores[0] <= 1


def test_toxicity_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    found = queries.op8_toxicity(spark, MEDIUM).join(labels, "doc_id").toPandas()
    insults = documents(spark, MEDIUM).select("doc_id", "text").toPandas()
    insults = set(insults[insults["text"].str.contains(r"\b(?:idiot|moron|scum)\b", regex=True)]["doc_id"])
    bad = found[found["held_out"] & (found["toxic"] == 1) & found["doc_id"].isin(insults)]
    good = found[found["held_out"] & (found["toxic"] == 0)]
    assert len(bad) and bad["predicted"].mean() > 0.9 and good["predicted"].mean() < 0.1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=24))
def test_segments_are_all_the_maximal_ones(scores):
    def maximal(a, b):  # by definition: the best run, then left and right of it
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return [*maximal(a, i), (i, j), *maximal(j, b)]

    sums = np.r_[0, np.cumsum(scores)]
    good = [i for i, x in enumerate(scores) if x > 0]
    found = toxicity.maximal_segments([float(sums[i]) for i in good], [float(sums[i + 1]) for i in good])
    expected = maximal(0, len(scores))
    assert sum(s for *_, s in found) == sum(sum(scores[i:j]) for i, j in expected)
    assert all(sum(scores[good[a]: good[b] + 1]) == s for a, b, s in found)


def test_rate_solves_its_equation():
    scores, counts = np.array([-1.0, 2.0]), np.array([90.0, 10.0])
    rate, scale = toxicity.extreme_values(scores, counts)
    assert 0.9 * np.exp(-rate) + 0.1 * np.exp(2 * rate) == pytest.approx(1) and 0 < scale <= 1


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i: i + 3])] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_rules_against_brute_force(spark):
    found = {r["doc_id"]: r for r in queries.op10_quality_rules(spark, MEDIUM).collect()}
    for row in documents(spark, MEDIUM).select("doc_id", "text").collect():
        r, (n, *rest) = found[row["doc_id"]], brute_rules(row["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n)
        assert r["kept"] == (not r["base_failed"] and r["lowest"] <= r["perplexity"] <= r["highest"])
    assert 0.7 < np.mean([r["kept"] for r in found.values()]) < 0.95


def brute_kneser_ney(texts):
    """Probability of a character after three others, by the textbook, in dictionaries."""
    counts = Counter(("   " + t)[i: i + 4] for t in texts for i in range(len(t)))
    levels = {4: counts}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discounts = {}
    for k, level in levels.items():
        n = {i: max(1, sum(c == i for c in level.values())) for i in (1, 2, 3, 4)}
        y = n[1] / (n[1] + 2 * n[2])
        discounts[k] = {i: min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(levels[1]) + 1)
        same = {g: c for g, c in levels[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        kept = {g: c - discounts[k][min(c, 3)] for g, c in same.items()}
        total = sum(same.values())
        return (kept.get(gram, 0) + (total - sum(kept.values())) * p(gram[1:])) / total

    return p


def packed(grams):
    return np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in grams], np.uint64)


def test_stored_model_is_kneser_ney(spark):
    texts = ["the cat and the hat", "a cat", "the thin cat then sat, thus that hat", "\u043a\u043e\u0442 \u0438 \u043a\u0438\u0442", "\ud55c\uad6d\uc5b4 \ud55c\uad6d"]
    docs = spark.createDataFrame([(t, "en", 0) for t in texts], "text string, model string, half int")
    table = perplexity.tables_of(perplexity.learn(perplexity.count_grams(docs)))["en", 0]
    p = brute_kneser_ney(texts)
    grams = sorted({("   " + t)[i: i + 4] for t in texts for i in range(len(t))})
    grams += ["zzzz", "thez", "thzz", "  \u043a\u043e", "cat\u043e", "\ud55c\uad6d\uc5b4\uc5b4", "hat ", "xcat"]
    assert np.allclose(table.log_probability(packed(grams)), np.log([p(g) for g in grams]), atol=1e-4)
    # what may follow a context, and one character never seen, add up to 1
    after = sorted({c for t in texts for c in t})
    for context in ("the", "  t", "zzz", "\ud55c\uad6d\uc5b4"):
        assert np.exp(table.log_probability(packed([context + c for c in [*after, "\u0416"]]))).sum() == pytest.approx(1, abs=1e-4)


def test_rare_grams_of_a_full_model_are_judged_by_shorter_ones(spark):
    texts = ["the cat and the hat", "a cat", "the thin cat then sat, thus that hat"] * 3
    docs = spark.createDataFrame([(t, "en", 0) for t in texts], "text string, model string, half int")
    table = perplexity.tables_of(perplexity.learn(perplexity.count_grams(docs), most=20))["en", 0]
    assert all(0 < len(level.grams) <= 20 for level in table.levels)
    after = sorted({c for t in texts for c in t} | {"z"})
    for context in ("the", " ca", "zzz"):
        total = np.exp(table.log_probability(packed([context + c for c in after]))).sum()
        assert total == pytest.approx(1, abs=0.02)


WORDS = {
    "ru": "дом вода город человек время работа книга дорога школа вечер утро письмо дерево солнце зима весна окно улица слово жизнь",
    "el": "σπίτι νερό πόλη άνθρωπος χρόνος δουλειά βιβλίο δρόμος σχολείο βράδυ πρωί γράμμα δέντρο ήλιος χειμώνας άνοιξη παράθυρο λέξη ζωή",
    "ar": "بيت ماء مدينة إنسان وقت عمل كتاب طريق مدرسة مساء صباح رسالة شجرة شمس شتاء ربيع نافذة شارع كلمة حياة",
    "hi": "घर पानी शहर आदमी समय काम किताब सड़क स्कूल शाम सुबह चिट्ठी पेड़ सूरज सर्दी बसंत खिड़की गली शब्द जीवन",
    "zh": "房子 河水 城市 人们 时间 工作 书本 道路 学校 晚上 早晨 书信 树木 太阳 冬天 春天 窗户 街道 词语 生活",
}


def test_random_letters_of_any_script_are_rejected(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lang, words in WORDS.items():
        words = words.split()
        letters = sorted(set("".join(words)))
        for _ in range(60):
            rows.append((len(rows), " ".join(rng.choice(words, 80)), lang, True))
        for _ in range(3):  # letters at random in words of the same lengths
            text = " ".join("".join(rng.choice(letters, len(w))) for w in rng.choice(words, 80))
            rows.append((len(rows), text, lang, False))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, prose boolean")
    found = {r["doc_id"]: r for r in perplexity.quality_rules(docs, max_repeated=100).collect()}
    assert all(found[i]["kept"] == prose for i, _, _, prose in rows)


def test_lots_of_models_give_the_same_scores(spark):
    docs = spark.createDataFrame(
        [(i, f"some words of text {i} " * 3, f"l{i % 5}") for i in range(40)] + [(40, None, "none"), (41, "", None), (42, "alone", None)],
        "doc_id long, text string, lang string")
    one, many = ({r["doc_id"]: r["log_perplexity"] for r in perplexity.measure(docs, n).collect()} for n in (1 << 30, 1))
    assert one == many and len(one) == 43 and one[40] is None and one[41] is None


def test_metadata_places_of_frequent_values():
    import pyarrow as pa

    known = [["a", None, "b"], ["x"]]
    values = [pa.array(["a", None, "b", "rare", ""]), pa.array(["x", "y", None, "x", "x"])]
    rows = quality.metadata_features(values, pa.array([0, 1, None, 2 ** 40, 7]), known)
    width = 4 + 2 + quality.STEPS
    assert rows[:, 0].tolist() == [width] * 5
    assert rows[:, 1].tolist() == [0, 1, 2, 3, 3] and rows[:, 2].tolist() == [4, 5, 5, 4, 4]
    assert (rows[:, 3] - 6).tolist() == [0, 1, 0, quality.STEPS - 1, 3]
    spread = quality._matrix("metadata", pa.array([r.tobytes() for r in rows]))
    assert spread.shape == (5, width) and (spread.sum(axis=1) == 3).all()


def test_hundreds_of_sources_tell_good_from_bad(spark):
    rows = [(i, "same words in every text", f"s{i % 200}", "en", 24) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int")
    labels = spark.createDataFrame([(i, int(i % 200 < 100)) for i in range(8000)], "doc_id long, quality int")
    found = quality.score_quality(docs, labels).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 200 < 100) for r in found)


def test_languages_of_many_grams_are_scored_by_all_of_them(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["some", "words", "of", "texts", f"own{i}", f"x{i * 7}"], 12)) for i in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(30, texts[0], "en"), (31, None, "en"), (32, "alone", "xx"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r["doc_id"]: r["log_perplexity"] for r in perplexity.measure(docs).collect()}
    for most in (0, 40):
        found = {r["doc_id"]: r["log_perplexity"] for r in perplexity.measure(docs, most=most).collect()}
        assert found.keys() == whole.keys() and found[31] is None and found[None] is None
        assert all(found[i] == pytest.approx(x, abs=1e-4) for i, x in whole.items() if x is not None)
